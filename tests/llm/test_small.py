"""Small cases of each operator against brute force, with nulls, ties, repeats, empty and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adipose.llm import decontaminate, language_model, line_dedup, near_dup, quality, sentencepiece_codec, suffix_dedup, token_counts, topk, warc

LONG = "Wort für wort and so on. " * 4000
CLASH = "digest string, row long, key long, label long, n long, a long, b long, component long, spans string, host string, rank int, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, and columns with the operators' inner names."""
    texts = [None, "", " \n\t", "one", "One two THREE four five six", "one two three four five six", LONG, LONG + "end", "tie tie tie tie tie tie tie", "a\n\nb\na", "<|endoftext|> é　x", "one"]
    rows = [(k, t, "en", "s" if k % 3 else None, None, *["x", 1, 2, 3, 4, 5, 6, 7, "y", "z", 8, 0.5]) for k, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, *["x", 1, 2, 3, 4, 5, 6, 7, "y", "z", 8, 0.5]), (None, "no id at all", None, "s", 1, *["x", 1, 2, 3, 4, 5, 6, 7, "y", "z", 8, 0.5])]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# --- 1


def _labelled(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
    rows = []
    for k in range(240):
        good = k % 3 > 0
        rows.append((k, " ".join(word() for _ in range(60)) + "." if good else " ".join([word().upper() + "!!"] * 40), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_against_plain_formulas(spark):
    data = _labelled(spark)
    labels = data.select("doc_id", "quality", F.lit(0).alias("toxic"))
    got = {r.doc_id: r for r in quality.quality(data.drop("quality"), labels).collect()}
    rows = data.collect()
    x = {r.doc_id: quality.statistics(pa.array([r.text]))[0] for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    groups = {c: np.array([x[r.doc_id] for r in rows if r.quality == c and not held[r.doc_id]]) for c in (0, 1)}
    total = sum(map(len, groups.values()))
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups.values()) / total
    density = {}
    for c, g in groups.items():
        s = (1 - quality.POOLED) * np.cov(g.T, bias=True) + quality.POOLED * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * (np.trace(s) / quality.D + 1e-9) * np.eye(quality.D)
        inverse, logdet = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[c] = lambda v, g=g, inverse=inverse, logdet=logdet: math.log(len(g) / total) - 0.5 * logdet - 0.5 * (v - g.mean(0)) @ inverse @ (v - g.mean(0))
    for r in rows:
        odds = density[1](x[r.doc_id]) - density[0](x[r.doc_id])
        assert got[r.doc_id].score == pytest.approx(0.5 + 0.5 * odds / (1 + abs(odds)), abs=1e-6)
        assert got[r.doc_id].held_out == held[r.doc_id] and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
    wrong = [r for r in rows if held[r.doc_id] and got[r.doc_id].predicted != r.quality]
    assert len(wrong) <= 2


def test_quality_of_odd_tables(spark, odd, none):
    labels = _labelled(spark).select("doc_id", "quality")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality.quality(none, labels).count() == 0
    assert {r.score for r in quality.quality(odd, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.quality(odd, odd.select("doc_id", F.lit(1).alias("quality"))).collect()} == {1.0}
    kept = quality.keep_good(odd, labels.where("false"))
    assert kept.schema == odd.schema and kept.count() == odd.count()


# --- 2


def _distance(pattern, text):
    col = list(range(len(pattern) + 1))
    best = len(pattern)
    for c in text:
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(col[i - 1] + (pattern[i - 1] != c), col[i] + 1, new[i - 1] + 1))
        col, best = new, min(best, new[-1])
    return best


def test_edit_matches_against_dynamic_programming(spark):
    r = random.Random(3)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 7)))
    items = [(k, " ".join(word("abcdé") for _ in range(r.randint(4, 30)))) for k in range(12)]
    docs = []
    for k in range(60):
        _, x = r.choice(items)
        y = list(decontaminate.normal(x))
        for _ in range(r.randint(0, decontaminate.budget(len(y)) + 2)):
            y[r.randrange(len(y))] = r.choice(["", "z", "qq"])
        docs.append((k, " ".join([word("abcdé") for _ in range(20)] + ["".join(y).upper()] + [word("abcdé") for _ in range(20)])))
    docs += [(60, ""), (61, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (90, ""), (91, None)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.matches(d, b).collect()}
    want = {}
    for k, t in docs:
        for i, x in items:
            p = decontaminate.normal(x)
            n = _distance(p, decontaminate.normal(t))
            if n <= decontaminate.budget(len(p)):
                want[k, i] = n
    assert got == want and len(want) > 20
    hit = {k for k, _ in want}
    assert sorted(x.doc_id for x in decontaminate.drop_contaminated(d, b).collect()) == [k for k, _ in docs if k not in hit]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"some text {k} about item number {k % 5} of the list of things") for k in range(20)], "doc_id long, text string")
    b = spark.createDataFrame([(k, f"text {k} about item number {k} of the list") for k in range(5)], "item_id long, text string")
    whole = sorted(decontaminate.matches(d, b).collect())
    clean = sorted(decontaminate.drop_contaminated(d, b).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 100)
    assert sorted(decontaminate.matches(d, b).collect()) == whole
    assert sorted(decontaminate.drop_contaminated(d, b).collect()) == clean


def test_decontamination_of_odd_tables(spark, odd, none):
    b = spark.createDataFrame([(1, "One two three four five six"), (2, None), (None, "no id at all")], "item_id long, text string")
    assert sorted((x.doc_id or -1, x.item_id or -1) for x in decontaminate.matches(odd, b).collect()) == [(-1, -1), (4, 1), (5, 1)]
    kept = decontaminate.drop_contaminated(odd, b)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert decontaminate.drop_contaminated(odd, b.where("false")).count() == odd.count()
    assert decontaminate.matches(none, b).count() == 0


# --- 3


def test_archives_round_trip(spark, tmp_path):
    body = "<html>\r\n\r\nWARC/1.1\r\n" + "ä" * 100
    pages = [(5, "http://x/a b", body), (3, None, body), (9, "http://y", body), (3, None, body), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", body), (-4, "u", "other " * 40)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, refers_to long")
    for compression in ("gzip", "none"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_archives(frame, path, compression=compression)
        rows = warc.read_archives(spark, path).collect()
        assert len(rows) == len(pages)
        got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest, r.payload) for r in rows)
        want = []
        for k, _, t in pages:
            raw = (t or "").encode()
            again = raw == body.encode() and k not in (3, None)
            want.append((k is None, k or 0, "revisit" if again else "response", 3 if again else 0, len(raw), hashlib.sha256(raw).hexdigest(), None if again else raw))
        assert got == sorted(want, key=lambda x: x[:6])
    assert warc.rewrite(frame.where("false")).count() == 0


# --- 4


def test_token_counts_against_the_library(spark, odd, none, tmp_path, monkeypatch):
    shared_by_ids = token_counts.by_ids
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_counts.tokenizer_path())
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all are in the cache
        rows = token_counts.token_counts(odd, cache=cache).collect()
        want = sorted((k is None, k or 0, len((t or "").encode()), n := len(encoder.encode(t or "", add_special_tokens=False)), n > 1024) for k, t in texts_of(odd))
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts_of(odd)})
    # what is cached is not encoded again, and its text is not moved
    more = spark.createDataFrame([(1, "one"), (2, "new words")], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(token_counts, "by_ids", lambda rows, ids, key, how="left_semi": asked.append(sorted(map(tuple, ids.collect()))) or shared_by_ids(rows, ids, key, how))
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(more, cache=cache).collect()) == [(k, len(encoder.encode(t, add_special_tokens=False))) for k, t in ((1, "one"), (2, "new words"))]
    assert asked[0] == [(2,)] and asked[1] == []
    assert token_counts.token_counts(none).count() == 0


def test_pieces_count_as_the_whole():
    from tokenizers import Tokenizer

    encoder, r = Tokenizer.from_file(token_counts.tokenizer_path()), random.Random(5)
    texts = ["".join(r.choice("ab  \n\t'st'rE19.!é　<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += [f"a{x}<|endoftext|>{y}b" for x in ("", " ", "  ") for y in ("", " ", "  ")]
    assert token_counts.counter(token_counts.tokenizer_path())(texts) == [len(encoder.encode(t, add_special_tokens=False)) for t in texts]


# --- 5


def _sets(rows):
    out = {}
    for k, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def _components(sets, percent):
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([4, 7, 30, 150]))]
        for _ in range(r.randint(1, 14)):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(x)))
    rows += [(2000, ""), (2001, None), (2002, " \t "), (2003, "one"), (2004, "ONE")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = _sets(rows)
    assert _components(sets, 85) != _components(sets, near_dup.PERCENT)
    for block, percent in ((512, 85), (3, 85), (512, near_dup.PERCENT), (3, near_dup.PERCENT)):
        want = _components(sets, percent)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = (near_dup.near_duplicates(frame) if percent == near_dup.PERCENT else near_dup.near_duplicates(frame, percent)).collect()
        assert {x.doc_id: x.component_id for x in got} == want
        assert all(x.n_shingles == len(sets[x.doc_id]) and x.kept == (x.doc_id == x.component_id) for x in got)


def test_estimates_and_bands(spark):
    r = np.random.default_rng(1)
    pool = r.permutation(np.unique(r.integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2)))
    a, b = np.sort(pool[:4000]), np.sort(pool[500:4500])
    regs = near_dup.registers([a, b])
    est, count = near_dup.estimate(regs[:1], regs[1:], np.array([4000]), np.array([4000]))
    assert abs(est[0] - 3500 / 4500) < 0.15 and count[0] == near_dup.BUCKETS
    small = near_dup.registers([a[:3], a[:3], np.empty(0, np.uint64)])
    keys = near_dup.band_keys(small[:2])
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == near_dup.BANDS


def test_bands_follow_the_threshold():
    assert near_dup.PERCENT == 80 and near_dup.banding(80) == (32, 4) and near_dup.banding(85) == (25, 5)
    for percent in range(11, 101):
        bands, rows = near_dup.banding(percent)
        assert bands * rows <= near_dup.BUCKETS and (1 - (percent / 100) ** rows) ** bands <= near_dup.MISS
        assert near_dup.band_keys(np.ones((2, near_dup.BUCKETS), np.uint16), percent).shape == (2, bands)


def test_near_duplicates_of_odd_tables(spark, odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert got[None] == (None, True) and got[11] == (3, False) and got[5] == (4, False) and got[0] == (0, True) and got[1] == (1, True)
    assert near_dup.near_duplicates(none).count() == 0


def test_ids_by_broadcast_and_by_bitmap(spark, monkeypatch):
    from adipose.llm import shared

    rows = spark.createDataFrame([(k if k % 50 else None, f"text {k}") for k in range(3000)], "id long, text string").repartition(5)
    ids = spark.createDataFrame([(k,) for k in range(7, 5000, 11)], "id long")
    for bits in (1 << 27, 1 << 15):
        monkeypatch.setattr(shared, "BITMAP_BITS", bits)
        for how in ("left_semi", "left_anti"):
            results = []
            for most in (10**6, 1):
                monkeypatch.setattr(shared, "BROADCAST_IDS", most)
                found = shared.by_ids(rows, ids, "id", how)
                assert found.columns == rows.columns
                results.append(sorted(r.text for r in found.collect()))
            assert results[0] == results[1] == sorted(f"text {k}" for k in range(3000) if (k % 50 > 0 and k >= 7 and (k - 7) % 11 == 0) == (how == "left_semi"))


# --- 6


def test_top_k_against_all_products(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=4).round(2).tolist()) for k in range(120)]
    rows += [(200 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(30)]  # ties
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (350, [1.0, 2.0]), (400, [1.0, 3.0]), (450, [3e6, -3e6, 1.0, 2.0]), (550, [3e6, 1e6, 1.0, 2.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, tile int, cell int")
    good = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), k) for k, b in good if k != q and len(a) == len(b))[:5]
            want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    for tile, shard in ((2048, 4096), (2, 16)):
        monkeypatch.setattr(topk, "TILE_ROWS", tile)
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        got = topk.top_k(frame, F.pmod("vec_id", F.lit(50)) == 0).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.where("false"), F.lit(True)).count() == 0


# --- 7


def test_boilerplate_lines(spark, odd, none):
    rows = [(k, "h1", f"menu\ntext {k}\nmenu\n\nfoot{k % 2}") for k in range(10)] + [(20, "h2", "menu\nx"), (21, None, "menu\nx"), (22, "h1", None), (23, "h1", "")]
    frame = spark.createDataFrame([(*x, "x", "y") for x in rows], "doc_id long, source string, text string, line string, lines string")
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.drop_boilerplate(frame, ratio=0.5, least_pages=3, removed="gone").collect()}
    assert got[0] == ("text 0\n\nfoot0", 2) and got[20] == ("menu\nx", 0) and got[21] == ("menu\nx", 0) and got[22] == (None, 0) and got[23] == ("", 0)
    kept = line_dedup.drop_boilerplate(odd)
    assert kept.schema.names == odd.schema.names and kept.count() == odd.count()
    assert line_dedup.drop_boilerplate(none).count() == 0


# --- 8


def _spans(docs, length):
    seen = collections.Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        m = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                m[i : i + length] = True
        m = m[: len(d)]
        runs = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(m.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~m])))
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_repeats_against_all_windows(spark, monkeypatch, block):
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    base = [make(r.randint(0, 120)) for _ in range(15)]
    docs = ["".join(r.choice(base) if r.random() < 0.5 else make(r.randint(0, 40)) for _ in range(4)) for _ in range(80)]
    docs += ["", "ab" * 60, "xxx" * 40, docs[3], docs[3], None]
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(docs)], "doc_id long, text string, anchor string, row int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.drop_repeats(frame, 40, 20).collect()}
    assert got == dict(enumerate(_spans([(t or "").encode() for t in docs], 40)))


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(3)
    x = r.integers(97, 99, 2000).astype(np.uint8)
    x[500:900], x[1500:1800] = x[1000:1400], 97
    raw, order = x.tobytes(), suffix_dedup.suffix_array(x, 64)
    assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(len(raw)))
    lcp = suffix_dedup.common_prefixes(x, order, 64)
    for a, b in zip(order[:-1], order[1:]):
        n = 0
        while n < 64 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == n


def test_stretches_that_part_after_the_sorted_bytes():
    # pairs share more bytes than the suffix array's order covers, then part
    r = random.Random(21)
    make = lambda n: "".join(r.choice("ab") for _ in range(n)).encode()
    bodies = []
    for k in range(120):
        shared = make(512 + k % 80)
        bodies += [shared + make(599 - len(shared)), shared + make(599 - len(shared))]
    r.shuffle(bodies)
    windows = np.full(len(bodies), 200)
    seen = collections.Counter(b[i : i + 400] for b in bodies for i in range(200))
    want = [(k, i) for k, b in enumerate(bodies) for i in range(200) if seen[b[i : i + 400]] > 1]
    got = suffix_dedup.repeated_windows(bodies, windows, np.zeros(len(bodies), np.int64), 400)
    assert list(zip(*(x.tolist() for x in got))) == want
    text, _, _ = suffix_dedup._concatenated(bodies, windows, 400)
    raw, order = text.tobytes(), suffix_dedup.suffix_array(text, 400)
    lcp = suffix_dedup.common_prefixes(text, order, 400)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        x, y = raw[a : a + 400], raw[b : b + 400]
        assert lcp[b] == next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))


def test_repeats_of_odd_tables(odd, none):
    rows = suffix_dedup.drop_repeats(odd).collect()
    assert len(rows) == odd.count()
    texts = [(k, (t or "").encode()) for k, t in texts_of(odd)]
    want = sorted(((k is None, k or 0, *s[:3]) for (k, _), s in zip(texts, _spans([t for _, t in texts], 400))))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == want
    assert suffix_dedup.drop_repeats(none).count() == 0


def test_many_copies_and_long_runs(spark, monkeypatch):
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    long, part = make(3000), make(90)
    docs = [long] * 5 + [long[:1500] + make(20) + long[1400:], part * 4, part + make(30) + part + "x" + part, make(10) + part, long[700:2200], ""]
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", 100)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.drop_repeats(frame, 40, 20).collect()}
    assert got == dict(enumerate(_spans([t.encode() for t in docs], 40)))


def test_stretches_with_one_digest_stop_the_job():
    pdf = pd.DataFrame({"row": [1, 2], "first": [0, 0], "windows": [5, 5], "cell": [4, 4], "block": [0, 0], "sure": [True, True], "run": [True, True], "body": [b"abcdefghijkl", b"abcdefghijkx"]})
    for run in (True, False):
        with pytest.raises(ValueError, match="digest"):
            suffix_dedup._shard(8)((0, 0, 0), pdf.assign(run=run))
        assert suffix_dedup._shard(8)((0, 0, 0), pdf.assign(run=run, body=[b"abcdefghijkl"] * 2))[["row", "lo", "hi"]].values.tolist() == [[1, 0, 12], [2, 0, 12]]


def test_shared_passages_against_all_windows(spark, odd):
    r = random.Random(10)
    make = lambda n: [r.choice("abcdefgh") + r.choice("xyz") for _ in range(n)]
    base = [make(r.choice([9, 10, 11, 14, 30])) for _ in range(10)]
    docs = [r.choice([" ", "\n "]).join(w for _ in range(3) for w in (r.choice(base) if r.random() < 0.5 else make(r.randint(0, 12)))) for _ in range(60)]
    docs += [docs[0], docs[0].upper(), " ".join(make(25) * 2), "", None]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for n in (10, 50):
        words = [re.findall(r"[^ \t-\r]+", (t or "").lower()) for t in docs]
        windows = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in words]
        on = collections.Counter(x for w in windows for x in set(w))
        want = {k: sum(on[x] > 1 for x in w) for k, w in enumerate(windows)}
        got = {x.doc_id: x.n_shared_windows for x in suffix_dedup.drop_repeats(frame, passage=n).collect()}
        assert got == want and any(want.values())
    assert suffix_dedup.drop_repeats(odd, passage=50).count() == odd.count()


# --- 9


def test_pieces_against_the_library(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    encoded = sentencepiece_codec.encode(odd, keep=("doc_id", "row"))
    want = sorted((k is None, k or 0, model.encode(t or "")) for k, t in texts_of(odd))
    rows = encoded.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows) == want and all(r.n_pieces == len(r.ids) for r in rows)
    back = sentencepiece_codec.decode(encoded, keep=("doc_id",)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((k is None, k or 0, t or "") for k, t in texts_of(odd))
    assert sentencepiece_codec.round_trip(none).count() == 0


def test_random_texts_against_the_library():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    model, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    texts = ["".join(r.choice(" ▁abcdethe  \n\t\0éñ①ﬁ<s></s><0x41>日本語🙂") for _ in range(r.randint(0, 50))) for _ in range(600)]
    got = [np.frombuffer(x, "<i4").tolist() for x in sentencepiece_codec.encoder(path)(texts)]
    assert got == [model.encode(t) for t in texts]
    assert [sentencepiece_codec.decode_ids(x, sentencepiece_codec.pieces(path)) for x in got] == [model.decode(x) for x in got]


# --- 10


def test_scores_against_plain_counts(spark, monkeypatch):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcXYé") for _ in range(3)) for _ in range(40)]
    rows = [(k, r.choice([" ", "\n"]).join(r.choice(vocabulary[: r.choice([3, 40])]) for _ in range(r.randint(0, 30)))) for k in range(150)] + [(200, None), (201, "unseen words here")]
    for name, size in (("BLOCK_BYTES", 2000), ("SHARD_PAIRS", 300), ("SHARD_WORDS", 60), ("HOT_SHARE", 20)):
        monkeypatch.setattr(language_model, name, size)
    got = {x.doc_id: x for x in language_model.score(spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, block string, shard int")).collect()}
    tokens = {k: [w.lower() for w in (t or "").encode().split()] + [None] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    ones, pairs = collections.Counter(), collections.Counter()
    for k, w in tokens.items():
        if not held[k]:
            ones.update(w)
            pairs.update(zip([None, *w], w))
    n, v, followers, d = sum(ones.values()), len(ones), collections.Counter(a for a, _ in pairs), language_model.DISCOUNT
    steps = lambda x, n: 10 ** (round(math.log10(x) * n) / n)
    assert sum(c > language_model.hot_least(n) for c in ones.values()) > 2  # some contexts are split
    for k, w in tokens.items():
        base = [math.log10((ones[x] + 1) / (n + v + 1)) for x in w]
        total = 0.0
        for a, x, u in zip([None, *w], w, base):
            if ones[a]:
                seen = steps((pairs[a, x] - d) / ones[a], language_model.STEPS) if pairs[a, x] else 0
                weight = d * followers[a] / ones[a]
                if ones[a] < language_model.hot_least(n):
                    weight = steps(weight, language_model.WEIGHT_STEPS)
                total += math.log10(min(1, seen + weight * 10**u))
            else:
                total += u
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(w), sum(y in ones for y in w), n)
        assert x.base_score == pytest.approx(sum(base)) and x.score == pytest.approx(total, rel=1e-6)


def test_large_counts_do_not_saturate():
    count = np.array([1, 10**7, 17 * 10**7, 6 * 10**9, 2**40])
    follower, d = np.arange(10).astype(np.uint64), language_model.DISCOUNT
    for some in (2, 5):
        # each context has a pair of that count and another of one
        counts, context = np.stack([count[:some], np.ones(some, np.int64)], axis=1).ravel(), np.repeat(np.arange(some), 2).astype(np.uint64)
        trie = language_model.Trie(language_model.Trie.levels(context, follower[: 2 * some], counts, d))
        code, weight, followers = trie.find(np.append(context[::2], 99).astype(np.uint64), np.append(np.full(some, 2), 0), follower[: 2 * some])
        want = (counts - d) / np.repeat(count[:some] + 1, 2)
        assert (np.abs((1 - code.astype(float)) / language_model.STEPS - np.log10(want)) <= 0.5 / language_model.STEPS + 1e-9).all()
        assert (np.abs((1 - weight[:-1].astype(float)) / language_model.WEIGHT_STEPS - np.log10(2 * d / (count[:some] + 1))) <= 0.5 / language_model.WEIGHT_STEPS + 1e-9).all()
        assert followers.tolist() == [2] * some + [0] and weight[-1] == 0
    assert trie.find(context[:1], np.array([3]), np.array([0, 2, 77], np.uint64))[0].tolist()[1:] == [0, 0]
    assert (language_model._unpack(language_model._pack(count)) == count).all()
    words = np.array([7, 9], np.uint64).tobytes()
    pieces = pd.DataFrame({"block": [1, 2], "words": [words, words], "counts": [language_model._pack(np.array([3 * 10**9, 1]))] * 2})
    answers = language_model._add_words(10**12)((0,), pieces)
    assert all(language_model._unpack(x).tolist() == [6 * 10**9, 2] for x in answers["codes"][:2])


def test_scores_do_not_depend_on_hot_words(spark, monkeypatch):
    words = [f"w{k}" for k in range(1400)]
    rows = [(1, " ".join(words), False), (2, " ".join(random.Random(2).sample(words, 600)), True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = lambda: {r.doc_id: r.score for r in language_model.score(frame, held=F.col("held")).collect()}
    got = score()
    monkeypatch.setattr(language_model, "HOT_SHARE", 1)
    assert got == pytest.approx(score()) and all(map(math.isfinite, got.values()))
    monkeypatch.setattr(language_model, "HOT_SHARE", 10**6)
    for pairs in (700, 40, 1):  # from no split context to every one, in as many parts as it has tokens
        monkeypatch.setattr(language_model, "SHARD_PAIRS", pairs)
        assert got == pytest.approx(score(), rel=1e-4)


def test_scores_of_a_few_thousand_tokens(spark):
    r = random.Random(12)
    rows = [(k, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 60)))) for k in range(90)]
    got = {x.doc_id: x.score for x in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {k: [*t.split(), None] for k, t in rows}
    train = [w for k, w in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    ones, pairs, d = collections.Counter(x for w in train for x in w), collections.Counter(p for w in train for p in zip([None, *w], w)), language_model.DISCOUNT
    n, followers = sum(ones.values()), collections.Counter(a for a, _ in pairs)
    assert 1000 < n < 3000
    for k, w in tokens.items():
        p = [(ones[x] + 1) / (n + len(ones) + 1) for x in w]
        p = [(max(pairs[a, x] - d, 0) + d * followers[a] * u) / ones[a] if ones[a] else u for a, x, u in zip([None, *w], w, p)]
        assert abs(got[k] - sum(map(math.log10, p))) <= len(w) * (0.5 / language_model.STEPS + 0.5 / language_model.WEIGHT_STEPS)


def test_elias_fano():
    from adipose.llm.elias_fano import EliasFano

    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 2**62), (1, 1), (1000, 2**60), (5000, 6000), (300, 300)):
        x = np.sort(r.integers(0, top, n)).astype(np.uint64)
        form, _ = EliasFano.from_buffer(EliasFano.of(x).to_bytes())
        assert (form.get(np.arange(n)) == x).all()
        asked = np.concatenate([x, r.integers(0, top, 200).astype(np.uint64), x + np.uint64(1)])
        assert (form.successor(asked) == np.searchsorted(x, asked)).all()


def test_scores_of_odd_tables(odd, none):
    rows = language_model.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows) and {r.doc_id for r in rows} == {k for k, _ in texts_of(odd)}
    assert language_model.score(none).count() == 0
    alone = language_model.score(odd, held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0.0 for r in alone)
