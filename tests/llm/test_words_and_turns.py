"""Byte-level BPE, spelling variants and conversation repair against plain versions; semi and anti joins by ids."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from adipose.llm import byte_bpe, conversation_repair, queries, sentencepiece_codec, shared, spelling_variants
from compare import SMALL

CLASH = "word string, n long, pos long, token long, shard int, member boolean, gone boolean, later boolean, best string"
CLASHED = ["x", 1, 2, 3, 4, True, False, True, "y"]


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.ranks_path()), special_tokens={})


def _bpe_row(library, doc_id, text):
    text = text or ""
    ids = np.array(library.encode_ordinary(text), "<u4")
    return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_byte_bpe(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(rows_of(got)) == sorted(_bpe_row(library, *r) for r in docs)


def test_byte_bpe_of_odd_tables(spark, library):
    r = random.Random(2)
    texts = [None, "", " ", "  a", "one", "one", "<|endoftext|>", "it's\r\n\t 12345 é日本語 \U0001f600́", "aaaa" * 900, "x" * 100_000, "ab c " * 20_000]
    texts += ["".join(r.choice("abth e'1\n.é日") for _ in range(r.randint(1, 80))) for _ in range(200)]
    rows = [(k if k != 4 else None, t, *CLASHED) for k, t in enumerate(texts)]
    odd = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)
    key = lambda t: (t[0] is None, t)
    assert sorted(rows_of(byte_bpe.round_trip(odd)), key=key) == sorted((_bpe_row(library, *r[:2]) for r in rows), key=key)
    assert rows_of(byte_bpe.round_trip(odd.where("false"))) == []
    back = byte_bpe.decode(byte_bpe.encode(odd, keep=("doc_id", "text")), keep=("doc_id",))
    assert sorted(rows_of(back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_long_words_are_contracted_alike(library):
    path, r = byte_bpe.ranks_path(), random.Random(4)
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "日本é"):
        words = ["".join(r.choice(letters) for _ in range(r.randint(2, 300))).encode() for _ in range(40)]
        assert [byte_bpe.contract_long(w, path) for w in words] == byte_bpe.contract_words(words, path)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert np.frombuffer(byte_bpe.encoder(path)([long])[0], "<u4").tolist() == library.encode_ordinary(long)


# --- spelling variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _plain_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in words}
    gaps = collections.defaultdict(set)  # words that are equal when one place is left out are near, or equal but for it
    for w in words:
        gaps[w].add(w)
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :]].add(w)
    for group in gaps.values():
        for a in group:
            near[a] += [b for b in group if _near(a, b)]
    form = {}
    for w, found in near.items():
        best = min(set(found), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(set(near[w])), words.get(form[w])))
    return sorted(out)


def test_spelling_variants_query_against_gaps(spark):
    docs = rows_of(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    got = queries.op11_spelling_variants(spark, SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(rows_of(got), key=lambda t: t[0]) == _plain_variants(docs)


@pytest.mark.parametrize("shard", [7, 40, 100_000])
def test_spelling_variants_in_many_shards_and_blocks(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling_variants, "SHARD", shard)
    monkeypatch.setattr(spelling_variants, "BLOCK", shard)
    r = random.Random(shard)
    word = lambda: "".join(r.choice("abÿ") for _ in range(r.randint(7, 9)))
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(40)]
    rows += [(100 + k, "testing " * 10**k + "tasting " * 2 * 10 ** (k > 2) + "teksting") for k in range(4)]
    got = spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(rows_of(got), key=lambda t: t[0]) == _plain_variants(rows)


def test_spelling_variants_of_odd_tables(spark):
    long = "q" * 50_000
    texts = [None, "", "1 2 3", "ABCdefg ABCdefg abcdefgh abcdefgh", "×÷ÀÉÿÿÿ ×÷ÀÉÿÿÿ ×÷Àéÿÿÿ", f"{long} {long} {long}q {long}q", "ÿÿÿÿÿÿÿ " * 3 + "ÿÿÿÿÿÿÿÿ " * 30]
    rows = [(k if k != 3 else None, t, *CLASHED) for k, t in enumerate(texts)]
    rows += [rows[3], rows[6]]
    odd = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)
    assert sorted(rows_of(spelling_variants.variants(odd)), key=lambda t: t[0]) == _plain_variants([r[:2] for r in rows])
    assert rows_of(spelling_variants.variants(odd.where("false"))) == []


# --- conversation repair


def _plain_repair(rows):
    """Damage, faults and the cheapest edits of one conversation by trying what keeps the cost least, with whole audits and texts."""
    kept = []
    for conv, turn, role, text in rows:
        of = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{of(conv)}:{of(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else of(role), {1: "", 2: re.sub("[.!?]", "", of(text))}.get(kind, of(text))
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, facts = set(), []
    for _, role, text in kept:
        body = text.strip(" \t\n\v\f\r")
        facts.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def inserts(tops):
        for _ in range(4):
            for state, (cost, audit, out) in list(tops.items()):
                for x in fits[state].replace("s", ""):
                    put(tops, x, (cost + 2, audit + "I", (*out, {"u": "user:", "a": "assistant:"}[x])))
        return tops

    best = inserts(best)
    for (_, role, text), fact in zip(kept, facts):
        after = {}
        for state, (cost, audit, out) in best.items():
            put(after, state, (cost + 3, audit + "D", out))
            if fact not in ("blank", "duplicate"):
                more = int(fact == "truncated")
                if role[:1] and role[0] in fits[state]:
                    put(after, role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for x in fits[state].replace("s", ""):
                    put(after, x, (cost + 2 + more, audit + "R", (*out, f"{ {'u': 'user', 'a': 'assistant'}[x] }:{text}")))
        best = inserts(after)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in kept if t is not None]
    initials = [r[:1] for _, r, _ in kept]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [facts.count(x) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return rows[0][0], gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _repairs(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return sorted(map(_plain_repair, groups.values()), key=repr)


def test_conversation_repair_query_against_plain_search(spark):
    rows = rows_of(spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    got = queries.op13_conversation_repair(spark, SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(rows_of(got), key=repr) == _repairs(rows)


@pytest.mark.parametrize("block", [2, 1024])
def test_conversation_repair_of_random_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    r = random.Random(block)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unit"], ["Yes.", "No!", "maybe", "", " \n", None, "a.b", "é?", "Yes. "]
    rows = [(k % 150 if k % 50 else None, r.choice([None, *range(9)]), r.choice(roles[: r.choice([3, 7])]), r.choice(texts), *CLASHED) for k in range(1500)]
    rows += [(900, k, "user", "same." if k % 2 else f"{k}.", *CLASHED) for k in range(600)] + [(901, None, None, None, *CLASHED)] * 3 + [(902, 0, "user", "x" * 300_000 + ".", *CLASHED)]
    rows += [(1000 + k, 0, "user", "gone?", *CLASHED) for k in range(60)]
    rows += [(2000 + k, r.randint(-5, 5), "assistant", "once.", *CLASHED) for k in range(60) for _ in range(2)]
    odd = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, {CLASH}").repartition(3)
    assert sorted(rows_of(conversation_repair.repair(odd)), key=repr) == _repairs([x[:4] for x in rows])
    assert rows_of(conversation_repair.repair(odd.where("false"))) == []
    assert any(x[7:] == ("", hashlib.sha256().hexdigest()) for x in _repairs([x[:4] for x in rows]))


# --- joins by ids


def test_null_keys_by_bitmap_as_by_broadcast(spark, monkeypatch):
    """An id whose hash has the bit that a null key's hash has."""
    null_bit = spark.range(1).select(F.pmod(F.xxhash64(F.lit(None).cast("long")), F.lit(shared._BUCKET))).first()[0]
    hit = spark.range(400_000).where(F.pmod(F.xxhash64("id"), F.lit(shared._BUCKET)) == null_bit).first()[0]
    rows = spark.createDataFrame([(hit, "hit"), (-7, "a"), (-8, "b"), (None, "n1"), (None, "n2")], "doc_id long, text string")
    for ids in ([(hit,)], [(hit,), (None,)]):
        frame = shared.stored(spark.createDataFrame(ids, "doc_id long"), "test-ids")
        for how, want in (("left_semi", ["hit"]), ("left_anti", ["a", "b", "n1", "n2"])):
            for bound in (200_000, 0):
                monkeypatch.setattr(shared, "BROADCAST_IDS", bound)
                assert sorted(r.text for r in shared.by_ids(rows, frame, "doc_id", how).collect()) == want


def test_near_dedup_stage_keeps_rows_without_id_by_bitmap(spark, monkeypatch):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(42, text), (43, text), (7, "other words " * 9), (None, text), (None, "no id here")], "doc_id long, text string")
    for bound in (200_000, 0):
        monkeypatch.setattr(shared, "BROADCAST_IDS", bound)
        assert sorted(r.doc_id or -1 for r in corpus_pipeline.near_deduplication(spark, rows, SMALL).collect()) == [-1, -1, 7, 42]


# --- long cuts of the SentencePiece encoder


def test_a_million_letters_without_a_space(monkeypatch):
    import sentencepiece

    path, r = sentencepiece_codec.model_path(), random.Random(8)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encode = sentencepiece_codec.encoder(path)
    ids = lambda texts: [np.frombuffer(x, "<i4").tolist() for x in encode(texts)]
    long = ["".join(r.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("aaab", 30_000), ("日本語のé", 20_000), ("the", 1_001), ("the", 1_000))]
    texts = [*long, f"some words {long[1]} more  {long[3]}\n", "a short one"]
    assert ids(texts) == library.encode(texts)
    monkeypatch.setattr(sentencepiece_codec, "LONG_CUT", 5)
    mixed = ["".join(r.choice("abthe r\n.é日▁") for _ in range(r.randint(1, 120))) for _ in range(300)]
    sentencepiece_codec.encoder.cache_clear()
    encode = sentencepiece_codec.encoder(path)
    assert ids(mixed) == library.encode(mixed)
    sentencepiece_codec.encoder.cache_clear()
