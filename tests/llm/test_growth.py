"""What operators send grows with their rows, not with the pairs of a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from adipose.llm import decontaminate, shared, suffix_dedup, topk
from test_small import _spans


def _texts(kind, n, seed=5):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    short, long = make(300), make(450)
    if kind == "footer":  # 300 equal bytes and no 400
        return [make(150) + short + make(150) for _ in range(n)]
    if kind == "passage":  # one passage between different texts
        return [make(60) + long + make(60) for _ in range(n)]
    # shorter and longer parts of one passage, whole copies among them
    return [make(40) + long[a : a + r.choice([399, 400, 420])] + make(40) if a else long for a in (r.choice([0, 3, 9, 30]) for _ in range(n))]


@pytest.fixture
def sent(monkeypatch):
    """Rows that reach the shards, a run."""
    seen = []

    def stored(df, name):
        out = shared.stored(df, name)
        if name == "sent-stretches":
            seen.append(out.agg(F.coalesce(F.sum(F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.col("blocks")).otherwise(1)), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    return seen


@pytest.mark.parametrize("kind", ["footer", "passage", "parts"])
def test_hot_anchors_are_linear(spark, monkeypatch, sent, kind):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    for n in (128, 256, 512):
        docs = _texts(kind, n)
        frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.drop_repeats(frame).collect()}
        assert got == dict(enumerate(_spans([t.encode() for t in docs], 400)))
    one, two, four = sent
    assert two <= 2.6 * one + 50 and four <= 2.6 * two + 50 and four <= 8 * 512
    if kind == "footer":
        # only stretches of anchors that are not split, of 16 at most, are sent unasked
        assert four < 512 // 8


def test_blocks_of_items_take_rows_off_once(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"text {k} about item number {k} of the list") for k in range(5)] + [(9, None)], "item_id long, text string")
    texts = [f"some text {k % 9} about item number {k % 9} of the list of things" for k in range(30)] + ["", None, None, "text of its own"]
    docs = spark.createDataFrame([(None if k % 4 == 0 else k // 2, t, "x", k) for k, t in enumerate(texts)], "doc_id long, body string, text_digest string, n int")
    clean = sorted(decontaminate.drop_contaminated(docs, items, text="body").collect(), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", 100)
    for most in (200_000, 0):
        monkeypatch.setattr(shared, "BROADCAST_IDS", most)
        kept = decontaminate.drop_contaminated(docs, items, text="body")
        assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == clean
    assert 0 < len(clean) < len(texts)
    assert decontaminate.drop_contaminated(docs.where("false"), items, text="body").count() == 0


def test_copies_of_queries_do_not_meet_in_the_driver(spark):
    # Spark knows the size of the queries before a copy a shard group is made, so it took the copies for small
    frame = spark.createDataFrame([(k, [float(k % 7), float(k % 11)]) for k in range(300)], "vec_id long, embedding array<float>")
    found = topk.top_k(frame, F.pmod("vec_id", F.lit(50)) == 0)
    assert len(found.collect()) == 6 * 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
