"""The registered queries against SQL, and the pipeline against plain versions of its stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from adipose.llm import decontaminate, line_dedup, quality, queries, sentencepiece_codec
from compare import SMALL, same
from test_small import _components, _sets


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SMALL)


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    model = quality.fit(quality.features(docs), labels)
    scores = model.scores(np.concatenate([quality.statistics(pa.array([t])) for t, _ in rows.values()]))
    rows = {k: x for (k, x), s in zip(rows.items(), scores) if s >= 0.5}
    on, total = {}, {}
    for t, s in rows.values():
        total[s] = total.get(s, 0) + 1
        for line in set(t.split("\n")):
            on[s, line] = on.get((s, line), 0) + 1
    gone = lambda s, x: x.strip(" ") != "" and on[s, x] >= line_dedup.LEAST_PAGES and on[s, x] > line_dedup.RATIO * total[s]
    texts = {k: "\n".join(x for x in t.split("\n") if not gone(s, x)) for k, (t, s) in rows.items()}
    component = _components(_sets(texts.items()), 80)
    texts = {k: t for k, t in texts.items() if component[k] == k}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def dirty(t):
        # every item against the whole text, without pieces
        clean = decontaminate.normal(t)
        return any(decontaminate.search(decontaminate.masks(p), len(p), clean)[0] <= decontaminate.budget(len(p)) for p in items if p)

    texts = {k: t for k, t in texts.items() if not dirty(t)}
    encode = sentencepiece_codec.encoder(sentencepiece_codec.model_path())
    want = {k: np.frombuffer(x, "<i4").tolist() for (k, x) in zip(texts, encode(list(texts.values())))}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_pass_odd_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(3).withColumn("digest", F.lit(1)).withColumn("n_chars", F.lit(None).cast("long"))
    odd = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for frame in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
            assert name == "sentencepiece" or set(docs.columns) <= set(frame.columns)
        frame.collect()


def test_sentencepiece_stage_decodes(spark):
    rows = [(1, "one  two\n日本 é"), (2, ""), (3, None), (4, "a \x00 b <s> ▁"), (None, "no id")]
    got = corpus_pipeline.sentencepiece_encoding(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert got.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    assert {r.doc_id: r.round_trip for r in got.collect()} == dict.fromkeys([1, 2, 3, 4, None], True)
    path = sentencepiece_codec.model_path()
    right, wrong = (sentencepiece_codec.encoder(path)([x])[0] for x in ("same", "other"))
    assert sentencepiece_codec._gives_back(["same", "same"], [right, wrong], path).to_pylist() == [True, False]


def test_near_dedup_stage_links_from_080(spark):
    rows = []
    for n in [*range(49, 65)] * 3:  # one word of n replaced: Jaccard (n - 9) / (n + 1), from 0.80 up to 0.85
        words = [f"w{len(rows)}x{k}" for k in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:20], "other", *words[21:]]))]
    rows.append((len(rows), " ".join(f"far{k}" for k in range(48))))
    rows.append((len(rows), " ".join("other" if k == 20 else f"far{k}" for k in range(48))))  # 39 / 49
    kept = corpus_pipeline.near_deduplication(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    component = _components(_sets(rows), 80)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _ in rows if component[k] == k] == [*range(0, 96, 2), 96, 97]
