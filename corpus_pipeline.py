"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on all rows its predecessor kept and passes the columns of ``documents``; the
last one gives each document's piece ids and whether they decode to its text. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adipose.llm import decontaminate, line_dedup, near_dup, quality, sentencepiece_codec
from adipose.llm.shared import by_ids, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source go; every document stays."""
    return line_dedup.drop_boilerplate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at 0.80 stays; null ids all stay."""
    found = near_dup.near_duplicates(docs, percent=near_dup.PERCENT)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "near-duplicates")
    return by_ids(docs, gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of each document; round_trip: the ids decode to its text."""
    return sentencepiece_codec.encode(docs, keep=("doc_id",), check=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]

#: The classifier and the encoder are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
