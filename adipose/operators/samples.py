"""Sample groups and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled


def group_of(sample_id: Column) -> Column:
    """The leading part without digits, without _ at both ends; ``unknown`` where nothing is left."""
    return F.coalesce(filled(F.btrim(F.regexp_extract(sample_id, r"^(\D+)", 1), F.lit("_"))), F.lit("unknown"))


def sample_table(samples: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """``samples`` (…, sample_id) with ``group``: from ``mapping`` (sample_id, group, ord) first, then by name.

    A sample in several groups of the mapping belongs to the last by ``ord``.
    """
    if mapping is None:
        return samples.withColumn("group", group_of(F.col("sample_id")))
    last = mapping.groupBy("sample_id").agg(F.max_by("group", "ord").alias("mapped"))
    return samples.join(last, "sample_id", "left").withColumn("group", F.coalesce("mapped", group_of(F.col("sample_id")))).drop("mapped")


def with_labels(samples: DataFrame, columns: DataFrame, by: str = "name", lipid_idx: int = 0) -> DataFrame:
    """``samples`` (dataset_id, ordinal, sample_id) with the label of the column of that name.

    ``by='position'`` pairs the k-th sample with the k-th label after the first column, whatever
    columns were chosen. Blank labels are null.
    """
    label = filled(F.trim("label")).alias("label")
    if by == "name":
        last = columns.groupBy("dataset_id", F.col("column").alias("sample_id")).agg(F.max_by("label", "col_idx").alias("label"))
        return samples.join(last.select("dataset_id", "sample_id", label), ["dataset_id", "sample_id"], "left")
    return samples.join(columns.where("col_idx > 0").select("dataset_id", (F.col("col_idx") - 1).alias("ordinal"), label), ["dataset_id", "ordinal"], "left")
