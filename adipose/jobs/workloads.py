"""The three workloads end to end, each a chain of DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, columns, export, profile, quant, reactions, samples, stats, validate
from ..sources import delimited
from ..sources import reference_tables as ref


class Imported(NamedTuple):
    samples: DataFrame
    quant: DataFrame
    lipids: DataFrame
    means: DataFrame
    coverage: DataFrame


def import_table(spark: SparkSession, path: str, names: DataFrame, lipid: str | int | None = None, wanted: list[str | int] | None = None, mapping: DataFrame | None = None, has_labels: bool = False) -> Imported:
    """One table: read, choose columns, long form, standardised names, statistics per group."""
    rows, cols = delimited.read_table(spark, path, has_labels=has_labels)
    header = [r["column"] for r in cols.orderBy("col_idx").collect()]
    at = columns.lipid_column(header, lipid)
    chosen = cols.where(F.col("col_idx").isin(columns.sample_columns(header, at, wanted)))
    values = quant.extract(rows, chosen, profile.table_profile(rows), at)
    listed = chosen.select("dataset_id", F.col("col_idx").alias("ordinal"), F.col("column").alias("sample_id"))
    sample = samples.with_labels(samples.sample_table(listed, mapping), cols)
    per_lipid = stats.lipid_group_values(values, sample)
    return Imported(sample, values, annotate.standardise(quant.lipids(values), names), stats.group_means(per_lipid), stats.group_coverage(per_lipid, sample))


def validate_files(spark: SparkSession, path: str | list[str], **limits) -> DataFrame:
    """Many files: read, check, one report a file."""
    batch = delimited.read_batch(spark, path)
    return export.report(*validate.validate(batch.raw_rows, batch.columns, **limits))


def validate_added_files(spark: SparkSession, path: str | list[str], states: str, **limits) -> DataFrame:
    """Reports of all files so far: the new ones are read, their states and columns are added to the folder ``states``.

    What was added before is not read again. A file must not be added twice.
    """
    batch = delimited.read_batch(spark, path)
    validate.check_state(batch.raw_rows).write.mode("append").parquet(f"{states}/checks")
    batch.columns.write.mode("append").parquet(f"{states}/columns")
    known = spark.read.schema(batch.columns.schema).parquet(f"{states}/columns")
    return export.report(*validate.validate_state(spark.read.parquet(f"{states}/checks"), known, **limits))


class Linked(NamedTuple):
    lipids: DataFrame
    links: DataFrame
    edges: DataFrame


def link_reactions(lipids: DataFrame, structures: DataFrame, headgroups: DataFrame, reaction_table: DataFrame) -> Linked:
    """Fill missing ids, pick the reactions they touch, link lipids to them, derive the graph."""
    filled = annotate.fill_from_headgroups(annotate.fill_from_structures(lipids, ref.structure_keys(structures)), headgroups)
    ids = filled.where("lm_id <> ''").select("lm_id").distinct()
    kept = reactions.keep_main(reactions.touching(reaction_table, ids))
    return Linked(filled, reactions.reaction_links(kept, ids), reactions.edges(kept))
