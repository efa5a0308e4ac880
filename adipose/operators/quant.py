"""From raw cells to values per lipid and sample, and simple reads of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored, with_lists
from ..functions.text import number, strip


def sample_columns(columns: DataFrame, profile: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """(dataset_id, ordinal, sample_id): the column of each sample, if it is numeric and not empty.

    ``columns`` lists the sample columns; of those with equal names the last one counts, whether or not it is numeric.
    """
    usable = profile.where("not is_empty and column_type = 'numeric'").select("dataset_id", "col_idx")
    last = columns.where((F.col("col_idx") != lipid_idx) & (strip(F.col("column")) != "")).groupBy("dataset_id", F.col("column").alias("sample_id")).agg(F.max("col_idx").alias("col_idx"))
    return last.join(usable, ["dataset_id", "col_idx"], "left_semi").select("dataset_id", F.col("col_idx").alias("ordinal"), "sample_id")


def column_plan(columns: DataFrame, profile: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """(dataset_id, plan): a row a dataset with its sample columns (ordinal, sample_id) in order, stored."""
    entry = F.struct("ordinal", "sample_id")
    return stored(sample_columns(columns, profile, lipid_idx).groupBy("dataset_id").agg(F.array_sort(F.collect_list(entry)).alias("plan")), "column-plan")


def named_rows(raw_rows: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """(dataset_id, row_idx, input_name, cells) of rows with a name."""
    return raw_rows.select("dataset_id", "row_idx", strip(F.col("cells")[lipid_idx]).alias("input_name"), "cells").where("input_name <> ''")


def row_values(raw_rows: DataFrame, plan: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """(dataset_id, row_idx, input_name, values): a row's numbers (ordinal, sample_id, value), taken from its own cells.

    The plan of the row's dataset says which cells these are, so no cell leaves its row; rows without any value go.
    """
    value = lambda c: F.struct(c["ordinal"].alias("ordinal"), c["sample_id"].alias("sample_id"), number(F.get("cells", c["ordinal"])).alias("value"))
    joined = with_lists(named_rows(raw_rows, lipid_idx), plan, "plan")
    return joined.select("dataset_id", "row_idx", "input_name", F.filter(F.transform("plan", value), lambda v: v["value"].isNotNull()).alias("values")).where(F.size("values") > 0)


def extract(raw_rows: DataFrame, columns: DataFrame, profile: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """quant (dataset_id, row_idx, input_name, ordinal, sample_id, value) of numeric sample columns.

    Rows with a blank name, whole columns that are empty or not numeric, and cells that are blank or
    no number are left out; a row without any value is so too. ``columns`` lists the sample columns;
    of those with equal names the last one counts, whether or not it is numeric.
    """
    return row_values(raw_rows, column_plan(columns, profile, lipid_idx), lipid_idx).select("dataset_id", "row_idx", "input_name", F.inline("values"))


def lipids(quant: DataFrame) -> DataFrame:
    return quant.select("dataset_id", "row_idx", "input_name").distinct()


def failed_imports(annotated: DataFrame) -> DataFrame:
    """Lipids that were not standardised; an empty name is no failure."""
    return annotated.where("standardized_name is null")


def import_counts(annotated: DataFrame) -> DataFrame:
    """(successful_import_count, failed_import_count); the first counts all lipids."""
    return annotated.agg(F.count(F.lit(1)).alias("successful_import_count"), F.count_if(F.col("standardized_name").isNull()).alias("failed_import_count"))


def of_class(annotated: DataFrame, name: str) -> DataFrame:
    return annotated.where((F.col("main_class") == name) | (F.col("sub_class") == name))


def by_names(annotated: DataFrame, names: DataFrame) -> DataFrame:
    """(name, row): the first lipid whose input or standardised name is each of ``names`` (name).

    Two equi-joins and a union instead of one join on either name.
    """
    row = F.struct(*[F.col(c) for c in annotated.columns]).alias("row")
    keyed = annotated.select(F.col("input_name").alias("name"), "row_idx", row).unionByName(annotated.where("standardized_name is not null").select(F.col("standardized_name").alias("name"), "row_idx", row))
    return keyed.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min_by("row", "row_idx").alias("row"))


def values_for(annotated: DataFrame, quant: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, sample_id, value) of ``wanted`` (name, sample_id); null where either is absent."""
    found = by_names(annotated, wanted).select("name", F.col("row.row_idx").alias("row_idx"))
    return wanted.join(found, "name", "left").join(quant.select("row_idx", "sample_id", "value"), ["row_idx", "sample_id"], "left").select("name", "sample_id", "value")


def lm_ids(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("lm_id").startswith("LM")).select("lm_id").distinct()


def unmatched_names(annotated: DataFrame) -> DataFrame:
    return annotated.where("standardized_name <> '' and lm_id is null").select("standardized_name").distinct()


def first_rows(annotated: DataFrame, n: int = 10) -> DataFrame:
    return annotated.orderBy("row_idx").limit(max(0, n))
