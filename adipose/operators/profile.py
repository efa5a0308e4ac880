"""Column profile and type guess on the first filled cells of each column."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored, with_lists
from ..functions.text import number, strip

# fixed values: cells looked at, cells that must look like identifiers, share of numbers, mean length
FIRST, FEW, NUMERIC, SHORT = 100, 10, 0.8, 20


def long_cells(raw_rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(dataset_id, row_idx, col_idx, raw[, column]): a row a cell."""
    cells = raw_rows.select("dataset_id", "row_idx", F.posexplode("cells").alias("col_idx", "raw"))
    return cells if columns is None else cells.join(columns.select("dataset_id", "col_idx", "column"), ["dataset_id", "col_idx"])


def _kinds(top: DataFrame, counts: DataFrame) -> DataFrame:
    """The profile of counted columns by their first filled cells ``top`` (dataset_id, col_idx, text, rank)."""
    plain = F.regexp_replace("text", "[_-]", "").rlike(r"^[\p{L}\p{N}]+$")
    seen = top.groupBy("dataset_id", "col_idx").agg(
        F.avg(number(F.col("text")).isNotNull().cast("double")).alias("numbers"),
        F.avg(F.length("text")).alias("size"),
        F.min(F.when(F.col("rank") <= FEW, plain)).alias("plain"),
    )
    kind = F.when(F.col("numbers") > NUMERIC, "numeric").when((F.col("size") < SHORT) & F.col("plain"), "identifier").when(F.col("numbers").isNotNull(), "text")
    return counts.join(seen, ["dataset_id", "col_idx"], "left").select("dataset_id", "col_idx", "n_rows", "n_non_empty", (F.col("n_non_empty") == 0).alias("is_empty"), kind.alias("column_type"))


def _ranked(cells: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("dataset_id", "col_idx").orderBy("row_idx"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= FIRST)


def column_profile(cells: DataFrame) -> DataFrame:
    """(dataset_id, col_idx, n_rows, n_non_empty, is_empty, column_type) of long cells.

    The first hundred filled cells in row order decide: over 80 % numbers are ``numeric``; short
    cells whose first ten are letters, digits, _ and - are ``identifier``; else ``text``; an empty
    column has no type. The rank is cut before the shuffle, so no column is gathered whole. For
    tables that are there as rows, ``table_profile`` gives the same without sorting all cells.
    """
    text = strip(F.coalesce("raw", F.lit("")))
    trimmed = cells.select("dataset_id", "col_idx", "row_idx", text.alias("text"))
    counts = trimmed.groupBy("dataset_id", "col_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text") != "").alias("n_non_empty"))
    return _kinds(_ranked(trimmed.where("text <> ''")), counts)


def _prefix(raw_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(dataset_id, col_idx, row_idx, text): filled cells up to each column's ``bound``; other rows are not unpivoted."""
    entry = F.struct("col_idx", "bound")
    plan = stored(bounds.groupBy("dataset_id").agg(F.max("bound").alias("until"), F.collect_list(entry).alias("open")), "profile-bounds")
    about = plan.agg(F.max("until").alias("until"), F.coalesce(F.sum(F.size("open") + 1), F.lit(0)).alias("entries")).first()
    first = raw_rows.select("dataset_id", "row_idx", "cells").where(F.col("row_idx") <= F.lit(about["until"]))
    rows = with_lists(first, plan, "open", entries=about["entries"]).where("row_idx <= until")
    cell = lambda c: F.struct(c["col_idx"].alias("col_idx"), c["bound"].alias("bound"), strip(F.coalesce(F.get("cells", c["col_idx"]), F.lit(""))).alias("text"))
    asked = F.filter(F.col("open"), lambda c: c["bound"] >= F.col("row_idx"))
    return rows.select("dataset_id", "row_idx", F.inline(F.transform(asked, cell))).where("text <> ''").select("dataset_id", "col_idx", "row_idx", "text")


def table_profile(raw_rows: DataFrame) -> DataFrame:
    """``column_profile`` of whole rows, without sorting more than the first rows.

    One pass counts each column's cells and finds its first and last filled row; partial counts are
    all that is shuffled. A column of a hundred filled cells at most is looked at up to its last one.
    Of others the rows are read up to a bound that should hold two hundred filled cells if they were
    spread evenly; it is doubled for the columns where it holds fewer than a hundred.
    """
    text = strip(F.coalesce("raw", F.lit("")))
    cells = long_cells(raw_rows).select("dataset_id", "col_idx", F.when(text != "", F.col("row_idx")).alias("at"))
    counts = stored(cells.groupBy("dataset_id", "col_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.count("at").alias("n_non_empty"), F.min("at").alias("first"), F.max("at").alias("last")), "column-counts")
    wide = F.ceil((F.col("last") - F.col("first") + 1) * (2.0 * FIRST) / F.col("n_non_empty"))
    open_ = counts.where("n_non_empty > 0").select("dataset_id", "col_idx", "first", "last", F.when(F.col("n_non_empty") <= FIRST, F.col("last")).otherwise(F.least("last", F.col("first") + wide)).alias("bound"))
    found = []
    while True:
        top = stored(_ranked(_prefix(raw_rows, open_)), "first-cells")
        held = top.groupBy("dataset_id", "col_idx").agg(F.max("rank").alias("held"))
        further = F.least("last", F.col("first") + 2 * (F.col("bound") - F.col("first") + 1))
        open_ = open_.where("bound < last").join(held, ["dataset_id", "col_idx"], "left").where(F.coalesce("held", F.lit(0)) < FIRST).select("dataset_id", "col_idx", "first", "last", further.alias("bound"))
        open_ = stored(open_, "open-columns")
        if open_.isEmpty():
            return _kinds(functools.reduce(DataFrame.unionByName, [*found, top]), counts)
        found.append(top.join(open_.select("dataset_id", "col_idx"), ["dataset_id", "col_idx"], "left_anti"))
