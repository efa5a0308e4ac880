"""Statistics per group and per lipid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored, with_lists
from ..functions.text import number
from .quant import named_rows


def lipid_group_values(quant: DataFrame, samples: DataFrame) -> DataFrame:
    """(dataset_id, group, row_idx, input_name, mean, std, n): population std, 0 for one value.

    A sample that a repeated header lists twice counts twice, each time with the last column's value.
    """
    joined = quant.join(samples.select("dataset_id", "sample_id", "group"), ["dataset_id", "sample_id"])
    return joined.groupBy("dataset_id", "group", "row_idx", "input_name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def _moments(items: Column, of: Callable[[Column], Column]) -> Column:
    """``items`` (with an array of doubles that ``of`` gives) as structs of the item with n, mean and population std."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    means = F.transform(items, lambda i: F.struct(i.alias("item"), F.size(of(i)).cast("long").alias("n"), (total(of(i)) / F.size(of(i))).alias("mean")))
    squares = lambda m: F.aggregate(of(m["item"]), F.lit(0.0), lambda a, x: a + (x - m["mean"]) * (x - m["mean"]))
    return F.transform(means, lambda m: F.struct(m["item"].alias("item"), m["n"].alias("n"), m["mean"].alias("mean"), F.sqrt(squares(m) / m["n"]).alias("std")))


def row_group_values(raw_rows: DataFrame, columns: DataFrame, samples: DataFrame, lipid_idx: int = 0) -> DataFrame:
    """``lipid_group_values`` from the rows' own cells: ``columns`` is (dataset_id, ordinal, sample_id) of ``quant.sample_columns``.

    A dataset's groups are one row (group, ordinals of its samples) beside its rows; each row sums up
    its own groups, so neither cells nor rows are shuffled while the lists are small.
    """
    listed = samples.select("dataset_id", "sample_id", "group").join(columns, ["dataset_id", "sample_id"]).groupBy("dataset_id", "group").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))
    groups = stored(listed.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("group", "ordinals"))).alias("groups")), "group-plan")
    numbers = lambda g: F.filter(F.transform(g["ordinals"], lambda o: number(F.get("cells", o))), lambda x: x.isNotNull())
    filled = F.filter(F.transform("groups", lambda g: F.struct(g["group"].alias("group"), numbers(g).alias("xs"))), lambda g: F.size(g["xs"]) > 0)
    joined = with_lists(named_rows(raw_rows, lipid_idx), groups, "groups").select("dataset_id", "row_idx", "input_name", filled.alias("groups"))
    found = joined.select("dataset_id", "row_idx", "input_name", F.explode(_moments(F.col("groups"), lambda g: g["xs"])).alias("g"))
    return found.select("dataset_id", F.col("g.item.group").alias("group"), "row_idx", "input_name", "g.mean", "g.std", "g.n")


def row_zscores(rows: DataFrame) -> DataFrame:
    """``zscores`` of ``quant.row_values`` (…, values): each row has all its numbers, so nothing is shuffled."""
    whole = F.get(_moments(F.array(F.struct(F.transform("values", lambda v: v["value"]).alias("xs"))), lambda g: g["xs"]), F.lit(0))
    scored = rows.withColumn("__m", whole)
    z = lambda v: F.when(F.col("__m.std") == 0, 0.0).otherwise((v["value"] - F.col("__m.mean")) / F.col("__m.std"))
    each = F.transform("values", lambda v: F.struct(v["ordinal"].alias("ordinal"), v["sample_id"].alias("sample_id"), v["value"].alias("value"), z(v).alias("z")))
    return scored.select("dataset_id", "row_idx", "input_name", F.inline(each))


def group_means(values: DataFrame) -> DataFrame:
    """(dataset_id, group, input_name, mean, std): of rows with equal names the last counts."""
    last = values.groupBy("dataset_id", "group", "input_name").agg(F.max_by(F.struct("mean", "std"), "row_idx").alias("last"))
    return last.select("dataset_id", "group", "input_name", "last.mean", "last.std")


def group_coverage(values: DataFrame, samples: DataFrame) -> DataFrame:
    """(dataset_id, group, sample_count, lipid_coverage); groups without data stay with coverage 0.

    Coverage counts rows, those with equal names too.
    """
    counted = samples.groupBy("dataset_id", "group").agg(F.count(F.lit(1)).alias("sample_count"))
    covered = values.groupBy("dataset_id", "group").agg(F.count(F.lit(1)).alias("lipid_coverage"))
    return counted.join(covered, ["dataset_id", "group"], "left").withColumn("lipid_coverage", F.coalesce("lipid_coverage", F.lit(0)))


def zscores(quant: DataFrame) -> DataFrame:
    """``quant`` with ``z``: distance to the row's mean in population deviations, 0 where that is 0."""
    row = Window.partitionBy("dataset_id", "row_idx")
    scored = quant.withColumn("__mean", F.avg("value").over(row)).withColumn("__std", F.stddev_pop("value").over(row))
    return scored.withColumn("z", F.when(F.col("__std") == 0, 0.0).otherwise((F.col("value") - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std")


def grouped_data(quant: DataFrame, samples: DataFrame) -> DataFrame:
    """(dataset_id, group, row_idx, input_name, values): for every group and lipid a map of its values.

    A dataset's groups are collected to its lipids as an array, so empty maps come without a cross
    join of tables; a map is as long as a group has samples.
    """
    groups = samples.groupBy("dataset_id").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    rows = quant.select("dataset_id", "row_idx", "input_name").distinct().join(groups, "dataset_id").withColumn("group", F.explode("groups")).drop("groups")
    listed = samples.select("dataset_id", "sample_id", "group").distinct()  # a repeated header lists a sample twice
    joined = quant.join(listed, ["dataset_id", "sample_id"])
    maps = joined.groupBy("dataset_id", "group", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("sample_id", "value")))).alias("values"))
    return rows.join(maps, ["dataset_id", "group", "row_idx"], "left").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,double>")))
