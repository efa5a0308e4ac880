"""Stable row numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """``df`` with 1, 2, ... in input order.

    Rows are counted per partition; only that table, a row a partition, is summed in order and
    broadcast. The input must be read in the same partitions twice, as files are.
    """
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", "__first", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__part", "__at", "__first", "__before", "__n")


def with_split_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """``df`` (file, block, …) with 1, 2, ... in order of file and place in it, whatever order Spark reads splits in.

    Rows of a split must be neighbours in their order, as a file's are. Like ``with_row_idx``; the table has a row a split.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    sizes = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", "__first", before.alias("__before"))
    return placed.join(F.broadcast(starts), ["file", "block"]).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__first", "__before", "__n")
