"""Tables that are written once and read again, and small tables beside rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of lists goes to every executor up to so many entries (some 20 MB); beyond, rows are shuffled to it.
BROADCAST_ENTRIES = 300_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder in ``spark.checkpoint.dir``; where that is unset (tests) in a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="adipose-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared path and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores where they are read in fewer parts: each of them makes many rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def with_lists(rows: DataFrame, lists: DataFrame, column: str, key: str = "dataset_id", how: str = "inner", entries: int | None = None) -> DataFrame:
    """``rows`` joined to ``lists`` (key, column), a stored table of one row a key.

    The entries of all lists are counted, unless the caller knows them. Below the bound the table is
    broadcast and rows stay where they are read; beyond it whole rows, not their cells, are shuffled
    by key, and a hot key is split by the skew join.
    """
    if entries is None:
        entries = lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0]
    return rows.join(F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists, key, how)


def lists_in_parts(items: DataFrame, keys: list[str], order: list[str], size: int, name: str = "items") -> DataFrame:
    """(keys, part, ``name``): the items of each key in ``order`` as lists of ``size`` at most, numbered from 0.

    Put together in order of the parts they are the key's whole list. Keys with more items than
    ``size`` are sorted by (key, order) over all tasks; an item's place is counted per task and summed
    over the tasks before, so no task holds more than its range and a part. Keys are not null.
    """
    fields = [*order, *[c for c in items.columns if c not in [*keys, *order]]]
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias(name)
    large = stored(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size).select(*keys), "large-lists")
    few = F.broadcast(large) if large.count() <= BROADCAST_ENTRIES else large
    plain = items.join(few, keys, "left_anti").groupBy(*keys).agg(F.lit(0).cast("long").alias("part"), listed).select(*keys, "part", name)
    ranged = items.join(few, keys, "left_semi").repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.spark_partition_id()), "ranged-items")
    # a row for each large key and task that it meets
    runs = ranged.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("__at") - F.col("__first") + F.col("__before")
    placed = ranged.join(runs.withColumn("__before", before).drop("__n"), [*keys, "__task"]).withColumn("part", F.floor(place / size).cast("long"))
    return plain.unionByName(placed.groupBy(*keys, "part").agg(listed))
