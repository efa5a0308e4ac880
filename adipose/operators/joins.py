"""Joins of many rows with a reference table when some keys are hot or absent.

A reference table below a counted bound is broadcast whole. Beyond it a frequent-items sketch of the
rows' keys (partial sketches per task, merged) names the hot ones. Their reference rows are broadcast,
and their rows meet them where they are read, as do rows without key; only the rest is shuffled.

A reference table that many jobs look up is written once in buckets of its key (``bucket_reference``).
Beyond the bound its part of a join then is read bucket by bucket, sorted: only the rows move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_path, stored

#: Reference rows that are broadcast, all of a table or those of hot keys.
BROADCAST_ROWS = 200_000
#: Copies of a hot key's reference rows where there are too many of them to broadcast.
SALTS = 64


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys that may fill more than half of a shuffle task's mean share, by a sketch of all rows."""
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = min(2 * tasks, 20_000)
    found = rows.select(F.col(key).alias("k")).where("k is not null").agg(F.count("k").alias("n"), F.expr(f"approx_top_k(k, {most}, {min(32 * most, 1_000_000)})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if 2 * tasks * x["count"] > found["n"]]


def bucket_reference(side: DataFrame, key: str, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``side`` without null keys, saved as table ``name`` in ``buckets`` by ``key`` and sorted in them.

    Rows of equal keys all stay. A table of that name is replaced. Without ``buckets`` there are as
    many as shuffle partitions: with fewer Spark may deal both sides anew. Each bucket is one file, as
    rows are dealt by the buckets' hash first. Null keys match nothing, so they are left out.
    """
    spark = side.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = side.where(F.col(key).isNotNull()).repartition(buckets, key)
    kept.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path or shared_path(spark, name)).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def reference_join(rows: DataFrame, side: DataFrame, key: str, how: str = "left", bucketed: bool = False) -> DataFrame:
    """``rows`` joined (left or inner) to ``side`` on ``key``; the same rows as a plain join gives.

    ``rows`` is read up to three times, so it should be a table or a short way from one. A ``bucketed``
    side is (columns of) a table of ``bucket_reference``; it is read where it is and not copied.
    """
    side = side.where(F.col(key).isNotNull())
    side = side if bucketed else stored(side, "reference")
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, how)
    hot = hot_keys(rows, key)
    if not hot:
        return _cold(rows, side, key, how)
    names = rows.sparkSession.createDataFrame([(k,) for k in hot], side.select(key).schema)
    theirs = stored(side.join(F.broadcast(names), key, "left_semi"), "hot-reference")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    met, rest = rows.where(is_hot), rows.where(~is_hot)
    if theirs.count() <= BROADCAST_ROWS:
        hot_part = met.join(F.broadcast(theirs), key, how)
    else:
        salted = theirs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot_part = met.withColumn("__salt", (F.rand(0) * SALTS).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")
    return hot_part.unionByName(_cold(rest, side, key, how))


def _cold(rows: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """A join by shuffle; rows without key, which would all go to one task, stay where they are."""
    found = rows.where(F.col(key).isNotNull()).join(side, key, how)
    if how == "inner":
        return found
    absent = rows.where(F.col(key).isNull())
    for f in side.schema.fields:
        if f.name != key:
            absent = absent.withColumn(f.name, F.lit(None).cast(f.dataType))
    return found.unionByName(absent)
