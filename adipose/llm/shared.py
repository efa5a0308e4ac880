"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests) a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="adipose-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores where their table ``source`` is read in fewer parts than there are cores.

    Such a table is small, or one file that cannot be split; a larger one stays where it is read.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if source.rdd.getNumPartitions() < cores else rows


#: Up to so many ids a semi or anti join broadcasts them (some MB); beyond, it broadcasts two bitmaps of at most so many bits (16 MB) each.
BROADCAST_IDS, BITMAP_BITS = 200_000, 1 << 27
_BUCKET = 1 << 15  # bits in one value of bitmap_construct_agg


def _may_be_among(rows: DataFrame, ids: DataFrame, key: str, n: int, mark: str) -> DataFrame:
    """``rows`` with ``mark``: false only where the key is none of the ids, by a broadcast bitmap of hashes made for ``n`` keys."""
    bits = max(_BUCKET, min(BITMAP_BITS, 1 << (8 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bitmap = ids.select((place / _BUCKET).cast("int").alias("__bucket"), (place % _BUCKET).alias("at")).groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__bits"))
    placed = rows.withColumn("__at", place).withColumn("__bucket", (F.col("__at") / _BUCKET).cast("int")).join(F.broadcast(bitmap), "__bucket", "left")
    at = (F.col("__at") % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.expr("shiftright(__byte, __shift) & 1") == 1, F.lit(False))
    return placed.withColumn("__byte", byte).withColumn("__shift", at % 8).withColumn(mark, may).drop("__at", "__bucket", "__bits", "__byte", "__shift")


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) the ``ids``, a stored table of distinct keys.

    A null key is equal to none: left_semi drops its rows, left_anti keeps them. The ids are counted
    first. A set below the bound is broadcast. Of a larger one a bitmap of bounded size is, and
    another of the rows' keys that are not among the ids: only rows that are in both bitmaps are
    open and are shuffled, all others stay where they are read; null keys meet no bitmap. The result
    is the same.
    """
    n = ids.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, how)
    keyed, ids, columns = rows.where(F.col(key).isNotNull()), ids.where(F.col(key).isNotNull()), rows.columns
    others = stored(keyed.select(key).distinct().join(ids, key, "left_anti"), "other-keys")
    keys = n + others.count()
    marked = _may_be_among(keyed, ids, key, keys, "__in")
    both = _may_be_among(marked, others, key, keys, "__out")
    settled = both.where("__in and not __out") if how == "left_semi" else marked.where("not __in")
    found = both.where("__in and __out").select(columns).join(ids.hint("shuffle_hash"), key, how).select(columns).unionByName(settled.select(columns))
    return found if how == "left_semi" else found.unionByName(rows.where(F.col(key).isNull()))
