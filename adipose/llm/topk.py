"""Exact top-k search by tiled matrix products.

Vectors are packed into shards of some thousand rows, queries into tiles; the grid of
(query tile, shard group) cells is an equi-join, so both sides are shuffled in blocks and no
task holds more than one tile and a few shards. A cell's matrix products are made for some queries at
a time, each with a partial selection; the lists of a cell are merged in its task, those of a query by
partial lists in the tasks (window group limit) and then at its own. A shard is copied once for every
16,384 queries: with tiles of bounded size no exact search moves less.

Defined results: vectors that are null or hold null or non-finite components, and rows without
id, take no part; vectors are compared with those of their own length only; rows that repeat a
candidate's id are candidates each; a query id that repeats is asked once (the vector that is
smallest in array order); equal scores go to the smaller id; scores beyond 64 bits are held at their ends; with fewer candidates than k all
are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
TILE_ROWS, PRODUCT_ROWS = 16_384, 2048
GROUP_SHARDS = 16
_BLOCK = "dim int, ids binary, matrix binary, peak double"
_SCORES = "query_id long, vec_id long, score long"


def _integers(scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = part.column(1)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    matrix = np.floor(scale * flat[starts[rows][:, None] + np.arange(dim)])
                    order = np.argsort(ids[rows], kind="stable")
                    peak = float(np.abs(matrix).max(initial=0))
                    kind = np.float32 if peak < 1 << 24 else np.float64
                    yield pa.record_batch(
                        [pa.array([int(dim)], pa.int32()), pa.array([ids[rows][order].tobytes()], pa.binary()), pa.array([matrix[order].astype(kind).tobytes()], pa.binary()), pa.array([peak], pa.float64())],
                        names=["dim", "ids", "matrix", "peak"],
                    )

    return pack


def _matrix(raw: bytes, rows: int, dim: int, peak: float) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if peak < 1 << 24 else np.float64).reshape(rows, dim)


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products: the float kind whose mantissa holds every partial sum."""
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    ends = np.iinfo(np.int64)
    return np.clip(whole(a) @ whole(b).T, ends.min + 1, ends.max).astype(np.int64)


def _search(k: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, all_ids, ids = row["dim"], np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                queries, matrix = _matrix(row["q_matrix"], len(all_ids), dim, row["q_peak"]), _matrix(row["matrix"], len(ids), dim, row["peak"])
                for at in range(0, len(all_ids), PRODUCT_ROWS):
                    q_ids = all_ids[at : at + PRODUCT_ROWS]
                    scores = _products(queries[at : at + PRODUCT_ROWS], matrix, dim * row["q_peak"] * row["peak"])
                    top = min(k + 1, len(ids))  # one more: a query's own row goes afterwards
                    own = (q_ids[:, None] == ids[None, :]) if np.intersect1d(q_ids, ids).size else None
                    low = np.iinfo(np.int64).min
                    if own is not None:
                        scores[own] = low
                    # the kth best score bounds the list; among equals, ids are in order already
                    edge = np.partition(scores, len(ids) - top, axis=1)[:, len(ids) - top]
                    q, v = np.nonzero(scores >= edge[:, None])
                    s = scores[q, v]
                    order = np.lexsort((v, -s, q))
                    q, v, s = q[order], v[order], s[order]
                    nth = np.arange(len(q)) - np.searchsorted(q, q)
                    keep = (nth < k) & (s != low)
                    yield pa.record_batch([pa.array(q_ids[q[keep]]), pa.array(ids[v[keep]]), pa.array(s[keep])], names=["query_id", "vec_id", "score"])

    return cells


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product of floor(scale * x) for each query row."""
    spark = vectors.sparkSession
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(
        ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    asked = valid.where(is_query).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vector_col).alias("embedding"))
    rows = valid.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    n_queries, n_rows = asked.count(), rows.count()
    tiles = max(1, -(-n_queries // TILE_ROWS))
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = -(-n_rows // SHARD_ROWS)
    groups = max(1, min(n_shards, max(-(-cells // tiles), -(-n_shards // GROUP_SHARDS))))
    shards = rows.repartition(groups).mapInArrow(_integers(scale), _BLOCK)
    shards = shards.withColumn("cell", F.spark_partition_id() % groups).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    packed = asked.repartition(tiles, F.xxhash64("vec_id")).mapInArrow(_integers(scale), _BLOCK)
    packed = packed.select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("peak").alias("q_peak"), (F.spark_partition_id() % tiles).alias("tile"))
    packed = packed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # the copies made by explode are in no size that Spark knows, so it would broadcast them through the driver
    found = shards.join(packed.hint("merge"), ["dim", "tile", "cell"]).mapInArrow(_search(k), _SCORES)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
