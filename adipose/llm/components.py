"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one smaller vertex at most, on which no edge goes on."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    of_vertex = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return of_vertex.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("root") > 0))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id reachable.

    Every step halves the paths at least; hot vertices are pre-aggregated, and their edges are
    split by the skew join. Each step's edges are checkpointed, so a lost executor repeats one, and
    edges that are stars already need none.
    """
    current = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(current):
        current = checkpointed(_large_star(current))
        current = checkpointed(_small_star(current).distinct())
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
