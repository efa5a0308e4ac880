"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds
``ratio`` and it is on at least ``least_pages`` of them. Only 64-bit line digests are shuffled;
they are counted once a page, combined before the shuffle. What one host can hold of boilerplate
lines is bounded by (mean lines a page) / ratio, so the lists per host are small whatever the
host's size; the pages then join that table by host. Spark broadcasts the table only if its
files are below its threshold; otherwise a hot host is split by the skew join.

Defined results: a null host is a site of its own; a null text stays null and an empty one
empty; blank lines are never boilerplate and stay; a page that repeats counts each time, a line
that repeats in a page once; a page all of whose lines go keeps an empty text; all other
columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

RATIO = 0.1
LEAST_PAGES = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): for each host the digests of its boilerplate lines."""
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.filter(_lines(text), lambda x: F.trim(x) != ""))).alias("line"))
    counts = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= least_pages)
    t = totals.withColumnRenamed("host", "total_host")
    over = counts.join(t, F.col("host").eqNullSafe(F.col("total_host"))).where(F.col("on") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, removed: str | None = None) -> DataFrame:
    """``pages`` with the boilerplate lines of their host taken out of ``text``.

    ``removed`` names a column for the number of lines taken out.
    """
    found = stored(boilerplate(pages, host, text, ratio, least_pages), "boilerplate").select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    joined = pages.join(found, pages[host].eqNullSafe(found["__host"]), "left")
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains("__lines", F.xxhash64(x)))
    cleaned = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else joined[c] for c in pages.columns]
    if removed:
        columns.append(F.when(F.col("__lines").isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(text)) - F.size(kept)).cast("long").alias(removed))
    return joined.select(columns)
