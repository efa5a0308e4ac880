"""Spark results against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if glob.glob(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NA or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.item() if hasattr(x, "item") else x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def same(query, sql, spark, sf_dir):
    got = rows(query(spark, sf_dir).toPandas().astype(object))
    want = rows(connection(sf_dir).execute(sql).df().astype(object))
    number = lambda t: [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in t]
    assert got[0] == want[0]
    assert sorted(number(got[1]), key=repr) == sorted(number(want[1]), key=repr)


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
