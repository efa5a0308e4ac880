"""Values, statistics and profiles from the rows' own cells: same rows as the long forms, and no shuffle of cells."""

import random

import pytest
from pyspark.sql import functions as F

from adipose.functions import tables
from adipose.jobs import registry
from adipose.operators import profile, quant, samples, stats
from compare import SMALL


def _table(spark, seed, n=1500):
    """Two datasets; columns fill early, late, rarely, never, or turn from text to numbers."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        cells = [r.choice(["A", "B", "", f"n{k}"]), str(k), "" if k < n // 2 else r.choice(["1_0", "x", "2.5", ""]), "7" if k % 400 == 3 else "", "", "text" if k < 90 else "5", r.choice(["ab-1", "c_2", " 3 "])]
        rows.append((r.choice(["d", "d", "e"]), k * 7 + 5, cells[: r.choice([7, 7, 7, 3])], [], []))
    r.shuffle(rows)
    raw = spark.createDataFrame(rows, "dataset_id string, row_idx long, cells array<string>, missing_columns array<string>, extra_fields array<string>").repartition(5)
    names = ["lipid", "s1", "s3", "s3", "s4", "s2", "s5"]
    cols = spark.createDataFrame([(d, k, c, None) for d in "de" for k, c in enumerate(names)], "dataset_id string, col_idx int, column string, label string")
    return raw, cols


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("first", [100, 7])
def test_profile_by_prefixes_equals_the_ranked_one(spark, monkeypatch, seed, first):
    monkeypatch.setattr(profile, "FIRST", first)
    raw, _ = _table(spark, seed)
    want = sorted(map(tuple, profile.column_profile(profile.long_cells(raw)).collect()), key=repr)
    assert sorted(map(tuple, profile.table_profile(raw).collect()), key=repr) == want
    assert profile.table_profile(raw.where("false")).collect() == []


@pytest.mark.parametrize("bound", [0, 300_000])
def test_row_statistics_equal_the_long_ones(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "BROADCAST_ENTRIES", bound)
    raw, cols = _table(spark, 3, 400)
    found = profile.table_profile(raw)
    listed = samples.sample_table(cols.where("col_idx > 0").select("dataset_id", F.col("col_idx").alias("ordinal"), F.col("column").alias("sample_id")))
    long = quant.extract(raw, cols, found)
    shown = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    assert long.count() > 100
    assert shown(stats.row_group_values(raw, quant.sample_columns(cols, found), listed)) == shown(stats.lipid_group_values(long, listed))
    scored = stats.row_zscores(quant.row_values(raw, quant.column_plan(cols, found)))
    assert scored.columns == stats.zscores(long).columns and shown(scored) == shown(stats.zscores(long))


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["p3_extract", "a1_repeated_headers", "a3_row_zscores"])
def test_cells_stay_in_their_rows(spark, name):
    """The column plan is not small by estimate, but it is by count: no exchange but the one row a dataset that is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _final_plan(registry.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_profile_sorts_only_first_rows(spark):
    raw, _ = _table(spark, 4)
    cells = profile._prefix(raw, spark.createDataFrame([("d", 1, 150), ("e", 6, 75)], "dataset_id string, col_idx int, bound long"))
    assert {(r.dataset_id, r.col_idx) for r in cells.collect()} == {("d", 1), ("e", 6)}
    assert all(r.row_idx <= {"d": 150, "e": 75}[r.dataset_id] for r in cells.collect())
