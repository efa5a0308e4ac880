"""Checks from mergeable states: one read of the rows, states put together, messages of every kind."""

import json
import random

import pytest
from pyspark.sql import functions as F

from adipose.jobs import registry, workloads
from adipose.operators import validate
from compare import SMALL
from test_sources import _raw


def _sorted(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def _table(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(300):
        cells = [r.choice(["A", "B", "", "NA", "12", "unknown x", f"name {k}"]), *[r.choice(["1", "-2", "0", "x", "", " 3 "]) for _ in range(3)]]
        lacking = r.choice([[], [], [], ["s3"]])
        rows.append((r.choice("de"), 17 * k, cells[: 4 - len(lacking)] + [""] * len(lacking), lacking, r.choice([[], [], ["more", "1"]])))
    return spark.createDataFrame(rows, "dataset_id string, row_idx long, cells array<string>, missing_columns array<string>, extra_fields array<string>").repartition(4)


def _long(raw, columns, **limits):
    """Issues by separate passes over the rows, as a plain version of what states give."""
    cells = validate.entries(raw)
    flagged = raw.select("dataset_id", "row_idx", "missing_columns", "extra_fields", (validate._first() == "").alias("unnamed"))
    issues = validate.counted_issues(columns, cells, **limits).unionByName(validate.row_issues(flagged)).unionByName(validate.name_issues(validate.duplicate_names(validate.name_table(raw))))
    return issues, validate.summary(columns, validate.counts(cells), issues)


@pytest.mark.parametrize("block", [1, 100, 4096])
def test_states_give_what_passes_over_the_rows_give(spark, monkeypatch, block):
    monkeypatch.setattr(validate, "BLOCK", block)
    raw = _table(spark, block)
    columns = spark.createDataFrame([(d, k, n, None) for d in "def" for k, n in enumerate(["name", "s1", "s2", "s2"])], "dataset_id string, col_idx int, column string, label string")
    for limits in ({}, {"min_samples": 5, "min_lipids": 999, "max_missing_percent": 15.0}):
        got, want = validate.validate(raw, columns, **limits), _long(raw, columns, **limits)
        assert got[0].columns == want[0].columns and _sorted(got[0]) == _sorted(want[0])
        assert _sorted(got[1]) == _sorted(want[1])
    assert {r.check_id for r in got[0].collect()} >= {f"V{k}" for k in (1, 3, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15)}


def test_states_of_parts_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(validate, "BLOCK", 64)
    raw = _table(spark, 9)
    columns = spark.createDataFrame([(d, k, n, None) for d in "de" for k, n in enumerate(["name", "s1", "s2", "s3"])], "dataset_id string, col_idx int, column string, label string")
    parts = [validate.check_state(raw.where(c)) for c in ("row_idx < 1000", "row_idx between 1000 and 1717", "row_idx > 1717")]
    together = validate.validate_state(parts[0].unionByName(parts[1]).unionByName(parts[2]), columns)
    whole = validate.validate(raw, columns)
    assert _sorted(together[0]) == _sorted(whole[0]) and _sorted(together[1]) == _sorted(whole[1])


def test_added_files_equal_a_full_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one, two = tmp_path / "in" / "a.csv", tmp_path / "in" / "b.csv"
    one.write_text("lipid,s1\nABC,1\nABC,-2\nDEF,x\n,3\n")
    two.write_text("lipid,s1,s2\nA,1\nXYZ,0,0,7\n")
    full = _sorted(workloads.validate_files(spark, str(tmp_path / "in")))
    states = str(tmp_path / "states")
    first = workloads.validate_added_files(spark, str(one), states)
    assert first.count() == 1
    one.unlink()  # what was added is not read again
    assert _sorted(workloads.validate_added_files(spark, str(two), states)) == full


def test_rows_are_read_once(spark, tmp_path):
    """All outputs are made of a state written by one job: the input is gone before they are asked for."""
    _table(spark, 3).write.parquet(str(tmp_path / "rows"))
    columns = spark.createDataFrame([(d, k, n, None) for d in "de" for k, n in enumerate(["name", "s1", "s2", "s3"])], "dataset_id string, col_idx int, column string, label string")
    issues, summary = validate.validate(spark.read.parquet(str(tmp_path / "rows")), columns)
    for p in (tmp_path / "rows").iterdir():
        p.unlink()
    assert issues.count() > 50 and summary.count() == 2


def test_messages_of_column_checks(spark):
    raw, cols = _raw(spark, ["lipid", "s1", "s2", "s3"], [["Aaa", "1", "-2", "0"], ["Bbb", "", "x", "0"], ["Ccc", "", "-1.5", "3"], ["Ddd", "2", "4", "0"]])
    found = {(r.check_id, json.loads(r.location)["column"]): r for r in validate.validate(raw, cols, max_missing_percent=40.0)[0].collect()}
    assert {k: (r.severity, r.message) for k, r in found.items()} == {
        ("V9", "s1"): ("error", "s1: 50.0% missing (2/4)"), ("V10", "s2"): ("error", "s2: 1 cells are not numbers"),
        ("V11", "s2"): ("warning", "s2: 2 negative values"), ("V12", "s3"): ("warning", "s3: 3 of 4 values are zero"),
    }
    assert json.loads(found["V11", "s2"].location)["examples"] == [{"row": 1, "text": "-2"}, {"row": 3, "text": "-1.5"}]
    assert json.loads(found["V9", "s1"].location)["missing_count"] == 2
    assert registry.QUERIES["v9_v12_messages"](spark, SMALL).where(F.col("message").isNull()).count() == 0
