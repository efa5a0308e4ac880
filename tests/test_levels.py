"""Chains counted by levels, the core of cycles, chains from asked starts, and lists in parts."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from adipose.functions.tables import lists_in_parts
from adipose.operators import export, joins, reactions, validate
from test_operators import _compound, _reactions
from test_sources import _raw


def _graph(spark, seed, acyclic):
    r = random.Random(seed)
    rows = []
    for k in range(24):
        takes = {r.randint(0, k) if acyclic else r.randint(0, 14) for _ in range(r.randint(1, 2))}
        makes = {k + r.randint(1, 4) if acyclic else r.randint(0, 30) for _ in range(r.randint(1, 3))}
        rows.append((sorted(takes), sorted(makes)))
    c = lambda ids: [_compound("lm_main", None, f"LM{x}") for x in ids]
    return rows, _reactions(spark, [(c(a), c(b)) for a, b in rows])


def _steps(rows):
    return collections.Counter((i, j) for i, (_, b) in enumerate(rows) for j, (a, _) in enumerate(rows) if i != j for _ in set(a) & set(b))


@pytest.mark.parametrize("acyclic", [True, False])
@pytest.mark.parametrize("bound", [0, 200_000])
def test_walks_by_levels(spark, monkeypatch, acyclic, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    rows, table = _graph(spark, 3, acyclic)
    steps, level, want = _steps(rows), {k: 1 for k in range(len(rows))}, {}
    for hop in range(1, 5):
        ahead = collections.Counter()
        for (i, j), n in steps.items():
            ahead[j] += n * level.get(i, 0)
        level = {k: n for k, n in ahead.items() if n}
        want |= {(hop, k): n for k, n in level.items()}
    assert {(r.hops, r.reaction_ord): int(r.walks) for r in reactions.walk_counts(table, 4).collect()} == want


def test_core_of_cycles(spark):
    rows, table = _graph(spark, 5, False)
    left = set(range(len(rows)))
    steps = set(_steps(rows))
    while True:
        kept = {k for k in left if any(j == k and i in left for i, j in steps) and any(i == k and j in left for i, j in steps)}
        if kept == left:
            break
        left = kept
    got = {r.reaction_ord for r in reactions.cycle_core(table).collect()}
    assert got == left and 0 < len(left) < len(rows)
    outside = table.select("reaction_ord").join(reactions.cycle_core(table), "reaction_ord", "left_anti")
    clear = reactions.walk_counts(table, 3, within=outside)
    free = {r.reaction_ord for r in outside.collect()}
    paths = [(i, j) for (i, j), n in _steps(rows).items() if i in free and j in free for _ in range(n)]
    assert sum(int(r.walks) for r in clear.where("hops = 1").collect()) == len(paths)
    assert reactions.cycle_core(_graph(spark, 6, True)[1]).collect() == []


def test_chains_from_asked_starts(spark):
    _, table = _graph(spark, 7, False)
    every = {tuple(r.path) for r in reactions.chains(table, 3).collect()}
    starts = spark.createDataFrame([(2,), (9,), (9,), (99,)], "reaction_ord long")
    got = [tuple(r.path) for r in reactions.chains_from(table, starts, 3).collect()]
    assert sorted(got) == sorted(p for p in every if p[0] in (2, 9)) and got


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_lists_in_parts(spark, size):
    r = random.Random(size)
    items = [(r.choice(["hub", "hub", "b", f"k{k % 40}"]), r.randint(0, 300), f"x{k}") for k in range(1500)]
    frame = spark.createDataFrame(items, "key string, at int, what string").repartition(5)
    found = collections.defaultdict(dict)
    for row in lists_in_parts(frame, ["key"], ["at", "what"], size).collect():
        assert 0 < len(row["items"]) <= size
        found[row.key][row.part] = [tuple(x) for x in row["items"]]
    want = collections.defaultdict(list)
    for k, at, what in sorted(items):
        want[k].append((at, what))
    assert {k: [x for n in range(len(p)) for x in p[n]] for k, p in found.items()} == want


def test_report_with_its_issues(spark):
    raw, cols = _raw(spark, ["lipid", "s1"], [["", "x"]] * 30 + [["ABC", "1"]])
    clean = _raw(spark, ["lipid", "s1"], [["ABC", "1"]])
    raw = raw.unionByName(clean[0].withColumn("dataset_id", F.lit("e")))
    cols = cols.unionByName(clean[1].withColumn("dataset_id", F.lit("e")))
    issues, summary = validate.validate(raw, cols)
    rows = export.report_parts(issues, summary, size=8).orderBy("dataset_id", "part").collect()
    assert [(r.dataset_id, r.part, len(r.issues), r.issue_count, r.passed) for r in rows] == [("d", 0, 8, 31, False), ("d", 1, 8, 31, False), ("d", 2, 8, 31, False), ("d", 3, 7, 31, False), ("e", 0, 0, 0, True)]
    assert sorted(x.check_id for r in rows for x in r.issues) == ["V10"] + ["V8"] * 30 and rows[0].issues[0].message


def test_matrix_of_12000_samples_equals_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(export, "BROADCAST_ENTRIES", 0)
    n = 12_000
    samples = spark.range(n).select(F.lit("d").alias("dataset_id"), (F.col("id") * 3).cast("int").alias("ordinal"), F.concat(F.lit("s"), "id").alias("sample_id"))
    rows = spark.range(12 * n).select((F.col("id") % 12).alias("row_idx"), F.floor(F.col("id") / 12).alias("k")).where("(k + 1) * (row_idx + 3) % 7 < 4 and (row_idx < 11 or k < 40)")
    quant = rows.select(F.lit("d").alias("dataset_id"), "row_idx", F.concat(F.lit("n"), "row_idx").alias("input_name"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("sample_id"), (F.col("k") + F.col("row_idx") / 16).alias("value"))
    got = {(r.row_idx, r.block): list(r["values"]) for r in export.dense_matrix(quant, samples, block=500).collect()}
    sql = f"""WITH q AS (SELECT r, k, CASE WHEN (k + 1) * (r + 3) % 7 < 4 AND (r < 11 OR k < 40) THEN k + r / 16 END AS value FROM range(12) AS a(r), range({n}) AS b(k))
    SELECT r, k // 500, list(value ORDER BY k) FROM q GROUP BY r, k // 500 HAVING count(value) > 0"""
    assert got == {(r, b): v for r, b, v in duckdb.sql(sql).fetchall()}
    assert len(got) == 11 * 24 + 1
