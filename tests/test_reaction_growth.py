"""Chains counted without a list, links made once, and reactions read once."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from adipose.operators import reactions
from test_levels import _graph
from test_operators import _compound, _reactions


def _table(spark, rows):
    c = lambda ids: [_compound("lm_main", None, f"LM{x}") for x in ids]
    return _reactions(spark, [(c(a), c(b)) for a, b in rows])


def _dense(seed, n=40, compounds=9):
    """Reactions that share several compounds, take what they make, and repeat compounds."""
    r = random.Random(seed)
    return [([r.randrange(compounds) for _ in range(r.randint(0, 4))], [r.randrange(compounds) for _ in range(r.randint(0, 4))]) for _ in range(n)]


def _links(rows):
    return {(i, j) for i, (_, b) in enumerate(rows) for j, (a, _) in enumerate(rows) if i != j and set(a) & set(b)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_are_counted_as_listed(spark, seed):
    rows = _dense(seed)
    links = _links(rows)
    want = collections.Counter((1, i) for i, _ in links)
    after = collections.defaultdict(list)
    for i, j in links:
        after[i].append(j)
    want.update((2, i) for i, j in links for k in after[j] if k != i)
    got = {(x.hops, x.reaction_ord): int(x.chains) for x in reactions.chain_counts(_table(spark, rows)).collect()}
    assert got == dict(want) and any(k[0] == 2 for k in got)


def test_chain_counts_equal_chains_and_may_be_none(spark):
    _, table = _graph(spark, 4, False)
    listed = collections.Counter((x.hops, x.path[0]) for x in reactions.chains(table, 2).collect())
    assert {(x.hops, x.reaction_ord): int(x.chains) for x in reactions.chain_counts(table).collect()} == dict(listed)
    assert reactions.chain_counts(_table(spark, [([1], [2]), ([], [])])).collect() == []


def test_chains_over_a_hub_are_not_listed(spark):
    n = 6_000  # each makes and each takes the hub: 9 million links, 5.4e10 chains of two steps in a list
    ids = [[0] for _ in range(n)]
    table = _table(spark, [*zip(ids, ids)])
    total = {x.hops: int(x.n) for x in reactions.chain_counts(table).groupBy("hops").agg(F.sum("chains").alias("n")).collect()}
    assert total == {1: n * (n - 1), 2: n * (n - 1) * (n - 2)}


@pytest.mark.parametrize("hub", [2, 1000])
def test_links_come_once(spark, monkeypatch, hub):
    monkeypatch.setattr(reactions, "HUB", hub)
    for rows in (_dense(5), _dense(6, 12, 200), [(list(range(90)), list(range(90)))] * 3):
        got = [tuple(x) for x in reactions.next_reactions(_table(spark, rows)).collect()]
        assert sorted(got) == sorted(_links(rows))


def test_only_open_links_are_made_distinct(spark):
    rows = [([k], [k + 1]) for k in range(300)] + [([1000, 1001], []), ([], [1000, 1001])]
    sides = reactions._marked(reactions._sides(_table(spark, rows))).collect()
    assert {x.others == 0 for x in sides if x.reaction_ord < 300} == {True}
    assert all(x.others != 0 for x in sides if x.reaction_ord >= 300) and len(sides) == 604


def _scans(df, what="ExistingRDD"):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def test_participants_read_reactions_once(spark):
    table = _table(spark, _dense(7))
    assert _scans(reactions.participants(table)) == 1
    assert _scans(reactions.compound_links(table)) == 1


def test_links_are_written_once(spark):
    table = _table(spark, _dense(8))
    ids = spark.createDataFrame([("LM1",), ("LM4",), (None,), ("",)], "lm_id string")
    links = reactions.reaction_links(table, ids, details=True)
    assert _scans(links) == 0 and _scans(links, "Join") == 0
    want = [(k, role, pos, f"LM{x}") for k, (a, b) in enumerate(_dense(8)) for role, side in (("reactant", a), ("product", b)) for pos, x in enumerate(side) if x in (1, 4)]
    assert sorted((x.reaction_ord, x.role, x.pos, x.lm_id) for x in links.collect()) == sorted(want)


def test_lipids_of_one_part_are_dealt_before_they_are_expanded(spark):
    table = _table(spark, [([1], [2])] * 50)
    lipids = spark.range(100).select(F.col("id").alias("row_idx"), F.lit("a").alias("input_name"), F.lit("LM1").alias("lm_id")).coalesce(1)
    found = reactions.lipid_reactions(lipids, reactions.reaction_links(table, lipids))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in tasks) == 5_000 and len(tasks) > 1
