"""Joins split by heavy hitters: the rows of a plain join, and no task with far more than the others."""

import pytest
from pyspark.sql import functions as F

from adipose.operators import annotate, joins, reactions
from test_operators import NAME, _compound, _reactions


@pytest.fixture
def large(monkeypatch):
    """No reference table is small enough to be broadcast whole."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 50)


def _rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    return spark.range(30_000).select("id", key.alias("key")).repartition(12)


def _side(spark):
    """Unique keys, the hot one among them, and a null."""
    return spark.range(900).select(F.when(F.col("id") == 5, "hot").when(F.col("id") == 6, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), F.col("id").alias("found"))


def _sorted(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def _even(frame):
    """Rows of the tasks that have any: the largest has at most twice the median's."""
    sizes = sorted(r[1] for r in frame.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_third_of_the_rows_on_one_key(spark, large, how):
    rows, side = _rows(spark), _side(spark)
    assert joins.hot_keys(rows, "key") == ["hot"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got, plain = joins.reference_join(rows, side, "key", how), rows.join(side, "key", how)
        assert got.columns == plain.columns and _sorted(got) == _sorted(plain)
        assert _even(got) and not _even(plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_with_many_reference_rows_is_salted(spark, large, monkeypatch):
    monkeypatch.setattr(joins, "SALTS", 4)
    rows = _rows(spark).where("id < 2000")
    side = _side(spark).unionByName(spark.range(70).select(F.lit("hot").alias("key"), F.col("id").alias("found")))
    assert _sorted(joins.reference_join(rows, side, "key", "inner")) == _sorted(rows.join(side, "key", "inner"))


def test_small_tables_and_no_hot_key(spark, large):
    few = spark.createDataFrame([(k, f"k{k}") for k in range(400)], "id long, key string")
    side = _side(spark)
    assert joins.hot_keys(few, "key") == [] and joins.hot_keys(few.where("false"), "key") == []
    for how in ("left", "inner"):
        assert _sorted(joins.reference_join(few, side, "key", how)) == _sorted(few.join(side, "key", how))
        assert _sorted(joins.reference_join(few, side.limit(10), "key", how)) == _sorted(few.join(side.limit(10), "key", how))
    assert joins.reference_join(few.where("false"), side, "key").collect() == []


def test_annotation_with_hot_names(spark, large):
    lipids = spark.range(900).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, "PC hot").when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("n"), "id")).alias("input_name"))
    names = spark.createDataFrame([("PC hot", "Hot", None, *[None] * 8), *[(f"n{k}", f"N{k}", f"LM{k}" if k % 3 else None, *[None] * 8) for k in range(300)]], NAME)
    keys = spark.createDataFrame([("Hot", "name", "LMH"), *[(f"N{k}", "abbrev", f"LMS{k}") for k in range(0, 300, 6)], *[(f"z{k}", "name", "LMZ") for k in range(60)]], "key string, matched_field string, lm_id string")
    heads = spark.createDataFrame([(f"n{k}", [f"LMG{k}"]) for k in range(250, 400)], "headgroup string, lm_ids array<string>")

    def chain():
        return annotate.fill_from_headgroups(annotate.fill_from_structures(annotate.standardise(lipids, names), keys), heads)

    got = chain()
    joins.BROADCAST_ROWS = 200_000  # all tables whole
    want = chain()
    assert got.columns == want.columns and _sorted(got) == _sorted(want) and got.count() == 900


def test_links_and_components_of_a_hot_compound(spark, large):
    m = "lm_main"
    table = _reactions(spark, [([_compound(m, "h", "LM0"), _compound(m, "b", f"LM{k}")], [_compound(m, "c", f"LM{k + 1}")]) for k in range(1, 80)])
    lipids = spark.range(300).select(F.col("id").alias("row_idx"), F.lit("x").alias("input_name"), F.concat(F.lit("LM"), F.when(F.col("id") % 3 > 0, F.col("id") % 90).otherwise(0).cast("string")).alias("lm_id"))
    links = reactions.reaction_links(table, lipids)
    assert _sorted(reactions.lipid_reactions(lipids, links)) == _sorted(lipids.select("row_idx", "input_name", "lm_id").join(links, "lm_id"))
    each = reactions.participants(table).select("reaction_ord", "role", "pos", F.col("compound.compound_lm_id").alias("lm_id"))
    assert _sorted(reactions.component_lipids(table, lipids)) == _sorted(each.join(lipids.select("lm_id", "row_idx"), "lm_id").select("reaction_ord", "role", "pos", "lm_id", "row_idx"))


def _exchanges(frame):
    """(shuffles, those right above a read of a bucketed table, bucketed reads) of the plan that ran."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    above = sum(a.startswith("Exchange hash") and "Bucketed: true" in "".join(lines[i + 1 : i + 5]) for i, a in enumerate(lines))
    return sum(x.startswith("Exchange") for x in lines), above, sum("Bucketed: true" in x for x in lines)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_reference_in_buckets_does_not_move(spark, large, how, tmp_path):
    rows, side = spark.range(3000).select("id", F.concat(F.lit("k"), (F.col("id") % 997).cast("string")).alias("key")).repartition(12), _side(spark)
    side = side.unionByName(side.where("found % 7 = 0"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for buckets in (4, 16):
            table = joins.bucket_reference(side, "key", f"buckets_{how}_{buckets}", buckets, f"file://{tmp_path}/{how}{buckets}")
            assert len(list((tmp_path / f"{how}{buckets}").glob("part-*"))) <= buckets
            got = joins.reference_join(rows, table.select("key", "found"), "key", how, bucketed=True)
            assert _sorted(got) == _sorted(rows.join(side, "key", how))
            # one deals the rows out at first (repartition), one brings them to the buckets
            shuffles, above, read = _exchanges(got)
            assert read == 1 and above == 0 and shuffles <= 3
            plain = _exchanges(joins.reference_join(rows, side, "key", how))
            assert plain[0] > shuffles
        hot = joins.reference_join(_rows(spark), table, "key", how, bucketed=True)
        assert _sorted(hot) == _sorted(_rows(spark).join(side, "key", how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_names_and_structures(spark, large):
    lipids = spark.range(500).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, "PC hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), "id")).alias("input_name"))
    names = spark.createDataFrame([("PC hot", "Hot", None, *[None] * 8), (None, "none", "LM", *[None] * 8), *[(f"n{k}", f"N{k}", f"LM{k}" if k % 3 else None, *[None] * 8) for k in range(300)]], NAME)
    keys = spark.createDataFrame([("Hot", "name", "LMH"), *[(f"N{k}", "abbrev", f"LMS{k}") for k in range(0, 300, 6)], *[(f"z{k}", "name", "LMZ") for k in range(60)]], "key string, matched_field string, lm_id string")
    want = annotate.fill_from_structures(annotate.standardise(lipids, names), keys)
    stored_names, stored_keys = joins.bucket_reference(names, "input_name", "some_names"), joins.bucket_reference(keys, "key", "some_keys")
    got = annotate.fill_from_structures(annotate.standardise(lipids, stored_names, bucketed=True), stored_keys, bucketed=True)
    assert got.columns == want.columns and _sorted(got) == _sorted(want) and got.count() == 500
    pair = [annotate.annotate_table(lipids, n, "input_name", bucketed=b) for n, b in ((names, False), (stored_names, True))]
    assert _sorted(pair[0]) == _sorted(pair[1])
    # a table of the same name is replaced, and an empty one gives no hit
    assert joins.reference_join(lipids, joins.bucket_reference(names.where("false"), "input_name", "some_names"), "input_name", bucketed=True).where("standardized_name is not null").count() == 0
