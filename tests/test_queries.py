import pytest

from adipose.jobs import registry
from compare import SMALL, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, SMALL)


@pytest.mark.parametrize("name", ["a1_group_statistics", "a2_column_profile", "v1_v16_issues", "r6_edges"])
def test_partitions_do_not_matter(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, registry.QUERIES[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
