"""Delimited files that Spark writes from the star-schema tables, for the queries that read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_path
from ..operators import export
from . import driver_tables as t

#: Customers in one of the many files.
CUSTOMERS_A_FILE = 250


def written(rows: DataFrame, order: str, name: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    """The path of ``rows`` written as one table of several files, each with the header, in ``order``, which is not in them."""
    path = shared_path(rows.sparkSession, name)
    given = {"header": True, "sep": sep, "encoding": encoding, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.options(**given).csv(path)
    return path


def quoted_table(spark: SparkSession, d: str) -> str:
    """Customers with commas, quotes, blanks at the ends and line ends inside quoted fields."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit('", '), "c_mktsegment")).otherwise(F.col("c_name"))
    note = F.when(key % 7 == 0, "first\nsecond").when(key % 5 == 0, "").otherwise("  padded ")
    return written(t.table(spark, d, "customer").select(key.alias("at"), key.alias("id"), name.alias("name"), note.alias("note")), "at", "quoted-table")


def accented_table(spark: SparkSession, d: str, encoding: str) -> str:
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("at"), F.concat(F.lit("Zürich "), "c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return written(rows, "at", "accented-table", ";", encoding)


def labelled_table(spark: SparkSession, d: str) -> str:
    """Customers below a row of labels, one of them blank."""
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("at"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    labels = spark.createDataFrame([(-1, "Label", "", "group 2")], rows.schema)
    return written(labels.unionByName(rows), "at", "labelled-table")


def many_files(spark: SparkSession, d: str) -> list[str]:
    """Folders of one file each: customers by blocks of their keys, with headers and delimiters of their own.

    Every fifth file has a field that is longer than the parser takes, in the row of its last customer.
    """
    path, key = shared_path(spark, "many-files"), F.col("c_custkey")
    customer = t.table(spark, d, "customer").withColumn("file", F.floor(key / CUSTOMERS_A_FILE).cast("int"))
    sep = F.element_at(F.array(*map(F.lit, [",", "\t", ";", "|"])), F.col("file") % 4 + 1)
    name = F.when((F.col("file") % 5 == 4) & (key % CUSTOMERS_A_FILE == CUSTOMERS_A_FILE - 1), F.repeat(F.lit("x"), F.lit(140_000))).otherwise(F.col("c_name"))
    data = customer.select("file", key.cast("long").alias("at"), F.array_join(F.array(key.cast("string"), name, "c_mktsegment"), ",").alias("line"), sep.alias("sep"))
    files = customer.select("file").distinct()
    head = files.select("file", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("id,name,segment "), F.col("file").cast("string")).alias("line"), sep.alias("sep"))
    lines = head.unionByName(data).select("file", "at", F.replace("line", F.lit(","), F.col("sep")).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    return [f"{path}/file={r['file']}" for r in files.collect()]


def id_names(spark: SparkSession, d: str) -> str:
    key = F.col("p_partkey")
    return written(t.table(spark, d, "part").select(key.alias("at"), F.concat(F.lit("LM"), key.cast("string")).alias("lm_id"), F.concat("p_brand", F.lit(', "'), "p_name", F.lit('"')).alias("name")), "at", "id-names")


def matrix_file(spark: SparkSession, d: str) -> str:
    """The wide matrix with tabs; names are in column 12, column 13 has a blank header."""
    ids = [f"NATION_{k}" for k in range(25)]
    wide = export.wide_matrix(t.quant(spark, d), ids)
    return written(wide.select(F.col("row_idx").alias("at"), *ids[:12], "input_name", F.lit(1).alias(" "), *ids[12:]), "at", "matrix-file", "\t")
