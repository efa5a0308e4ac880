"""The library's tables, derived by Spark from the star-schema tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reference_tables as ref

DATASET = "orders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quant(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of each part per nation of its suppliers."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("input_name"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("sample_id"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    bought = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(supplier, "l_suppkey")
    sums = bought.groupBy(F.col("l_partkey").alias("row_idx"), "n_nationkey").agg(F.sum("l_quantity").alias("value"))
    return sums.join(nation, "n_nationkey").join(part, "row_idx").select(F.lit(DATASET).alias("dataset_id"), "row_idx", "input_name", F.col("n_nationkey").alias("ordinal"), "sample_id", "value")


QUANT = """q AS (
  SELECT l_partkey AS row_idx, p_name AS input_name, n_name AS sample_id, sum(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY l_partkey, p_name, n_name
)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Nations as samples, regions as their groups."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("group"))
    return table(spark, d, "nation").join(region, "n_regionkey").select(F.lit(DATASET).alias("dataset_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("sample_id"), "group")


SAMPLES = "s AS (SELECT n_nationkey AS ordinal, n_name AS sample_id, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"


def lipids(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a lipid; with a name the table does not have for every 11th."""
    name = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("PC-"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.lit(DATASET).alias("dataset_id"), F.col("p_partkey").alias("row_idx"), name.alias("input_name"))


LIPIDS = "l AS (SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 11 = 0 THEN 'PC-' || p_name ELSE p_name END AS input_name FROM part)"


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    """The name table as it is read: strings, dashes, blanks, repeated names, masses that are no numbers."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_name").alias("input_name"),
        F.when(F.length("p_name") % 4 == 0, "-").otherwise(F.initcap("p_name")).alias("standardized_name"),
        F.when(key % 3 == 0, "-").when(key % 3 == 1, "").otherwise(F.concat(F.lit("LM"), key.cast("string"))).alias("lm_id"),
        F.when(key % 5 == 0, "heavy").otherwise(F.col("p_size").cast("string")).alias("exact_mass"),
        F.col("p_brand").alias("main_class"), F.col("p_type").alias("sub_class"), key.alias("line"),
    )


def names(spark: SparkSession, d: str) -> DataFrame:
    return ref.clean_names(raw_names(spark, d), "line")


NAMES = """r AS (
  SELECT p_partkey AS line, p_name AS input_name,
         CASE WHEN length(p_name) % 4 = 0 THEN NULL ELSE upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) END AS standardized_name,
         CASE WHEN p_partkey % 3 = 2 THEN 'LM' || p_partkey END AS lm_id,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS exact_mass, p_brand AS main_class, p_type AS sub_class
  FROM part
), n AS (
  SELECT input_name, standardized_name, lm_id, exact_mass, main_class, sub_class FROM (SELECT *, row_number() OVER (PARTITION BY input_name ORDER BY line DESC) AS k FROM r) WHERE k = 1
)"""


def structures(spark: SparkSession, d: str) -> DataFrame:
    """Structures under several names, half of them without id."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.when(key % 4 == 0, F.col("p_name")).alias("name"), F.when(key % 2 == 0, F.concat(F.lit("LMS"), key.cast("string"))).alias("lm_id"), F.initcap("p_name").alias("sys_name"), F.col("p_brand").alias("abbrev"), F.col("p_type").alias("abbrev_chains"),
    )


STRUCTURES = """t AS (
  SELECT p_partkey, p_name, 'LMS' || p_partkey AS lm_id, p_brand, p_type,
         upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS sys_name
  FROM part WHERE p_partkey % 2 = 0
), ek AS (
  SELECT 0 AS prio, 'name' AS matched_field, p_name AS key, lm_id FROM t WHERE p_partkey % 4 = 0
  UNION ALL SELECT 1, 'sys_name', sys_name, lm_id FROM t UNION ALL SELECT 2, 'abbrev', p_brand, lm_id FROM t UNION ALL SELECT 3, 'abbrev_chains', p_type, lm_id FROM t
), k AS (
  SELECT key, matched_field, lm_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, lm_id) AS i FROM ek) WHERE i = 1
)"""


def headgroups(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each brand and type with its ids; one is empty."""
    part = table(spark, d, "part")
    both = part.select(F.regexp_extract("p_name", r"^([A-Za-z0-9\-]+)", 1).alias("headgroup"), F.col("p_partkey").alias("ord")).unionByName(part.select(F.regexp_extract(F.concat(F.lit("PC-"), "p_name"), r"^([A-Za-z0-9\-]+)", 1).alias("headgroup"), F.col("p_partkey").alias("ord")))
    ids = F.when(F.col("headgroup") == "red", F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("LMH"), F.col("ord").cast("string")), F.lit("fragment")))
    return both.select("headgroup", ids.alias("lm_ids"), "ord")


HEADGROUPS = """h AS (
  SELECT w AS headgroup, CASE WHEN w <> 'red' THEN 'LMH' || max(p_partkey) END AS head_id
  FROM (SELECT split_part(p_name, ' ', 1) AS w, p_partkey FROM part UNION ALL SELECT 'PC-' || split_part(p_name, ' ', 1), p_partkey FROM part) GROUP BY w
)"""


def reactions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reactions: returned lines are reactants, accepted ones products, new ones genes."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").join(part, "l_partkey")
    null = F.lit(None).cast("string")
    compound = F.struct(
        F.when(F.col("l_linestatus") == "O", "lm_main").otherwise("other").alias("compound_type"), F.when(F.col("l_partkey") % 5 != 0, F.col("p_name")).alias("compound_name"),
        F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("LM"), F.col("l_partkey").cast("string"))).alias("compound_lm_id"), null.alias("compound_sys_name"), null.alias("compound_synonyms"), F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("compound_generic_id"),
    )
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", compound.alias("compound"))
    side = lambda flag: F.transform(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, item))), lambda x: x["compound"])
    built = lines.groupBy(F.col("l_orderkey").alias("reaction_ord")).agg(side("R").alias("reactants"), side("A").alias("products"), side("N").alias("genes"))
    key = F.col("reaction_ord")
    enzymes = F.when(key % 4 != 0, F.array(F.concat(F.lit("E"), (key % 10).cast("string")), F.lit("E0")))
    free = F.array().cast("array<map<string,string>>")
    return built.select("reaction_ord", F.col("reaction_ord").alias("reaction_id"), F.concat(F.lit("order "), F.col("reaction_ord").cast("string")).alias("reaction_name"), "reactants", "products", "genes", free.alias("proteins"), free.alias("curations"), free.alias("pathways"), enzymes.alias("enzyme_ids"), F.array(F.concat(F.lit("P"), (key % 7).cast("string"))).alias("pathway_ids"))


PARTICIPANTS = """p AS (
  SELECT l_orderkey AS reaction_ord, CASE l_returnflag WHEN 'R' THEN 'reactant' ELSE 'product' END AS role, l_linestatus = 'O' AS main,
         CASE WHEN l_partkey % 7 <> 0 THEN 'LM' || l_partkey END AS lm_id,
         CASE WHEN l_partkey % 5 <> 0 THEN p_name WHEN l_partkey % 7 <> 0 THEN 'LM' || l_partkey ELSE 'G' || l_suppkey END AS display,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) - 1 AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A')
)"""


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a lipid row with an id that reactions know, or none."""
    part, key = table(spark, d, "part"), F.col("p_partkey")
    return part.select(F.lit(DATASET).alias("dataset_id"), key.alias("row_idx"), F.col("p_name").alias("input_name"), F.when(key % 3 != 0, F.concat(F.lit("LM"), (key % 500).cast("string"))).alias("lm_id"))


OBSERVED = "o AS (SELECT p_partkey AS row_idx, p_name AS input_name, CASE WHEN p_partkey % 3 <> 0 THEN 'LM' || (p_partkey % 500) END AS lm_id FROM part)"

COLUMNS = ["name", "balance", "segment", "nation", "nation"]


def customer_lines(spark: SparkSession, d: str) -> DataFrame:
    """(dataset_id, row_idx, line): customers as comma-separated lines, one dataset a nation.

    Names repeat, are short, blank or placeholders; balances are blank or no numbers; lines are ragged.
    """
    key = F.col("c_custkey")
    name = F.when(key % 17 == 0, "").when(key % 19 == 0, "NA").when(key % 23 == 0, "12").when(key % 29 == 0, "unknown 1").when(key % 31 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    balance = F.when(key % 7 == 0, "").when(key % 11 == 0, "n/a").when(key % 13 == 0, " 1_000 ").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    zero = F.when(key % 3 == 0, F.lit("5")).otherwise(F.lit("0"))
    nation = F.col("c_nationkey").cast("string")
    fields = F.when(key % 37 == 0, F.array(name, balance)).when(key % 41 == 0, F.array(name, balance, "c_mktsegment", zero, nation, F.lit("surplus"), F.lit("2"))).when(key % 43 == 0, F.array(name, F.lit(""), F.lit(""), F.lit(""), F.lit(""))).otherwise(F.array(name, balance, "c_mktsegment", zero, nation))
    return table(spark, d, "customer").select(F.concat(F.lit("nation "), nation).alias("dataset_id"), (key + 1).alias("row_idx"), F.array_join(fields, ",").alias("line"))


LINES = """f AS (
  SELECT 'nation ' || c_nationkey AS dataset_id, c_custkey + 1 AS row_idx, c_custkey AS key,
         CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'NA' WHEN c_custkey % 23 = 0 THEN '12' WHEN c_custkey % 29 = 0 THEN 'unknown 1' WHEN c_custkey % 31 = 0 THEN c_mktsegment ELSE c_name END AS name,
         CASE WHEN c_custkey % 37 <> 0 AND c_custkey % 41 <> 0 AND c_custkey % 43 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'n/a' WHEN c_custkey % 13 = 0 THEN '1_000' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS c1,
         CASE WHEN c_custkey % 37 = 0 OR (c_custkey % 41 <> 0 AND c_custkey % 43 = 0) THEN '' ELSE c_mktsegment END AS c2,
         CASE WHEN c_custkey % 37 = 0 OR (c_custkey % 41 <> 0 AND c_custkey % 43 = 0) THEN '' WHEN c_custkey % 3 = 0 THEN '5' ELSE '0' END AS c3,
         CASE WHEN c_custkey % 37 = 0 OR (c_custkey % 41 <> 0 AND c_custkey % 43 = 0) THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS c4,
         c_custkey % 37 = 0 AS short, c_custkey % 37 <> 0 AND c_custkey % 41 = 0 AS longer
  FROM customer
), c AS (
  SELECT dataset_id, row_idx, col_idx, text, TRY_CAST(CASE WHEN text = 'n/a' THEN NULL ELSE replace(text, '_', '') END AS DOUBLE) AS value
  FROM (SELECT dataset_id, row_idx, 1 AS col_idx, c1 AS text FROM f UNION ALL SELECT dataset_id, row_idx, 2, c2 FROM f UNION ALL SELECT dataset_id, row_idx, 3, c3 FROM f UNION ALL SELECT dataset_id, row_idx, 4, c4 FROM f)
)"""


def column_names(spark: SparkSession, d: str) -> DataFrame:
    """The header of every customer dataset, with a repeated name."""
    nation = table(spark, d, "customer").select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("dataset_id")).distinct()
    return nation.select("dataset_id", F.posexplode(F.array(*map(F.lit, COLUMNS))).alias("col_idx", "column")).withColumn("label", F.when(F.col("col_idx") > 1, F.concat(F.lit("label "), F.col("col_idx").cast("string"))))
