"""The tables that names, ids and reactions are looked up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dashed, filled, first_filled, number, strip

# fixed values: header names of the name table and the fields they fill
NAME_COLUMNS = {
    "Input name": "input_name",
    "Standardized name": "standardized_name",
    "LM_ID": "lm_id",
    "Formula": "formula",
    "Exact mass": "exact_mass",
    "Super class": "super_class",
    "Main class": "main_class",
    "Sub class": "sub_class",
    "ChEBI_ID": "chebi_id",
    "KEGG_ID": "kegg_id",
    "RefMet_ID": "refmet_id",
}
COMPOUND = "struct<compound_type:string,compound_name:string,compound_lm_id:string,compound_sys_name:string,compound_synonyms:string,compound_generic_id:string>"
REACTION = f"struct<reaction_id:bigint,id:bigint,reaction_name:string,type:string,enzyme_ids:array<string>,pathway_ids:array<string>,reactants:array<{COMPOUND}>,products:array<{COMPOUND}>,genes:array<{COMPOUND}>,proteins:array<map<string,string>>,curations:array<map<string,string>>,pathways:array<map<string,string>>>"
STRUCTURE = "struct<input_name:string,name:string,lm_id:string,sys_name:string,abbrev:string,abbrev_chains:string,matched_field:string>"


def clean_names(table: DataFrame, order: str) -> DataFrame:
    """``table`` with the name fields cleaned, one row an input name: the last by ``order``.

    A dash is null in every field; empty is null but in the two names; a mass that is no number is
    null; rows without input name go.
    """
    fields = []
    for name in NAME_COLUMNS.values():
        c = dashed(F.col(name).cast("string")) if name in table.columns else F.lit(None).cast("string")
        c = c if name in ("input_name", "standardized_name") else filled(c)
        fields.append((c.try_cast("double") if name == "exact_mass" else c).alias(name))
    rows = table.select(*fields, F.col(order).alias("__order")).where("input_name is not null and input_name <> ''")
    return rows.groupBy("input_name").agg(F.max_by(F.struct(*[x for x in NAME_COLUMNS.values() if x != "input_name"]), "__order").alias("last")).select("input_name", "last.*")


def name_table(spark: SparkSession, path: str) -> DataFrame:
    """The name table of a tab-separated file; absent columns are null, the last of equal names wins."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    known = [F.col(f"`{c}`").alias(NAME_COLUMNS[c]) for c in raw.columns if c in NAME_COLUMNS]
    return clean_names(raw.select(*known, F.monotonically_increasing_id().alias("line")), "line")


def structures_from_json(texts: DataFrame, text: str = "text") -> DataFrame:
    """Structure hits in JSON documents: a list, one object, or an object with ``error`` alone.

    An error object gives a row with ``error`` set; empty text gives none.
    """
    body = F.trim(F.col(text))
    wrapped = F.when(body.startswith("["), body).when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]")))
    kind = f"array<{STRUCTURE[:-1]},error:string>>"
    hit = texts.select(F.explode(F.from_json(wrapped, kind)).alias("h")).select("h.*")
    return hit.select(*[filled(F.col(c)).alias(c) for c in hit.columns])


def structure_table(spark: SparkSession, path: str) -> DataFrame:
    """Structure hits of a tab-separated file; header names in any case, empty is null.

    ``abbrev_chains`` is a number here, null where the text is none; in JSON it stays as it is.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    have = {c.lower(): c for c in raw.columns}
    names = [x.split(":")[0] for x in STRUCTURE.removeprefix("struct<").removesuffix(">").split(",")]
    cell = lambda n: filled(strip(F.col(f"`{have[n]}`"))) if n in have else F.lit(None).cast("string")
    return raw.select(*[(number(cell(n)) if n == "abbrev_chains" else cell(n)).alias(n) for n in names])


def structure_keys(table: DataFrame) -> DataFrame:
    """(key, matched_field, lm_id): for each name under which a structure is found its best hit.

    Fields count in the order name, sys_name, abbrev, abbrev_chains; equal ones by smallest id.
    """
    order = ["name", "sys_name", "abbrev", "abbrev_chains"]
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("prio"), F.lit(f).alias("matched_field"), F.col(f).cast("string").alias("key")) for k, f in enumerate(order)]), lambda x: x["key"].isNotNull() & (x["key"] != ""))
    rows = table.where("lm_id is not null and lm_id <> ''").select("lm_id", F.explode(hits).alias("h")).select("h.*", "lm_id")
    return rows.groupBy("key").agg(F.min(F.struct("prio", "lm_id", "matched_field")).alias("best")).select("key", "best.matched_field", "best.lm_id")


def reactions_from_json(texts: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Reactions of JSON arrays, one text a row; items that are no reactions are left out.

    ``reaction_ord`` numbers them inside a text; ``order`` columns are carried along. ``id`` stands in
    for a ``reaction_id`` that is absent.
    """
    items = texts.select(*(order or []), F.posexplode(F.from_json(text, "array<string>")).alias("reaction_ord", "item"))
    parsed = items.select(*(order or []), F.col("reaction_ord").cast("long"), F.from_json("item", REACTION).alias("r"))
    named = parsed.withColumn("r", F.col("r").withField("reaction_id", F.coalesce("r.reaction_id", "r.id")).dropFields("id"))
    return named.where("r.reaction_id is not null or r.reactants is not null or r.products is not null").select(*(order or []), "reaction_ord", "r.*")


def headgroup_table(rows: DataFrame, valid_ids_only: bool = False) -> DataFrame:
    """(headgroup, lm_ids); the last of equal keys by ``ord`` wins; on request only ids that begin with LM."""
    last = rows.groupBy("headgroup").agg(F.max_by("lm_ids", "ord").alias("lm_ids"))
    return last.select("headgroup", F.filter("lm_ids", lambda x: x.startswith("LM")).alias("lm_ids")) if valid_ids_only else last


def id_name_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(T.StructType([T.StructField("lm_id", T.StringType()), T.StructField("name", T.StringType())])).csv(path)


def display_name(c: Column) -> Column:
    """First of a compound's name, id and generic id that is not empty."""
    return F.coalesce(first_filled(c["compound_name"], c["compound_lm_id"], c["compound_generic_id"]), F.lit("Unknown"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
