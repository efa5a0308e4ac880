"""Names, classes and ids of lipids by joins with reference tables, with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, first_filled
from .joins import reference_join

NAME_FIELDS = ["standardized_name", "lm_id", "formula", "exact_mass", "super_class", "main_class", "sub_class", "chebi_id", "kegg_id", "refmet_id"]


def standardise(lipids: DataFrame, names: DataFrame, bucketed: bool = False) -> DataFrame:
    """``lipids`` with the fields of the name table (unique on input_name) and who found them.

    Values that were there are overwritten. Frequent names don't meet in one task (``joins``), which
    also says what ``bucketed`` tables are, here and below.
    """
    kept = [c for c in lipids.columns if c not in [*NAME_FIELDS, "mass", "standardized_by", "lm_id_found_by"]]
    joined = reference_join(lipids.select(kept), names.select("input_name", *NAME_FIELDS), "input_name", bucketed=bucketed)
    by = lambda c: F.when(F.col(c) != "", "RefMet")
    return joined.select(*kept, *[F.col(c).alias("mass") if c == "exact_mass" else F.col(c) for c in NAME_FIELDS], by("standardized_name").alias("standardized_by"), by("lm_id").alias("lm_id_found_by"))


def annotate_table(table: DataFrame, names: DataFrame, name_col: str, bucketed: bool = False) -> DataFrame:
    """``table`` with ``refmet_result``, the name table's row for ``name_col``; the row count stays."""
    result = names.select(F.col("input_name").alias("__key"), F.struct("input_name", *NAME_FIELDS).alias("refmet_result"))
    return reference_join(table.withColumn("__key", F.col(name_col)), result, "__key", bucketed=bucketed).drop("__key")


def _absent(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def fill_from_structures(lipids: DataFrame, keys: DataFrame, use_standardized_name: bool = True, bucketed: bool = False) -> DataFrame:
    """``lipids`` whose missing ids are filled from ``keys`` (key, matched_field, lm_id); others stay.

    Adds ``matched_field`` and ``was_filled``.
    """
    asked = first_filled(F.col("standardized_name"), F.col("input_name")) if use_standardized_name else F.col("input_name")
    hit = keys.select(F.col("key").alias("__key"), F.col("matched_field").alias("__field"), F.col("lm_id").alias("__id"))
    joined = lipids.drop("matched_field", "was_filled").withColumn("__key", F.when(_absent("lm_id"), asked))
    joined = reference_join(joined, hit, "__key", bucketed=bucketed)
    took = F.col("__id").isNotNull()
    return joined.select(
        *[c for c in lipids.columns if c not in ("lm_id", "lm_id_found_by", "matched_field", "was_filled")],
        F.when(took, F.col("__id")).otherwise(F.col("lm_id")).alias("lm_id"),
        F.when(took, "LMSD").otherwise(F.col("lm_id_found_by")).alias("lm_id_found_by"),
        F.when(took, F.col("__field")).alias("matched_field"),
        took.alias("was_filled"),
    )


def fill_report(filled_lipids: DataFrame) -> DataFrame:
    """Rows whose id was absent before ``fill_from_structures`` and is there now."""
    return filled_lipids.where("was_filled").select("row_idx", "input_name", "lm_id", "matched_field")


def headgroup_key(name: Column) -> Column:
    return F.regexp_extract(name, r"^([A-Za-z0-9\-]+)", 1)


def fill_from_headgroups(lipids: DataFrame, headgroups: DataFrame) -> DataFrame:
    """``lipids`` whose missing ids are filled by the first id of their headgroup, if it is not empty."""
    first = headgroups.select(F.col("headgroup").alias("__key"), filled(F.get("lm_ids", F.lit(0))).alias("__id")).where("__id is not null")
    joined = reference_join(lipids.withColumn("__key", F.when(_absent("lm_id"), headgroup_key(F.col("input_name")))), first, "__key")
    took = F.col("__id").isNotNull()
    return joined.withColumn("lm_id", F.when(took, F.col("__id")).otherwise(F.col("lm_id"))).withColumn("lm_id_found_by", F.when(took, "headgroup").otherwise(F.col("lm_id_found_by"))).drop("__key", "__id")
