"""Reshapes and files for readers outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_ENTRIES, lists_in_parts, stored
from .reactions import lipid_reactions


def wide_matrix(quant: DataFrame, sample_ids: list[str]) -> DataFrame:
    """One row per lipid row and one column per sample of the list; more than the pivot limit is refused.

    A sample that the list names twice has one column.
    """
    sample_ids = list(dict.fromkeys(sample_ids))
    most = int(quant.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if len(sample_ids) > most:
        raise ValueError(f"{len(sample_ids)} samples are more than spark.sql.pivotMaxValues ({most}); use dense_matrix")
    return quant.groupBy("dataset_id", "row_idx", "input_name").pivot("sample_id", sample_ids).agg(F.first("value"))


#: Samples in one block of a dense matrix.
MATRIX_BLOCK = 1000


def dense_matrix(quant: DataFrame, samples: DataFrame, block: int = MATRIX_BLOCK) -> DataFrame:
    """(dataset_id, row_idx, input_name, block, values): a wide matrix of any width as vectors of ``block`` samples at most.

    ``samples`` is (dataset_id, ordinal, sample_id). The k-th sample of a dataset by ordinal is place
    k % block of block k // block, null where the row has no value; a block without any value is left
    out. ``matrix_header`` names the places. One shuffle by row and block; nothing depends on the
    number of samples but the number of blocks.
    """
    places = stored(matrix_header(samples, block).select("dataset_id", "sample_id", "block", "place", "width"), "matrix-places")
    few = F.broadcast(places) if places.count() <= BROADCAST_ENTRIES else places
    put = quant.join(few, ["dataset_id", "sample_id"]).groupBy("dataset_id", "row_idx", "input_name", "block", "width").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("put"))
    gap = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    before = lambda k: F.coalesce(F.get("put", k - 1)["place"], F.lit(-1))
    filled = F.flatten(F.transform("put", lambda x, k: F.concat(gap(x["place"] - before(k) - 1), F.array(x["value"]))))
    return put.select("dataset_id", "row_idx", "input_name", "block", F.concat(filled, gap(F.col("width") - F.element_at("put", -1)["place"] - 1)).alias("values"))


def matrix_header(samples: DataFrame, block: int = MATRIX_BLOCK) -> DataFrame:
    """(dataset_id, sample_id, ordinal, block, place, width): where each sample stands in ``dense_matrix``; one listed twice stands once."""
    once = samples.groupBy("dataset_id", "sample_id").agg(F.min("ordinal").alias("ordinal"))
    of = Window.partitionBy("dataset_id")
    k = F.row_number().over(of.orderBy("ordinal", "sample_id")) - 1
    placed = once.withColumn("k", k).withColumn("n", F.count(F.lit(1)).over(of))
    number = F.floor(F.col("k") / block).cast("int")
    return placed.select("dataset_id", "sample_id", "ordinal", number.alias("block"), (F.col("k") % block).cast("int").alias("place"), F.least(F.lit(block), F.col("n") - number * block).cast("int").alias("width"))


def nested_dataset(lipids: DataFrame, quant: DataFrame) -> DataFrame:
    """``lipids`` with the map of their values."""
    maps = quant.groupBy("dataset_id", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("sample_id", "value")))).alias("values"))
    return lipids.join(maps, ["dataset_id", "row_idx"], "left").withColumn("values", F.coalesce("values", F.create_map().cast("map<string,double>")))


def annotation_rows(annotated: DataFrame, name_col: str = "input_name") -> DataFrame:
    mass = "exact_mass" if "exact_mass" in annotated.columns else "mass"
    return annotated.select(F.col(name_col).alias("sample"), "lm_id", "standardized_name", "refmet_id", "formula", F.col(mass).alias("exact_mass"), "row_idx")


def write_annotations(annotated: DataFrame, path: str) -> None:
    """CSV in input order, null as blank."""
    annotation_rows(annotated).sort("row_idx").drop("row_idx").write.option("header", True).option("nullValue", "").csv(path)


def report(issues: DataFrame, summary: DataFrame) -> DataFrame:
    """(dataset_id, passed, has_warnings, issue_count, summary), one row per dataset.

    The issues stay a table of their own, since a dataset can have one for each of its rows.
    """
    levels = [F.col(f"{s}_count") for s in ("critical", "error", "warning", "info")]
    sums = F.struct(*[c for c in summary.columns if c != "dataset_id"]).alias("summary")
    return summary.select("dataset_id", F.col("validation_passed").alias("passed"), "has_warnings", (levels[0] + levels[1] + levels[2] + levels[3]).alias("issue_count"), sums)


#: Issues in one part of a report.
REPORT_PART = 1000


def report_parts(issues: DataFrame, summary: DataFrame, size: int = REPORT_PART) -> DataFrame:
    """``report`` with its issues: (dataset_id, part, passed, has_warnings, issue_count, summary, issues), at most ``size`` issues a part.

    Issues are in order of check, location and message; a dataset without any has part 0 with an empty list.
    """
    parts = lists_in_parts(issues, ["dataset_id"], ["check_id", "location", "message"], size, "issues")
    joined = report(issues, summary).join(parts, "dataset_id", "left")
    empty = F.array().cast(parts.schema["issues"].dataType)
    return joined.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("issues", F.coalesce("issues", empty))


def write_report(issues: DataFrame, summary: DataFrame, path: str) -> None:
    """``verdicts``: a JSON line a dataset; ``issues``: a folder a dataset, a JSON line an issue, in as many files as it needs."""
    report(issues, summary).write.json(f"{path}/verdicts")
    issues.write.partitionBy("dataset_id").json(f"{path}/issues")


def as_list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def reaction_rows(reactions: DataFrame) -> DataFrame:
    """(reaction_id, reaction_name, reactants, products); a null side is an empty list."""
    return reactions.select("reaction_id", "reaction_name", as_list(F.col("reactants")).alias("reactants"), as_list(F.col("products")).alias("products"))


def annotated_listing(annotated: DataFrame, links: DataFrame, n: int = 10) -> DataFrame:
    """The first n lipids with the reactions they are linked to, a row a link or one without."""
    top = annotated.orderBy("row_idx").limit(max(0, n)).select("row_idx", "input_name", "standardized_name", "lm_id")
    linked = lipid_reactions(top, links).select("row_idx", "reaction_ord", "reaction_id", "reaction_name", "role")
    return top.join(linked, "row_idx", "left")
