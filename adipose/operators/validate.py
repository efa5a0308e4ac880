"""Checks of raw tables; each finding is a row of ``issues``.

The first column holds names and all others are samples. ``issues`` is (dataset_id, check_id,
severity, category, message, location, suggestion), location a JSON text. A table without rows is
only told so (V1).

The rows are read once, whatever the number of checks: ``check_state`` makes mergeable rows of them,
counts and first examples a block of rows and column, counts a name, and the findings that are a row
each. Issues and summary follow from the states alone. States of different rows can be put together,
so a state that was kept spares reading its rows again when files are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import number, strip

# fixed values: severities, share of missing values that warns, share of zeros, length of a short name, examples
CRITICAL, ERROR, WARNING, INFO = LEVELS = "critical", "error", "warning", "info"
MISSING_WARNS, ZEROS_WARN, SHORT_NAME = 10.0, 0.5, 3
PLACEHOLDERS = {"numbers only": r"^\d+$", "NA": r"^[Nn][Aa]$", "unknown": r"^[Uu]nknown"}


def _found(when: Column, check: str, severity: str | Column, category: str, message: Column, location: Column | None = None, suggestion: str | Column = "") -> Column:
    """The issue where ``when`` holds, else null."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    where = F.lit(None).cast("string") if location is None else F.to_json(location)
    fields = {"check_id": F.lit(check), "severity": text(severity), "category": F.lit(category), "message": message, "location": where, "suggestion": text(suggestion)}
    return F.when(when, F.struct(*[c.alias(k) for k, c in fields.items()]))


def _issues(rows: DataFrame, found: list[Column]) -> DataFrame:
    return rows.select("dataset_id", F.explode(F.array_compact(F.array(*found))).alias("issue")).select("dataset_id", "issue.*")


def _text(pattern: str, *columns: str | Column) -> Column:
    return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in columns])


def _first(cells: str = "cells") -> Column:
    return strip(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))


def entries(raw_rows: DataFrame) -> DataFrame:
    """(dataset_id, row_idx, col_idx, text, value, blank): a row a sample cell, and one with col_idx -1 a row, its text being the name."""
    blank = ~F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda x: strip(F.coalesce(x, F.lit(""))) != "")
    each = raw_rows.select("dataset_id", "row_idx", blank.alias("blank"), F.posexplode(F.concat(F.slice("cells", 1, 1), "cells")).alias("col_idx", "raw")).where("col_idx <> 1")
    cell = each.select("dataset_id", "row_idx", (F.col("col_idx") - 1).alias("col_idx"), strip(F.coalesce("raw", F.lit(""))).alias("text"), "blank")
    return cell.withColumn("value", F.when(F.col("col_idx") > 0, number(F.col("text"))))


def _flags() -> dict[str, Column]:
    """What is counted of entries, and shown by examples."""
    cell, name = F.col("col_idx") > 0, F.col("col_idx") < 0
    return {
        "non_numeric": cell & (F.col("text") != "") & F.col("value").isNull(), "negative": cell & (F.col("value") < 0),
        "short": name & (F.col("text") != "") & (F.length("text") < SHORT_NAME), **{k: name & F.col("text").rlike(p) for k, p in PLACEHOLDERS.items()}, "blank": name & F.col("blank"),
    }


def counts(cells: DataFrame) -> DataFrame:
    """Per column, and per dataset at col_idx -1, in one shuffle: total, missing, zero, numeric and what ``_flags`` names."""
    cell = F.col("col_idx") > 0
    return cells.groupBy("dataset_id", "col_idx").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(cell & (F.col("text") == "")).alias("missing"), F.count_if(cell & (F.col("value") == 0)).alias("zero"), F.count("value").alias("numeric"),
        *[F.count_if(c).alias(k) for k, c in _flags().items()],
    )


def column_counts(raw_rows: DataFrame) -> DataFrame:
    """(dataset_id, col_idx, total, missing, non_numeric, negative, zero, numeric) of the sample columns."""
    return counts(entries(raw_rows)).where("col_idx > 0").select("dataset_id", "col_idx", "total", "missing", "non_numeric", "negative", "zero", "numeric")


def _examples(cells: DataFrame) -> DataFrame:
    """(dataset_id, col_idx, examples): the first ten of each flag; ranked before the shuffle, so no column is gathered."""
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in _flags().items()]))
    flagged = cells.select("dataset_id", "col_idx", "row_idx", "text", F.explode(kinds).alias("kind"))
    rank = F.row_number().over(Window.partitionBy("dataset_id", "col_idx", "kind").orderBy("row_idx"))
    top = flagged.withColumn("rank", rank).where("rank <= 10")
    return top.groupBy("dataset_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("kind", F.col("row_idx").alias("row"), "text"))).alias("examples"))


def _of(kind: str, n: int, field: str | None = None) -> Column:
    """The first n examples of a flag: (row, text), or one of the two."""
    some = F.slice(F.filter("examples", lambda x: x["kind"] == kind), 1, n)
    return F.transform(some, lambda x: x[field] if field else F.struct(x["row"].alias("row"), x["text"].alias("text")))


def name_table(raw_rows: DataFrame) -> DataFrame:
    return raw_rows.select("dataset_id", "row_idx", _first().alias("name"))


def duplicate_names(names: DataFrame) -> DataFrame:
    """(dataset_id, name, n, first_row) of names that occur more than once; counted before the shuffle."""
    return names.where("name <> ''").groupBy("dataset_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row")).where("n > 1")


def headers(columns: DataFrame) -> DataFrame:
    """(dataset_id, width, repeated, unnamed) of each dataset's columns."""
    names = columns.groupBy("dataset_id", "column").agg(F.count(F.lit(1)).alias("n"), F.min("col_idx").alias("first"), F.collect_list("col_idx").alias("at"))
    again = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("first", "column"))))
    return names.groupBy("dataset_id").agg(
        F.sum("n").alias("width"), F.transform(again, lambda x: x["column"]).alias("repeated"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.trim("column") == "", F.col("at"))))).alias("unnamed"),
    )


def sized(columns: DataFrame, counted: DataFrame) -> DataFrame:
    """The counts of every column that ``columns`` lists, and of every dataset at col_idx -1 with its ``headers``."""
    whole = headers(columns).select("dataset_id", F.lit(-1).alias("col_idx"), F.lit(None).cast("string").alias("column"), "width", "repeated", "unnamed")
    each = columns.where("col_idx > 0").select("dataset_id", "col_idx", "column")
    return whole.unionByName(each, allowMissingColumns=True).join(counted, ["dataset_id", "col_idx"], "left").withColumn("rows", F.when(F.col("col_idx") < 0, F.coalesce("total", F.lit(0))))


def counted_issues(columns: DataFrame, cells: DataFrame, min_samples: int = 1, min_lipids: int = 1, max_missing_percent: float = 50.0) -> DataFrame:
    """V1 to V4, V6, V7, V9 to V12 and V14 to V16 of ``entries``."""
    return issues_of_counts(columns, counts(cells), _examples(cells), min_samples, min_lipids, max_missing_percent)


def issues_of_counts(columns: DataFrame, counted: DataFrame, examples: DataFrame, min_samples: int = 1, min_lipids: int = 1, max_missing_percent: float = 50.0) -> DataFrame:
    """V1 to V4, V6, V7, V9 to V12 and V14 to V16: what follows from counts, with the first examples."""
    rows = sized(columns, counted).join(examples, ["dataset_id", "col_idx"], "left").withColumn("percent", F.try_divide(F.col("missing") * 100.0, F.col("total")))
    here, samples, much = F.col("rows") > 0, F.col("width") - 1, F.col("percent") > max_missing_percent
    column = F.struct("column")
    shown = lambda kind, n, field=None: F.struct(_of(kind, n, field).alias("examples"))
    both = lambda kind: F.struct("column", _of(kind, 3).alias("examples"))
    found = [
        _found(F.col("rows") == 0, "V1", CRITICAL, "structure", F.lit("no data rows"), None, "see whether the file was read as it should be"),
        _found(here & (F.col("width") < 2), "V2", CRITICAL, "structure", _text("%d columns, at least 2 are needed", "width"), None, "give a column of names and one or more of samples"),
        _found(here & (F.size("repeated") > 0), "V3", ERROR, "structure", _text("duplicate headers: %s", F.array_join("repeated", ", ")), None, "give every column a header of its own"),
        _found(here & (F.size("unnamed") > 0), "V4", WARNING, "structure", _text("blank headers at %s", F.array_join(F.col("unnamed").cast("array<string>"), ", ")), F.struct(F.col("unnamed").alias("columns")), "name every column"),
        _found(here & (samples < min_samples), "V6", ERROR, "structure", _text("%d sample columns, at least %d are needed", samples, F.lit(min_samples)), F.struct(samples.alias("sample_count"))),
        _found(here & (F.col("rows") < min_lipids), "V7", WARNING, "structure", _text("%d rows, at least %d are needed", "rows", F.lit(min_lipids)), F.struct(F.col("rows").alias("lipid_count"))),
        _found((F.col("percent") > MISSING_WARNS) | much, "V9", F.when(much, ERROR).otherwise(WARNING), "missing_data", _text("%s: %.1f%% missing (%d/%d)", "column", "percent", "missing", "total"), F.struct("column", F.col("missing").alias("missing_count")), F.when(much, f"at most {max_missing_percent}% may be missing").otherwise("")),
        _found(F.col("non_numeric") > 0, "V10", ERROR, "invalid_value", _text("%s: %d cells are not numbers", "column", "non_numeric"), both("non_numeric"), "sample cells must be numbers"),
        _found(F.col("negative") > 0, "V11", WARNING, "invalid_value", _text("%s: %d negative values", "column", "negative"), both("negative"), "quantities are positive as a rule"),
        _found((F.col("col_idx") > 0) & (F.col("zero") > ZEROS_WARN * F.col("numeric")), "V12", WARNING, "data_quality", _text("%s: %d of %d values are zero", "column", "zero", "numeric"), column),
        _found(F.col("short") > 0, "V14", INFO, "data_quality", _text("%d short names", "short"), shown("short", 5, "text")),
        *[_found(F.col(f"`{k}`") > 0, "V15", INFO, "data_quality", _text(f"%d placeholder names ({k})", F.col(f"`{k}`")), shown(k, 5, "text")) for k in PLACEHOLDERS],
        _found(F.col("blank") > 0, "V16", WARNING, "data_consistency", _text("%d rows without any value", "blank"), F.struct(_of("blank", 10, "row").alias("rows")), "leave out rows without values"),
    ]
    return _issues(rows, found)


def row_issues(flagged: DataFrame) -> DataFrame:
    """V5 and V8 of rows (dataset_id, row_idx, missing_columns, extra_fields, unnamed): findings that are a row each."""
    row = F.col("row_idx").alias("row")
    found = [
        _found(F.size("extra_fields") > 0, "V5", ERROR, "structure", _text("row %d has %d extra fields", "row_idx", F.size("extra_fields")), F.struct(row, "extra_fields"), "give every row as many delimiters as the header has"),
        _found(F.size("missing_columns") > 0, "V5", ERROR, "structure", _text("row %d lacks %s", "row_idx", F.array_join("missing_columns", ", ")), F.struct(row, "missing_columns"), "give a value or a blank cell for every column"),
        _found(F.col("unnamed"), "V8", ERROR, "missing_data", _text("row %d has no name", "row_idx"), F.struct(row)),
    ]
    return _issues(flagged, found)


def name_issues(again: DataFrame) -> DataFrame:
    """V13: repeated names (dataset_id, name, n, first_row), counted, and the first five."""
    number_of = again.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("first_row"))
    top = again.withColumn("rank", rank).where("rank <= 5").groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("first_row", "name"))).alias("top"))
    names = F.struct(F.transform("top", lambda x: x["name"]).alias("examples"))
    return _issues(number_of.join(top, "dataset_id"), [_found(F.lit(True), "V13", WARNING, "data_consistency", _text("%d names are repeated", "n"), names, "use names of their own, or sum up equal ones")])


def summary(columns: DataFrame, counted: DataFrame, issues: DataFrame) -> DataFrame:
    """V17 and V18: one row per dataset with sizes, completeness, verdict and counts by severity."""
    size = sized(columns, counted).groupBy("dataset_id").agg(
        F.max("rows").alias("total_rows"), F.max("width").alias("total_columns"), F.sum(F.when(F.col("col_idx") > 0, F.col("total"))).alias("cells"), F.sum(F.when(F.col("col_idx") > 0, F.col("total") - F.col("missing"))).alias("full")
    )
    levels = issues.groupBy("dataset_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in LEVELS])
    joined = size.join(levels, "dataset_id", "left").na.fill(0)
    complete = F.coalesce(F.bround(F.try_divide(F.col("full") * 100.0, F.col("cells")), 2), F.lit(0.0))
    return joined.select(
        "dataset_id", "total_rows", "total_columns", F.greatest(F.col("total_columns") - 1, F.lit(0)).alias("sample_columns"), complete.alias("completeness_percent"),
        ((F.col("critical_count") == 0) & (F.col("error_count") == 0)).alias("validation_passed"), (F.col("warning_count") > 0).alias("has_warnings"),
        *[f"{s}_count" for s in LEVELS],
    )


#: Rows of one block share their examples; a state has a row for each block and column.
BLOCK = 4096
_SHOWN = 10
_COUNTS = ["total", "missing", "zero", "numeric", "non_numeric", "negative", "short", *PLACEHOLDERS, "blank"]


def check_state(raw_rows: DataFrame) -> DataFrame:
    """The mergeable state of rows, in one pass: a row a (dataset, block of rows, column), a (dataset, name), and a row with a finding of its own.

    ``part`` says which: "cells" has the counts and the first ten examples of each flag (col_idx -1 for
    what concerns rows), "name" a name's count and first row, "row" what V5 and V8 tell. All are summed
    up before the shuffle.
    """
    none = lambda kind: F.lit(None).cast(kind)
    blank = ~F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda x: strip(F.coalesce(x, F.lit(""))) != "")
    name, block = F.col("name"), F.floor(F.col("row_idx") / BLOCK).cast("long")
    fields = lambda part, col, text, key, at: F.struct(F.lit(part).alias("part"), col.cast("int").alias("col_idx"), text.alias("text"), key.alias("key"), at.cast("long").alias("at"))
    cells = F.transform(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda x, k: fields("cells", k + 1, F.coalesce(x, F.lit("")), none("string"), F.col("block")))
    flagged = (F.size("extra_fields") > 0) | (F.size("missing_columns") > 0) | (name == "")
    others = F.array_compact(F.array(
        fields("cells", F.lit(-1), name, none("string"), F.col("block")), F.when(name != "", fields("name", F.lit(0), none("string"), name, none("long"))), F.when(flagged, fields("row", F.lit(0), none("string"), none("string"), F.col("row_idx"))),
    ))
    rows = raw_rows.select("dataset_id", "row_idx", "cells", "missing_columns", "extra_fields", _first().alias("name"), block.alias("block"), blank.alias("blank"))
    each = rows.select("dataset_id", "row_idx", "blank", "missing_columns", "extra_fields", (name == "").alias("unnamed"), F.explode(F.concat(others, cells)).alias("e")).select("dataset_id", "row_idx", "blank", "missing_columns", "extra_fields", "unnamed", "e.*")
    valued = each.withColumn("text", strip("text")).withColumn("value", F.when((F.col("part") == "cells") & (F.col("col_idx") > 0), number(F.col("text"))))
    of_cells = F.col("part") == "cells"
    flags = {k: of_cells & c for k, c in _flags().items()}
    cell = of_cells & (F.col("col_idx") > 0)
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    found = valued.withColumn("kinds", kinds).groupBy("dataset_id", "part", "col_idx", "key", "at").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(cell & (F.col("text") == "")).alias("missing"), F.count_if(cell & (F.col("value") == 0)).alias("zero"), F.count("value").alias("numeric"),
        *[F.count_if(c).alias(k) for k, c in flags.items()],
        F.min("row_idx").alias("first_row"),
        F.array_sort(F.collect_list(F.when(F.size("kinds") > 0, F.struct(F.col("row_idx").alias("row"), "text", "kinds")))).alias("shown"),
        F.first(F.when(F.col("part") == "row", F.struct("missing_columns", "extra_fields", F.col("unnamed"))), ignorenulls=True).alias("ragged"),
    )
    some = lambda k: F.transform(F.slice(F.filter("shown", lambda x: F.array_contains(x["kinds"], k)), 1, _SHOWN), lambda x: F.struct(F.lit(k).alias("kind"), x["row"].alias("row"), x["text"].alias("text")))
    examples = F.flatten(F.array(*[some(k) for k in flags]))
    return found.select("dataset_id", "part", "col_idx", "key", "at", *[F.col(f"`{c}`") for c in _COUNTS], "first_row", examples.alias("examples"), "ragged.missing_columns", "ragged.extra_fields", "ragged.unnamed")


def _counts_of(state: DataFrame) -> DataFrame:
    return state.where("part = 'cells'").groupBy("dataset_id", "col_idx").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in _COUNTS])


def _examples_of(state: DataFrame) -> DataFrame:
    """The first ten of each flag among the blocks' first tens."""
    each = state.where("part = 'cells'").select("dataset_id", "col_idx", F.inline("examples"))
    rank = F.row_number().over(Window.partitionBy("dataset_id", "col_idx", "kind").orderBy("row"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= _SHOWN)
    return top.groupBy("dataset_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("kind", "row", "text"))).alias("examples"))


def _repeated_of(state: DataFrame) -> DataFrame:
    names = state.where("part = 'name'").groupBy("dataset_id", F.col("key").alias("name"))
    return names.agg(F.sum("total").alias("n"), F.min("first_row").alias("first_row")).where("n > 1")


def validate_state(state: DataFrame, columns: DataFrame, min_samples: int = 1, min_lipids: int = 1, max_missing_percent: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(issues, summary) of all datasets that ``columns`` lists, from states (one or several put together)."""
    counted = _counts_of(state)
    rows = state.where("part = 'row'").select("dataset_id", F.col("at").alias("row_idx"), "missing_columns", "extra_fields", "unnamed")
    issues = issues_of_counts(columns, counted, _examples_of(state), min_samples, min_lipids, max_missing_percent)
    issues = issues.unionByName(row_issues(rows)).unionByName(name_issues(_repeated_of(state)))
    return issues, summary(columns, counted, issues)


def validate(raw_rows: DataFrame, columns: DataFrame, min_samples: int = 1, min_lipids: int = 1, max_missing_percent: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(issues, summary) of all datasets that ``columns`` lists; the rows are read once."""
    return validate_state(stored(check_state(raw_rows), "check-state"), columns, min_samples, min_lipids, max_missing_percent)


def required_columns(raw_rows: DataFrame, columns: DataFrame, required: list[str], quant: list[str]) -> DataFrame:
    """V19: (dataset_id, row_idx, problem) for absent columns, rows longer than the header, cells that are no numbers.

    A blank cell is no number; a cell that a short row lacks is passed over.
    """
    wanted = columns.select("dataset_id").distinct().withColumn("column", F.explode(F.array(*map(F.lit, [*required, *quant]))))
    absent = wanted.join(columns.select("dataset_id", "column"), ["dataset_id", "column"], "left_anti").select("dataset_id", F.lit(None).cast("long").alias("row_idx"), F.concat(F.lit("missing column "), "column").alias("problem"))
    longer = raw_rows.where(F.size("extra_fields") > 0).select("dataset_id", "row_idx", F.lit("more fields than the header").alias("problem"))
    cells = raw_rows.select("dataset_id", "row_idx", "missing_columns", F.posexplode("cells").alias("col_idx", "raw"))
    named = cells.join(columns.where(F.col("column").isin(quant)).select("dataset_id", "col_idx", "column"), ["dataset_id", "col_idx"])
    odd = named.where(number(F.col("raw")).isNull() & ~F.array_contains("missing_columns", F.col("column")))
    return absent.unionByName(longer).unionByName(odd.select("dataset_id", "row_idx", F.concat(F.lit("not a number in "), "column").alias("problem")))
