"""Delimited tables: headers, delimiters, formats, ragged rows, many files at once.

``raw_rows`` is (dataset_id, row_idx, cells, missing_columns, extra_fields) and ``columns`` is
(dataset_id, col_idx, column, label); every cell is a trimmed string.
"""

from __future__ import annotations

import csv
import functools
import io
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import with_split_idx
from ..functions.tables import BROADCAST_ENTRIES, stored
from ..functions.text import strip
from . import files, quoted

# fixed values: delimiters in order of preference, length of the head, marks of an MS-DIAL header
DELIMITERS = [",", "\t", ";", "|"]
HEAD = 8192
MSDIAL = ["alignment id", "average rt", "metabolite name", "ms-dial"]


def delimiter(text: Column) -> Column:
    """The most frequent delimiter in the head of a file's text; ties go to the earlier one."""
    head = F.substring(text, 1, HEAD)
    counts = [F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    found = F.lit(DELIMITERS[0])
    for d, n in reversed(list(zip(DELIMITERS, counts))):
        found = F.when(n == most, F.lit(d)).otherwise(found)
    return found


def table_format(header: Column) -> Column:
    """``msdial`` where the header line names one of its columns, else ``standard``."""
    return F.when(F.lower(header).rlike("|".join(MSDIAL)), "msdial").otherwise("standard")


def ragged(cells: Column, columns: list[str]) -> tuple[Column, Column, Column]:
    """(cells as long as the header, names of missing columns, surplus cells) of split rows."""
    n, names = F.size(cells), F.array(*map(F.lit, columns))
    width = len(columns)
    full = F.concat(F.slice(cells, 1, width), F.array_repeat(F.lit(""), F.greatest(F.lit(width) - n, F.lit(0))))
    missing = F.when(n < width, F.slice(names, n + 1, width)).otherwise(F.array().cast("array<string>"))
    extra = F.when(n > width, F.slice(cells, width + 1, F.greatest(n - width, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return full, missing, extra


class Batch(NamedTuple):
    """What a reader found: rows, columns, one line per file, and files that failed."""

    raw_rows: DataFrame
    columns: DataFrame
    datasets: DataFrame
    errors: DataFrame


def fields(line: Column, sep: str) -> Column:
    """The fields of one line: quoted ones may hold the delimiter and doubled quotes, as many as there are."""
    d = re.escape(sep)
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{d}("[^"]*+(?:""[^"]*+)*+"[^{d}]*|[^{d}]*)'), F.lit(1))
    body = lambda x: F.replace(F.regexp_extract(x, '(?s)^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"'))
    behind = lambda x: F.regexp_replace(x, '(?s)^"[^"]*+(?:""[^"]*+)*+"', "")
    return F.transform(found, lambda x: strip(F.when(x.startswith('"'), F.concat(body(x), behind(x))).otherwise(x)))


def _open_at_end(line: Column, sep: str) -> Column:
    """Whether a quoted field of ``line`` is not closed in it: one is left when all closed ones are taken out."""
    begins = f'{sep}"'
    closed = F.regexp_replace(F.concat(F.lit(sep), line), F.lit(f'{re.escape(begins)}[^"]*+(?:""[^"]*+)*+"'), F.lit(re.sub(r"([\\$])", r"\\\1", sep)))
    return F.contains(closed, F.lit(begins))


def _head(lines: DataFrame) -> str:
    """The first 8192 characters of ``lines`` (value) in order: as many lines as that takes, in two reads as a rule."""
    n = 32
    while True:
        found = [r["value"] for r in lines.select(F.substring("value", 1, HEAD + 1).alias("value")).limit(n).collect()]
        if len(found) < n or sum(map(len, found)) + len(found) > HEAD:
            return "\n".join(found)[:HEAD]
        n *= 8


def _header(lines: DataFrame, sep: str) -> list[str]:
    """The trimmed fields of the first row of ``lines`` (value), which end at LF alone."""
    n = 32
    while True:
        walk, found = quoted.Walk(quoted.Scanner(sep), False), [r["value"] for r in lines.limit(n).collect()]
        ended = next((text for line in found for _, text in walk.feed(line)), None)
        if ended is None and len(found) < n:
            ended = "\n".join(walk.parts)
        if ended is not None:
            return quoted.cells_of([ended], sep)[0]
        n *= 8


def read_dataset(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, has_labels: bool = False) -> Batch:
    """One table whose files share a header: rows, columns and what was found out about it.

    A missing path is an error. Wholly empty lines are skipped, lines of blanks are short rows, a byte
    order mark is dropped, and rows are numbered in order of the files' paths. One pass over the bytes
    decides the encoding (UTF-8, else Latin-1) and whether any line ends inside a quoted field. If
    none does, lines are split into fields by expressions where they are read; else
    splits are parsed with the state they begin in (``quoted``). Either way
    files may have any size. The delimiter is counted in the first 8192 characters; an MS-DIAL header
    means tabs. With ``has_labels`` the first data row becomes the labels; columns that it lacks have none.
    """
    lines = spark.read.text(path)
    found = lines.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("odd_bytes"),
        F.count_if(F.contains("value", F.lit('"')) & functools.reduce(Column.__or__, [_open_at_end(F.col("value"), d) for d in [sep] * bool(sep) or DELIMITERS])).alias("open_quotes"),
    ).first()
    encoding = encoding or ("latin-1" if found["odd_bytes"] else "utf-8")
    kind = "ISO-8859-1" if encoding.lower() in ("latin-1", "iso-8859-1") else encoding.upper()
    text = F.col("value") if kind == "UTF-8" else F.decode(F.col("value").cast("binary"), kind)
    located = lambda rows: rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line"))
    about = spark.read.format("binaryFile").load(path).where("length > 0").agg(F.min("path").alias("first"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("size")).first()
    top = located(spark.read.text(about["first"])).where("block = 0").select(F.col("line").alias("value")) if about["first"] else None
    start = top.where("value <> ''").first() if top is not None else None
    form = "msdial" if start and any(m in start["value"].lower() for m in MSDIAL) else "standard"
    sep = sep or ("\t" if form == "msdial" else max(DELIMITERS, key=_head(top).count) if start else DELIMITERS[0])
    if found["open_quotes"]:
        placed = located(spark.read.option("lineSep", "\n").text(path))
        names = _header(placed.where((F.col("file") == about["first"]) & (F.col("block") == 0)).select(F.col("line").alias("value")), sep)
        split = stored(quoted.rows_in_splits(placed, sep), "parsed-rows")
        # a row a file: its header's number, and how many headers there are up to it
        heads = split.groupBy("file").agg(F.min("number").alias("head")).withColumn("nth", F.row_number().over(Window.orderBy("head")))
        cells = split.join(F.broadcast(heads), "file").where("number > head").select((F.col("number") - F.col("nth")).alias("row_idx"), "cells")
    else:
        names = quoted.cells_of([start["value"]], sep)[0] if start else []
        placed = located(lines).where("line <> ''").withColumn("at", F.monotonically_increasing_id())
        heads = placed.where("block = 0").groupBy("file").agg(F.min("at").alias("at"))
        # one row a file, so it is broadcast whatever the table's size, and rows stay where they are read
        data = placed.join(F.broadcast(heads), ["file", "at"], "left_anti").select("file", "block", fields(F.col("line"), sep).alias("cells"))
        cells = with_split_idx(data)
    full, missing, extra = ragged(F.col("cells"), names)
    rows = cells.select(F.lit(path).alias("dataset_id"), "row_idx", full.alias("cells"), missing.alias("missing_columns"), extra.alias("extra_fields"))
    labels: list[str | None] = [None] * len(names)
    if has_labels:
        first = rows.where("row_idx = 1").first()
        labels = [x if k < len(names) - len(first["missing_columns"]) else None for k, x in enumerate(first["cells"])] if first else labels
        rows = rows.where("row_idx > 1").withColumn("row_idx", F.col("row_idx") - 1)
    columns = spark.createDataFrame([(path, k, name, label) for k, (name, label) in enumerate(zip(names, labels))], "dataset_id string, col_idx int, column string, label string")
    described = spark.createDataFrame([(path, path, sep, encoding, about["size"], form)], "dataset_id string, source_file string, delimiter string, encoding string, file_size_bytes long, format_type string")
    return Batch(rows, columns, described, spark.createDataFrame([], "dataset_id string, error string"))


def read_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, has_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(raw_rows, columns) of ``read_dataset``."""
    done = read_dataset(spark, path, sep, encoding, has_labels)
    return done.raw_rows, done.columns


_FIELDS = [("kind", pa.string()), ("dataset_id", pa.string()), ("at", pa.int64()), ("cells", pa.list_(pa.string())), ("missing_columns", pa.list_(pa.string())), ("extra_fields", pa.list_(pa.string())), ("text", pa.string()), ("label", pa.string()), ("size", pa.int64())]
PARSED = "kind string, dataset_id string, at long, cells array<string>, missing_columns array<string>, extra_fields array<string>, text string, label string, size long"


def _decoded(content: bytes, encoding: str | None = None) -> tuple[str, str]:
    if encoding:
        return content.decode(encoding), encoding
    try:
        return content.decode("utf-8").removeprefix("\ufeff"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1"


def _file(path: str, content: bytes, sep: str | None, has_labels: bool, encoding: str | None = None) -> Iterator[tuple]:
    text, encoding = _decoded(content, encoding)
    lower = text[: text.find("\n") if "\n" in text else len(text)].lower()
    kind = "msdial" if any(m in lower for m in MSDIAL) else "standard"
    head = text[:HEAD]
    sep = sep or ("\t" if kind == "msdial" else max(DELIMITERS, key=head.count))
    lines = ([x.strip() for x in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row)
    names = next(lines, [])
    labels = next(lines, None) if has_labels else None
    yield ("dataset", path, None, [kind, sep, encoding], None, None, None, None, len(content))
    for k, name in enumerate(names):
        yield ("column", path, k, None, None, None, name, labels[k] if labels and k < len(labels) else None, None)
    width = len(names)
    for k, cells in enumerate(lines, 1):
        yield ("row", path, k, (cells + [""] * width)[:width], names[len(cells) :], cells[width:], None, None, None)


def file_records(path: str, content: bytes, sep: str | None, has_labels: bool, encoding: str | None) -> Iterator[pa.RecordBatch]:
    """The records of one file in batches: its dataset, columns and rows, or its error."""
    schema, rows = pa.schema(_FIELDS), []
    try:
        for row in _file(path, content, sep, has_labels, encoding):
            rows.append(row)
            if len(rows) == 5000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    except (csv.Error, ValueError) as e:
        rows.append(("error", path, None, None, None, None, str(e), None, None))
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _parse(sep: str | None, has_labels: bool, encoding: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from file_records(path, content.as_py(), sep, has_labels, encoding)

    return run


def read_batch(spark: SparkSession, path: str | list[str], sep: str | None = None, has_labels: bool = False, encoding: str | None = None) -> Batch:
    """Many files with their own headers, delimiters and encodings, each parsed once.

    The files go through the data source of ``files`` where pyarrow can open their store, else
    through ``binaryFile``, a file a record (that one passes over files of no bytes). What the one
    parse gave is written, and all four outputs are read from it. A file that cannot be parsed, at
    whatever row, gives a row in ``errors`` and nothing else; the others go on. UTF-8 falls back to
    Latin-1, and the encoding used is reported. Files of any size but single huge ones belong here;
    those go through ``read_dataset``, which splits them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if files.can_open(paths):
        files.register(spark)
        given = {"paths": json.dumps(paths), "hasLabels": str(has_labels).lower(), "sep": sep, "encoding": encoding}
        parsed = spark.read.format("delimited_files").options(**{k: v for k, v in given.items() if v is not None}).load()
    else:
        parsed = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_parse(sep, has_labels, encoding), PARSED)
    parsed = stored(parsed, "parsed-files")
    failed = parsed.where("kind = 'error'").select("dataset_id")
    count, whole = failed.count(), parsed
    if count:
        whole = parsed.join(F.broadcast(failed) if count <= BROADCAST_ENTRIES else failed, "dataset_id", "left_anti")
    return Batch(
        whole.where("kind = 'row'").select("dataset_id", F.col("at").alias("row_idx"), "cells", "missing_columns", "extra_fields"),
        whole.where("kind = 'column'").select("dataset_id", F.col("at").cast("int").alias("col_idx"), F.col("text").alias("column"), "label"),
        whole.where("kind = 'dataset'").select("dataset_id", F.col("dataset_id").alias("source_file"), F.col("cells")[1].alias("delimiter"), F.col("cells")[2].alias("encoding"), F.col("size").alias("file_size_bytes"), F.col("cells")[0].alias("format_type")),
        parsed.where("kind = 'error'").select("dataset_id", F.col("text").alias("error")),
    )


def split_lines(lines: DataFrame, columns: list[str], sep: str = ",", line: str = "line") -> DataFrame:
    """raw_rows of ``lines`` (dataset_id, row_idx, line) without quoted fields."""
    cells = F.transform(F.split(F.col(line), f"\\Q{sep}\\E"), strip)
    full, missing, extra = ragged(F.col("cells"), columns)
    return lines.where(F.col(line) != "").select("dataset_id", "row_idx", cells.alias("cells")).select("dataset_id", "row_idx", full.alias("cells"), missing.alias("missing_columns"), extra.alias("extra_fields"))
