"""Rows of a table whose quoted fields may run over line ends, parsed in splits.

Whether a line end also ends a row depends on all quotes before it. So each split of a file first
gives what it does to the state: whether it ends inside a quoted field if it begins outside, and if it
begins inside, and how many rows begin in it either way. These small rows, one a split, are composed
in the order of the splits by windows, which gives every split its first state and row number. Then
each split is parsed by itself. What stands before a split's first row end belongs to a row of an
earlier split, and its last row may be unfinished: such pieces are put together by the number of the
row they belong to. No task reads more than its split, and a row is as long as it is.

The rules are those of the csv module: a quote opens a field only at its start, a doubled one stands
for itself, text behind a closing quote is kept, line ends are CR, LF or both, wholly empty lines are
no rows, and a field that is open at the end of a file ends there.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored

#: States of so many splits are broadcast; with more, lines are shuffled to them.
BROADCAST_SPLITS = 200_000
_ROWS = 2_000


class Scanner:
    """Where rows end in a line, and whether the next line begins inside a quoted field."""

    def __init__(self, sep: str) -> None:
        self.close = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
        self.plain = re.compile(rf"[^{re.escape(sep)}\r]*+")

    def scan(self, line: str, inside: bool) -> tuple[list[int], bool]:
        """(places of carriage returns that end a row before the line's own end, state behind the line)."""
        ends: list[int] = []
        if '"' not in line:
            if not inside and "\r" in line:
                ends = [k for k, c in enumerate(line[:-1]) if c == "\r"]
            return ends, inside
        at, n, quoted = 0, len(line), inside
        while True:
            if quoted or line.startswith('"', at):
                closed = self.close.match(line, at + (not quoted))
                if closed is None:
                    return ends, True
                at, quoted = closed.end(), False
            at = self.plain.match(line, at).end()
            if at >= n - 1:  # a last delimiter or carriage return changes nothing
                return ends, False
            if line[at] == "\r":
                ends.append(at)
            at += 1


class Walk:
    """One pass over a split's lines from a given first state; texts are kept only if asked for."""

    def __init__(self, scanner: Scanner, inside: bool, keep: bool = True) -> None:
        self.scanner, self.inside, self.keep = scanner, inside, keep
        self.head = inside  # what comes first belongs to a row of an earlier split
        self.parts: list[str] = []
        self.rows = 0

    def feed(self, line: str) -> list[tuple[bool, str]]:
        """(is it the head, text) of each row that ends in this line."""
        ends, self.inside = self.scanner.scan(line, self.inside)
        out, begin = [], 0
        for end in [*ends, *[len(line)] * (not self.inside)]:
            piece = line[begin:end]
            begin = end + 1
            if self.head or self.parts or piece not in ("", "\r"):
                text = "\n".join([*self.parts, piece]) if self.keep else ""
                self.rows += not self.head
                out.append((self.head, text))
            self.head, self.parts = False, []
        if self.inside and (self.keep or not self.parts):
            self.parts.append(line[begin:] if self.keep else "")
        return out

    def started(self) -> int:
        """Rows that begin in the lines so far, the open one too."""
        return self.rows + bool(self.parts and not self.head)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(columns but the last, lines) of neighbouring rows of one split, in order; a split comes in many parts."""
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 1))))
        lines = batch.column(batch.num_columns - 1).to_pylist()
        at = 0
        for end in [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)] * bool(keys):
            yield keys[at], lines[at:end]
            at = end


_STATES = "file string, block long, out_inside boolean, out_rows long, in_inside boolean, in_rows long"


def _states(sep: str):
    names = ["file", "block", "out_inside", "out_rows", "in_inside", "in_rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, done, current, walks = Scanner(sep), [], None, ()

        def close() -> None:
            done.append((*current, *[x for w in walks for x in (w.inside, w.started())]))

        for key, lines in _units(batches):
            if key != current:
                if current is not None:
                    close()
                current, walks = key, (Walk(scanner, False, False), Walk(scanner, True, False))
            for line in lines:
                for walk in walks:
                    walk.feed(line)
        if current is not None:
            close()
        if done:
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    return run


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, inside, before) of each split of ``lines`` (file, block, line): its first state and how many rows begin before it."""
    found = stored(lines.mapInArrow(_states(sep), _STATES), "split-states")
    in_file, ahead = Window.partitionBy("file").orderBy("block"), (Window.unboundedPreceding, -1)
    # a split either sets the state, whatever it was, or keeps it, or turns it round
    turns = found.withColumn("turn", (F.col("out_inside") & ~F.col("in_inside")).cast("int"))
    counted = turns.withColumn("turns", F.sum("turn").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    sets = F.when(F.col("out_inside") == F.col("in_inside"), F.struct(F.col("out_inside").alias("to"), "turns"))
    last = F.last(sets, ignorenulls=True).over(in_file.rowsBetween(*ahead))
    placed = counted.withColumn("last", last)
    since = F.col("turns") - F.col("turn") - F.coalesce("last.turns", F.lit(0))
    started = placed.withColumn("inside", F.coalesce("last.to", F.lit(False)) != (since % 2 == 1))
    rows = started.withColumn("rows", F.when(F.col("inside"), F.col("in_rows")).otherwise(F.col("out_rows")))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file", "block").rowsBetween(*ahead)), F.lit(0))
    return stored(rows.select("file", "block", "inside", before.alias("before"), "rows"), "split-starts")


_PARSED = "file string, block long, number long, cells array<string>, text string"


def cells_of(texts: list[str], sep: str) -> list[list[str]]:
    """The trimmed fields of each text, which is one row."""
    csv.field_size_limit(sys.maxsize)
    return [[x.strip() for x in next(csv.reader([t], delimiter=sep), [])] for t in texts]


def _parse(sep: str):
    names = ["file", "block", "number", "cells", "text"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, current, walk, out = Scanner(sep), None, None, []

        def rest() -> list[tuple]:
            """The unfinished row of the split that ends."""
            if not walk.parts:
                return []
            return [(*current[:2], None if walk.head else current[3] + walk.started(), None, "\n".join(walk.parts))]

        for key, lines in _units(batches):
            if key != current:
                out += rest() if current is not None else []
                current, walk = key, Walk(scanner, key[2])
            for line in lines:
                first = current[3] + walk.rows
                ended = walk.feed(line)
                whole = [text for head, text in ended if not head]
                out += [(*current[:2], None, None, text) for head, text in ended if head]
                out += [(*current[:2], first + k, cells, None) for k, cells in enumerate(cells_of(whole, sep), 1)]
                if len(out) >= _ROWS:
                    yield made(out)
                    out = []
        out += rest() if current is not None else []
        if out:
            yield made(out)

    return run


def _stitched(pieces: DataFrame, sep: str) -> DataFrame:
    """(file, number, cells) of rows in pieces (file, block, number, text): a piece without number goes on with the row before it."""
    order = Window.partitionBy("file").orderBy("block", F.col("number").isNotNull())
    owned = pieces.withColumn("owner", F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("block", F.col("number").isNotNull().alias("begins"), "text")
    # of one split a row has its beginning or its end
    texts = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("file", "owner", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cells_of(batch.column(2).to_pylist(), sep), pa.list_(pa.string()))], names=["file", "number", "cells"])

    return texts.mapInArrow(run, "file string, number long, cells array<string>")


def rows_in_splits(lines: DataFrame, sep: str) -> DataFrame:
    """(file, number, cells) of ``lines`` (file, block, line), which end at LF alone; numbers count all rows in order of file and place."""
    starts = split_states(lines, sep)
    if starts.count() <= BROADCAST_SPLITS:
        begun = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        begun = lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    parsed = begun.select("file", "block", "inside", "before", "line").mapInArrow(_parse(sep), _PARSED)
    pieces = stored(parsed.where("cells is null").select("file", "block", "number", "text"), "row-pieces")
    return parsed.where("cells is not null").select("file", "number", "cells").unionByName(_stitched(pieces, sep))
