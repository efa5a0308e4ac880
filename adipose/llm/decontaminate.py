"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared lower-cased with runs of white space as one space. An item of
m characters may lie in a document with up to floor(rate * m) edits. Cut into budget + 1 pieces, at
least one piece then occurs unchanged: one Aho-Corasick automaton finds all pieces of all items in
one pass over a text, and Myers' bit-parallel search verifies the stretch around each hit. The
budget is never so large that pieces fall below ``LEAST_PIECE`` characters.

The test items are a stated query set. They are handled in blocks of bounded size: each block is
broadcast and run against all documents where they are read, so matching never shuffles texts. With more
than one block each one's result is stored and its broadcast released before the next is collected,
so driver and workers hold one block at a time; ``drop_contaminated`` then stores digests, not rows.

Defined results: null or blank items match nothing, nor do null or empty documents; an item that
repeats matches under each of its ids; rows that repeat give a row each; rows without id are
matched too; one row per (document row, item) with the smallest distance and the first end where it
is reached; with no items nothing matches; other columns pass unchanged in ``drop_contaminated``.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .shared import by_ids, stored

RATE = 0.08
LEAST_PIECE = 10
BLOCK_CHARACTERS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE) -> int:
    return max(0, min(int(rate * m), m // LEAST_PIECE - 1))


def masks(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        bits[c] |= 1 << k
    return dict(bits)


def search(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest edit distance of the pattern to any stretch of ``text``, first end with it)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for k, c in enumerate(text):
        eq = bits.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, k + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, at


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        pieces, self.items = defaultdict(list), {}
        for k, (item, text) in enumerate(items):
            m, e = len(text), budget(len(text), rate)
            if m:
                self.items[k] = (item, m, e, masks(text))
                cuts = [m * j // (e + 1) for j in range(e + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    pieces[text[a:b]].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def stretches(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the stretches of ``text`` that can hold it, overlapping ones joined."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text) if self.items else ():
            for k, a in where:
                _, m, e, _ = self.items[k]
                start = end + 1 - size - a
                lo, hi = max(0, start - e), min(len(text), start + m + e)
                if found[k] and lo <= found[k][-1][1] and found[k][-1][0] <= hi:
                    last = found[k][-1]
                    last[0], last[1] = min(last[0], lo), max(last[1], hi)
                else:
                    found[k].append([lo, hi])
        return found

    def matches(self, text: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item in the text; with ``first`` of one item only."""
        clean, out = normal(text), []
        for k, where in self.stretches(clean).items():
            item, m, e, bits = self.items[k]
            best = min(((d, lo + at) for lo, hi in where for d, at in [search(bits, m, clean[lo:hi])]), default=(m, 0))
            if best[0] <= e:
                out.append((item, *best))
                if first:
                    break
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(whether it is the only one, items) of blocks of about BLOCK_CHARACTERS, each small enough to broadcast."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARACTERS))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield n == 1, sorted(((r["item"], normal(r["text"])) for r in block.collect()), key=lambda x: (x[1], x[0] is not None, x[0] or 0))


def _matcher(shared) -> Callable[[], Matcher]:
    held: list[Matcher] = []

    def get() -> Matcher:
        if not held:
            held.append(Matcher(*shared.value))
        return held[0]

    return get


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_end) of each item found in a document; ends count normalised characters."""
    spark, parts = documents.sparkSession, []
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_end", pa.int64())])
    for only, items in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((items, rate))
        get = _matcher(shared)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            for part in ta.slices(batches, "text"):
                rows = [(d, *m) for d, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for m in get().matches(x)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance int, match_end long")
        parts.append(found if only else stored(found, "item-matches"))
        if not only:
            shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holding(texts: DataFrame, get: Callable[[], Matcher], digest: str) -> DataFrame:
    """Distinct digests of the ``texts`` (digest, text) that hold an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            held = pa.array([bool(get().matches(x, first=True)) for x in part.column(1).to_pylist()], pa.bool_())
            yield part.select([digest]).filter(held)

    return texts.mapInArrow(run, f"`{digest}` string").distinct()


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` without the rows that hold any item.

    Items of one block filter the rows where they are read. With several blocks each lists the digests
    of the texts that hold one of its items, and one anti join at the end takes their rows off; a null
    text holds none.
    """
    spark, at, found = documents.sparkSession, documents.columns.index(text), []
    digest = "text_digest"
    while digest in documents.columns:
        digest += "_"
    for only, items in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((items, rate))
        get = _matcher(shared)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            for part in ta.slices(batches, text):
                yield part.filter(pa.array([not get().matches(x, first=True) for x in part.column(at).to_pylist()], pa.bool_()))

        if only:
            return documents.mapInArrow(run, documents.schema)
        texts = documents.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias(digest), F.col(text).alias("text"))
        found.append(stored(_holding(texts, get, digest), "contaminated-texts"))
        shared.destroy()
    gone = stored(functools.reduce(DataFrame.unionByName, found).distinct(), "contaminated")
    return by_ids(documents.withColumn(digest, F.sha2(F.col(text), 256)), gone, digest, "left_anti").drop(digest)
