"""Repair of damaged conversations by a generalised LR parser over the grammar of roles.

The grammar is ``(s?(ua)+)?`` over the roles' initials. Its automaton has four states (nothing yet,
after s, after u, after a), so the graph-structured stack has four tops at most at any time. Every row shifts each top by the edits that the
automaton allows (keep, rerole, delete; inserts between rows), and tops that reach the same state
are merged: the one of least (cost, audit) stays. Two audits of equal cost never start one another,
since they have equally many letters besides I and each letter has a fixed cost at its row, so what
is smaller stays smaller whatever follows, and merging loses nothing.

On Spark: rows are damaged by expressions; which of equal rows of a conversation is the first is an
aggregate by (conversation, digest), of which only digests that repeat are kept; then rows are
shuffled by conversation and sorted, and each task streams through its conversations. A top carries
its cost, its audit and the running SHA-256 of its repaired rows, so one pass suffices and nothing
of a conversation is held but its tops: of audits the letters in frozen blocks that tops share and
a short tail each. A hot conversation is one task's stream (its hash is a sequential one), in
bounded memory but for its audit, one letter a row, which is its result.

Defined results: nulls in role or text count as one space, and so do nulls of conv_id or turn in the
damage's key; a null conv_id is a conversation; null turns come first; rows of one turn are ordered
by role and text; an empty text or role is kept as such (a role without a letter fits no place in
the grammar, but it can be reroled); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Fixed values of the task: what a row's crc32 of ``conv_id:turn`` modulo 20 does to it, and what edits cost.
DROP, EMPTY, UNSTOP, REPEAT, TO_USER, OF = 0, 1, 2, 3, 4, 20
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

BLOCK = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial) -> state; START and ASSISTANT accept.
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
#: What a rerole or an insert can be in a state; at most one role fits.
FITS = {state: (initial, to) for (state, initial), to in SHIFT.items() if initial in ROLES}
LEGAL = {"su", "ua", "au"}

_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage; dropped rows stay as marks with ``gone``."""
    space = F.lit(" ")
    of = lambda name: F.coalesce(F.col(name).cast("string"), space)
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), of(role).alias("role"), of(text).alias("text"), F.pmod(F.crc32(F.concat(of(conv), F.lit(":"), of(turn)).cast("binary")), F.lit(OF)).alias("kind"))
    kind, body = F.col("kind"), F.col("text")
    after = F.when(kind.isin(DROP, EMPTY), "").when(kind == UNSTOP, F.regexp_replace(body, "[.!?]", "")).otherwise(body)
    copies = F.when(kind == REPEAT, F.array(F.lit(False), F.lit(False))).otherwise(F.array(kind == DROP))
    return rows.select("conv_id", "turn", F.when(kind == TO_USER, "user").when(kind == DROP, "").otherwise(F.col("role")).alias("role"), after.alias("text"), F.explode(copies).alias("gone"))


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def with_later(rows: DataFrame) -> DataFrame:
    """``rows`` with ``later``: an earlier turn of the conversation has the same role and text."""
    present = rows.where("not gone").select("conv_id", "turn", _digest().alias("digest"))
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    first = present.groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    first = stored(first.select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), F.col("first.some").alias("some"), F.col("first.turn").alias("first")), "repeated-rows")
    joined = rows.withColumn("digest", _digest()).join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")) & ~F.col("gone"), "left")
    later = F.col("same").isNotNull() & F.col("turn").isNotNull() & (~F.coalesce(F.col("some"), F.lit(True)) | (F.col("turn") > F.col("first")))
    return joined.select("conv_id", "turn", "role", "text", "gone", F.coalesce(later, F.lit(False)).alias("later"))


class Block(NamedTuple):
    """Letters of an audit that no longer change, with what comes before them; blocks are shared by tops."""

    before: Block | None
    letters: str


class Top(NamedTuple):
    """A stack top. Tops of one rank share their blocks; a smaller rank means smaller blocks that don't start the larger ones."""

    cost: int
    rank: int
    tail: str
    blocks: Block | None
    digest: object  # hashlib state of the repaired rows
    empty: bool  # no repaired row yet


def _hashed(top: Top, line: str) -> tuple[object, bool]:
    digest = top.digest.copy()
    digest.update(line.encode() if top.empty else b"\n" + line.encode())
    return digest, False


def _freeze(tops: dict[int, Top]) -> dict[int, Top]:
    """Tails become blocks. Where one audit starts another, both share the shorter one's blocks."""
    out: dict[int, Top] = {}
    rank, blocks, held = -1, None, None
    for state in sorted(tops, key=lambda s: (tops[s].rank, tops[s].tail)):
        top = tops[state]
        if held is None or held[0] != top.rank or not top.tail.startswith(held[1]):
            rank, blocks, held = rank + 1, Block(top.blocks, top.tail), (top.rank, top.tail)
        out[state] = top._replace(rank=rank, tail=top.tail[len(held[1]) :], blocks=blocks)
    return out


def audit_of(top: Top) -> str:
    parts, block = [top.tail], top.blocks
    while block is not None:
        parts.append(block.letters)
        block = block.before
    return "".join(reversed(parts))


class Parser:
    """The stack over one conversation's rows."""

    def __init__(self) -> None:
        self.rows = 0
        self.tops = self._inserted({START: Top(0, 0, "", None, hashlib.sha256(), True)})

    @staticmethod
    def _merge(tops: dict[int, Top], state: int, cost: int, parent: Top, letter: str, line: str | None) -> bool:
        """Put the successor of ``parent`` on ``state`` unless a smaller one is there."""
        held, tail = tops.get(state), parent.tail + letter
        if held is not None and (held.cost, held.rank, held.tail) <= (cost, parent.rank, tail):
            return False
        digest, empty = (parent.digest, parent.empty) if line is None else _hashed(parent, line)
        tops[state] = Top(cost, parent.rank, tail, parent.blocks, digest, empty)
        return True

    def _inserted(self, tops: dict[int, Top]) -> dict[int, Top]:
        """Inserts from every top until nothing gets smaller."""
        todo = list(tops)
        while todo:
            top = tops[state := todo.pop()]
            initial, to = FITS[state]
            if self._merge(tops, to, top.cost + INSERT_COST, top, "I", f"{ROLES[initial]}:"):
                todo.append(to)
        return tops

    def shift(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        after: dict[int, Top] = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, top in self.tops.items():
            self._merge(after, state, top.cost + DELETE_COST, top, "D", None)
            if must_go:
                continue
            if (to := SHIFT.get((state, role[:1]))) is not None:
                self._merge(after, to, top.cost + extra, top, "K", f"{role}:{text}")
            initial, to = FITS[state]
            self._merge(after, to, top.cost + REROLE_COST + extra, top, "R", f"{ROLES[initial]}:{text}")
        self.rows += 1
        self.tops = self._inserted(_freeze(after) if self.rows % BLOCK == 0 else after)

    def best(self) -> Top:
        return min((self.tops[s] for s in (START, ASSISTANT) if s in self.tops), key=lambda t: (t.cost, t.rank, t.tail))


_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


class Conversation:
    """Counts and parser of the conversation that a task is streaming."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.parser = conv_id, Parser()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last_turn = None
        self.before: tuple | None = None

    def add(self, turn, role: str, text: str, later: bool) -> None:
        if turn is not None and turn != self.last_turn:  # in order, so equal turns are neighbours
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        visible = text.rstrip(_SPACES)
        blank = not visible
        # copies in one turn are neighbours too
        duplicate = not blank and (later or self.before == (turn, role, text))
        truncated = not blank and not duplicate and visible[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = (turn, role, text)
        self.parser.shift(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        best = self.parser.best()
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, audit_of(best), best.digest.hexdigest()


def _stream():
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def made(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, kind = None, [], pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for conv_id, turn, role, text, gone, later in zip(*(c.to_pylist() for c in part.columns)):
                    if current is None or current.conv_id != conv_id:
                        if current is not None:
                            done.append(current.result())
                        current = Conversation(conv_id)
                    if not gone:
                        current.add(turn, role, text, later)
                if len(done) >= 2_000:
                    yield made(done, kind)
                    done = []
        if current is not None:
            yield made([*done, current.result()], kind)

    return run


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    With ``damage`` false the rows are repaired as they are.
    """
    if damage:
        rows = damaged(conversations, conv, turn, role, text)
    else:
        rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(False).alias("gone"))
    ordered = with_later(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_stream(), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_OUT}")
