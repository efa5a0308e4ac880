"""SentencePiece encoding and decoding by suffix-array matching.

For a byte-fallback BPE model whose normaliser only adds a leading mark and turns spaces to marks.
No piece has a mark behind another character, so no merge crosses from a character to a mark; texts
are cut there, and each distinct cut of a task is encoded once:

1. the cuts are concatenated and a suffix array is made by prefix doubling, as deep as the longest
   piece; the first step sorts as many letters as an integer holds;
2. every piece of the vocabulary is binary-searched for its range of occurrences, by these integers
   and, where it is longer, by the text;
3. the occurrences, as edges (position, length, piece), are sorted by position;
4. the edges are relaxed in the model's order: in each cut the adjacent pair of symbols that an edge
   of best score spans (leftmost among equals) becomes one symbol, until no edge spans a pair.
   All cuts relax side by side, but those of more than ``LONG_CUT`` characters, whose edges are
   taken from a heap one by one. Characters without an edge become byte pieces.

Defined results: null is an empty text, which has no pieces and decodes to an empty text; a text's
own mark characters decode as spaces, as in the public library; very long texts are encoded whole;
rows that repeat are each encoded; an empty table gives no rows; ``encode`` passes the columns named
in ``keep`` and adds ``n_pieces`` and ``ids``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO_CHARACTERS = 2_500_000
BATCH_CHARACTERS = 200_000
LONG_CUT = 1_000
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces(NamedTuple):
    """A model's pieces: those that match text by length, and all of them for decoding."""

    by_length: list[tuple[int, np.ndarray, np.ndarray]]  # length, code points (rows), ids
    rank: np.ndarray  # merge order of each id, smaller first
    first_byte: int
    plain: list[bytes]  # what each id decodes to


@functools.cache
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [model.id_to_piece(k) for k in range(n)]
    special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(n)]
    byte = [model.is_byte(k) for k in range(n)]
    normal = [k for k in range(n) if not special[k] and not byte[k]]
    if any(MARK in text[k].lstrip(MARK) for k in normal) or sum(byte) != 256:
        raise ValueError("the model has marks inside pieces or no byte pieces")
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda k: (-model.get_score(k), k))] = np.arange(n)
    by_length = []
    for size in sorted({len(text[k]) for k in normal}):
        ids = np.array([k for k in normal if len(text[k]) == size], np.int32)
        codes = np.frombuffer("".join(text[k] for k in ids).encode("utf-32-le"), np.uint32).reshape(-1, size)
        by_length.append((size, codes.astype(np.int64), ids))
    first = byte.index(True)
    plain = [b"" if model.is_control(k) else bytes([k - first]) if byte[k] else text[k].replace(MARK, " ").encode() if not special[k] else b" \xe2\x81\x87 " for k in range(n)]
    return Pieces(by_length, rank, first, plain)


class Suffixes(NamedTuple):
    """Suffixes of a text in order, and what their first letters look like as sorted integers."""

    order: np.ndarray
    letter: np.ndarray  # number of each code point, from 1; 0 where it does not occur
    bits: int  # of a letter
    span: int  # letters in a key
    keys: np.ndarray  # first ``span`` letters of each suffix, in order


def _packed(letters: np.ndarray, bits: int, span: int) -> np.ndarray:
    """At each place the ``span`` letters from there as one integer; 0 past the end."""
    key = np.zeros(len(letters), np.int64)
    for j in range(span):
        key <<= bits
        key[: max(0, len(letters) - j)] |= letters[j:]
    return key


def suffix_array(codes: np.ndarray, depth: int) -> Suffixes:
    """Suffixes in the order of their first ``depth`` elements (or more).

    As many letters as an integer holds are sorted at once; then the depth doubles, and only suffixes
    that are still equal are sorted again.
    """
    n, occurs = len(codes), np.bincount(codes) > 0
    letter = np.where(occurs, np.cumsum(occurs), 0)
    bits = int(letter.max(initial=1)).bit_length()
    first = span = 62 // bits
    key = _packed(letter[codes], bits, span)
    order = np.argsort(key)
    keys = key[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.empty(0, bool)
    while span < depth:
        rank = np.zeros(n + span, np.int64)  # 0 past the end
        rank[order] = np.cumsum(fresh)
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(open_):
            break
        at = order[open_]
        pair = rank[at] * (n + 1) + rank[at + span]
        again = np.argsort(pair)
        order[open_] = at[again]
        ordered = pair[again]
        fresh[open_] = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        span *= 2
    return Suffixes(order, letter, bits, first, keys)


def _bounds(codes: np.ndarray, suffixes: Suffixes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` the range of suffixes that start with it."""
    size = wanted.shape[1]
    lead = min(size, suffixes.span)
    letters = np.where(wanted < len(suffixes.letter), suffixes.letter[np.minimum(wanted, len(suffixes.letter) - 1)], 0)
    low = np.zeros(len(wanted), np.int64)
    for j in range(lead):
        low = low << suffixes.bits | letters[:, j]
    rest = suffixes.bits * (suffixes.span - lead)
    lo, hi = np.searchsorted(suffixes.keys, low << rest), np.searchsorted(suffixes.keys, (low + 1) << rest)
    hi = np.where((letters > 0).all(axis=1), hi, lo)
    some = np.flatnonzero(lo < hi) if size > lead else np.empty(0, np.int64)
    if len(some):
        lo[some], hi[some] = _narrowed(codes, suffixes.order, wanted[some], lo[some], hi[some], lead)
    return lo, hi


def _narrowed(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, first: np.ndarray, last: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [first, last) whose suffixes go on as ``wanted`` does after ``lead`` elements."""
    size = wanted.shape[1]
    padded = np.concatenate([codes, np.full(size, -1, np.int64)])
    out = []
    for past in (False, True):
        lo, hi = first.copy(), last.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            state = np.zeros(len(wanted), np.int64)  # -1: the suffix is smaller, 1: larger
            for j in range(lead, size):
                state = np.where(state == 0, np.sign(padded[at + j] - wanted[:, j]), state)
            less = (state <= 0) if past else (state < 0)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        out.append(lo)
    return out[0], out[1]


def edges(codes: np.ndarray, model: Pieces) -> np.ndarray:
    """grid[position, length]: the piece that occurs there, or -1."""
    longest = model.by_length[-1][0]
    suffixes = suffix_array(codes, longest)
    grid = np.full((len(codes), longest + 1), -1, np.int32)
    for size, wanted, ids in model.by_length:
        lo, hi = _bounds(codes, suffixes, wanted)
        count = hi - lo
        total = int(count.sum())
        if total:
            inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            grid[suffixes.order[np.repeat(lo, count) + inside], size] = np.repeat(ids, count)
    return grid


def _relax(grid: np.ndarray, starts: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, owners) of the symbols that are left; at first each character is one."""
    longest = grid.shape[1] - 1
    size = np.ones(len(starts), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    none = np.int64(len(rank))
    while len(starts):
        both = np.zeros(len(starts), np.int64)
        both[:-1] = np.where(owner[1:] == owner[:-1], size[1:] + size[:-1], 0)
        piece = np.where((both > 0) & (both <= longest), grid[starts, np.minimum(both, longest)], -1)
        value = np.where(piece >= 0, rank[piece], none)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(value, heads)
        lengths = np.diff(np.append(heads, len(starts)))
        live = np.repeat(best < none, lengths)
        done.append((starts[~live], size[~live], owner[~live]))
        hit = np.flatnonzero(live & (value == np.repeat(best, lengths)))
        hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit
        size[hit] = both[hit]
        live[hit + 1] = False
        starts, size, owner = starts[live], size[live], owner[live]
    s, z, o = (np.concatenate(x) for x in zip(*done)) if done else (starts, size, owner)
    order = np.argsort(s, kind="stable")
    return s[order], z[order], o[order]


def _relax_long(grid: np.ndarray, begin: int, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the symbols left of one long cut: the same order of edges, kept in a heap, with linked symbols."""
    longest, ranks = grid.shape[1] - 1, rank.tolist()
    pair = grid[begin : begin + length, 2]  # a merge of single characters; -1 where the next cut's separator follows
    heap = [(ranks[p], k, 1, 1) for k, p in enumerate(pair.tolist()) if p >= 0]
    heapq.heapify(heap)
    size, after, before = [1] * length, list(range(1, length + 1)), list(range(-1, length - 1))
    while heap:
        _, at, left, right = heapq.heappop(heap)
        follower = after[at]
        if size[at] != left or follower >= length or size[follower] != right:
            continue  # one of the two has grown or gone since
        size[at], size[follower], after[at] = left + right, 0, after[follower]
        if after[at] < length:
            before[after[at]] = at
        for a in (before[at], at):
            if a >= 0 and after[a] < length and (both := size[a] + size[after[a]]) <= longest and (piece := grid[begin + a, both]) >= 0:
                heapq.heappush(heap, (ranks[piece], a, size[a], size[after[a]]))
    sizes = np.array(size, np.int64)
    starts = np.flatnonzero(sizes)
    return starts + begin, sizes[starts]


def encode_cuts(cuts: list[str], model: Pieces) -> list[bytes]:
    """The piece ids of each cut as int32 bytes."""
    text = "\0".join(cuts) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(x) for x in cuts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(cuts)), lengths)
    starts = np.arange(lengths.sum()) + owner  # one separator a cut before
    grid = edges(codes, model)
    long = lengths > LONG_CUT
    side_by_side = ~long[owner]
    s, z, o = _relax(grid, starts[side_by_side], owner[side_by_side], model.rank)
    if long.any():
        # a round of all cuts side by side makes one merge a cut, so a long cut would need as many rounds as it has letters
        alone = [(*_relax_long(grid, int(begins[k]), int(lengths[k]), model.rank), k) for k in np.flatnonzero(long).tolist()]
        s, z, o = (np.concatenate([x, *y]) for x, y in zip((s, z, o), zip(*[(a, b, np.full(len(a), k)) for a, b, k in alone])))
        order = np.argsort(s, kind="stable")
        s, z, o = s[order], z[order], o[order]
    ids = grid[s, z]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [np.frombuffer(text[a].encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) + model.first_byte for a in s[unknown].tolist()]
        width = np.ones(len(ids), np.int64)
        width[unknown] = [len(x) for x in spelled]
        out = np.repeat(ids, width)
        out[np.repeat(ids < 0, width)] = np.concatenate(spelled)
        ids, o = out, np.repeat(o, width)
    cut = np.searchsorted(o, np.arange(len(cuts) + 1)) * 4
    raw = ids.astype("<i4").tobytes()
    assert len(begins) == len(cuts)
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@functools.cache
def encoder(path: str):
    """A function from texts to int32 id bytes; its memory of cuts outlives the task in a reused worker."""
    model, known, kept = pieces(path), {}, [0]

    def encode(texts: list[str | None]) -> list[bytes]:
        if kept[0] > MEMO_CHARACTERS:
            known.clear()
            kept[0] = 0
        cut = [_CUT.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        new, part, held = {p for x in cut for p in x if p not in known}, [], 0
        for p in new:
            part.append(p)
            held += len(p) + 1
            kept[0] += len(p) + 8
            if held >= BATCH_CHARACTERS:
                known.update(zip(part, encode_cuts(part, model)))
                part, held = [], 0
        if part:
            known.update(zip(part, encode_cuts(part, model)))
        return [b"".join(map(known.__getitem__, x)) for x in cut]

    return encode


def decode_ids(ids: list[int], model: Pieces) -> str:
    raw = b"".join(map(model.plain.__getitem__, ids))
    return raw.decode("utf-8", "replace").removeprefix(" ")


def _list_array(raw: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in raw], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _gives_back(texts: list[str | None], raw: list[bytes], path: str) -> pa.Array:
    """Whether each row of ids decodes to its text."""
    return pa.array([decode_ids(np.frombuffer(r, "<i4").tolist(), pieces(path)) == (x or "").replace(MARK, " ") for r, x in zip(raw, texts)], pa.bool_())


def encode(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, check: bool = False) -> DataFrame:
    """The columns ``keep`` with n_pieces and ids of each row's whole text.

    With ``check`` the ids are decoded too and round_trip tells whether they give the text back.
    """
    path = model or model_path()
    source = documents.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "__text"):
            texts = part.column(len(keep)).to_pylist()
            raw = encoder(path)(texts)
            flags = [_gives_back(texts, raw, path)] if check else []
            yield pa.record_batch([*part.columns[:-1], pa.array([len(x) // 4 for x in raw], pa.int64()), _list_array(raw), *flags], names=[*keep, "n_pieces", "ids", "round_trip"][: len(keep) + 2 + check])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, n_pieces long, ids array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns ``keep`` with the text of each row's ids; null ids give an empty text."""
    path = model or model_path()
    source = encoded.select(*keep, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [decode_ids(x or [], pieces(path)) for x in part.column(len(keep)).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, text string")


def round_trip(documents: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, round_trip): the ids are encoded, digested and decoded in one pass."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            texts = part.column(1).to_pylist()
            raw = encoder(path)(texts)
            yield pa.record_batch([part.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), _gives_back(texts, raw, path)], names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")
