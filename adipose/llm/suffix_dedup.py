"""Removal of repeated 400-byte strings with suffix arrays.

Every window of ``LENGTH`` bytes owns one anchor: the ``GRAM``-byte gram in it whose hash is smallest
(the leftmost among equals). Equal windows have equal anchors at equal places, so comparing the
windows of equal anchors finds every repeat, and sharding by anchor brings equal windows together.

1. One pass over the texts lists the anchors, each with a digest of the stretch its windows cover.
2. Anchors that occur once have no repeat. Of every other stretch the first place goes with its text
   to a shard, and if it has several places the last one too.
3. Where an anchor has several stretches, all go to the anchor's shard. It drops those none of whose
   window hashes repeats there; for the rest it makes a suffix array by Larsson-Sadakane refinement
   (each round sorts only groups that are still tied, by the rank ``h`` bytes on, doubling ``h``),
   the common prefixes by Kasai's rule in parallel lanes, and marks windows that share ``LENGTH``
   bytes with a neighbour.
4. An anchor with more than ``BLOCK`` stretches is not compared all with all. Its window hashes are
   shuffled first; a stretch without one that repeats is done. Of each hash that repeats the least
   place represents it, and a stretch goes to the representatives of its windows only. One with more
   than ``BLOCK`` followers meets them in blocks: representative and block have suffix arrays of
   their own, and the windows of one are binary-searched in the other. So what is sent grows with
   the stretches, not with their pairs.
5. Where an anchor has one stretch in several places, there is nothing to sort: neighbouring
   stretches of the same two documents travel as one run and the shard compares its bytes.
6. A third and any further place of a stretch is covered by its digest, without moving text: the
   bytes of two of its places have been compared by 3 or 5, and the job stops if they differ.
7. Marked windows become byte spans per document; texts with spans are cut.

``shared_passages`` counts, for each document, the windows of ``PASSAGE`` words that another document
holds too, whatever their bytes: anchors of words, then window hashes where anchors disagree.

Defined results: null is an empty text; texts shorter than ``LENGTH`` stay whole; rows that repeat
are different documents and so repeat each other; rows without id are handled too; spans are judged
on the input; bytes that are cut may split a character, so what is kept is binary; an empty table
gives no rows; other columns are not read. Rows equal in id and text are one document to
``shared_passages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_arrays as ta
from .shared import by_ids, stored

LENGTH, GRAM = 400, 128
BLOCK = 4096
SHARD_BYTES = 1 << 20
RUN_WINDOWS = 1 << 16
PASSAGE, WORD_GRAM = 50, 13
_POSITION_BITS = 28
_CHUNK = 1 << 27
_ANCHORS = "row long, anchor long, stretch long, first long, last long, windows int, times int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` elements, by block prefix and suffix minima."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def owned_windows(prefix: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, windows) of each run of windows with one anchor; no window crosses a document's end."""
    parts = [(np.empty(0, np.int64),) * 3]
    n = int(offsets[-1])
    for a in range(0, n - length + 1, _CHUNK):
        b = min(n, a + _CHUNK + length - 1)
        at = np.arange(a, b - gram + 1)
        value = (ta.hash_spans(prefix, at, at + gram) >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | (at - a).astype(np.uint64)
        owner = (_sliding_min(value, length - gram + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        begin, end = np.clip(offsets[:-1], a, a + len(owner)), np.clip(offsets[1:] - length + 1, a, a + len(owner))
        some = begin < end
        change = np.zeros(len(owner) + 1, np.int8)
        change[begin[some] - a] += 1
        change[end[some] - a] -= 1
        window = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
        owner = owner[window]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)])) if len(window) else window
        parts.append((owner[first] + a, window[first] + a, np.diff(np.append(first, len(owner)))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _list_anchors(length: int, gram: int):
    """A row per anchor and stretch of a document with its ``times``; rows without anchor are spans."""
    names = [x.split()[0] for x in _ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            data, offsets = ta.utf8(part.column(1))
            prefix = ta.prefix_hash(data)
            rows = part.column(0).to_numpy()
            anchor, first, windows = owned_windows(prefix, offsets, length, gram)
            doc = np.searchsorted(offsets, first, "right") - 1
            stretch = ta.hash_spans(prefix, first, first + windows + length - 1) + ta.mix64((anchor - first).astype(np.uint64))
            name = ta.hash_spans(prefix, anchor, anchor + gram)
            _, at, group, times = np.unique(ta.mix64(ta.mix64(name) ^ stretch) + ta.mix64(doc.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
            last = np.empty(len(at), np.int64)
            last[group] = np.arange(len(group))
            lo = first - offsets[doc]
            columns = [rows[doc[at]], name[at].view(np.int64), stretch[at].view(np.int64), lo[at], lo[last], windows[at].astype(np.int32), times.astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in columns], names=names)
            # places between a stretch's first and last in the same document
            inner = times[group] > 2
            if inner.any():
                a, b, of = first[inner], (first + windows + length - 1)[inner], doc[inner]
                head = np.flatnonzero(np.concatenate([[True], (a[1:] > b[:-1]) | (of[1:] != of[:-1])]))
                tail = np.append(head[1:], len(a)) - 1
                none, begin = pa.nulls(len(head), pa.int64()), a[head] - offsets[of[head]]
                yield pa.record_batch([pa.array(rows[of[head]]), none, none, pa.array(begin), pa.array(begin), pa.array((b[tail] - a[head]).astype(np.int32)), pa.nulls(len(head), pa.int32())], names=names)

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes, ties in text order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def group(at: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Set the ranks of sorted positions ``at``; returns which of them are still tied."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(base[heads], sizes)
        return np.repeat(sizes > 1, sizes)

    slots = np.arange(n)
    tied = group(order, key[order], slots + 1) if n else np.zeros(0, bool)
    slots, h = slots[tied], 8
    while len(slots) and h < depth:
        at = order[slots]
        after = np.zeros(len(at), np.int64)
        inside = at + h < n
        after[inside] = rank[at[inside] + h]
        keys = rank[at] * (n + 2) + after
        local = np.argsort(keys, kind="stable")
        at, keys = at[local], keys[local]
        order[slots] = at
        tied = group(at, keys, slots + 1)
        slots = slots[tied]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 256) -> np.ndarray:
    """For each position the common prefix with its predecessor in ``order``, ``most`` at most.

    Kasai's rule, a position's value is at least its left neighbour's less one, is followed in text
    order by lanes of ``lanes`` positions side by side. Where the neighbour's value is ``most`` the two
    may be tied in ``order``, and the rule holds only if the predecessor moves along with it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rows = -(-n // lanes)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = eight << np.uint64(8) | padded[j : j + n]
    out = np.zeros(rows * lanes, np.int32)
    have = np.zeros(rows, np.int64)
    other = np.full(rows, -1, np.int64)
    begin = np.arange(rows) * lanes

    def grow(some: np.ndarray, values: np.ndarray, step: int) -> None:
        """Lengthen by ``step`` bytes where they are equal, as long as ``most`` and the text's end allow."""
        while len(some):
            a, b, l = at[some], other[some], have[some]
            some = some[(l + step <= np.minimum(most, n - np.maximum(a, b)))]
            l, a, b = have[some], at[some], other[some]
            some = some[values[a + l] == values[b + l]]
            have[some] += step

    for step in range(lanes):
        at = begin + step
        last, other = other, np.where(at < n, before[np.minimum(at, n - 1)], -1)
        holds = (other >= 0) & ((have < most) | (other == last + 1))
        have = np.where(holds, np.maximum(have - 1, 0), 0)
        some = np.flatnonzero((other >= 0) & (have < most))
        grow(some, eight, 8)
        grow(some, text, 1)
        out[at] = have
    return out[:n]


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | text[at + j]
    return out


def find_windows(text: np.ndarray, order: np.ndarray, other: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which windows other[start:start+length] occur in ``text``, by binary search in its suffix array."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    wanted = np.concatenate([other, np.zeros(length + 8, np.uint8)])
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    found = np.zeros(len(starts), bool)
    while (open_ := np.flatnonzero((lo < hi) & ~found)).size:
        mid = (lo[open_] + hi[open_]) // 2
        a, b = order[mid], starts[open_]
        sign, left = np.zeros(len(open_), np.int8), np.arange(len(open_))
        for j in range(0, length, 8):
            x, y = _words(padded, a[left] + j), _words(wanted, b[left] + j)
            if length - j < 8:
                shift = np.uint64(8 * (8 - (length - j)))
                x, y = x >> shift, y >> shift
            sign[left[x < y]], sign[left[x > y]] = -1, 1
            left = left[x == y]
            if not len(left):
                break
        found[open_[(sign == 0) & (a + length <= len(text))]] = True
        lo[open_[sign < 0]] = mid[sign < 0] + 1
        hi[open_[sign >= 0]] = mid[sign >= 0]
    return found


def _concatenated(bodies: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, window starts, index of each window's stretch) of stretches one after the other.

    Each ends with a byte that UTF-8 never has, so nothing equal crosses an end.
    """
    text = np.frombuffer(b"".join(x + b"\xff" for x in bodies), np.uint8)
    base = np.cumsum(windows + length) - (windows + length)
    which = np.repeat(np.arange(len(bodies)), windows)
    starts = base[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    return text, starts, which


def repeated_windows(bodies: list[bytes], windows: np.ndarray, block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch index, window index in it) of windows that another window equals.

    ``block`` is 0 or 1; with two blocks only repeats between them are wanted.
    """
    if not len(bodies):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text, starts, which = _concatenated(bodies, windows, length)
    hashes = ta.hash_spans(ta.prefix_hash(text), starts, starts + length)
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = np.zeros(len(order), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    maybe = np.zeros(len(order), bool)
    maybe[order] = same
    some = np.unique(which[maybe])
    marked = np.zeros(len(starts), bool)
    if len(some):
        first = np.cumsum(windows) - windows
        sides = [some[block[some] == k] for k in (0, 1)]
        arrays = []
        for own in sides:
            if len(own):
                part, at, in_part = _concatenated([bodies[k] for k in own], windows[own], length)
                index = first[own][in_part] + np.arange(len(at)) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
                arrays.append((part, at, index, suffix_array(part, length)))
        if len(arrays) == 1 and not (block == 1).any():
            part, at, index, sa = arrays[0]
            shared = np.flatnonzero(common_prefixes(part, sa, length) >= length)
            before = np.empty(len(part), np.int64)
            before[sa[1:]] = sa[:-1]
            hit = np.zeros(len(part), bool)
            hit[shared] = hit[before[shared]] = True
            marked[index[hit[at]]] = True
            marked &= maybe
        elif len(arrays) == 2:
            for (part, _, _, sa), (other, at, index, _) in (arrays, arrays[::-1]):
                try_ = maybe[index]
                marked[index[try_]] = find_windows(part, sa, other, at[try_], length)
    hits = np.flatnonzero(marked)
    return which[hits], hits - (np.cumsum(windows) - windows)[which[hits]]


def _shard(length: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        windows = pdf["windows"].to_numpy().astype(np.int64)
        run, sure = pdf["run"].to_numpy(), pdf["sure"].to_numpy()
        pairs = pdf[run].groupby("cell")["body"]
        if (pairs.first() != pairs.last()).any() or (pairs.size() != 2).any():
            raise ValueError("two different stretches have one digest")
        whole = pd.DataFrame({"row": pdf["row"], "lo": pdf["first"], "hi": pdf["first"] + pdf["windows"] + length - 1})[run]
        pdf, windows, sure = pdf[~run], windows[~run], sure[~run]
        if key[1] == key[2]:
            # a place that follows several representatives of this shard is there once
            own = sure | ~pdf.duplicated(["row", "first", "sure"]).to_numpy()
            pdf, windows, sure = pdf[own], windows[own], sure[own]
        block = (pdf["block"].to_numpy() != key[1]).astype(np.int64)
        which, window = repeated_windows(pdf["body"].tolist(), windows, block, length)
        if key[1] == key[2] and (np.bincount(which, minlength=len(pdf)) < windows)[sure].any():
            raise ValueError("two different stretches have one digest")
        if not len(which):
            return whole
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(which)) - 1
        first = pdf["first"].to_numpy()[which[head]]
        marked = pd.DataFrame({"row": pdf["row"].to_numpy()[which[head]], "lo": first + window[head], "hi": first + window[tail] + length})
        return pd.concat([whole, marked], ignore_index=True)

    return run


_WANTED = "first long, windows int, cell long, block int, blocks int, sure boolean, run boolean"


def _stretch_bodies(length: int):
    names = [x.split()[0] for x in _WANTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            data, offsets = ta.utf8(part.column(part.schema.get_field_index("text")))
            lists = part.column(part.schema.get_field_index("wanted"))
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            of = np.repeat(np.arange(part.num_rows), np.diff(ends))
            lo = offsets[of] + flat.field("first").to_numpy()
            hi = lo + flat.field("windows").to_numpy() + length - 1
            raw = data.tobytes()
            rows = part.column(part.schema.get_field_index("row"))
            for at in range(0, len(lo), 4096):
                stop = min(len(lo), at + 4096)
                bodies = pa.array([raw[a:b] for a, b in zip(lo[at:stop].tolist(), hi[at:stop].tolist())], pa.binary())
                yield pa.record_batch([rows.take(pa.array(of[at:stop])), *(flat.field(c).slice(at, stop - at) for c in names), bodies], names=["row", *names, "body"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, ...) to what is left of each text; columns behind them pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for part in ta.slices(batches, "text"):
        rows = []
        for doc, text, spans in zip(*(part.column(k).to_pylist() for k in range(3))):
            raw, runs = (text or "").encode(), []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
            rows.append((doc, len(raw), len(raw) - len(kept), len(runs), kept))
        cut = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        yield pa.record_batch([*cut, *part.columns[3:]], names=[*schema.names, *part.schema.names[3:]])


def _runs(stretches: DataFrame) -> DataFrame:
    """The two places of each stretch that is its anchor's only one, neighbours of the same two documents joined.

    A run ends after ``RUN_WINDOWS`` windows, so none is longer than a small part of a shard.
    """
    pair = ["row_a", "row_b", "apart"]
    each = stretches.where("not mixed").select(F.col("one.row").alias("row_a"), F.col("two.row").alias("row_b"), (F.col("two.at") - F.col("one.at")).alias("apart"), F.col("one.at").alias("first"), "windows")
    along = Window.partitionBy(*pair).orderBy("first")
    new = F.coalesce(F.lag(F.col("first") + F.col("windows")).over(along) != F.col("first"), F.lit(True))
    begun = each.withColumn("new", new).withColumn("begin", F.last(F.when(F.col("new"), F.col("first")), ignorenulls=True).over(along))
    part = F.floor((F.col("first") - F.col("begin")) / RUN_WINDOWS)
    runs = begun.groupBy(*pair, "begin", part.alias("part")).agg(F.min("first").alias("first"), F.sum("windows").cast("int").alias("windows"))
    places = F.explode(F.array(F.struct(F.col("row_a").alias("row"), "first"), F.struct(F.col("row_b").alias("row"), (F.col("first") + F.col("apart")).alias("first"))))
    return runs.select(places.alias("place"), "windows", F.xxhash64(*pair, "first").alias("cell"), F.lit(0).alias("block"), F.lit(1).alias("blocks"), F.lit(True).alias("sure"), F.lit(True).alias("run")).select("place.*", "windows", "cell", "block", "blocks", "sure", "run")


def _window_hashes(length: int):
    """(id, window): the hash of each window of the wanted stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            data, offsets = ta.utf8(part.column(part.schema.get_field_index("text")))
            prefix = ta.prefix_hash(data)
            lists = part.column(part.schema.get_field_index("wanted"))
            flat, of = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            ids, first, windows = (flat.field(c).to_numpy().astype(np.int64) for c in ("id", "first", "windows"))
            first = first + offsets[of]
            for at in range(0, len(ids), 4096):
                lo, n = first[at : at + 4096], windows[at : at + 4096]
                start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield pa.record_batch([pa.array(np.repeat(ids[at : at + 4096], n)), pa.array(ta.hash_spans(prefix, start, start + length).view(np.int64))], names=["id", "window"])

    return run


def _followers(rows: DataFrame, split: DataFrame, length: int) -> DataFrame:
    """What is sent of the stretches ``split`` (row, first, windows, id): each to the representatives of its windows.

    A window's representative is the place with the least id that has it. Windows that are nowhere
    else need no text. Followers are dealt to blocks from 1; block 0 is the representative.
    """
    wanted = stored(split.groupBy("row").agg(F.collect_list(F.struct("id", "first", "windows")).alias("wanted")), "split-rows")
    texts = by_ids(rows.select("row", "text"), wanted.select("row"), "row").dropDuplicates(["row"])
    hashes = stored(texts.join(wanted, "row").mapInArrow(_window_hashes(length), "id long, window long"), "split-windows")
    repeated = hashes.groupBy("window").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("window", "head")
    pairs = stored(hashes.join(stored(repeated, "repeated-windows"), "window").select("id", "head").distinct(), "followers")
    sizes = stored(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "follower-blocks")
    block = F.when((F.col("id") == F.col("head")) | (F.col("blocks") == 1), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    return pairs.join(sizes, "head").join(split, "id").select("row", "first", "windows", F.xxhash64("head").alias("cell"), block.alias("block"), "blocks", F.lit(False).alias("sure"), F.lit(False).alias("run"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, spans) for each of ``rows`` (row, text) with repeated windows; spans may overlap."""
    listed = stored(rows.select("row", "text").mapInArrow(_list_anchors(length, gram), _ANCHORS), "anchors")
    anchors = listed.where("anchor is not null")
    inner = listed.where("anchor is null").select("row", F.col("first").alias("lo"), (F.col("first") + F.col("windows")).alias("hi"))
    repeated = anchors.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    again = stored(anchors.join(repeated, "anchor"), "repeated-anchors")
    one, two = F.min(F.struct("row", F.col("first").alias("at"))), F.max(F.struct("row", F.col("last").alias("at")))
    stretches = stored(again.groupBy("anchor", "stretch").agg(F.sum("times").alias("n"), one.alias("one"), two.alias("two"), F.max("windows").alias("windows"), F.first("mixed").alias("mixed")), "stretches")
    # the third and further places
    more = again.join(stretches.where("n > 2").select("anchor", "stretch"), ["anchor", "stretch"]).select("row", F.explode(F.array_distinct(F.array("first", "last"))).alias("lo"), "windows")
    whole = more.select("row", "lo", (F.col("lo") + F.col("windows") + length - 1).alias("hi"))
    # different stretches of one anchor
    mixed = stretches.where("mixed")
    sizes = stored(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")), "anchor-sizes")
    sized = mixed.join(sizes, "anchor")
    split = stored(sized.where(F.col("members") > BLOCK).select("one.row", F.col("one.at").alias("first"), "windows", F.xxhash64("one.row", "one.at").alias("id")), "split-anchors")
    # of a split anchor a stretch with two places is compared there, beside what its windows meet
    paired = F.when(F.col("members") > BLOCK, F.xxhash64("anchor", "stretch")).otherwise(F.xxhash64("anchor"))
    places = F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))
    apart = sized.where((F.col("members") <= BLOCK) | (F.col("n") > 1)).select(F.explode(places).alias("place"), "windows", paired.alias("cell"), F.lit(0).alias("block"), F.lit(1).alias("blocks"), (F.col("n") > 1).alias("sure"), F.lit(False).alias("run"))
    apart = apart.select("place.row", F.col("place.at").alias("first"), "windows", "cell", "block", "blocks", "sure", "run")
    if not split.isEmpty():
        apart = apart.unionByName(_followers(rows, split, length))
    sent = stored(apart.unionByName(_runs(stretches)), "sent-stretches")
    total = sent.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = stored(sent.groupBy("row").agg(F.collect_list(F.struct("first", "windows", "cell", "block", "blocks", "sure", "run")).alias("wanted")), "wanted-stretches")
    texts = by_ids(rows.select("row", "text"), wanted.select("row"), "row").dropDuplicates(["row"])
    bodies = texts.join(wanted, "row").mapInArrow(_stretch_bodies(length), f"row long, {_WANTED}, body binary")
    # a representative meets every block of its followers and has cells of its own; the others share shards
    is_head = (F.col("block") == 0) & (F.col("blocks") > 1)
    other = bodies.withColumn("other", F.explode(F.when(is_head, F.sequence(F.lit(1), F.col("blocks"))).otherwise(F.array(F.lit(0)))))
    shard = F.when(F.col("blocks") > 1, F.col("cell")).otherwise(F.pmod("cell", F.lit(int(shards))))
    cells = other.select(shard.alias("shard"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "first", "windows", "cell", "block", "sure", "run", "body")
    marked = cells.groupBy("shard", "low", "high").applyInPandas(_shard(length), "row long, lo long, hi long")
    return whole.unionByName(inner).unionByName(marked).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _word_anchors(size: int, gram: int, listed: bool):
    """Of each document its anchors with their stretches, or (``listed``: the wanted ones) the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            data, offsets = ta.utf8(part.column(part.schema.get_field_index("text")))
            low = ta.lower_ascii(data)
            starts, ends, ends_of = ta.words(low, offsets)
            prefix = ta.prefix_hash(ta.hash_spans(ta.prefix_hash(low), starts, ends))
            rows = part.column(part.schema.get_field_index("row")).to_numpy()
            anchor, first, windows = owned_windows(prefix, ends_of, size, gram)
            doc = np.searchsorted(ends_of, first, "right") - 1
            name = ta.hash_spans(prefix, anchor, anchor + gram)
            stretch = ta.hash_spans(prefix, first, first + windows + size - 1) + ta.mix64((anchor - first).astype(np.uint64))
            key = lambda names, stretches, docs: ta.mix64(ta.mix64(names) ^ stretches) + ta.mix64(docs.astype(np.uint64))
            mine = key(name, stretch, doc)
            if listed:
                lists = part.column(part.schema.get_field_index("wanted"))
                flat, of = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                wanted = key(flat.field("anchor").to_numpy().view(np.uint64), flat.field("stretch").to_numpy().view(np.uint64), of)
                order = np.argsort(wanted)
                at = order[np.minimum(np.searchsorted(wanted[order], mine), len(order) - 1)] if len(order) else np.empty(0, np.int64)
                some = np.flatnonzero(wanted[at] == mine) if len(order) else at
                window = np.repeat(first[some], windows[some]) + np.arange(int(windows[some].sum())) - np.repeat(np.cumsum(windows[some]) - windows[some], windows[some])
                alone = flat.field("alone").to_numpy(zero_copy_only=False)[at[some]]
                out = [rows[np.repeat(doc[some], windows[some])], ta.hash_spans(prefix, window, window + size).view(np.int64), np.repeat(alone, windows[some]).astype(bool)]
                yield pa.record_batch([pa.array(x) for x in out], names=["row", "window", "alone"])
            else:
                _, at, group = np.unique(mine, return_index=True, return_inverse=True)
                sums = np.bincount(group, windows, len(at)).astype(np.int64)
                yield pa.record_batch([pa.array(x) for x in (rows[doc[at]], name[at].view(np.int64), stretch[at].view(np.int64), sums)], names=["row", "anchor", "stretch", "windows"])

    return run


def shared_passages(rows: DataFrame, size: int = PASSAGE, gram: int = WORD_GRAM) -> DataFrame:
    """(row, n_shared_windows): the windows of ``size`` words (A-Z lower-cased) that other rows hold too; rows without any are left out."""
    anchors = stored(rows.select("row", "text").mapInArrow(_word_anchors(size, gram, False), "row long, anchor long, stretch long, windows long"), "word-anchors")
    common = anchors.groupBy("anchor").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), (F.min("stretch") != F.max("stretch")).alias("mixed")).where("lo <> hi").select("anchor", "mixed")
    again = stored(anchors.join(common, "anchor"), "common-anchors")
    stretches = stored(again.groupBy("anchor", "stretch").agg(F.min("row").alias("row"), (F.min("row") == F.max("row")).alias("alone"), F.first("mixed").alias("mixed")), "word-stretches")
    whole = again.join(stretches.where("not alone").select("anchor", "stretch"), ["anchor", "stretch"]).select("row", "windows")
    # where an anchor's stretches differ, their windows are compared; one document stands for those with the same stretch
    wanted = stored(stretches.where("mixed").groupBy("row").agg(F.collect_list(F.struct("anchor", "stretch", "alone")).alias("wanted")), "wanted-windows")
    texts = by_ids(rows.select("row", "text"), wanted.select("row"), "row").dropDuplicates(["row"])
    windows = stored(texts.join(wanted, "row").mapInArrow(_word_anchors(size, gram, True), "row long, window long, alone boolean"), "passage-windows")
    shared = windows.groupBy("window").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.bool_and("alone").alias("alone")).where("lo <> hi or not alone").select("window")
    found = windows.where("alone").join(shared, "window").select("row", F.lit(1).cast("long").alias("windows"))
    return whole.unionByName(found).groupBy("row").agg(F.sum("windows").alias("n_shared_windows"))


def drop_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; ``kept`` are the bytes that are left.

    With ``passage``, a number of words, n_shared_windows is added: the document's windows of so many
    words that another document holds too.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), "text"))
    spans = repeated_spans(rows, length, gram)
    if passage:
        spans = spans.join(shared_passages(rows, passage, passage // 4 + 1), "row", "full")
    spans = stored(spans, "spans")
    ids, more = spans.select("row"), ["n_shared_windows"] if passage else []
    none = F.array().cast(spans.schema["spans"].dataType)
    touched = by_ids(rows, ids, "row").join(spans, "row").select("doc_id", "text", F.coalesce("spans", none).alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in more])
    touched = touched.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", {c} long" for c in more))
    zero = F.lit(0).cast("long")
    same = by_ids(rows, ids, "row", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), *[zero.alias(c) for c in more])
    return touched.unionByName(same)
