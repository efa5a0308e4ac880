"""Spelling variants: words that differ by one code point, by dynamic programming over a sorted word list.

A word of L code points and a word near it agree in their first a = (L - 1) // 2 code points or in
their last L - a. So the vocabulary is sorted twice, as it is and with reversed words, and a word asks
in each order only the stretch of the list that starts as it does. Both lists are cut into shards of
about ``SHARD`` words in order; a word is sent to the shards that its stretch meets, found by binary
search over the shards' first words.

In a shard the list is scanned for all its words side by side. A row of the edit matrix has three
cells in the band (costs 0, 1 and more), so it is one small number, and the next row is a table
look-up by which of three letters match. Rows are kept for each depth: of the next word only the
rows below the common prefix with the word before it are new, and where a row has no cell below two,
all words that share this prefix are skipped by the minima of common prefixes. Of what a word finds
in a shard only the number and the best partner leave the task.

On Spark: runs are taken, damaged and counted by expressions (partial counts before the shuffle);
forms are followed to the last by doubling, some four joins. A shard that very many words ask is
asked in blocks of ``BLOCK`` words.

Defined results: null texts have no words, a null id counts as an empty string in the damage's key;
repeated rows count as often as they occur; an empty table gives no rows; other columns are not read;
a run of any length is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Fixed values of the task.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
DAMAGED_OF, LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 31, 7, 2, 10

SHARD, BLOCK = 20_000, 20_000
_LANES = 4_000  # words that are scanned side by side
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the damaged runs with their counts over all documents."""
    runs = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGED_OF == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# --- the scan of one shard


def _transitions() -> np.ndarray:
    """next[row, match]: rows are three costs, capped at 2, as a number to base 3; bit j of match: the letter equals the word's at depth + j - 1."""
    out = np.zeros((27, 8), np.uint8)
    for row in range(27):
        left, middle, right = row // 9, row // 3 % 3, row % 3
        for match in range(8):
            miss = [0 if match >> j & 1 else 1 for j in range(3)]
            a = min(middle + 1, left + miss[0])
            b = min(right + 1, a + 1, middle + miss[1])
            c = min(b + 1, right + miss[2])
            out[row, match] = min(a, 2) * 9 + min(b, 2) * 3 + min(c, 2)
    return out


_NEXT = _transitions()
_DEAD = 26  # all cells are 2
_EXACT = 1 * 9 + 0 * 3 + 1  # the row after a common prefix


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, each with a 0 behind it, and where each begins."""
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    return data, np.cumsum(sizes + 1) - sizes - 1


def _common_prefixes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """lcp[i] of words i - 1 and i; 0 for the first."""
    n = len(begins)
    out, open_ = np.zeros(n, np.int64), np.arange(1, n)
    while len(open_):
        d = out[open_]
        go = (d < sizes[open_]) & (d < sizes[open_ - 1])
        open_, d = open_[go], d[go]
        same = data[begins[open_] + d] == data[begins[open_ - 1] + d]
        open_ = open_[same]
        out[open_] += 1
    return out


class SortedList:
    """A shard's words in order, with the minima of their common prefixes over 1, 2, 4, ... places."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.data, self.begins = _joined(words)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.lcp = _common_prefixes(self.data, self.begins, self.sizes)
        self.minima = [np.append(self.lcp, -1)]  # -1: past the end
        while (1 << len(self.minima)) <= len(words):
            below, step = self.minima[-1], 1 << (len(self.minima) - 1)
            ahead = np.full(len(below), -1, np.int64)
            ahead[:-step] = below[step:]
            self.minima.append(np.minimum(below, ahead))

    def past(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place after ``place`` whose word shares less than ``depth`` letters with the one before it."""
        at = place + 1
        for k in range(len(self.minima) - 1, -1, -1):
            go = self.minima[k][np.minimum(at, len(self.words))] >= depth
            at = at + (go.astype(np.int64) << k)
        return at

    def near(self, asked: list[bytes], prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, place): each asked word's partners at distance one among the words with its first ``prefixes`` letters."""
        found = [self._scan(asked[k : k + _LANES], prefixes[k : k + _LANES]) for k in range(0, len(asked), _LANES)]
        lane = [f[0] + k * _LANES for k, f in enumerate(found)]
        return np.concatenate(lane or [np.empty(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])

    def _scan(self, asked: list[bytes], prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.words)
        place = np.searchsorted(np.array(self.words, object), np.array([w[:p] for w, p in zip(asked, prefixes.tolist())], object)).astype(np.int64)
        starts = np.array([p < n and self.words[p].startswith(w[:k]) for w, p, k in zip(asked, place.tolist(), prefixes.tolist())], bool)
        # three zeros around each word stand for letters that match nothing
        sizes = np.array([len(w) for w in asked], np.int64)
        letters = np.frombuffer(b"\0" + b"\0\0\0".join(asked) + b"\0\0\0", np.uint8)
        first = np.cumsum(sizes + 3) - sizes - 3 + 1
        rows = np.zeros(int(sizes.sum()) + 2 * len(asked), np.uint8)  # a row a depth, up to one more than the word's letters
        base = np.cumsum(sizes + 2) - sizes - 2
        rows[base + prefixes] = _EXACT
        lane, known = np.flatnonzero(starts), prefixes.astype(np.int64).copy()
        place = place[lane]
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lane):
            depth = known[lane].copy()
            row = rows[base[lane] + depth]
            end, begin, size = self.sizes[place], self.begins[place], sizes[lane]
            going = np.flatnonzero((depth < end) & (row != _DEAD))
            while len(going):
                k, d = lane[going], depth[going]
                letter = self.data[begin[going] + d]
                w = first[k] + d
                match = (letters[w - 1] == letter) | (letters[w] == letter).astype(np.uint8) << 1 | (letters[w + 1] == letter).astype(np.uint8) << 2
                after = _NEXT[row[going], match]
                # past one letter more than the word has, no cell of the band is in the matrix
                after[d >= size[going] + 1] = _DEAD
                depth[going] += 1
                row[going] = after
                alive = after != _DEAD
                keep = going[alive]
                rows[base[lane[keep]] + depth[keep]] = row[keep]
                going = keep[depth[keep] < end[keep]]
            over = size - end  # -1, 0 or 1 where the word's end is in the band
            cell = np.where(over == 0, row // 3 % 3, np.where(over == -1, row // 9, row % 3))
            hit = (depth == end) & (np.abs(over) <= 1) & (cell == 1)
            hits.append((lane[hit], place[hit]))
            place = self.past(place, np.where(row == _DEAD, depth, end + 1))
            shared = self.minima[0][place]
            stay = shared >= prefixes[lane]
            lane, place = lane[stay], place[stay]
            known[lane] = shared[stay]
        return np.concatenate([a for a, _ in hits] or [np.empty(0, np.int64)]), np.concatenate([b for _, b in hits] or [np.empty(0, np.int64)])


def _prefixes(words: list[bytes], reverse: bool) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    ahead = (sizes - 1) // 2
    return sizes - ahead if reverse else ahead


def _latin(column: pa.Array) -> list[bytes]:
    """Words as one byte a code point: all their letters are below 256, and bytes sort as code points do."""
    return [w.encode("latin-1") for w in column.to_pylist()]


_SENT = "shard int, block int, member boolean, word string, n long"
_FOUND = "word string, n_near long, best_n long, best string"


def _search(reverse: bool):
    def run(rows: pa.Table) -> pa.Table:
        member = rows.column("member").combine_chunks()
        listed, asking = rows.filter(member), rows.filter(pc.invert(member))
        listed = listed.sort_by("word")
        words, n = _latin(listed.column("word")), listed.column("n").to_numpy()
        asked = _latin(asking.column("word"))
        lane, place = SortedList(words).near(asked, _prefixes(asked, reverse)) if words and asked else (np.empty(0, np.int64), np.empty(0, np.int64))
        if reverse and len(lane):
            # what shares the first letters too has been found in the other order
            ahead = [(len(w) - 1) // 2 for w in asked]
            new = np.array([asked[k][len(asked[k]) - ahead[k] :] != words[p][len(words[p]) - ahead[k] :] for k, p in zip(lane.tolist(), place.tolist())], bool)
            lane, place = lane[new], place[new]
        plain = [w[::-1] for w in words] if reverse else words
        best: dict[int, tuple[int, bytes]] = {}
        count = np.bincount(lane, minlength=len(asked))
        for k, p in zip(lane.tolist(), place.tolist()):
            key = (-int(n[p]), plain[p])
            if k not in best or key < best[k]:
                best[k] = key
        who = list(best)
        names = [(asked[k][::-1] if reverse else asked[k]).decode("latin-1") for k in who]
        return pa.table({"word": pa.array(names, pa.string()), "n_near": pa.array(count[who] if who else [], pa.int64()), "best_n": pa.array([-best[k][0] for k in who], pa.int64()), "best": pa.array([best[k][1].decode("latin-1") for k in who], pa.string())})

    return run


def _after(prefix: bytes) -> bytes | None:
    """The least string above all that start with ``prefix``; None: there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def _routed(bounds: list[bytes], reverse: bool):
    """Each word as a member of its shard and as asking the shards that its stretch meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(bounds, object)
        for batch in batches:
            words = _latin(batch.column(0))
            part = [w[:k] for w, k in zip(words, _prefixes(words, reverse).tolist())]
            low = np.maximum(np.searchsorted(starts, np.array(part, object), "right") - 1, 0)
            after = [_after(w) for w in part]
            high = np.searchsorted(starts, np.array([w or b"" for w in after], object)) - 1
            high = np.maximum(np.where([w is None for w in after], len(starts) - 1, high), low)
            width = high - low + 1
            row = np.repeat(np.arange(len(words)), width)
            shard = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + low[row]
            own = np.searchsorted(starts, np.array(words, object), "right") - 1
            for flag, rows, shards in ((True, np.arange(len(words)), own), (False, row, shard)):
                at = pa.array(rows)
                yield pa.record_batch([pa.array(shards, pa.int32()), pa.array([flag] * len(rows), pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)], names=["shard", "member", "word", "n"])

    return run


def _one_order(words: DataFrame, shards: int, reverse: bool) -> DataFrame:
    """(word, n_near, best_n, best) of every word with partners that this order finds, a row a shard."""
    of = words.select(F.reverse("word").alias("word"), "n") if reverse else words
    # the first word of each shard: one word a shard at the driver
    ordered = stored(of.repartitionByRange(shards, "word").withColumn("part", F.spark_partition_id()), "sorted-words")
    bounds = sorted(r[0].encode("latin-1") for r in ordered.groupBy("part").agg(F.min("word")).select("min(word)").collect())
    sent = ordered.select("word", "n").mapInArrow(_routed(bounds, reverse), "shard int, member boolean, word string, n long")
    asking = sent.where("not member")
    # a row a shard, so one for 20,000 words
    sizes = asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = sent.join(F.broadcast(sizes), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    return dealt.select("shard", F.explode(block).alias("block"), "member", "word", "n").groupBy("shard", "block").applyInArrow(_search(reverse), _FOUND)


def _roots(forms: DataFrame, deepest: int) -> DataFrame:
    """(word, root) of every word with a form, following forms to the last: each round doubles the step."""
    links, reach = stored(forms.select("word", F.col("form").alias("root")), "forms"), 1
    while reach < deepest:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "forms")
        reach *= 2
    return links


def variants(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(vocabulary(documents, id_col, text), "vocabulary")
    total, most = words.agg(F.count(F.lit(1)), F.max("n")).first()
    shards = max(1, -(-total // SHARD))
    found = _one_order(words, shards, False).unionByName(_one_order(words, shards, True))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    joined = words.join(near, "word", "left")
    close = (-F.col("top.minus")) >= FORM_FACTOR * F.col("n")
    formed = stored(joined.select("word", F.when(close, F.col("top.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, -F.col("top.minus")).alias("form_n")), "near-words")
    # n grows ten times at least from a word to its form
    deepest = len(str((most or 1) // LEAST_COUNT))
    roots = _roots(formed.where("form is not null"), deepest)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
