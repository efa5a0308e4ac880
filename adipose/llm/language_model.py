"""Scores of an n-gram model whose tries are Elias-Fano levels, learnt and asked by shuffles.

The model is a bigram model with absolute discounting, interpolated with add-one unigrams:

    p(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * p1(w),   p1(w) = (c(w) + 1) / (N + V + 1)

with T(v) the distinct followers of v; p(w | v) = p1(w) where v was not seen. A document's tokens
are its words and one end; the end also stands as the context of the first word.

1. One pass cuts the documents into blocks of some MB of text and writes each block's distinct words
   (64-bit hashes) and tokens (numbers in the block, by frequency, as compressed byte planes).
2. Unigram counts: a block's words go to shards by hash, one packed piece a shard; a shard adds up
   the training counts and answers each piece with the totals of its words.
3. Bigrams: a block's distinct pairs go to shards by context, with their training counts. A shard
   adds them up and builds a trie: the followers it has, its contexts with their back-off weights
   D * T(v) / c(v), and each context's followers as numbers relative to the context, with monotone
   pointers between them, all Elias-Fano, and the discounted probabilities (c(v w) - D) / c(v) in
   quantised logarithms, a byte each or two in a shard whose smallest needs more; none saturates.
   The levels are memory-mapped from a temporary file while the shard's pieces are looked up by
   successor search and answered in one code a pair and one a context.
   A context with more than ``SHARD_PAIRS`` tokens is dealt by follower over as many parts as it has
   times that many; its T is the sum of the parts. Such contexts are counted before pairs are sent.
4. A block's tokens meet its answers and every document is scored.

What is moved is proportional to the text, and pieces are bounded by block and shard size. Only the
totals and the split contexts pass through the driver: those with more than ``SHARD_PAIRS`` tokens
and more than one in ``HOT_SHARE``, so at most a million of two numbers each (16 MB).

Defined results: a null text is empty: one token, the end; rows without id are learnt from; rows that
repeat count as often as they occur; without training rows N and V are 0 and every word is unknown;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .elias_fano import EliasFano
from .shared import stored

DISCOUNT = 0.8
BLOCK_BYTES = 4 << 20
SHARD_PAIRS = 1_000_000
SHARD_WORDS = 500_000
HOT_SHARE = 1_000_000
MOST_TASKS = 20_000
STEPS, WEIGHT_STEPS = 32, 2000  # quantisation: steps a decade of probabilities and of back-off weights
END = np.uint64(0x5851F42D4C957F2D)
_BLOCK = "block long, doc_ids binary, no_id binary, held binary, lengths binary, train_tokens long, n_tokens long, tokens binary, short binary, words binary, counts binary"
_ANSWER = "block long, kind int, shard long, codes binary, followers binary, key long, value long"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    x = np.ascontiguousarray(x, np.uint64 if int(x.max(initial=0)) >> 32 else np.uint32)
    planes = x.view(np.uint8).reshape(-1, x.itemsize)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = bytes([width]) + planes[:, :width].T.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    kind = np.dtype(np.uint64 if raw[0] > 4 else np.uint32)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(kind).ravel()


def _short(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.int64)


def _splits(counts: np.ndarray, hot: int, size: int) -> np.ndarray:
    """Over how many parts of ``size`` pairs contexts with these counts are dealt, from count ``hot`` on."""
    return np.where(counts >= hot, -(-counts // size), 1)


def _pair_shard(context: np.ndarray, follower: np.ndarray, splits: np.ndarray, shards: int) -> np.ndarray:
    """The shard of pairs, from the words' short hashes; a split context's pairs are spread by follower."""
    part = ta.mix64(follower.astype(np.uint64)) % splits.astype(np.uint64)
    return (ta.mix64(context.astype(np.uint64) << np.uint64(32) | part) % np.uint64(shards)).astype(np.int64)


def hot_least(n: int) -> int:
    return max(SHARD_PAIRS, n // HOT_SHARE) + 1


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in ta.slices(batches, "text", BLOCK_BYTES):
        data, offsets = ta.utf8(part.column(1))
        low = ta.lower_ascii(data)
        starts, ends, first = ta.words(low, offsets)
        tokens = np.insert(ta.hash_spans(ta.prefix_hash(low), starts, ends), first[1:], END)
        lengths = np.diff(first) + 1
        held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
        words, local, total = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        local, words = number[local], words[order]
        train = np.bincount(local[np.repeat(~held, lengths)], minlength=len(words))
        ids = part.column(0)
        row = (
            int.from_bytes(os.urandom(8), "little") >> 1,
            ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), held.astype(np.uint8).tobytes(), _pack(lengths), int(lengths[~held].sum()), int(lengths.sum()),
            _pack(local), _pack(_short(words)), words.tobytes(), _pack(train),
        )
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), *[pa.binary()] * 4])], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _pieces(order_by: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of each shard that occurs."""
    order = np.argsort(order_by, kind="stable")
    ordered = order_by[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else []
    for a, b in zip(heads, [*heads[1:], len(order)]):
        yield int(ordered[a]), order[a:b]


def _send_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), _unpack(row["counts"])
                out = [(s, row["block"], words[at].tobytes(), _pack(counts[at])) for s, at in _pieces(_short(words) % shards, shards)]
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["shard", "block", "words", "counts"])

    return run


def _add_words(hot: int):
    """A shard's unigram totals: an answer to each piece, its number of known words, its hot words."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        words, index = np.unique(np.concatenate(pieces), return_inverse=True)
        counts = np.bincount(index, np.concatenate([_unpack(x) for x in pdf["counts"]]), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([0] + [len(x) for x in pieces])
        rows = [(b, 0, key[0], _pack(counts[index[a:z]]), None, None, None) for b, a, z in zip(pdf["block"], ends, ends[1:])]
        rows.append((None, 1, key[0], None, None, None, int((counts > 0).sum())))
        rows += [(None, 2, key[0], None, None, w, c) for w, c in zip(words.view(np.int64)[counts >= hot].tolist(), counts[counts >= hot].tolist())]
        return _answers(rows)

    return run


def _answers(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) if rows else [[]] * 7
    whole = {"block": "Int64", "kind": "int32", "shard": "int64", "key": "Int64", "value": "Int64"}
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    return pd.DataFrame({name: pd.Series(list(c), dtype=whole.get(name, object)) for name, c in zip(names, columns)})


def _pairs(local: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, index of each token's pair) of a block's distinct pairs, in order."""
    context = np.concatenate([[end], local[:-1]]).astype(np.int64)
    keys, index = np.unique(context << 32 | local.astype(np.int64), return_inverse=True)
    return keys >> 32, keys & 0xFFFFFFFF, index


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


class Hot(NamedTuple):
    """The split contexts: their hashes in order and their counts."""

    words: np.ndarray
    counts: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """The count of each word that is split, else 0."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _send_pairs(shards: int, hot: Hot, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, local = np.frombuffer(row["words"], np.uint64), _unpack(row["tokens"])
                held, lengths = np.frombuffer(row["held"], np.uint8).astype(bool), _unpack(row["lengths"])
                context, word, index = _pairs(local, int(np.flatnonzero(words == END)[0]))
                train = np.bincount(index[np.repeat(~held, lengths)], minlength=len(context))
                short, splits = _short(words), _splits(hot.of(words), 1, size)
                out = []
                for s, at in _pieces(_pair_shard(short[context], short[word], splits[context], shards), shards):
                    head = _heads(context[at])
                    out.append((s, row["block"], words[context[at][head]].tobytes(), _pack(np.diff(np.append(head, len(at)))), words[word[at]].tobytes(), _pack(train[at])))
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["shard", "block", "contexts", "runs", "followers", "counts"])

    return run


class Trie:
    """Levels in one buffer: contexts, pointers, followers relative to their context, the shard's followers, codes, back-off weights."""

    def __init__(self, buffer):
        at, parts = 0, []
        for _ in range(4):
            part, at = EliasFano.from_buffer(buffer, at)
            parts.append(part)
        self.contexts, self.pointers, self.relative, self.followers = parts
        width = int(np.frombuffer(buffer, np.uint8, 1, at)[0])
        self.codes = np.frombuffer(buffer, f"<u{width}", self.relative.n, at + 1)
        self.weights = np.frombuffer(buffer, "<u2", self.contexts.n, at + 1 + width * self.relative.n)

    @staticmethod
    def levels(context: np.ndarray, follower: np.ndarray, count: np.ndarray, discount: float, total: np.ndarray | None = None) -> bytes:
        """The buffer for pairs in order of (context, follower) with counts above 0; contexts and followers below 2**63.

        ``total``: c(v) of each pair's context, by default the sum of its counts here.
        """
        head = _heads(context) if len(context) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(context)))
        rank = np.repeat(np.arange(len(head)), size)
        if total is None:
            total = np.repeat(np.add.reduceat(count, head) if len(head) else count, size)
        code = 1 + np.round(-np.log10((count - discount) / total) * STEPS)
        weight = 1 + np.round(-np.log10(discount * size / total[head]) * WEIGHT_STEPS)
        known, number = np.unique(follower, return_inverse=True)
        relative = rank.astype(np.uint64) * np.uint64(len(known)) + number.astype(np.uint64)
        parts = [EliasFano.of(context[head]), EliasFano.of(np.append(head, len(context))), EliasFano.of(relative), EliasFano.of(known)]
        width = 1 if code.max(initial=0) <= 255 else 2
        return b"".join(x.to_bytes() for x in parts) + bytes([width]) + code.astype(f"<u{width}").tobytes() + weight.astype("<u2").tobytes()

    @staticmethod
    def _at(level: EliasFano, wanted: np.ndarray) -> np.ndarray:
        """Where each value stands in a level, or -1."""
        at = level.successor(wanted)
        here = at < level.n
        here[here] = level.get(at[here]) == wanted[here]
        return np.where(here, at, -1)

    def find(self, context: np.ndarray, runs: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each pair, 0 where absent; back-off code and followers of each context, 0 where it is unseen).

        ``runs``: how many of the followers belong to each context.
        """
        code, weight, followers = np.zeros(len(follower), np.uint16), np.zeros(len(context), np.uint16), np.zeros(len(context), np.int64)
        rank = self._at(self.contexts, context)
        seen = np.flatnonzero(rank >= 0)
        weight[seen] = self.weights[rank[seen]]
        followers[seen] = (self.pointers.get(rank[seen] + 1) - self.pointers.get(rank[seen])).astype(np.int64)
        number, of = self._at(self.followers, follower), np.repeat(rank, runs)
        both = np.flatnonzero((number >= 0) & (of >= 0))
        at = self._at(self.relative, of[both].astype(np.uint64) * np.uint64(self.followers.n) + number[both].astype(np.uint64))
        code[both[at >= 0]] = self.codes[at[at >= 0]]
        return code, weight, followers


def _add_pairs(hot: Hot, discount: float):
    """A shard's trie, an answer to each piece, and the split contexts' followers in this shard."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # one bit goes for the sign, so that levels hold any hash
        heads = [np.frombuffer(x, np.uint64) for x in pdf["contexts"]]
        runs = [_unpack(x).astype(np.int64) for x in pdf["runs"]]
        context = np.concatenate([np.repeat(h, r) for h, r in zip(heads, runs)])
        follower = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["followers"]]) >> np.uint64(1)
        count = np.concatenate([_unpack(x) for x in pdf["counts"]]).astype(np.int64)
        some = np.flatnonzero(count)
        some = some[np.lexsort((follower[some], context[some]))]
        c, f = context[some], follower[some]
        head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (f[1:] != f[:-1])])) if len(some) else some
        sums, c, f = np.add.reduceat(count[some], head) if len(some) else some, c[head], f[head]
        first = _heads(c) if len(c) else head
        split = hot.of(c)
        total = np.where(split > 0, split, np.repeat(np.add.reduceat(sums, first) if len(c) else sums, np.diff(np.append(first, len(c)))))
        rows = []
        with tempfile.TemporaryFile() as file:
            file.write(Trie.levels(c >> np.uint64(1), f, sums, discount, total))
            file.flush()
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            trie = Trie(mapped)
            at = 0
            for block, h, r in zip(pdf["block"], heads, runs):
                end = at + int(r.sum())
                code, weight, _ = trie.find(h >> np.uint64(1), r, follower[at:end])
                rows.append((block, 3, key[1], _pack(code), _pack(weight), None, None))
                at = end
            here = c[first][split[first] > 0]
            _, _, followers = trie.find(here >> np.uint64(1), np.zeros(len(here), np.int64), np.empty(0, np.uint64))
            rows += [(None, 4, key[1], None, None, w, t) for w, t in zip(here.view(np.int64).tolist(), followers.tolist())]
            del trie
        return _answers(rows)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, word_shards: int, pair_shards: int, least: int, size: int, hot: dict[tuple[int, int], float]):
    """A block's documents from its tokens and all its answers. ``hot``: short hash and count of a split context to its back-off weight."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        local, short = _unpack(row["tokens"]).astype(np.int64), _unpack(row["short"]).astype(np.int64)
        lengths, held = _unpack(row["lengths"]).astype(np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)
        counts, weight = np.zeros(len(short), np.int64), np.full(len(short), -1.0)
        of_shard = dict(_pieces(short % word_shards, word_shards))
        for r in right[right["kind"] == 0].itertuples():
            counts[of_shard[r.shard]] = _unpack(r.codes)
        splits = _splits(counts, least, size)
        end = int(local[lengths[0] - 1])
        context, word, index = _pairs(local, end)
        code = np.zeros(len(context), np.int64)
        of_shard = dict(_pieces(_pair_shard(short[context], short[word], splits[context], pair_shards), pair_shards))
        for r in right[right["kind"] == 3].itertuples():
            at = of_shard[r.shard]
            code[at] = _unpack(r.codes)
            own, found = context[at][_heads(context[at])], _unpack(r.followers).astype(np.int64)
            weight[own[found > 0]] = 10.0 ** ((1 - found[found > 0]) / WEIGHT_STEPS)
        for k in np.flatnonzero(counts >= least).tolist():
            weight[k] = hot[int(short[k]), int(counts[k])]
        base = (counts + 1) / (n + v + 1)
        discounted = np.where(code > 0, 10.0 ** ((1 - code) / STEPS), 0.0)
        p = np.where(weight[context] >= 0, discounted + weight[context] * base[word], base[word])
        first = np.cumsum(lengths) - lengths
        ids = np.frombuffer(row["doc_ids"], np.int64)
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, "Int64").copy() if not any(row["no_id"]) else pd.Series([None if x else int(i) for i, x in zip(ids, row["no_id"])], dtype="Int64"),
                "held_out": held, "n_tokens": lengths, "n_known": np.add.reduceat((counts[local] > 0).astype(np.int64), first), "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(base[local]), first), "score": np.add.reduceat(np.log10(np.minimum(p, 1.0))[index], first),
            }
        )

    return run


def score(documents: DataFrame, discount: float = DISCOUNT, id_col: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text."""
    held = held_out(id_col) if held is None else held
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held.alias("held"))
    blocks = stored(source.mapInArrow(_cut, _BLOCK), "token-blocks")
    sums = blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.length("words") / 8), F.lit(0))).first()
    n, tokens, entries = int(sums[0]), int(sums[1]), int(sums[2])
    word_shards, pair_shards = max(1, -(-entries // SHARD_WORDS)), max(1, -(-tokens // SHARD_PAIRS))
    words = blocks.select("block", "words", "counts").mapInArrow(_send_words(word_shards), "shard long, block long, words binary, counts binary")
    unigrams = stored(words.groupBy("shard").applyInPandas(_add_words(hot_least(n)), _ANSWER), "unigram-answers")
    v = int(unigrams.where("kind = 1").agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0])
    hot_rows = unigrams.where("kind = 2").collect()
    order = np.argsort(keys := np.array([r["key"] for r in hot_rows], np.int64).view(np.uint64))
    hot = Hot(keys[order], np.array([r["value"] for r in hot_rows], np.int64)[order])
    pairs = blocks.select("block", "words", "tokens", "held", "lengths").mapInArrow(_send_pairs(pair_shards, hot, SHARD_PAIRS), "shard long, block long, contexts binary, runs binary, followers binary, counts binary")
    # shards are dealt out evenly, where a hash would put several of them into one task
    parts = min(pair_shards, MOST_TASKS)
    pairs = pairs.withColumn("part", (F.col("shard") % parts).cast("int")).repartitionById(parts, F.col("part"))
    bigrams = stored(pairs.groupBy("part", "shard").applyInPandas(_add_pairs(hot, discount), _ANSWER), "bigram-answers")
    followers = {r["key"]: r["t"] for r in bigrams.where("kind = 4").groupBy("key").agg(F.sum("value").alias("t")).collect()}
    weights = {(int(s), r["value"]): discount * followers.get(r["key"], 0) / r["value"] for s, r in zip(_short(keys), hot_rows)}
    answers = unigrams.where("kind = 0").unionByName(bigrams.where("kind = 3"))
    left = blocks.select("block", "doc_ids", "no_id", "held", "lengths", "tokens", "short")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(n, v, word_shards, pair_shards, hot_least(n), SHARD_PAIRS, weights), _SCORES)
