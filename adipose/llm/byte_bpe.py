"""Byte-level BPE encoding and decoding by recursive queries of DuckDB inside each partition.

Texts are cut by the tokenizer's pattern. Each distinct word of a batch becomes rows (word, position,
token), at first a row a byte. A recursive query joins every adjacent pair with the merge table,
contracts each word's leftmost pair of least rank and goes on with the words that had a pair until
none has one. A word that is a token itself is that token, as in the public library. Decoding joins
the ids of a batch with the tokens' bytes and aggregates them in order of position.

The intermediate rows of a word grow with the square of its bytes, so the words of one query are
bounded by the sum of these squares. A word of more than ``LONG_BYTES`` bytes (a run of letters
without a space, mostly) would need as many rounds over as many rows; it is contracted by the same
rule with a heap of its pairs.

Defined results: a null text is an empty text without tokens; rows that repeat are each encoded,
rows without id too; very long texts are encoded whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG_BYTES = 1_000
BATCH_ROWS = 3_000_000  # sum of squared word lengths in one recursive query
MEMO_WORDS = 700_000
SLICE_BYTES = 3 << 20

#: A row is a token with the one that follows it in its word; ``least`` is the rank of this pair and the place in one number, -1 where the two don't merge.
_CONTRACT = """
WITH RECURSIVE t(step, word, pos, next_pos, token, follower, least) AS (
  SELECT 0, b.word, b.pos, b.pos + 1, b.token, b.follower, coalesce(m.merged * 4096 + b.pos, -1) FROM bytes AS b LEFT JOIN merges AS m ON m.pair = b.token * 1048576 + b.follower
  UNION ALL
  (
    WITH best AS (
      SELECT word, min(least) AS least FROM t WHERE least >= 0 GROUP BY word
    ), hit AS (
      SELECT l.word, x.pos, x.next_pos AS gone, l.least // 4096 AS merged FROM best AS l JOIN t AS x ON x.word = l.word AND x.least = l.least
    ), contraction AS (
      SELECT h.word, h.pos, h.merged, h.gone, y.next_pos, y.follower FROM hit AS h JOIN t AS y ON y.word = h.word AND y.pos = h.gone
    ), kept AS (
      SELECT t.step + 1 AS step, t.word, t.pos,
             CASE WHEN t.pos = c.pos THEN c.next_pos ELSE t.next_pos END AS next_pos,
             CASE WHEN t.pos = c.pos THEN c.merged ELSE t.token END AS token,
             CASE WHEN t.pos = c.pos THEN c.follower WHEN t.next_pos = c.pos THEN c.merged ELSE t.follower END AS follower
      FROM t JOIN contraction AS c ON c.word = t.word AND c.gone <> t.pos
    )
    SELECT k.step, k.word, k.pos, k.next_pos, k.token, k.follower, coalesce(m.merged * 4096 + k.pos, -1) FROM kept AS k LEFT JOIN merges AS m ON m.pair = k.token * 1048576 + k.follower
  )
), last AS (
  SELECT word, max(step) AS step FROM t GROUP BY word
)
SELECT t.word, t.token FROM t JOIN last AS l ON l.word = t.word AND l.step = t.step ORDER BY t.word, t.pos
"""
#: One thread: the aggregate sees the rows in the order of the subquery.
_SPELL = "SELECT row, unhex(string_agg(spelled, '')) AS bytes FROM (SELECT i.row, v.spelled FROM ids AS i JOIN vocabulary AS v ON v.token = i.token ORDER BY i.pos) GROUP BY row"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def merges(path: str) -> dict[tuple[int, int], int]:
    """(left, right) -> the token that both spell together; its id is also the pair's rank."""
    known = ranks(path)
    cuts = ((t[:i], t[i:], r) for t, r in known.items() for i in range(1, len(t)))
    return {(known[a], known[b]): r for a, b, r in cuts if a in known and b in known}


@functools.cache
def _database(path: str):
    """A database in memory with the merge table and the spelling of each token, one a worker."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
    pairs = merges(path)
    table = np.array([(a << 20 | b, r) for (a, b), r in pairs.items()], np.int64).reshape(-1, 2)
    con.register("found", pa.table({"pair": table[:, 0], "merged": table[:, 1]}))
    con.execute("CREATE TABLE merges AS SELECT * FROM found")
    con.unregister("found")
    con.register("found", pa.table({"token": pa.array(ranks(path).values(), pa.int64()), "spelled": [t.hex() for t in ranks(path)]}))
    con.execute("CREATE TABLE vocabulary AS SELECT * FROM found")
    con.unregister("found")
    return con


def _single(path: str) -> np.ndarray:
    known = ranks(path)
    return np.array([known[bytes([b])] for b in range(256)], np.int64)


def contract_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, of ``LONG_BYTES`` at most, as int32 bytes."""
    con = _database(path)
    sizes = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = _single(path)[np.frombuffer(b"".join(words), np.uint8)]
    follower = np.append(token[1:], -1)
    follower[np.cumsum(sizes) - 1] = -1
    con.register("bytes", pa.table({"word": word, "pos": pos, "token": token, "follower": follower}))
    found = con.sql(_CONTRACT).to_arrow_table()
    con.unregister("bytes")
    owner, ids = (found.column(k).to_numpy() for k in (0, 1))
    ends = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
    raw = ids.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def contract_long(word: bytes, path: str) -> bytes:
    """The ids of one long word: the same rule, with the pairs in a heap and tokens linked."""
    pairs, n = merges(path), len(word)
    token: list[int] = _single(path)[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, token[k], token[k + 1]) for k in range(n - 1) if (r := pairs.get((token[k], token[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        merged, at, left, right = heapq.heappop(heap)
        follower = after[at]
        if token[at] != left or follower >= n or token[follower] != right:
            continue  # one of the two has been contracted since
        token[at], token[follower], after[at] = merged, -1, after[follower]
        if after[at] < n:
            before[after[at]] = at
        for a in (before[at], at):
            if a >= 0 and after[a] < n and (r := pairs.get((token[a], token[after[a]]))) is not None:
                heapq.heappush(heap, (r, a, token[a], token[after[a]]))
    return np.array([x for x in token if x >= 0], "<u4").tobytes()


@functools.cache
def encoder(path: str):
    """A function from texts to uint32 id bytes; its memory of words outlives the task in a reused worker."""
    whole, known = {t: np.array([r], "<u4").tobytes() for t, r in ranks(path).items()}, {}

    def learn(words: set[str]) -> None:
        part, rows = [], 0
        for w in words:
            spelled = w.encode()
            if spelled in whole:
                known[w] = whole[spelled]
            elif len(spelled) > LONG_BYTES:
                known[w] = contract_long(spelled, path)
            else:
                part.append((w, spelled))
                rows += len(spelled) ** 2
            if rows >= BATCH_ROWS:
                known.update(zip([w for w, _ in part], contract_words([s for _, s in part], path)))
                part, rows = [], 0
        if part:
            known.update(zip([w for w, _ in part], contract_words([s for _, s in part], path)))

    def encode(texts: list[str | None]) -> list[bytes]:
        if len(known) > MEMO_WORDS:
            known.clear()
        cut = [_pattern().findall(x) if x else [] for x in texts]
        learn({w for x in cut for w in x}.difference(known))
        return [b"".join(map(known.__getitem__, x)) for x in cut]

    return encode


def decode_rows(raw: list[bytes], path: str) -> list[bytes]:
    """The bytes that each row of ids spells."""
    con = _database(path)
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    con.register("ids", pa.table({"row": np.repeat(np.arange(len(raw)), sizes), "pos": np.arange(len(ids)), "token": ids}))
    found = con.sql(_SPELL).to_arrow_table()
    con.unregister("ids")
    spelled = [b""] * len(raw)
    for k, x in zip(*(found.column(k).to_pylist() for k in (0, 1))):
        spelled[k] = x
    return spelled


def encode(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep`` with n_tokens and ids of each row's whole text."""
    path = path or ranks_path()
    source = documents.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "__text", SLICE_BYTES):
            raw = encoder(path)(part.column(len(keep)).to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in raw])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.record_batch([*part.columns[:-1], pa.array(np.diff(ends), pa.int64()), ids], names=[*keep, "n_tokens", "ids"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep`` with the text of each row's ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    path = path or ranks_path()
    source = encoded.select(*keep, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [np.array(x or [], "<u4").tobytes() for x in part.column(len(keep)).to_pylist()]
                texts = [x.decode("utf-8", "replace") for x in decode_rows(raw, path)]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}text string")


def round_trip(documents: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids are encoded, digested and decoded in one pass."""
    path = path or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text", SLICE_BYTES):
            raw = encoder(path)(part.column(1).to_pylist())
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in decode_rows(raw, path)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
