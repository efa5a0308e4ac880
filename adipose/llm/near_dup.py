"""Near-duplicate documents by HyperMinHash signatures, banding and exact verification.

1. One pass over the texts makes a document's set of word shingles and its signature: the hash's
   top bits choose a bucket, the smallest rest of each bucket is kept as its leading-zero count
   with mantissa bits. Empty registers borrow from a full one, for banding only.
2. Documents with equal sets are one class, found by a digest of the whole set; only the class's
   smallest id goes on, so a group of exact copies costs one row.
3. Bands of compressed registers are bucket keys. Each bucket links its members to its smallest
   id: one pair a member. Pairs whose collision-corrected estimate lies five standard errors
   below the threshold go; the others are confirmed on the full sets.
4. Buckets whose members are then of one component are done, since more links change nothing.
   In the others the members of different components are compared block against block: first by
   estimates from the stored registers; only members with a partner left send their texts, and
   links on the full sets that join components are given out.
5. Components of all confirmed links.

The bands follow from the threshold: as many registers a band as leave a pair at the threshold a
chance of at most ``MISS`` to share no band (32 bands of 4 at 0.80: 5 in 100 million; 25 bands of 5
at 0.85: 4 in 10 million); a closer pair has less. Below 0.11, where single registers do not reach
that, bands are single registers.

Defined results: null, empty and blank texts have no set and are linked with nothing; an id that
repeats stands for all its rows; rows without id are linked with nothing, have no component and
are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .components import components
from .shared import by_ids, stored

WORDS = 5
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
PERCENT = 80
MISS = 1e-6
BLOCK = 512
SIGMAS = 5.0
# fixed value: the constant of the expected number of register collisions (Yu and Weber, HyperMinHash)
COLLISIONS = 0.169919487159739093975315012348630288


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers a band) for a threshold."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISS]
    rows = max(fits, default=1)
    return BUCKETS // rows, rows


BANDS, BAND_ROWS = banding(PERCENT)
_SIGNATURE = "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>"
_FACTORS = ta.mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(ta.BASE)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    data, offsets = ta.utf8(column)
    low = ta.lower_ascii(data)
    starts, ends, first = ta.words(low, offsets)
    word = ta.hash_spans(ta.prefix_hash(low), starts, ends)
    rolled = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size if len(rolled) else 0):
        rolled += word[j : j + len(rolled)] * _FACTORS[j]
    rolled = ta.mix64(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            sets.append(ta.mix64((word[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers a set; 0 is an empty bucket."""
    edges = (np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.uint64)
    least = np.zeros((len(sets), BUCKETS), np.uint64)
    full = np.zeros((len(sets), BUCKETS), bool)
    for k, s in enumerate(sets):
        cut = np.searchsorted(s, edges)
        first, after = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]])
        full[k] = first < after
        if len(s):
            least[k] = s[np.minimum(first, len(s) - 1)]
    rest = (least << np.uint64(BUCKET_BITS)) >> np.uint64(BUCKET_BITS)
    part, exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64) * 2.0 ** (BUCKET_BITS - 64))
    zeros = np.minimum(-exponent, 62).astype(np.uint16)
    mantissa = ((part - 0.5) * (2 << MANTISSA_BITS)).astype(np.uint16)
    return np.where(full, (zeros << np.uint16(MANTISSA_BITS) | mantissa) + np.uint16(1), np.uint16(0)).astype(np.uint16)


@functools.cache
def _borrow_order() -> np.ndarray:
    """For each bucket a fixed order of all buckets in which it looks for a full one."""
    keys = ta.mix64(np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS) + np.uint64(ta.BASE))
    return np.argsort(keys, axis=1)


def band_keys(regs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The bucket keys of each signature, after empty registers have borrowed."""
    bands, rows = banding(percent)
    filled = regs.copy()
    order = _borrow_order()
    for at in range(0, len(regs), 128):
        some = at + np.flatnonzero((regs[at : at + 128] == 0).any(axis=1))
        if len(some):
            source = order[np.arange(BUCKETS), (regs[some] > 0)[:, order].argmax(axis=2)]
            filled[some] = np.where(regs[some] > 0, regs[some], np.take_along_axis(regs[some], source, axis=1))
    grid = filled[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows)
    keys = (grid * _FACTORS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[rows]
    return ta.mix64(keys).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate without expected chance collisions, registers that count) of register rows."""
    either = ((a > 0) | (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    ratio = n / np.maximum(m, 1)
    chance = COLLISIONS * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / np.maximum(either, 1), either


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    share = percent / 100
    jaccard, count = estimate(a, b, n, m)
    return jaccard >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(count, 1))


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text"):
            sets = shingle_sets(part.column(1))
            regs = registers(sets)
            keys = band_keys(regs, percent)
            n = np.array([len(s) for s in sets])
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), bands], names=["doc_id", "n_shingles", "digest", "registers", "bands"])

    return run


def signatures(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_sign(percent), _SIGNATURE)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                keep = _may_link(_regs(c["ra"]), _regs(c["rb"]), c["na"].to_numpy(), c["nb"].to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))
                ta.give_back()

    return run


def _close_pairs(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule a link out."""
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close(percent), "a long, b long")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, "text_a"):
            a, b = shingle_sets(part.column(2)), shingle_sets(part.column(3))
            keep = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm(percent), "a long, b long")


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """One bit row a set over the shingles that more than one of the sets has."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    often = count[index] > 1
    at = column[index[often]]
    bits = np.zeros((len(sets), int((count > 1).sum()) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (owner[often], at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    return bits


def _cell(percent: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, block = pdf["doc_id"].to_numpy(), pdf["block"].to_numpy()
        sets = shingle_sets(pa.array(pdf["text"], pa.large_string()))
        n = np.array([len(s) for s in sets])
        regs = registers(sets)
        bands, bits = band_keys(regs, percent), _shared_bits(sets)
        names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        found = []
        for i in range(len(ids)):
            other = _candidates(ids, block, label, bands, key, i)
            if not len(other):
                continue
            other = other[_may_link(regs[i][None, :], regs[other], n[i], n[other], percent)]
            both = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in other[100 * both >= percent * (n[other] + n[i] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        if len(ids) > BLOCK // 4:
            del sets, regs, bands, bits
            ta.give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def _candidates(ids: np.ndarray, block: np.ndarray, label: np.ndarray, bands: np.ndarray, key: tuple, i: int) -> np.ndarray:
    """The members of a cell that member i is compared with."""
    # within one block each pair once; between two blocks first against second
    other = (ids > ids[i]) if key[1] == key[2] else (block == key[2]) & (block[i] == key[1])
    other = np.flatnonzero(other & (label != label[i]))
    if not len(other):
        return other
    # a pair that meets in several buckets is looked at in the first of them
    same = bands[other] == bands[i]
    return other[bands[i][same.argmax(axis=1)] == key[0]]


def _estimated_cell(percent: int):
    """The members of a cell that have a partner by estimate."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, block, label, n = (pdf[c].to_numpy() for c in ("doc_id", "block", "label", "n_shingles"))
        regs = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, BUCKETS)
        bands, keep = band_keys(regs, percent), np.zeros(len(ids), bool)
        for i in range(len(ids)):
            other = _candidates(ids, block, label, bands, key, i)
            if len(other):
                other = other[_may_link(regs[i][None, :], regs[other], n[i], n[other], percent)]
                keep[other] = True
                keep[i] |= len(other) > 0
        return pdf.loc[keep, ["key", "first", "second", "doc_id", "label", "block"]]

    return run


def _open_links(rows: DataFrame, heads: DataFrame, texts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components in buckets that hold more than one, compared block against block.

    A cell holds the registers of two blocks, then the full sets of those with a partner, and gives
    links enough to join what they join. A bucket of two has no pair but that with its hub.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.join(labels, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    still = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi and members > 2")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    member = named.join(still.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "doc_id", "label", "block")
    cell = ["key", "first", "second"]
    near = stored(member.join(heads, "doc_id").repartition(tasks, *cell).groupBy(*cell).applyInPandas(_estimated_cell(percent), "key long, first int, second int, doc_id long, label long, block int"), "estimated-cells")
    return near.join(texts, "doc_id").groupBy(*cell).applyInPandas(_cell(percent), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Rows are linked where 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component_id`` is the smallest id reachable and ``kept`` marks the row that has it.
    """
    sigs = stored(signatures(documents, percent, id_col, text), "signatures")
    sets = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    one = sets.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = one.select("doc_id", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("last > a").drop("last")
    members = stored(rows.join(hubs, "key").select("key", "a", "doc_id"), "bucket-members")
    heads = sets.select("doc_id", "registers", "n_shingles").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    heads = stored(heads, "candidate-signatures")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = stored(by_ids(texts, stored(members.select("doc_id").distinct(), "candidates"), "doc_id"), "candidate-texts")
    star = members.where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    close = stored(_close_pairs(star, heads, percent), "star-pairs")
    links = stored(_links(close, texts, percent), "star-links")
    labels = stored(components(links), "star-components")
    more = stored(_open_links(members.select("key", "doc_id"), heads, texts, labels, percent), "open-links")
    if not more.isEmpty():
        labels = stored(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    # written, since the skew join splits a hot digest only where both sides come right from their shuffles
    of_set = classes.join(labels, F.col("rep") == F.col("id"), "left").where("n > 1 or component is not null")
    of_set = stored(of_set.select("digest", F.coalesce("component", "rep").alias("component_id")), "set-components")
    # ids that repeat with different sets join their classes' components
    joined = sigs.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
