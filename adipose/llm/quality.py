"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each whole text becomes a vector of transformed statistics (logarithms of sizes, logits of shares).
Per class, count, mean and second moments are summed by Spark over all training rows; only the
d x d sums reach the driver. Covariances are shrunk to the pooled one and to a multiple of the
identity; their Cholesky factors are computed once. A text's score follows from the difference of
the two Gaussian log densities, each a squared Mahalanobis length by triangular solve, plus the
log prior ratio x: 0.5 + x / (2 * (1 + |x|)), which is 0.5 where both classes are as likely and
does not saturate.

Defined results: null, empty and blank texts are scored by their (zero) statistics; a label row
counts once for an id, ids whose label rows disagree or are null are not learnt from; without labels
every score is 0.5, with one class only every score is that class's; rows without id are scored and
count as not held out; an empty table gives no rows; labels, language, source and id are not
inputs of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .shared import by_ids, stored

POOLED, RIDGE = 0.5, 0.05
FEATURES = ("bytes", "words", "mean_word", "sd_word", "distinct", "top_word", "same_as_last", "upper", "digit", "mark", "odd_mark", "high", "lines", "line_words", "one_byte_words", "odd_end", "stops", "long_words")
D = len(FEATURES)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of part / whole, drawn to the middle by half a count."""
    part = np.minimum(part, whole)
    return np.log((part + 0.5) / (whole - part + 0.5)) / 2


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, offsets = ta.utf8(column)
    low = ta.lower_ascii(data)
    starts, ends, first = ta.words(low, offsets)
    size = np.diff(offsets).astype(np.float64)

    def total(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of, dtype=np.float64)])[at])

    n = np.diff(first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    some = np.maximum(n, 1)
    mean = total(length, first) / some
    spread = np.sqrt(np.maximum(total(length**2, first) / some - mean**2, 0))
    word = ta.hash_spans(ta.prefix_hash(low), starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            runs = np.diff(np.append(np.flatnonzero(np.concatenate([[True], (s := np.sort(word[a:b]))[1:] != s[:-1]])), b - a))
            distinct[k], top[k] = len(runs), runs.max()
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = ((low >= 97) & (low <= 122)) | (data >= 128)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(letter | digit | space)
    odd = mark & ~np.isin(data, np.frombuffer(b".,;:'\"-()?", np.uint8))
    last = data[ends - 1] if len(ends) else data[:0]
    newline = data == 10
    lines = total(newline, offsets) + 1
    letters = np.maximum(total(letter, offsets), 1)
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), _share(distinct, n), _share(top, n), _share(total(again, first), n),
        _share(total(upper, offsets), letters), _share(total(digit, offsets), size), _share(total(mark, offsets), size), _share(total(odd, offsets), size), _share(total(data >= 128, offsets), size),
        np.log(lines), np.log1p(n / lines), _share(total(length == 1, first), n), _share(total(np.isin(last, data[:0]) if not len(last) else odd[ends - 1], first), n), _share(total(last == 46, first), n), _share(total(length > 12, first), n),
    ]
    return np.stack(columns, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in ta.slices(batches, "text"):
        rows = statistics(part.column(1))
        vectors = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, D, dtype=np.int32), pa.array(rows.ravel()))
        yield pa.record_batch([part.column(0), vectors], names=["doc_id", "features"])


def features(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_features, "doc_id long, features array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the sums of (1, x) times (1, x), one row an entry."""
    sums = {}
    for batch in batches:
        if batch.num_rows:
            x = np.hstack([np.ones((batch.num_rows, 1)), _rows(batch.column(0))])
            labels = batch.column(1).to_numpy()
            for c in np.unique(labels):
                own = x[labels == c]
                sums[int(c)] = sums.get(int(c), 0) + own.T @ own
    for c, m in sums.items():
        yield pa.record_batch([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "entry", "value"])


class Model(NamedTuple):
    """Means, inverse Cholesky factors and constants of class 0 and 1; ``only`` where there is no second class."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        odds = density[1] - density[0]
        return 0.5 + 0.5 * odds / (1 + np.abs(odds))


def fit_moments(sums: dict[int, np.ndarray], pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    sums = {c: m for c, m in sums.items() if m[0, 0] > 0}
    if len(sums) < 2:
        return Model([], [], [], 0.5 if not sums else float(min(sums)))
    count = {c: m[0, 0] for c, m in sums.items()}
    means = {c: m[0, 1:] / m[0, 0] for c, m in sums.items()}
    scatter = {c: m[1:, 1:] - count[c] * np.outer(means[c], means[c]) for c, m in sums.items()}
    shared = sum(scatter.values()) / sum(count.values())
    factors, constants = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / count[c] + pooled * shared
        s = (1 - ridge) * s + ridge * (np.trace(s) / D + 1e-9) * np.eye(D)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(count[c] / sum(count.values())) - np.log(np.diag(lower)).sum()))
    return Model([means[0], means[1]], factors, constants)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(vectors: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of ``vectors`` (doc_id, features) that ``labels`` marks and that aren't held out."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    rows = vectors.where(~held_out()).join(marked, "doc_id").select("features", "quality")
    summed = rows.mapInArrow(_moments, "label int, entry int, value double").groupBy("label", "entry").agg(F.sum("value").alias("value")).collect()
    sums = {r["label"]: np.zeros((D + 1) * (D + 1)) for r in summed}
    for r in summed:
        sums[r["label"]][r["entry"]] = r["value"]
    return fit_moments({c: m.reshape(D + 1, D + 1) for c, m in sums.items()})


def score(vectors: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(_rows(batch.column(1))))], names=["doc_id", "score"])

    scored = vectors.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    vectors = stored(features(documents, id_col, text), "statistics")
    return score(vectors, fit(vectors, labels))


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the rows that score below 0.5; all columns pass unchanged.

    Statistics for learning are made of labelled rows only, found by their ids; then every text is
    scored where it is read. Texts are shuffled only as ``shared.by_ids`` does it: those that a bitmap of
    many labelled ids lets through.
    """
    known = stored(labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "labelled")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where(~held_out())
    model = fit(features(by_ids(rows, known, "doc_id")), labels)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ta.slices(batches, text):
            yield part.filter(pa.array(model.scores(statistics(part.column(names.index(text)))) >= 0.5))

    return documents.mapInArrow(run, documents.schema)
