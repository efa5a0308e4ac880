"""Token counts with a digest cache.

The key is the digest of a text's bytes (the tokenizer has no normaliser, so nothing but null, which
counts as empty, may be folded) with the digest of the tokenizer file. Digests that the cache lacks
are encoded once each: the smallest document id of a digest stands for all its copies. Texts are
found by these ids as ``shared.by_ids`` does it: where they are read if the misses are few, else by a
shuffle of those that a bitmap lets through, so a digest that is cached moves no text. The new counts
are appended to the cache and every document then joins it by digest (a hot digest is split by the
skew join).

Inside a task, texts are cut before single spaces between other characters. The byte-level
pre-tokenizer never joins across such a place, so a text's count is the sum of its pieces' counts,
and each distinct piece is encoded once by the tokenizer library.

Defined results: a null text is an empty text with 0 tokens; ids may repeat, each row is counted;
rows without id are counted too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_ids, new_path, spread, stored

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
MEMO_CHARACTERS = 8_000_000
_CACHE = "digest string, tokenizer string, n_tokens long"
_CUT = re.compile(r"(?<=\S)(?= \S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


def pieces(text: str) -> list[str]:
    """``text`` cut where a single space stands between two characters that are no white space."""
    return _CUT.split(text)


@functools.cache
def counter(path: str):
    """A function from texts to token counts; its memory of pieces outlives the task in a reused worker."""
    encoder, known, held = _encoder(path), {}, [0]

    def count(texts: list[str]) -> list[int]:
        if held[0] > MEMO_CHARACTERS:
            known.clear()
            held[0] = 0
        cut = [pieces(x) if x else [] for x in texts]
        new = list({p for x in cut for p in x if p not in known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            held[0] += sum(map(len, part)) + 16 * len(part)
            known.update(zip(part, map(len, encoder.encode_batch_fast(part, add_special_tokens=False))))
        return [sum(map(known.__getitem__, x)) for x in cut]

    return count


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                new = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                yield pa.record_batch([pa.array(list(new), pa.string()), pa.array([version] * len(new), pa.string()), pa.array(count(list(new.values())), pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def token_counts(documents: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; ``cache`` is a Parquet folder that grows."""
    spark = documents.sparkSession
    path = tokenizer or tokenizer_path()
    version = tokenizer_digest(path)
    cache = cache or new_path(spark, "token-cache")
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)
    body = F.coalesce(F.col(text), F.lit(""))
    heads = documents.select(F.col(id_col).alias("doc_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    cached = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version)
    # one id stands for a digest; rows without id stand by their digest alone
    stand_in = heads.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cached.select("digest"), "digest", "left_anti")
    stand_in = stored(stand_in, "misses")
    named, unnamed = stand_in.where("doc_id is not null"), stand_in.where("doc_id is null").select("digest")
    texts = documents.select(F.col(id_col).alias("doc_id"), body.alias("text"))
    of_id = by_ids(texts.where("doc_id is not null"), named.select("doc_id").distinct(), "doc_id")
    of_none = by_ids(texts.where("doc_id is null").withColumn("digest", F.sha2("text", 256)), unnamed, "digest")
    misses = of_id.select(F.sha2("text", 256).alias("digest"), "text").unionByName(of_none.select("digest", "text"))
    spread(misses, documents).mapInArrow(_count(path, version), _CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    known = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, since the skew join splits a hot digest only where both sides come right from their shuffles
    counted = heads.join(stored(known, "known-counts"), "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
