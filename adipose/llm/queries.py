"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, decontaminate, language_model, line_dedup, near_dup, quality, sentencepiece_codec, spelling_variants, suffix_dedup, token_counts, topk, warc
from .shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewrite(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5, scale=256)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), removed="n_removed")
    return cleaned.select("doc_id", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_windows")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_near_dup": op5_near_dup,
    "op6_topk": op6_topk,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_model": op10_language_model,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
          SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
    """,
    "op5_near_dup": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), p AS (
          SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0
        ), s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM p
        ), n AS (
          SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), c AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), l AS (
          SELECT c.a, c.b FROM c JOIN n AS x ON x.doc_id = c.a JOIN n AS y ON y.doc_id = c.b WHERE 100 * c.both_n >= 85 * (x.n + y.n - c.both_n)
        ), e AS (
          SELECT a, b FROM l UNION SELECT b, a FROM l
        ), r AS (
          SELECT doc_id AS id, doc_id AS reached FROM documents
          UNION
          SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a
        ), m AS (
          SELECT id, min(reached) AS component_id FROM r GROUP BY id
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents AS d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op6_topk": """
        WITH e AS (
          SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE embedding IS NOT NULL
        ), bad AS (
          SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)
        ), v AS (
          SELECT vec_id, pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS c FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad)
        ), s AS (
          SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(sum(q.c * v.c) AS BIGINT) AS score
          FROM v AS q JOIN v ON q.pos = v.pos AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, v.vec_id
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_line_dedup": """
        WITH l AS (
          SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
        ), t AS (
          SELECT source, count(*) AS pages FROM documents GROUP BY source
        ), c AS (
          SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line
        ), b AS (
          SELECT c.source, c.line FROM c JOIN t ON c.source = t.source WHERE c.n >= 3 AND c.n > 0.1 * t.pages
        ), k AS (
          SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source = b.source AND l.line = b.line
        )
        SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM k GROUP BY doc_id
    """,
}
