"""WARC archives with revisit records, written and read back.

Headers (id, digest, length) alone are shuffled by payload digest to find each payload's original;
the payloads are shuffled once, by page, to the archive they go to. Records are UTF-8 text that
ends with CRLF CRLF, so Spark's text writer with that separator writes valid archives without
Python, by default each as one gzip stream. Archives are read back as binary files and walked by
Content-Length.

Defined results: a null html is an empty payload; payloads shorter than ``least`` bytes are always
responses; rows that repeat the smallest id of a payload are responses each; a row without id is
written with the id ``null`` and is a response; an empty table gives no records; other columns are
not stored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stored

CRLF = "\r\n"
LEAST_BYTES = 100
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def headers(pages: DataFrame, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))


def revisits(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload an earlier id has already.

    The first records are written before headers join them, so the skew join splits a hot digest.
    """
    long = heads.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    first = stored(first, "first-records")
    return long.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write one record per row of ``pages`` to archives of about ``archive_bytes`` in folder ``path``."""
    heads = headers(pages, id_col, payload)
    total = heads.agg(F.coalesce(F.sum(F.col("bytes") + 700), F.lit(0))).first()[0]
    archives = max(1, -(-total // archive_bytes))
    body = F.coalesce(F.col(payload), F.lit(""))
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("about:blank")), r"\s", "%20").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    # a join takes no fewer parts than are set, and would deal the payloads once more for fewer archives
    keys, parts = ["page_id", "digest"], max(int(archives), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = full.repartition(parts, *keys).join(revisits(heads, least).repartition(parts, *keys), keys, "left").coalesce(int(archives))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(again, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)
    joined.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, plain or gzip."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, gap = 0, b"\r\n\r\n"
    while at < len(content):
        end = content.index(gap, at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        stop = end + 4 + int(fields["Content-Length"])
        yield fields, content[end + 4 : stop]
        at = stop + 4


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "null") else None


def _parse(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    rows.append((_number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, size, _number(fields.get("WARC-Refers-To")), payload if with_payload and kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return parse


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; a response's payload is checked against its digest, a revisit has none."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), _READ)


def rewrite(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives and read them back, without payloads."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path, with_payload=False).drop("payload")
