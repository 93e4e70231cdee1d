"""WARC archives with revisit resolution.

Only headers (id, digest, size) are shuffled to resolve copies: the smallest id
per payload digest is found with map-side aggregation, headers are joined to
it (a digest of a third of all pages is split by the skew join), and the pages
then meet the list of revisits by id and digest, which names a page row at most
once, so ids may be missing or repeat with other payloads. Archives are written by Spark's own
text writer: a row is one record and the line separator is the two line breaks
that close a WARC record, so any store and the usual commit protocol work.

Files are gzip streams of plain WARC/1.1 records. Reading parses records by
their declared lengths (a payload may hold anything) and then joins revisit
records to the responses they refer to.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.llm.common import settle, table, text_bytes
from tabsieve.session import checkpoint_dir

LEAST_BYTES = 100
CLOSE = "\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------ resolving and writing
def headers(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(key, digest, bytes) of each page; a null payload is empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(key, F.sha2(body, 256).alias("digest"), text_bytes(body).alias("bytes"))


def revisits(heads: DataFrame, key: str = "page_id", least: int = LEAST_BYTES) -> DataFrame:
    """(key, digest, origin), distinct, of pages that repeat the payload of a page with a smaller id.

    Rows that share the smallest id of a payload are all originals; a page without an id is a revisit where an id is
    known for its payload, else a response.
    """
    originals = (heads.where(F.col("bytes") >= least).groupBy("digest")
                 .agg(F.min(key).alias("origin"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1 and origin is not null").select("digest", "origin"))
    repeated = heads.where(F.col("bytes") >= least).join(originals, "digest")
    return repeated.where(~F.col(key).eqNullSafe(F.col("origin"))).select(key, "digest", "origin").distinct()


def _uri(value: Column, digest: Column) -> Column:
    """Record id: the page's id and its payload, so that a repeated id names one payload."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def records(pages: DataFrame, repeated: DataFrame, key: str = "page_id", url: str = "url",
            payload: str = "html") -> DataFrame:
    """One WARC record per page, without its closing line breaks.

    Revisits keep the HTTP header but not the payload. Control characters and spaces in a url are percent-encoded;
    a page without a url gets its record id as target. ``repeated`` comes from ``revisits``.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    again = repeated.select(F.col(key).alias("again_id"), F.col("digest").alias("again_digest"),
                            F.col("origin").alias("again_origin"))
    digest = F.col("own_digest")
    rows = pages.select(F.col(key), F.col(url), F.col(payload), F.sha2(body, 256).alias("own_digest"))
    rows = rows.join(again, F.col(key).eqNullSafe(F.col("again_id")) & (digest == F.col("again_digest")), "left")
    revisit = F.col("again_origin").isNotNull()
    rid = _uri(F.col(key), digest)
    target = F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {CAPTURED}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(target, rid)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("again_origin"), digest))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return rows.select(F.concat(head, F.lit(CLOSE), block).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Deduplicated archives of all pages under ``path``, a file per partition of the join that marks revisits (or of
    the scan, where the planner broadcasts the revisits), so payloads are shuffled once at most."""
    heads = settle(headers(pages, key, payload))
    rows = records(pages, revisits(heads, key), key, url, payload)
    rows.write.text(path, compression="gzip", lineSep=CLOSE)


# ------------------------------------------------------------------ reading
_READ = [("page_id", pa.int64()), ("type", pa.string()), ("record", pa.string()), ("refers", pa.string()),
         ("target", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.string())]


class _Inflated(io.RawIOBase):
    """A gzip stream (any number of members) of bytes in memory, inflated piece by piece."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.out, self.z = data, 0, b"", zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, b):
        while not self.out and self.at < len(self.data):
            piece = self.data[self.at:self.at + (1 << 16)]
            self.out = self.z.decompress(piece)
            self.at += len(piece) - len(self.z.unused_data)
            if self.z.eof:
                self.z = zlib.decompressobj(31)
        n = min(len(b), len(self.out))
        b[:n], self.out = self.out[:n], self.out[n:]
        return n


def parse(stream):
    """(header fields, block) of every record of a WARC stream; a damaged record raises."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        fields = {}
        for line in iter(stream.readline, b"\r\n"):
            name, colon, value = line.decode().partition(":")
            if not colon:
                raise ValueError("damaged WARC header")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("damaged WARC record")
        yield fields, block


def read_record(fields: dict, block: bytes, with_payload: bool) -> tuple:
    """The columns of ``_READ``. A response is measured by its payload and checked against its digest; a revisit by
    its headers."""
    head, _, payload = block.partition(b"\r\n\r\n")
    response = fields["warc-type"] == "response"
    declared = fields["warc-payload-digest"].removeprefix("sha256:")
    if response:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != declared:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = declared
    page = fields["warc-record-id"].split(":")[2]
    return (None if page == "none" else int(page), fields["warc-type"], fields["warc-record-id"],
            fields.get("warc-refers-to"), fields["warc-target-uri"], digest, size,
            payload.decode() if response and with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of all records under ``path``; files are inflated and parsed as streams."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(io.BufferedReader(_Inflated(memoryview(content.as_buffer())), 1 << 16)):
                    rows.append(read_record(fields, block, with_payload))
                    held += len(block) if with_payload else 100
                    if held > 8 << 20:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _READ)],
                                          [n for n, _ in _READ])
    schema = T.StructType([T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in _READ])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolve(rows: DataFrame) -> DataFrame:
    """Join revisits to the responses they name: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose response is missing, or has another digest, keeps a null ``refers_to``.
    """
    # page_id may repeat among responses, so the origin side is made unique; it is as small as the list of originals
    named = rows.where("refers is not null").select("refers").distinct()
    origins = (rows.where("type = 'response'").select(F.col("record").alias("refers"), "digest", F.col("page_id").alias("origin"))
               .join(named, "refers", "left_semi").distinct())
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
               F.col("type").alias("record_type")]
    again = rows.where("refers is not null").join(origins, ["refers", "digest"], "left")
    return (rows.where("refers is null").select(*columns, F.lit(None).cast("long").alias("refers_to"))
            .union(again.select(*columns, F.col("origin").alias("refers_to"))))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(settle(read_archives(spark, path, with_payload=False).drop("payload")))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS d FROM p),
o AS (SELECT d, min(page_id) AS origin FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN origin IS NOT NULL AND origin IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN origin IS DISTINCT FROM page_id THEN origin END AS refers_to
FROM q LEFT JOIN o USING (d)
"""
