"""WARC revisit resolution: archives in which each payload is stored once.

Headers alone are shuffled by payload digest to find, for each payload of at least ``MIN_BYTES``,
its original response. The rows then meet their decision, are written as WARC records by Spark's
text writer (a record ends with the blank lines that serve as line separator, so the commit protocol
covers the files and a lost executor leaves no half archive), and are read back by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, join_unique

MIN_BYTES = 1000
#: Mean payload bytes of one archive file.
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _key(page_id, digest):
    return F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest)


def decide(headers: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, to_id, to_url, decided) for the pages whose payload occurs more than once."""
    large = headers.filter(F.col("payload_bytes") >= min_bytes)
    best = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("to"))
    best = scratch.table(best.filter("n > 1"), "originals")
    out = join_unique(large.select("page_id", "digest").distinct(), best, "digest", "n", "inner")
    return out.select(_key(F.col("page_id"), F.col("digest")).alias("key"), F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url"), F.lit(True).alias("decided"))


def _uri(url, page_id):
    clean = F.regexp_replace(url, r"[\x00-\x20\x7f]", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def records(pages: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The text of one WARC record, without its closing blank lines, for each row of ``pages``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    headers = scratch.table(rows.drop("payload"), "headers")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("digest"))).repartition(max(1, math.ceil(total / file_bytes)), "key")
    rows = rows.join(scratch.table(decide(headers, scratch, min_bytes), "decisions").hint("shuffle_merge"), "key", "left")
    # Rows alike in id and payload share a key; the first of them may be the response.
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.col("url").desc_nulls_last())))
    response = F.col("decided").isNull() | (F.col("page_id").eqNullSafe(F.col("to_id")) & (F.col("copy") == 1))
    name = lambda i, k: F.concat(F.lit("<urn:assaylake:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(":"), k, F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(response, F.concat(http, "payload")).otherwise(http)
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("to_id"), F.lit("1"))), line("WARC-Refers-To-Target-URI", _uri(F.col("to_url"), F.col("to_id"))), line("WARC-Refers-To-Date", F.lit(DATE))
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))), line("WARC-Record-ID", name(F.col("page_id"), F.col("copy").cast("string"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(refers), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    return rows.select(head.alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """One record for each row; the folder's files are WARC 1.1 in gzip.

    A null payload is empty; a null id is written as ``null`` and ranks below all others. Of rows
    alike in id and payload one is the response, the others revisit it. Extra columns are not read.
    """
    records(pages, Scratch(pages.sparkSession), min_bytes, file_bytes).write.mode("overwrite").option("lineSep", _END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record; a broken file raises ValueError."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        top, *lines = data[at:stop].decode().split("\r\n")
        if top != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        end = stop + 4 + int(fields["Content-Length"])
        block = data[stop + 4 : end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end after its Content-Length")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: ids, digest and type; payloads of responses are checked against their digest."""

    def number(urn: str) -> int | None:
        text = urn.split(":")[3]
        return None if text == "null" else int(text)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out = []
                for warc, http, payload in parse(gzip.decompress(data.as_py())):
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} does not match its digest")
                    out.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"], number(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = best THEN NULL ELSE best END AS refers_to
FROM r
"""
