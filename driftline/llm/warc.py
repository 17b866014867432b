"""A content-addressed archive of WARC records.

The archive is two tables. `payloads` has each distinct payload once, under the SHA-256 of
its bytes; `records` has one row per record: its exact head (the WARC header block and, after
an empty line, the HTTP head), the digest of its payload, and whether the payload follows the
head. A record is its head, its payload where it has one, and the closing line ends; a join
on the digest gives it back byte by byte. Reading recomputes the digest of every stored
payload and fails where bytes are not what their address says, or are missing.

Records of equal payloads of at least `least` bytes: the one with the largest page_id is a
response, the others are revisits that name it and hold no payload. A payload that a third
of all pages have is combined before its shuffle and stored once; the records that join to it
are rows without payloads, which adaptive execution splits.

export_warc() writes the records as WARC files that any reader of the format takes, and
read_warc() takes such files apart again, so that archive() can hold foreign records too.

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI line; control
characters of a url are percent-encoded in its line; page_ids that repeat are told apart by
url and then by a number, so that one record is the response; a null page_id is less than all
others and reads back as null; a very long page is one payload; an empty table gives empty
tables; other columns are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import materialize, read

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What closes a record.
CLOSE = "\r\n\r\n"


class Archive(NamedTuple):
    """records: head (binary), digest (binary), bytes, holds (whether the payload follows). payloads: digest, payload."""

    records: DataFrame
    payloads: DataFrame


def _binary(text: Column) -> Column:
    return text.cast("string").cast("binary")


def _address(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _urn(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def _lines(*lines: tuple[str, Column]) -> Column:
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in lines])


def _uri(url: Column) -> Column:
    """A url as one line: its control characters and spaces percent-encoded."""
    return F.array_join(F.transform(F.split(url, ""), lambda ch: F.when(ch.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.hex(ch.cast("binary")))).otherwise(ch)), "")


def page_records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """page_id, head, digest, bytes and holds of the record of each page; payloads are hashed and left."""
    payload = F.coalesce(_binary(F.col("html")), F.lit(b""))
    url = F.col("url").cast("string")
    rows = pages.select("page_id", F.when(url.rlike(r"[\x00-\x20\x7F]"), _uri(url)).otherwise(url).alias("uri"), payload.alias("payload"))
    rows = rows.select("page_id", "uri", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), _address(F.col("payload")).alias("digest"))
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "warc-rows")  # fixes the numbers
    own = F.struct("page_id", "uri", "number")
    kept = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(own).alias("response"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(kept.drop("n"), "digest", "left")
    revisit = F.col("response").isNotNull() & (F.col("number") != F.col("response.number"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CLOSE))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _urn(F.col("page_id"), F.col("number"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, _urn(F.col("response.page_id"), F.col("response.number")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("response.uri"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", length.cast("string")),
        ),
        F.lit("\r\n"),
        http,
    )
    return joined.select("page_id", _binary(head).alias("head"), "digest", "bytes", (~revisit).alias("holds"))


def archive(records: DataFrame, payloads: DataFrame) -> Archive:
    """Store records (head, digest, bytes, holds) and payloads (payload; repeats are stored once) as an archive in the shared folder."""
    once = payloads.select(F.col("payload").cast("binary").alias("payload")).withColumn("digest", _address(F.col("payload")))
    once = once.groupBy("digest").agg(F.first("payload").alias("payload"))
    return Archive(materialize(records.select("head", "digest", "bytes", "holds"), "warc-records"), materialize(once, "warc-payloads"))


def archive_pages(pages: DataFrame, least: int = LEAST, date: str = DATE) -> Archive:
    """The archive of the pages: page_id, url and html."""
    return archive(page_records(pages, least, date), pages.select(F.coalesce(_binary(F.col("html")), F.lit(b"")).alias("payload")))


def verified(payloads: DataFrame) -> DataFrame:
    """digest and payload; fails where a payload is not what its digest says."""
    sound = F.when(_address(F.col("payload")) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest"))).cast("binary"))
    return payloads.select("digest", sound.alias("payload"))


def read_archive(stored: Archive) -> DataFrame:
    """record (all its bytes), head, and payload (a revisit's is that of the record it refers to)."""
    lost = F.raise_error(F.concat(F.lit("no payload is stored under "), F.hex("digest"))).cast("binary")
    joined = stored.records.join(verified(stored.payloads), "digest", "left")
    payload = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(lost)
    rows = joined.select("head", "holds", payload.alias("payload"))
    return rows.select(F.concat("head", F.when(F.col("holds"), F.col("payload")).otherwise(F.lit(b"")), F.lit(CLOSE.encode())).alias("record"), "head", "payload")


def field(head: Column, name: str) -> Column:
    """The value of a header line of a record, null without it; heads are read up to their first empty line."""
    block = F.substring_index(head.cast("string"), CLOSE, 1)
    value = F.regexp_extract(block, rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def page_of(urn: Column) -> Column:
    """The page_id in a record's name, as text."""
    found = F.regexp_extract(urn, r"^<urn:page:([^:>]*):", 1)
    return F.when(found != "", F.url_decode(found))


def export_warc(stored: Archive, folder: str, records_per_file: int = 20_000) -> None:
    """The records as WARC files, each with at most so many records; what closes a record stands between rows of text."""
    rows = read_archive(stored).select(F.expr(f"substring(record, 1, octet_length(record) - {len(CLOSE)})").cast("string").alias("value"))
    rows.write.option("lineSep", CLOSE).option("maxRecordsPerFile", records_per_file).text(folder)


def take_apart(content: bytes) -> list[tuple[bytes, bytes, str]]:
    """(head, payload, type) of the records of a WARC file; the head includes that of an HTTP response."""
    out, at = [], 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        block = content[at:end]
        length = int(re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", block).group(1))
        kind = re.search(rb"(?i)\r\nWARC-Type:[ \t]*([^\r\n]*)", block).group(1).decode()
        body = content[end : end + length]
        http = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") and b"\r\n\r\n" in body else 0
        out.append((block + body[:http], body[http:], kind))
        at = end + length + 4
    return out


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """head, payload and type of every record of WARC files without compression; a file is one row, so files should be of bounded size."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = take_apart(content.as_py())
                for k in range(0, len(rows), 512):
                    columns = list(zip(*rows[k : k + 512], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2])], names=["head", "payload", "type"])

    return map_in_arrow(spark.read.format("binaryFile").load(folder).select("content"), run, "head binary, payload binary, type string")


def archive_warc(spark: SparkSession, folder: str) -> Archive:
    """The archive of the records of WARC files, with all their heads as they are."""
    found = read_warc(spark, folder)
    rows = found.select("head", _address(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), (F.col("type") != "revisit").alias("holds"))
    named = rows.withColumn("sha1", field(F.col("head"), "WARC-Payload-Digest"))
    full = named.where("holds").select(F.col("sha1"), F.col("digest").alias("full")).where("sha1 is not null").groupBy("sha1").agg(F.first("full").alias("full"))
    joined = named.join(full, "sha1", "left")  # the payload of a revisit is elsewhere
    digest = F.when(F.col("holds"), F.col("digest")).otherwise(F.coalesce("full", "digest"))
    return archive(joined.select("head", digest.alias("digest"), "bytes", "holds"), found.where("type <> 'revisit' or octet_length(payload) > 0").select("payload").unionByName(spark.range(1).select(F.lit(b"").alias("payload"))))


def op13_warc_archive(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = read_archive(archive_pages(pages))
    head = F.substring_index(F.col("record").cast("string"), CLOSE, 1)  # of the record's own bytes
    return found.select(
        page_of(field(head, "WARC-Record-ID")).cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        field(head, "WARC-Type").alias("record_type"), page_of(field(head, "WARC-Refers-To")).cast(kind).alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id, url) AS k FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, k DESC) ELSE 1 END AS place,
        first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, k DESC) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to FROM r"""
