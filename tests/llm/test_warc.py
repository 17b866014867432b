"""The archive: exact round trips, references, damage, and files."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.llm import queries, warc
from .test_llm import SF, spark_rows, sql_rows

LONG, OTHER = "<p>é</p>\r\n\r\n" * 100, "x" * 1000
ROWS = [
    (1, "http://a.com/", LONG), (2, "http://a.com/2", LONG), (2, "http://a.com/3", LONG), (2, "http://a.com/3", LONG), (3, None, "x" * 999), (4, "http://b.com/\r\nWARC-Type: x", "x" * 999),
    (5, "u", None), (6, "u", ""), (None, "http://c.com", OTHER), (None, "http://c.com", OTHER), (7, "ü v", OTHER), (8, "d", "y" * 300_000), (9, "e", "\r\n\r\nWARC/1.1\r\n" * 90),
]


def some_pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, b"p", "d", 1) for r in rows], "page_id bigint, url string, html string, payload binary, digest string, bytes int")


def test_query_matches_sql_on_odd_rows(spark, tmp_path):
    some_pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    assert spark_rows(queries.QUERIES["op13_warc_archive"](spark, str(tmp_path))) == sql_rows(warc.OP13_SQL, pages=some_pages(spark))


def test_query_matches_sql_on_pages(spark):
    assert spark_rows(queries.QUERIES["op13_warc_archive"](spark, SF)) == sql_rows(warc.OP13_SQL, pages=spark.read.parquet(f"{SF}/pages.parquet"))


def test_empty_table(spark, tmp_path):
    some_pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["op13_warc_archive"](spark, str(tmp_path)).collect() == []


def test_payloads_are_stored_once_and_records_are_whole(spark):
    stored = warc.archive_pages(some_pages(spark))
    assert stored.payloads.count() == len({r[2] or "" for r in ROWS}) and stored.records.count() == len(ROWS)
    seen = set()
    for row in warc.read_archive(stored).collect():
        block, rest = bytes(row["record"]).split(b"\r\n\r\n", 1)
        lines = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:])
        body, close = rest[: int(lines["Content-Length"])], rest[int(lines["Content-Length"]) :]
        http, payload = body.split(b"\r\n\r\n", 1)
        full = bytes(row["payload"])
        assert close == b"\r\n\r\n" and payload == (full if lines["WARC-Type"] == "response" else b"")
        assert lines["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(full).hexdigest() and f"Content-Length: {len(full)}".encode() in http
        seen.add(lines["WARC-Record-ID"])
    assert len(seen) == len(ROWS)


def test_files_round_trip(spark, tmp_path):
    stored = warc.archive_pages(some_pages(spark))
    warc.export_warc(stored, f"{tmp_path}/files", records_per_file=3)
    records = sorted(bytes(r["record"]) for r in warc.read_archive(stored).collect())
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert len(written) == sum(map(len, records)) and len(list((tmp_path / "files").glob("part-*"))) > 3
    again = warc.archive_warc(spark, f"{tmp_path}/files")
    assert sorted(bytes(r["record"]) for r in warc.read_archive(again).collect()) == records
    assert sorted(bytes(r["payload"]) for r in warc.read_archive(again).collect()) == sorted(bytes(r["payload"]) for r in warc.read_archive(stored).collect())


def test_damage_is_found(spark):
    stored = warc.archive_pages(some_pages(spark))
    bent = stored._replace(payloads=stored.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    short = stored._replace(payloads=stored.payloads.where("octet_length(payload) < 1000"))
    for damaged in (bent, short):
        with pytest.raises(PySparkException):
            warc.read_archive(damaged).collect()
