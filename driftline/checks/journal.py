"""Journal queries and content verification on the derived tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.functions.hashing import in_sample
from driftline.operators import chunks, tree
from driftline.operators import journal as jr
from driftline.sources.generate import gen_listing
from driftline.sources.journal import append_journal, append_once, read_journal, read_once
from driftline.sources.listing import scan_objects
from driftline.sources.posix import read_posix
from driftline.storage import shared_folder

R = Registry()
QUERIES, SQL = R.queries, R.sql
c = F.col
ERRS = "e AS (SELECT *, CASE WHEN type = 'VERIFY_FAIL' THEN 'VERIFY_FAIL' WHEN errno = 13 THEN 'EACCES' WHEN errno = 116 THEN 'ESTALE' ELSE errno || '' END AS class FROM journal WHERE type IN ('ERROR', 'FIDELITY_EXCEPTION', 'VERIFY_FAIL'))"
DEDUP = "tc AS (SELECT job_id, pass_no, type, count(*) AS n FROM (SELECT DISTINCT job_id, pass_no, type, rel_path FROM journal) GROUP BY ALL)"


def _path(df, name):
    return f"{shared_folder(df.sparkSession)}/driftline/{name}-{uuid.uuid4().hex}"


def _appended(j):
    """The journal appended in two deliveries, of which the second replays a third of the batches."""
    path = _path(j, "journal")
    append_journal(j, path)
    append_journal(j.where("seq % 3 = 0"), path)
    return path


#: Deliveries by batch: most arrive in order of their number, every seventh late; each brings replays of older ones, and a part of a batch before the rest.
_DELIVERIES = 4


def _delivered(j):
    path = _path(j, "journal-once")
    due = F.when(c("seq") % 7 == 0, 3).otherwise(c("seq") % 3)
    for n in range(_DELIVERIES):
        replayed = (due < n) & (c("seq") % 2 == n % 2)
        partly = (due == n + 1) & (c("place") == 0)
        acks = append_once(j.where((due == n) | replayed | partly).repartition(3), path, n)
    return path, acks


def _counts_stored(j):
    """The histogram written, and written again for one job."""
    path = _path(j, "counts")
    jr.persist_type_counts(j, path)
    jr.persist_type_counts(j.where("job_id = 2"), path)
    return j.sparkSession.read.parquet(path)


def _exported(j):
    path = _path(j, "export")
    jr.export_jsonl(j, path)
    return j.sparkSession.read.schema("pass_no int, type string, rel_path string, ts_ns bigint, mode string, sum string, errno string, detail string").json(path)


R.add("S5_read_journal", "journal", lambda j: read_journal(j.sparkSession, _appended(j), 2, [1, 3]).select("event_id", "seq", "place", "pass_no", "type", "rel_path"),
    """SELECT event_id, seq, place, pass_no, type, rel_path FROM journal WHERE job_id = 2 AND pass_no IN (1, 3)
       UNION ALL SELECT event_id, seq, place, pass_no, type, rel_path FROM journal WHERE job_id = 2 AND pass_no IN (1, 3) AND seq % 3 = 0""")
R.add("S5_read_journal_once", "journal", lambda j: read_journal(j.sparkSession, _appended(j), 2, once=True).select("event_id", "seq", "place"), "SELECT event_id, seq, place FROM journal WHERE job_id = 2")
R.add("S6_append_journal", "journal", lambda j: read_journal(j.sparkSession, _appended(j), 1).groupBy("pass_no", "agent_id", "seq").agg(F.count("*").alias("n"), F.countDistinct("place").alias("once")),
    "SELECT pass_no, agent_id, seq, count(*) + count(*) FILTER (seq % 3 = 0) AS n, count(DISTINCT place) AS once FROM journal WHERE job_id = 1 GROUP BY ALL")
R.add("S6_append_once", "journal", lambda j: read_once(j.sparkSession, _delivered(j)[0]).select("job_id", "pass_no", "agent_id", "seq", "place", "event_id", "type"), "SELECT job_id, pass_no, agent_id, seq, place, event_id, type FROM journal")
R.add("S6_acks", "journal", lambda j: _delivered(j)[1], "SELECT agent_id, max(seq) AS acked_seq FROM journal GROUP BY agent_id")
R.add("P5_by_prefix", "journal", lambda j: jr.by_prefix(j, "u1").select("event_id", "rel_path"), "SELECT event_id, rel_path FROM journal WHERE starts_with(rel_path, 'u1')")
R.add("P6_by_type", "journal", lambda j: jr.by_type(j, "jr_copied").select("event_id", "type"), "SELECT event_id, type FROM journal WHERE type = 'COPIED'")
R.add("P7_errors", "journal", lambda j: jr.errors(j, "ESTALE", "u2").select("event_id", "class", "rel_path"), "SELECT event_id, class, rel_path FROM e WHERE class = 'ESTALE' AND starts_with(rel_path, 'u2')", ERRS)
R.add("P8_select_passes", "passes", lambda p: jr.select_passes(p, "latest").select("job_id", "pass_no", "state"), "SELECT job_id, pass_no, state FROM passes p WHERE pass_no = (SELECT max(pass_no) FROM passes q WHERE q.job_id = p.job_id)")
R.add("P9_page", "journal", lambda j: jr.page(jr.errors(j), 50, 20, ("pass_no", "ts_ns", "rel_path", "event_id"))[0].select("event_id", "pass_no"), "SELECT event_id, pass_no FROM e ORDER BY pass_no, ts_ns, rel_path, event_id LIMIT 50 OFFSET 20", ERRS)
R.add("P9_truncated", "journal", lambda j: jr.page(jr.errors(j), 50, 20)[1], "SELECT count(*) - 20 > 50 AS truncated FROM e", ERRS)
R.add("O4_paged_scan", "journal", lambda j: jr.page(jr.by_type(j, "ORPHAN"), 100, 0, ("ts_ns", "event_id"))[0].select("event_id", "rel_path"), "SELECT event_id, rel_path FROM journal WHERE type = 'ORPHAN' ORDER BY ts_ns, event_id LIMIT 100")
R.add("P10_record_view", "journal", lambda j: jr.record_view(j).select("rel_path", "ts_ns", "mode", "errno", "detail"),
    "SELECT rel_path, ts_ns, lpad((mode // 64 % 8) || '' || (mode // 8 % 8) || (mode % 8), 4, '0') AS mode, CASE errno WHEN 0 THEN NULL WHEN 13 THEN 'EACCES' ELSE 'ESTALE' END AS errno, nullif(detail, '') AS detail FROM journal")
R.add("S7_export_jsonl", "journal", lambda j: _exported(j).select("pass_no", "type", "rel_path", "ts_ns", "mode", "errno", "detail"),
    "SELECT pass_no, type, rel_path, ts_ns, lpad((mode // 64 % 8) || '' || (mode // 8 % 8) || (mode % 8), 4, '0') AS mode, CASE errno WHEN 0 THEN NULL WHEN 13 THEN 'EACCES' ELSE 'ESTALE' END AS errno, nullif(detail, '') AS detail FROM journal")
R.add("P11_adhoc_filter", "journal", lambda j: jr.adhoc_filter(j, "type!=ORPHAN, errno>0, rel_path ~ U1, pass_no<3").select("event_id"), "SELECT event_id FROM journal WHERE type <> 'ORPHAN' AND errno > 0 AND rel_path ILIKE '%u1%' AND pass_no < 3")
R.add("P12_suspicious", "journal", lambda j: jr.split_suspicious(j.withColumn("rel_path", F.when(c("event_id") % 5 == 0, "").when(c("event_id") % 5 == 1, F.concat(c("rel_path"), F.lit("/../x"))).otherwise(c("rel_path"))))[1].select("event_id", "rel_path"),
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE rel_path || '/../x' END AS rel_path FROM journal WHERE event_id % 5 < 2")
R.add("A5_type_hist", "journal", lambda j: jr.type_hist(j, None, "u3"), "SELECT type, count(*) AS n FROM journal WHERE starts_with(rel_path, 'u3') GROUP BY type")
R.add("A6_type_counts", "journal", jr.type_counts, "SELECT * FROM tc", DEDUP)
R.add("S9_stored_counts", "journal", lambda j: _counts_stored(j).select("job_id", "pass_no", "type", "n"), "SELECT * FROM tc", DEDUP)
R.add("A7_job_type_counts", "journal", lambda j: jr.job_type_counts(jr.type_counts(j)), "SELECT job_id, type, sum(n)::BIGINT AS n FROM tc GROUP BY job_id, type", DEDUP)
R.add("A8_errors_by_class", "journal", lambda j: jr.errors_by_class(jr.errors(j)), "SELECT class, count(*) AS n FROM e GROUP BY class", ERRS)
R.add("A8_errors_by_class_page", "journal", lambda j: jr.errors_by_class(jr.page(jr.errors(j), 200, 0, ("pass_no", "ts_ns", "rel_path", "event_id"))[0]),
    "SELECT class, count(*) AS n FROM (SELECT * FROM e ORDER BY pass_no, ts_ns, rel_path, event_id LIMIT 200) GROUP BY class", ERRS)
R.add("O5_orphan_paths", "journal", jr.orphan_paths, "SELECT DISTINCT rel_path FROM journal WHERE type = 'ORPHAN'")
R.add("U2_distinct_orphans", "journal", lambda j: jr.orphan_paths(j.where("job_id = 1")), "SELECT DISTINCT rel_path FROM journal WHERE type = 'ORPHAN' AND job_id = 1")


def _with_bytes(d):
    return d.withColumn("content", F.encode("text", "UTF-8")).withColumn("size", F.length("content").cast("long"))


def _rows(s, ppm=1_000_000):
    return s.select("rel_path", in_sample(c("rel_path"), ppm).alias("sampled"))


#: FNV-1a of 64 bits, modulo one million.
FNV = "(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, strlen({0})), lambda i: ascii({0}[i + 1])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 1000000)"
VERIFIED = """
v AS (SELECT s.rel_path, CASE WHEN d.rel_path IS NULL THEN 'missing' WHEN strlen(s.text) <> strlen(d.text) THEN 'size mismatch' WHEN s.text <> d.text THEN 'checksum mismatch' END AS why
   FROM content s LEFT JOIN content_dst d ON s.rel_path = d.rel_path)"""
R.add("J6_verify", "content content_dst", lambda s, d: jr.verify(_rows(s), _with_bytes(s), _with_bytes(d)), "SELECT rel_path, CASE WHEN why IS NULL THEN 'VERIFY_OK' ELSE 'VERIFY_FAIL' END AS type, coalesce(why, '') AS detail FROM v", VERIFIED)
R.add("J7_recopy", "content content_dst", lambda s, d: jr.recopy(jr.verify(_rows(s), _with_bytes(s), _with_bytes(d)), s), "SELECT rel_path FROM v WHERE why IS NOT NULL", VERIFIED)
R.add("J15_audit_sums", "content content_dst", lambda s, d: jr.audit_sums(s.select("rel_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sum")), _with_bytes(d)),
    "SELECT s.rel_path, CASE WHEN d.rel_path IS NULL THEN 'missing' WHEN s.text = d.text THEN 'match' ELSE 'differs' END AS state FROM content s LEFT JOIN content_dst d ON s.rel_path = d.rel_path")
R.add("F15_verify_sample", "journal", lambda j: jr.verify_sample(j, 0.01),
    f"""SELECT job_id, pass_no, type, rel_path, type = 'COPIED' AND (hit OR NOT bool_or(hit) OVER w AND rel_path = min(rel_path) OVER w) AS sampled
       FROM (SELECT job_id, pass_no, type, rel_path, ppm < 10000 AS hit FROM (SELECT DISTINCT job_id, pass_no, type, rel_path FROM journal WHERE type IN ('COPIED', 'META_FIXED')) JOIN
         (SELECT rel_path, {FNV.format('rel_path')} AS ppm FROM (SELECT DISTINCT rel_path FROM journal)) USING (rel_path)) WINDOW w AS (PARTITION BY job_id, pass_no, type)""")
R.add("W10_chunk_content", "content", lambda s: tree.split_content(_with_bytes(s), 1000).select("rel_path", "offset", F.length("data").alias("length")),
    """SELECT rel_path, i * 1000 AS "offset", least(1000, strlen(text) - i * 1000) AS length FROM content, unnest(range(0, greatest(1, ceil(strlen(text) / 1000.0))::BIGINT)) u(i)""")
R.add("W10_assemble", "content", lambda s: tree.assemble(tree.split_content(_with_bytes(s), 777)).select("rel_path", F.decode("content", "UTF-8").alias("text")), "SELECT rel_path, text FROM content")
R.add("W10_stream_sums", "content", lambda s: chunks.stream_sums(tree.split_content(_with_bytes(s), 777)), "SELECT rel_path, strlen(text)::BIGINT AS size, sha256(text) AS sum, text IS NOT NULL AS whole FROM content")
R.add("W10_verify_pieces", "content content_dst", lambda s, d: chunks.verify_pieces(tree.split_content(_with_bytes(s), 1000), tree.split_content(_with_bytes(d), 777)),
    "SELECT rel_path, coalesce(s.text = d.text, false) AS ok FROM content s FULL JOIN content_dst d USING (rel_path)")
R.add("S2_content_listing", "content", lambda s: _with_bytes(s).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM content GROUP BY source")


#: Texts in a file of the tree at most: a file is one row when it is read.
_TEXTS = 20_000


def _tree(content, texts=_TEXTS):
    """The texts as files, in one directory for each language, one text a line; the root of the tree. Every task writes its own files, so none grows with the table."""
    root = _path(content, "tree")
    content.select("lang", c("text").alias("value")).write.option("maxRecordsPerFile", texts).partitionBy("lang").text(root)
    return root


def _lang():
    return F.regexp_extract("rel_path", "^lang=([^/]*)/", 1).alias("lang")


_LANGS = "l AS (SELECT lang, sum(coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS bytes FROM content GROUP BY lang)"
R.add("S2_scan_objects", "content", lambda t: scan_objects(t.sparkSession, _tree(t), "part-*.txt").groupBy(_lang()).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("content")).alias("read")),
    "SELECT lang, bytes, bytes AS read FROM l", _LANGS)


def _mounted(t):
    """The tree as every executor sees it: the shared folder is a mount."""
    return re.sub("^file:/*", "/", _tree(t))


R.add("S3_read_posix", "content", lambda t: read_posix(t.sparkSession, _mounted(t), names=3).where("type = 'DIR' or rel_path rlike '/part-[^/]*txt$'").groupBy("type", _lang()).agg(F.sum("size").alias("bytes"), F.sum(F.when(c("type") == "DIR", 1).otherwise(0)).alias("dirs")),
    """SELECT 'FILE' AS type, lang, bytes, 0::BIGINT AS dirs FROM l UNION ALL SELECT 'DIR', '', 0, count(*) FROM l""", _LANGS)
R.add("S10_gen_listing", "agents", lambda a: gen_listing(a.sparkSession, a.count()).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("rel_path").alias("paths")).where("type <> 'FILE'"),
    """SELECT type, n * (SELECT count(*) FROM agents) - root AS n, n * (SELECT count(*) FROM agents) - root AS paths FROM (VALUES ('DIR', 1, 1), ('SYMLINK', 3, 0), ('FIFO', 1, 0)) v(type, n, root)""")
