"""Scalar functions on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.functions import formats as fm
from driftline.functions import hashing, paths

R = Registry()
QUERIES, SQL = R.queries, R.sql
c = F.col


def _sizes(s):
    return s.select("rel_path", F.concat((c("size") % 1000).cast("string"), F.when(c("size") % 3 == 0, ".5").otherwise(""), F.element_at(F.array(*map(F.lit, ["", "KiB", " MiB", "GiB", "TiB", "KB"])), (c("size") % 6 + 1).cast("int"))).alias("text"))


R.add("F1_parse_byte_size", "src", lambda s: _sizes(s).select("rel_path", fm.parse_byte_size(c("text")).alias("bytes")),
    """SELECT rel_path, CASE WHEN size % 6 = 5 THEN NULL ELSE floor((size % 1000 + CASE WHEN size % 3 = 0 THEN 0.5 ELSE 0 END)::DOUBLE * ([1, 1024, 1048576, 1073741824, 1099511627776, 0])[size % 6 + 1])::BIGINT END AS bytes FROM src""")
R.add("F2_human_bytes", "src", lambda s: s.select("rel_path", fm.human_bytes(c("size") * (c("size") % 5000)).alias("text")),
    """SELECT rel_path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0)
         WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0) ELSE printf('%.1f TiB', n / 1099511627776.0) END AS text FROM (SELECT rel_path, size * (size % 5000) AS n FROM src)""")
R.add("F3_human_duration", "work_items", lambda w: w.select("item_id", fm.human_duration(c("wall_ms") * (c("item_id") % 40)).alias("text")),
    """SELECT item_id, CASE WHEN ms <= 0 THEN '0s' WHEN ms < 60000 THEN (ms // 1000) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's'
         ELSE (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' END AS text FROM (SELECT item_id, wall_ms * (item_id % 40) AS ms FROM work_items)""")
R.add("F4_commas", "src", lambda s: s.select("rel_path", fm.commas(c("size") * 97).alias("text")), "SELECT rel_path, format('{:,}', size * 97) AS text FROM src")
R.add("F5_octal_mode", "src", lambda s: s.select("rel_path", fm.octal_mode(c("mode")).alias("text")),
    "SELECT rel_path, lpad((mode // 512 % 8) || '' || (mode // 64 % 8) || (mode // 8 % 8) || (mode % 8), 4, '0') AS text FROM src")
R.add("F6_sum_hex", "journal", lambda j: j.select("event_id", fm.sum_hex(c("sum_hi"), c("sum_lo")).alias("text")),
    "SELECT event_id, lpad(printf('%x', (sum_hi::HUGEINT + CASE WHEN sum_hi < 0 THEN 18446744073709551616 ELSE 0 END)::UBIGINT), 16, '0') || lpad(printf('%x', (sum_lo::HUGEINT + CASE WHEN sum_lo < 0 THEN 18446744073709551616 ELSE 0 END)::UBIGINT), 16, '0') AS text FROM journal")
R.add("F7_verify_text", "passes", lambda p: p.select("job_id", "pass_no", fm.verify_text(c("verify_ok") * 1000, c("verify_fail")).alias("text")),
    "SELECT job_id, pass_no, format('{:,}', verify_ok * 1000) || ' ok' || CASE WHEN verify_fail > 0 THEN ' / ' || format('{:,}', verify_fail) || ' FAIL' ELSE '' END AS text FROM passes")
R.add("F8_errno_class", "journal", lambda j: j.select("event_id", fm.errno_class(c("errno")).alias("class")), "SELECT event_id, CASE errno WHEN 13 THEN 'EACCES' WHEN 116 THEN 'ESTALE' ELSE errno || '' END AS class FROM journal")
R.add("F9_paths", "src", lambda s: s.select("rel_path", paths.parent(c("rel_path")).alias("parent"), paths.leaf(c("rel_path")).alias("leaf"), paths.depth(c("rel_path")).alias("depth"),
        paths.join(paths.parent(c("rel_path")), paths.leaf(c("rel_path"))).alias("again"), F.array_join(paths.ancestors(c("rel_path")), "|").alias("above")),
    """SELECT rel_path, array_to_string(p[1:-2], '/') AS parent, p[-1] AS leaf, len(p) AS depth, rel_path AS again,
         array_to_string(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/')), '|') AS above FROM (SELECT rel_path, string_split(rel_path, '/') AS p FROM src)""")
_SLASHED = "rtrim({}, '/') || '/'"
_OVERLAP = f"starts_with({_SLASHED}, {_SLASHED}) OR starts_with({_SLASHED}, {_SLASHED})"
R.add("F10_paths_overlap", "src", lambda s: s.select(F.concat(F.lit("/"), "rel_path").alias("path"), F.explode(F.transform(paths.ancestors(c("rel_path")), lambda p: F.concat(F.lit("/"), p))).alias("above")).select(
        "path", "above", paths.paths_overlap(c("path"), F.concat("above", F.lit("/"))).alias("beneath"), paths.paths_overlap(c("above"), c("path")).alias("around"), paths.paths_overlap(c("path"), F.concat("above", F.lit(".old"))).alias("beside")),
    f"""SELECT path, above, {_OVERLAP.format("path", "above || '/'", "above || '/'", "path")} AS beneath, {_OVERLAP.format("above", "path", "path", "above")} AS around,
         {_OVERLAP.format("path", "above || '.old'", "above || '.old'", "path")} AS beside FROM (SELECT '/' || rel_path AS path, '/' || unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS above
         FROM (SELECT rel_path, string_split(rel_path, '/') AS p FROM src))""")
R.add("F11_mode_bits", "src", lambda s: s.select("rel_path", *[v.alias(k) for k, v in fm.mode_bits(c("mode") + (c("size") % 8 * 512).cast("int")).items()]),
    "SELECT rel_path, m % 4096 AS perm, m // 2048 % 2 = 1 AS setuid, m // 1024 % 2 = 1 AS setgid, m // 512 % 2 = 1 AS sticky FROM (SELECT rel_path, mode + size % 8 * 512 AS m FROM src)")
R.add("F12_temp_name", "work_items", lambda w: w.select("item_id", fm.temp_name(".sync.tmp.", c("job_id"), c("pass_no"), c("item_id"), c("attempt")).alias("name")),
    "SELECT item_id, printf('.sync.tmp.%x-%x.%x.%x', job_id::BIGINT, pass_no::BIGINT, item_id, attempt::BIGINT) AS name FROM work_items")
R.add("F13_temp_tag", "work_items", lambda w: w.withColumn("tail", F.concat(F.when(c("item_id") % 4 == 0, "+").when(c("item_id") % 4 == 1, "0").otherwise(""), F.lower(F.hex(c("job_id"))), F.lit("-"), F.lower(F.hex(c("pass_no"))), F.lit(".1.0"))).select(
        "item_id", fm.temp_tag(c("tail"))[0].alias("job"), fm.temp_tag(c("tail"))[1].alias("pass"), fm.tag_matches(c("tail"), c("job_id"), F.lit(2)).alias("own")),
    """SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN printf('%x', job_id::BIGINT) END AS job, CASE WHEN item_id % 4 <> 0 THEN printf('%x', pass_no::BIGINT) END AS pass, item_id % 4 <> 0 AND pass_no = 2 AS own FROM work_items""")
R.add("F14_times", "journal", lambda j: j.select("event_id", fm.ts_to_ns(fm.ns_to_ts(c("ts_ns") + 999)).alias("ns"), F.abs(c("ts_ns") - F.lit(1704067200000000000)).alias("apart")),
    "SELECT event_id, ts_ns AS ns, abs(ts_ns - 1704067200000000000) AS apart FROM journal")
FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(rel_path, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""
R.add("F15_in_sample", "src", lambda s: s.select("rel_path", hashing.fnv1a_ppm(c("rel_path")).alias("ppm"), hashing.in_sample(c("rel_path"), hashing.sample_ppm(0)).alias("sampled")),
    f"SELECT rel_path, ({FNV} % 1000000)::BIGINT AS ppm, ({FNV} % 1000000)::BIGINT < 10000 AS sampled FROM src")
R.add("F16_content_sum", "content", lambda d: d.select("doc_id", hashing.content_sum(F.encode("text", "UTF-8")).alias("sum")), "SELECT doc_id, sha256(text) AS sum FROM content")
R.add("F17_type_category", "journal", lambda j: j.groupBy("type").agg(F.count("*").alias("n")).select("type", fm.type_category(c("type")).alias("category"), fm.type_order(c("type")).alias("rank"), "n"),
    """SELECT type, CASE WHEN type IN ('ERROR', 'VERIFY_FAIL') THEN 'failure' WHEN type = 'ORPHAN' THEN 'informational' ELSE 'nominal' END AS category,
         CASE type WHEN 'COPIED' THEN 0 WHEN 'META_FIXED' THEN 1 WHEN 'VERIFY_OK' THEN 5 WHEN 'ORPHAN' THEN 10 WHEN 'ERROR' THEN 13 ELSE 15 END AS rank, count(*) AS n FROM journal GROUP BY type""")
R.add("F18_journal_label", "journal", lambda j: j.groupBy("type").agg(F.count("*").alias("n")).where("n > 0").select(fm.journal_label(c("type")).alias("label"), fm.commas(c("n")).alias("n")),
    """SELECT CASE type WHEN 'COPIED' THEN 'copied' WHEN 'META_FIXED' THEN 'meta fixed' WHEN 'VERIFY_OK' THEN 'verify ok' WHEN 'ORPHAN' THEN 'orphans observed' WHEN 'ERROR' THEN 'errors' ELSE 'verify failed' END AS label,
         format('{:,}', count(*)) AS n FROM journal GROUP BY type""")
