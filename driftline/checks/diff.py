"""Filters, diff, orphans, plans and their application on the derived listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.functions import globs
from driftline.operators import diff, tree
from driftline.options import SyncOptions
from driftline.sources.listing import as_listing, read_listing, slice_listing
from driftline.sources.snapshots import store_bucketed
from driftline.storage import materialize, shared_folder

R = Registry()
QUERIES, SQL = R.queries, R.sql
DRY = SyncOptions(dry_run=True)
RULES = (("include", "fA/sF/**"), ("exclude", "**/*_3.dat"), ("exclude", "fR/s?/y199*"), ("exclude", "fN/**"))
FILTERED = SyncOptions(rules=RULES)

PAIRS = """
p AS MATERIALIZED (SELECT coalesce(s.rel_path, d.rel_path) rel_path, s.rel_path IS NOT NULL has_s, d.rel_path IS NOT NULL has_d,
  s.type st, d.type dt, s.mode sm, d.mode dm, s.uid su, d.uid du, s.gid sg, d.gid dg, s.size ss, d.size ds, s.mtime_ns sn, d.mtime_ns dn, s.nlink nl,
  s.link_target sl, d.link_target dl, s.rdev_major sa, d.rdev_major da, s.rdev_minor si, d.rdev_minor di, s.blocks sb, d.blocks db
  FROM src s FULL OUTER JOIN dst d ON s.rel_path = d.rel_path),
r AS (SELECT *, CASE WHEN NOT has_s THEN NULL
   WHEN st = 'FILE' THEN CASE WHEN NOT has_d THEN 'absent' WHEN st <> dt THEN 'type' WHEN ss <> ds THEN 'size' WHEN abs(sn - dn) > 1000000 THEN 'mtime'
      WHEN su <> du OR sg <> dg THEN 'owner' WHEN sm % 4096 <> dm % 4096 THEN 'mode' END
   WHEN st = 'SYMLINK' THEN CASE WHEN NOT has_d THEN 'absent' WHEN st <> dt THEN 'type' WHEN sl <> dl THEN 'target' END
   WHEN st = 'DIR' THEN CASE WHEN NOT has_d THEN 'absent' WHEN st <> dt THEN 'type' END
   ELSE CASE WHEN NOT has_d THEN 'absent' WHEN st <> dt THEN 'type' WHEN sa <> da OR si <> di THEN 'rdev' END END reason FROM p),
pl AS MATERIALIZED (SELECT *, CASE WHEN NOT has_s THEN 'DST_ONLY' WHEN st = 'DIR' THEN CASE WHEN reason IS NULL THEN 'DIR' ELSE 'MKDIR' END
   WHEN reason IS NULL THEN 'CLEAN' WHEN st = 'SYMLINK' THEN 'SYMLINK' WHEN st <> 'FILE' THEN 'SPECIAL' WHEN reason IN ('owner', 'mode') THEN 'META_FIX' ELSE 'COPY' END AS action FROM r),
walked AS (SELECT rel_path AS up FROM pl WHERE st = 'DIR' UNION ALL SELECT ''),
extra AS MATERIALIZED (SELECT rel_path, dt AS type, CASE WHEN instr(rel_path, '/') > 0 THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS up FROM pl WHERE action = 'DST_ONLY'),
orphans AS MATERIALIZED (SELECT rel_path, type FROM extra SEMI JOIN walked USING (up) WHERE NOT starts_with(regexp_extract(rel_path, '[^/]*$'), '.sync.tmp.')),
aside AS MATERIALIZED (SELECT rel_path, CASE WHEN instr(rel_path, '/') > 0 THEN regexp_replace(rel_path, '/[^/]*$', '') || '/' ELSE '' END || '.sync.stale.1-1.' || ltrim(substr(md5(rel_path), 1, 15), '0') || '.0' AS stale
   FROM pl SEMI JOIN (SELECT up AS rel_path FROM extra) USING (rel_path) WHERE reason = 'type' AND dt = 'DIR' AND action <> 'MKDIR')"""
PAIRS += """,
pre AS (SELECT rel_path, unnest(list_transform(range(1, len(string_split(rel_path, '/')) + 1), lambda i: array_to_string(string_split(rel_path, '/')[1:i], '/'))) AS root FROM extra),
gone AS (SELECT DISTINCT rel_path FROM pre SEMI JOIN (SELECT rel_path AS root FROM orphans) USING (root)),
moved AS (SELECT pre.rel_path, stale || substr(pre.rel_path, len(root) + 1) AS new FROM pre JOIN aside ON root = aside.rel_path)"""


def _plan(src, dst, opts=SyncOptions()):
    return diff.plan(src, dst, opts)


def _written(src, dst, opts=SyncOptions(), **kept):
    return diff.written_plan(src, dst, opts, **kept)


def _journal(src, dst, opts=SyncOptions(), fields=("nlink",)):
    """The journal; of both sides it holds the fields that are asked for."""
    planned = _written(src, dst, opts, fields=fields, clean=False)
    return diff.to_journal(planned, diff.plan_orphans(planned, opts=opts), 1, 1, opts)


def _counters(src, dst):
    planned = _written(src, dst, fields=("nlink", "size"))
    return diff.pass_counters(planned, diff.plan_orphans(planned))


#: What plans compare.
COMPARED = ("size", "mtime_ns", "uid", "gid", "mode", "link_target", "rdev_major", "rdev_minor")


def _applied(src, dst, delete, fields=COMPARED):
    """The destination after the plan, as far as the fields that are asked for."""
    planned = _written(src, dst, fields=fields)
    return diff.apply_plan(dst, planned, diff.plan_orphans(planned) if delete else None)


def _read_back(src):
    """The listing written and read again in each format."""
    base = f"{shared_folder(src.sparkSession)}/driftline/listing-{uuid.uuid4().hex}"
    found = []
    rows = as_listing(src)
    for fmt in ("parquet", "json", "csv"):
        held = rows.drop("xattrs") if fmt == "csv" else rows
        held.write.format(fmt).option("header", True).option("nullValue", "\\N").save(f"{base}/{fmt}")
        found.append(read_listing(src.sparkSession, f"{base}/{fmt}", fmt).select(F.lit(fmt).alias("format"), "rel_path", "type", "size", "mtime_ns", "nlink", "link_target", "stat_errno"))
    return found[0].union(found[1]).union(found[2])


def add(name, run, sql, tables="src dst", more=PAIRS):
    R.add(name, tables, run, sql, more)


add("D1_tree_diff", lambda s, d: diff.tree_diff(s, d).select("rel_path", F.col("src").isNotNull().alias("in_src"), F.col("dst").isNotNull().alias("in_dst")),
    "SELECT rel_path, has_s AS in_src, has_d AS in_dst FROM p")
add("J1_full_outer", lambda s, d: diff.tree_diff(s, d).select("rel_path", F.col("src.size").alias("src_size"), F.col("dst.size").alias("dst_size")),
    "SELECT rel_path, ss AS src_size, ds AS dst_size FROM p")


def _bucketed(s, d):
    """Both listings stored in buckets of their paths, then joined bucket by bucket."""
    base = f"{shared_folder(s.sparkSession)}/driftline/bucketed-{uuid.uuid4().hex}"
    stored = [store_bucketed(df, f"bucketed_{side}_{uuid.uuid4().hex}", f"{base}/{side}", 8) for side, df in (("src", s), ("dst", d))]
    return diff.tree_diff(*stored)


add("J1_bucketed_join", lambda s, d: _bucketed(s, d).select("rel_path", F.col("src.size").alias("src_size"), F.col("dst.size").alias("dst_size")), "SELECT rel_path, ss AS src_size, ds AS dst_size FROM p")
add("D2_classify", lambda s, d: _plan(s, d).select("rel_path", "action", "reason"), "SELECT rel_path, action, reason FROM pl")
add("D3_mtime_equal", lambda s, d: diff.tree_diff(s, d).where("src.type = 'FILE' and dst.type = 'FILE'").select(
        "rel_path", diff.mtime_equal(F.col("src.mtime_ns"), F.col("dst.mtime_ns"), 1_000_000).alias("same")),
    "SELECT rel_path, abs(sn - dn) <= 1000000 AS same FROM p WHERE st = 'FILE' AND dt = 'FILE'")
add("D4_symlinks", lambda s, d: diff.plan_of(s.where("type = 'SYMLINK'"), d).select("rel_path", "action", "reason"), "SELECT rel_path, action, reason FROM pl WHERE st = 'SYMLINK'")
add("D5_specials", lambda s, d: diff.plan_of(s.where("type = 'CHARDEV'"), d).select("rel_path", "action", "reason"), "SELECT rel_path, action, reason FROM pl WHERE st = 'CHARDEV'")
add("D6_directories", lambda s, d: diff.plan_of(s.where("type = 'DIR'"), d).select("rel_path", "action", "reason"), "SELECT rel_path, action, reason FROM pl WHERE st = 'DIR'")
add("D7_type_changes", lambda s, d: diff.type_changes(diff.tree_diff(s, d), d, 1, 1).select("rel_path", "src_type", "dst_type", "step", "stale_path"),
    """SELECT rel_path, st AS src_type, dt AS dst_type, CASE WHEN stale IS NULL THEN 'REMOVE' ELSE 'SET_ASIDE' END AS step, stale AS stale_path
       FROM p LEFT JOIN aside USING (rel_path) WHERE has_s AND has_d AND st <> dt""")
add("D8_orphans", lambda s, d: diff.orphans(s, d).select("rel_path", "type"), "SELECT rel_path, type FROM orphans")
add("J2_dst_only_sweep", lambda s, d: diff.plan_orphans(materialize(diff.outline(s, d), "outline")).select("rel_path", "type"), "SELECT rel_path, type FROM orphans UNION ALL SELECT stale, 'DIR' FROM aside")
add("D9_temp_residue", lambda s, d: diff.temp_residue(s, d, 1, 1),
    r"SELECT rel_path, NOT regexp_matches(rel_path, '/\.sync\.tmp\.1-1\.') AS reclaim FROM p WHERE NOT has_s AND rel_path LIKE '%/.sync.tmp.%'")
add("D10_scan_errors", lambda s, d: diff.plan(
        s.withColumn("stat_errno", F.when(F.length("rel_path") % 7 == 0, 13).when(F.length("rel_path") % 7 == 1, 2).otherwise(0)),
        d.withColumn("stat_errno", F.when(F.length("rel_path") % 7 == 2, 5).otherwise(0)), rows=s.count() + d.count()).groupBy("action", "reason").agg(F.count("*").alias("n")),
    """SELECT action, reason, count(*) AS n FROM (SELECT CASE WHEN NOT has_s THEN action WHEN e = 0 THEN 'ERROR' WHEN e = 1 THEN 'VANISHED'
           WHEN e = 2 AND has_d THEN CASE st WHEN 'FILE' THEN 'COPY' WHEN 'DIR' THEN 'MKDIR' WHEN 'SYMLINK' THEN 'SYMLINK' ELSE 'SPECIAL' END ELSE action END AS action,
         CASE WHEN NOT has_s OR e IN (0, 1) THEN NULL WHEN e = 2 AND has_d THEN 'absent' ELSE reason END AS reason
       FROM (SELECT *, length(rel_path) % 7 AS e FROM pl) z) GROUP BY ALL""")
add("D11_dry_run", lambda s, d: _journal(s, d, DRY).groupBy("type").agg(F.count("*").alias("n")),
    """SELECT type, count(*) AS n FROM (SELECT 'WOULD_COPY' AS type FROM pl WHERE action = 'COPY' UNION ALL SELECT 'DIR_META' FROM pl WHERE st = 'DIR' UNION ALL SELECT 'DIR_META'
         UNION ALL SELECT 'ORPHAN' FROM orphans UNION ALL SELECT 'NLINK_DUP' FROM pl WHERE action IN ('COPY', 'META_FIX', 'CLEAN') AND st = 'FILE' AND nl > 1) GROUP BY type""")
STRATEGY = SyncOptions(direct_write=True, chunk_threshold=5_000_000, chunk_size=2_000_000)
add("D12_copy_strategy", lambda s, d: _plan(s, d, STRATEGY).where("action = 'COPY'").select("rel_path", "strategy"),
    "SELECT rel_path, CASE WHEN ss >= 5000000 THEN 'CHUNKED' WHEN reason = 'absent' THEN 'DIRECT' ELSE 'TEMP_RENAME' END AS strategy FROM pl WHERE action = 'COPY'")
add("D13_sparse", lambda s: s.where("type = 'FILE'").select("rel_path", diff.is_sparse(F.col("size"), F.col("blocks")).alias("sparse")),
    "SELECT rel_path, blocks * 512 + 4096 < size AS sparse FROM src WHERE type = 'FILE'", "src", "")
add("D14_drift", lambda s, d: diff.drift(_plan(s, d), s.where("ino % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("ino") % 5 == 1, 1).otherwise(0))
        .withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("ino") % 5 == 2, 1).otherwise(0))),
    """SELECT rel_path, CASE ino % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' ELSE 'mtime' END AS detail, 'SRC_CHANGED' AS type
       FROM pl JOIN src USING (rel_path) WHERE action = 'COPY' AND ino % 5 < 3""")
add("D18_dirfix", lambda s, d: diff.dirfix(_journal(s, d, fields=("nlink", "uid", "gid", "mode", "mtime_ns")),
        d.withColumn("mode", F.col("mode") + F.when(F.length("rel_path") % 2 == 0, 1).otherwise(0)).withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.length("rel_path") % 3 == 0, 1).otherwise(0))),
    """SELECT rel_path, false AS owner, length(rel_path) % 2 = 0 AS mode, length(rel_path) % 3 = 0 AS mtime FROM src
       WHERE type = 'DIR' AND rel_path IN (SELECT rel_path FROM dst WHERE type = 'DIR') AND (length(rel_path) % 2 = 0 OR length(rel_path) % 3 = 0)""")
JOURNAL = """SELECT 'COPIED' AS type, rel_path FROM pl WHERE action IN ('COPY', 'SYMLINK', 'SPECIAL') UNION ALL SELECT 'META_FIXED', rel_path FROM pl WHERE action = 'META_FIX'
  UNION ALL SELECT 'DIR_META', rel_path FROM pl WHERE st = 'DIR' UNION ALL SELECT 'DIR_META', '' UNION ALL SELECT 'ORPHAN', rel_path FROM orphans
  UNION ALL SELECT 'NLINK_DUP', rel_path FROM pl WHERE action IN ('COPY', 'META_FIX', 'CLEAN') AND st = 'FILE' AND nl > 1
  UNION ALL SELECT 'ORPHAN', stale FROM aside"""
add("D19_to_journal", lambda s, d: _journal(s, d).select("type", "rel_path"), JOURNAL)
add("D20_apply_plan", lambda s, d: _applied(s, d, True, ("size", "mtime_ns", "mode", "uid")).select("rel_path", "type", "size", "mtime_ns", "mode", "uid"),
    """SELECT rel_path, st AS type, ss AS size, sn AS mtime_ns, sm AS mode, su AS uid FROM pl WHERE has_s AND action <> 'CLEAN'
       UNION ALL SELECT rel_path, dt, ds, dn, dm, du FROM pl WHERE action = 'CLEAN'
       UNION ALL SELECT coalesce(new, pl.rel_path), dt, ds, dn, dm, du FROM pl LEFT JOIN moved ON pl.rel_path = moved.rel_path ANTI JOIN gone ON pl.rel_path = gone.rel_path WHERE action = 'DST_ONLY'
       UNION ALL SELECT stale, dt, ds, dn, dm, du FROM pl JOIN aside USING (rel_path)""")
add("D20_apply_then_diff", lambda s, d: _plan(s, _applied(s, d, False)).groupBy("action", "reason").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN st = 'DIR' THEN 'DIR' ELSE 'CLEAN' END AS action, NULL::VARCHAR AS reason, count(*) AS n FROM pl WHERE has_s GROUP BY 1
       UNION ALL SELECT 'DST_ONLY', NULL, (SELECT count(*) FROM extra) + (SELECT count(*) FROM aside)""")
add("D21_fidelity", lambda s, d: diff.fidelity(s, d),
    """SELECT attribute, sum(CASE WHEN same THEN 1 ELSE 0 END) AS n_match, sum(CASE WHEN NOT same THEN 1 ELSE 0 END) AS n_differ, 0 AS n_not_preservable FROM (
       SELECT unnest([{'attribute': 'type', 'same': st = dt}, {'attribute': 'size', 'same': CASE WHEN f THEN ss = ds END}, {'attribute': 'mtime', 'same': CASE WHEN f THEN abs(sn - dn) <= 1000000 END},
        {'attribute': 'owner', 'same': su = du AND sg = dg}, {'attribute': 'mode', 'same': sm % 4096 = dm % 4096}, {'attribute': 'xattrs', 'same': true},
        {'attribute': 'sparse', 'same': CASE WHEN f THEN (sb * 512 + 4096 < ss) = (db * 512 + 4096 < ds) END}, {'attribute': 'rdev', 'same': CASE WHEN st = 'CHARDEV' THEN sa = da AND si = di END},
        {'attribute': 'link_target', 'same': CASE WHEN st = 'SYMLINK' THEN sl = dl END}], recursive := true) FROM (SELECT *, st = 'FILE' AND dt = 'FILE' AS f FROM p WHERE has_s AND has_d)) GROUP BY attribute""")
add("J3_both_sides", diff.both_sides, "SELECT rel_path FROM p WHERE has_s AND has_d")
add("U3_dst_only", diff.dst_only, "SELECT rel_path FROM p WHERE NOT has_s")
add("A1_pass_counters", _counters,
    """SELECT count(*) FILTER (has_s) AS entries_walked, count(*) FILTER (action IN ('COPY', 'SYMLINK', 'SPECIAL')) AS files_copied, coalesce(sum(ss) FILTER (action = 'COPY'), 0)::BIGINT AS bytes_copied,
       count(*) FILTER (action = 'META_FIX') AS meta_fixed, count(*) FILTER (action = 'CLEAN') AS clean, 0 AS errors, count(*) FILTER (st = 'DIR') AS dirs, count(*) FILTER (action = 'SYMLINK') AS symlinks,
       count(*) FILTER (st = 'CHARDEV') AS specials, count(*) FILTER (st = 'FILE' AND nl > 1) AS nlink_dup_files, coalesce(sum(ss) FILTER (st = 'FILE' AND nl > 1), 0)::BIGINT AS nlink_dup_bytes,
       (SELECT count(*) FROM orphans) + (SELECT count(*) FROM aside) AS orphans FROM pl""")
add("A11_nlink_cost", diff.nlink_cost, "SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM src WHERE type = 'FILE' AND nlink > 1", "src", "")
add("S1_read_listing", _read_back, """SELECT unnest(['parquet', 'json', 'csv']) AS format, rel_path, type, size, mtime_ns, nlink, link_target, 0 AS stat_errno FROM src""", "src", "")
add("S4_slice_listing", lambda s, d: slice_listing(s, d.where("size % 3 = 0").select(F.expr("substring_index(rel_path, '/', size(split(rel_path, '/')) - 1)").alias("parent"), F.substring_index("rel_path", "/", -1).alias("name"))).select("rel_path", "size"),
    "SELECT rel_path, size FROM src WHERE rel_path IN (SELECT rel_path FROM dst WHERE size % 3 = 0)", more="")

EXCLUDED = r"""
x AS (SELECT rel_path, type, list_transform(range(1, len(string_split(rel_path, '/')) + 1), lambda i: array_to_string(string_split(rel_path, '/')[1:i], '/')) AS ps FROM src),
ex AS (SELECT rel_path, type, len(list_filter(ps, lambda q: CASE WHEN regexp_full_match(q, 'fA/sF/(?s:.*)') THEN false WHEN regexp_full_match(q, '(?s:.*)[^/]*_3\.dat') THEN true
   WHEN regexp_full_match(q, 'fR/s[^/]/y199[^/]*') THEN true WHEN regexp_full_match(q, 'fN/(?s:.*)') THEN true ELSE false END)) > 0 AS excluded FROM x)"""
for _i, (_glob, _regex) in enumerate((("**/*_1.dat", r"(?s:.*)[^/]*_1\.dat"), ("f?/s?/*", "f[^/]/s[^/]/[^/]*"), ("**", "(?s:.*)"), ("fA/**/y1997/**", "fA/(?s:.*)y1997/(?s:.*)"))):
    add(f"P1_glob_{_i}", lambda s, g=_glob: s.where(globs.glob_match(F.col("rel_path"), g)).select("rel_path"), f"SELECT rel_path FROM src WHERE regexp_full_match(rel_path, '{_regex}')", "src", "")
add("P2_apply_filters", lambda s: diff.apply_filters(s, RULES).select("rel_path", "type"), "SELECT rel_path, type FROM ex WHERE NOT excluded", "src", EXCLUDED)
add("P3_subtree_pruning", lambda s: diff.apply_filters(s, RULES, keep_excluded=True).where("type = 'DIR'").select("rel_path", "excluded"), "SELECT rel_path, excluded FROM ex WHERE type = 'DIR'", "src", EXCLUDED)
add("P4_filters_shield_source_only", lambda s, d: diff.plan(s, d, FILTERED).groupBy("action").agg(F.count("*").alias("n")).unionByName(
        diff.orphans(s, d, FILTERED).agg(F.count("*").alias("n")).select(F.lit("ORPHAN").alias("action"), "n")),
    """SELECT CASE WHEN excluded THEN 'EXCLUDED' ELSE action END AS action, count(*) AS n FROM pl LEFT JOIN ex USING (rel_path) GROUP BY 1
       UNION ALL SELECT 'ORPHAN', count(*) FROM orphans WHERE (CASE WHEN instr(rel_path, '/') > 0 THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END) NOT IN (SELECT rel_path FROM ex WHERE excluded)""",
    more=PAIRS + "," + EXCLUDED)
OFF = SyncOptions(owner=False, mode=False, times=False, specials=False)
add("P14_toggles", lambda s, d: diff.plan(s, d, OFF).groupBy("action", "reason").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN st = 'CHARDEV' THEN 'SKIPPED' WHEN reason IN ('mtime', 'owner', 'mode') THEN 'CLEAN' ELSE action END AS action,
       CASE WHEN st = 'CHARDEV' OR reason IN ('mtime', 'owner', 'mode') THEN NULL ELSE reason END AS reason, count(*) AS n FROM pl GROUP BY 1, 2""")

ANCESTORS = """
an AS (SELECT rel_path, type, size, unnest(list_transform(range(0, len(string_split(rel_path, '/'))), lambda i: array_to_string(string_split(rel_path, '/')[1:i], '/'))) AS dir FROM src)"""
add("A25_wide_dirs", lambda s: tree.wide_dirs(s, 400, 100), 
    "SELECT dir AS parent, count(*) AS n, ceil(count(*) / 100.0)::BIGINT AS slices FROM (SELECT CASE WHEN instr(rel_path, '/') > 0 THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS dir FROM src) GROUP BY dir HAVING count(*) > 400", "src", "")
add("A26_subtree_totals", lambda s: tree.subtree_totals(s), "SELECT dir, count(*) AS objects, sum(size)::BIGINT AS bytes FROM an GROUP BY dir", "src", ANCESTORS)
add("A26_over_budget", lambda s: tree.over_budget(s, 500), "SELECT dir, count(*) AS objects, sum(size)::BIGINT AS bytes FROM an GROUP BY dir HAVING count(*) > 500", "src", ANCESTORS)
add("J8_expand_deletes", lambda s, d: tree.expand_deletes(diff.orphans(s, d), d).select("rel_path", "type"),
    "SELECT d.rel_path, d.type FROM dst d WHERE d.rel_path IN (SELECT rel_path FROM gone)")
add("U4_delete_plan", lambda s, d: tree.delete_plan(diff.orphans(s, d), d, "job-1", "job-1", 7).groupBy("depth").agg(F.count("*").alias("n"), F.countDistinct("rel_path").alias("paths")),
    "SELECT len(string_split(d.rel_path, '/')) AS depth, count(*) AS n, count(*) AS paths FROM dst d WHERE d.rel_path IN (SELECT rel_path FROM gone) GROUP BY 1")


def _delete_journals(s, d):
    """Counts of the rows of a delete pass and of its dry run; orphans are found once and written."""
    roots = materialize(diff.orphans(s, d), "orphans")
    removed = tree.expand_deletes(roots, d)
    real, dry = (tree.delete_journal(removed, roots, dry_run).groupBy("type").agg(F.count("*").alias("n")) for dry_run in (False, True))
    return real.unionByName(dry)


add("U5_delete_journal", _delete_journals,
    "SELECT 'DELETED' AS type, count(*) AS n FROM dst d WHERE d.rel_path IN (SELECT rel_path FROM gone) UNION ALL SELECT 'WOULD_DELETE', count(*) FROM orphans")
add("O1_deepest_first", lambda s: tree.deepest_first(s.where("type = 'DIR'")).select("rel_path", "depth"), "SELECT rel_path, len(string_split(rel_path, '/')) AS depth FROM src WHERE type = 'DIR'", "src", "")
add("W11_batches", lambda s: tree.batches(tree.bucketed(s.where("type = 'FILE'"), 64).withColumn("parent", F.substring_index("rel_path", "/", 3)), 100, ["parent"], ["rel_path"]).select("rel_path", "batch"),
    "SELECT rel_path, (row_number() OVER (PARTITION BY regexp_extract(rel_path, '^[^/]*/[^/]*/[^/]*') ORDER BY rel_path) - 1) // 100 AS batch FROM src WHERE type = 'FILE'", "src", "")
add("W9_chunk_ranges", lambda s, d: tree.chunk_ranges(_plan(s, d).where("action = 'COPY'").select("rel_path", F.col("src.size").alias("size")), 1_000_000).select("rel_path", "chunk", "offset", "length", "kind"),
    """SELECT rel_path, i AS chunk, i * 1000000 AS "offset", least(1000000, ss - i * 1000000) AS length, CASE WHEN i = 0 THEN 'create' ELSE 'data' END AS kind
       FROM pl, unnest(range(0, greatest(1, ceil(ss / 1000000.0))::BIGINT)) u(i) WHERE action = 'COPY'
       UNION ALL SELECT rel_path, greatest(1, ceil(ss / 1000000.0))::BIGINT, NULL, NULL, 'finalize' FROM pl WHERE action = 'COPY'""")
add("A22_chunk_progress", lambda s, d: tree.chunk_progress(
        c := tree.chunk_ranges(_plan(s, d).where("action = 'COPY'").select("rel_path", F.col("src.size").alias("size")), 1_000_000),
        c.where("kind <> 'finalize' and (chunk + length(rel_path)) % 4 <> 0").select("rel_path", "chunk", (F.col("offset") % 7_000_000 == 6_000_000).alias("drifted"))),
    """SELECT rel_path, n AS n_chunks, done AS n_done, done = n AND NOT bad AS ready, bad AS aborted FROM (SELECT rel_path, count(*) AS n, count(*) FILTER ((i + length(rel_path)) % 4 <> 0) AS done,
         coalesce(bool_or((i * 1000000) % 7000000 = 6000000 AND (i + length(rel_path)) % 4 <> 0), false) AS bad
       FROM pl, unnest(range(0, greatest(1, ceil(ss / 1000000.0))::BIGINT)) u(i) WHERE action = 'COPY' GROUP BY rel_path)""")
add("A23_delete_closure", lambda d: tree.delete_closure(d.select(F.expr("substring_index(rel_path, '/', size(split(rel_path, '/')) - 1)").alias("dir"), (F.col("size") % 5 != 0).alias("done"))),
    """SELECT dir, bool_and(done) AS closed FROM (SELECT unnest(list_transform(range(1, len(string_split(parent, '/')) + 1), lambda i: array_to_string(string_split(parent, '/')[1:i], '/'))) AS dir, done
       FROM (SELECT regexp_replace(rel_path, '/[^/]*$', '') AS parent, size % 5 <> 0 AS done FROM dst WHERE instr(rel_path, '/') > 0)) GROUP BY dir""", "dst", "")
LINKS = """
gr AS (SELECT ino, min(rel_path) AS anchor, max(nlink) AS nlink_expected, count(DISTINCT rel_path) AS members_seen FROM src WHERE type = 'FILE' AND nlink > 1 GROUP BY ino)"""
add("A12_link_groups", lambda s: tree.link_groups(s, 2).select("ino", "anchor_path", "anchor_size", "nlink_expected", "members_seen", "fallback"),
    "SELECT gr.ino, anchor AS anchor_path, size AS anchor_size, nlink_expected, members_seen, members_seen > 2 AS fallback FROM gr JOIN src ON anchor = rel_path", "src", LINKS)
add("W12_anchor", lambda s: tree.link_groups(s, 0).select("ino", "anchor_path"), "SELECT ino, anchor AS anchor_path FROM gr", "src", LINKS)
add("J4_pending_links", lambda s: tree.pending_links(tree.link_groups(s, 0).withColumn("anchor_state", F.when(F.col("ino") % 20 == 0, "pending").otherwise("copied")), tree.link_members(s)).select("ino", "rel_path", "anchor_path"),
    "SELECT gr.ino, rel_path, anchor AS anchor_path FROM gr JOIN src ON src.ino = gr.ino AND src.type = 'FILE' AND nlink > 1 WHERE rel_path <> anchor AND gr.ino % 20 <> 0", "src", LINKS)
add("J5_link_outcomes", lambda s, d: tree.link_outcomes(tree.pending_links(tree.link_groups(s, 0).withColumn("anchor_state", F.lit("copied")), tree.link_members(s)), d.withColumn("dev", F.lit(1))).select("rel_path", "type", "detail"),
    """SELECT m.rel_path, CASE WHEN a.rel_path IS NULL THEN 'ERROR' WHEN a.size <> s.size OR a.mtime_ns <> s.mtime_ns THEN 'SRC_CHANGED' WHEN b.ino = a.ino THEN NULL ELSE 'LINK_CREATED' END AS type, anchor AS detail
       FROM gr JOIN src m ON m.ino = gr.ino AND m.type = 'FILE' AND m.nlink > 1 AND m.rel_path <> anchor JOIN src s ON s.rel_path = anchor LEFT JOIN dst a ON a.rel_path = anchor LEFT JOIN dst b ON b.rel_path = m.rel_path""", more=LINKS)


XATTRS = """
xa AS MATERIALIZED (SELECT rel_path, doc_id, lang, source FROM content),
xd AS MATERIALIZED (SELECT rel_path, doc_id % 10 AS k FROM content_dst)"""


def _xattrs(d, dst):
    """user.lang, user.source and two system names; a third of the destination differs in one of them."""
    text = lambda c: F.col(c).cast("binary")
    changed = F.when(F.col("doc_id") % 10 == 4, F.lit("other")).otherwise(F.col("lang")) if dst else F.col("lang")
    every = F.create_map(
        F.lit("user.lang"), changed.cast("binary"), F.lit("user.source"), text("source"), F.lit("security.selinux"), F.lit("d" if dst else "s").cast("binary"),
        F.lit("system.posix_acl_access"), F.lit("acl").cast("binary"),
    )
    held = F.map_filter(every, lambda k, v: (F.col("doc_id") % 10 != 2) | (k != "user.lang")) if dst else every
    return d.withColumn("xattrs", F.when(F.col("doc_id") % 10 == 5, F.lit(None)).otherwise(held) if dst else held)


def _pairs(s, d):
    return diff.tree_diff(_xattrs(s, False), _xattrs(d, True))


NO_ACL = SyncOptions(posix_acl=False)
add("D15_copyable_xattrs", lambda s, d: _xattrs(s, False).select("rel_path", F.explode(F.map_keys(diff.copyable_xattrs(F.col("xattrs")))).alias("name"), F.size(diff.copyable_xattrs(F.col("xattrs"), NO_ACL)).alias("without_acl")),
    "SELECT rel_path, unnest(['user.lang', 'user.source', 'system.posix_acl_access']) AS name, 2 AS without_acl FROM xa", "content content_dst", XATTRS)
add("D16_xattrs_equal", lambda s, d: _pairs(s, d).where("in_src and in_dst").select("rel_path", diff.xattrs_equal(F.col("src.xattrs"), F.col("dst.xattrs")).alias("same")),
    "SELECT rel_path, k NOT IN (2, 4) AS same FROM xd", "content content_dst", XATTRS)
add("D17_xattr_delta", lambda s, d: diff.xattr_delta(_pairs(s, d).where("dst.xattrs is not null"), SyncOptions(), ["user.lang"]).select("rel_path", "name", "step", "type"),
    "SELECT rel_path, 'user.lang' AS name, 'skip' AS step, 'FIDELITY_EXCEPTION' AS type FROM xd WHERE k IN (2, 4)", "content content_dst", XATTRS)
