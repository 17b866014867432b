"""Jobs, passes and work items on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.operators import journal as jr
from driftline.operators import ledger as lg
from driftline.options import SyncOptions

R = Registry()
QUERIES, SQL = R.queries, R.sql
c = F.col
NOW = 1_000_000_000_000
SPEC = SyncOptions(delta_files_below=40, delta_bytes_below=500_000_000, max_passes=6)
EFFECTIVE = """
rk AS (SELECT unnest(['PENDING', 'PROBING', 'SCANNING', 'DIRFIX', 'LINKFIX', 'VERIFY', 'DELETE', 'COMPLETE']) AS s, unnest(range(8)) AS r),
pr AS (SELECT job_id, pass_no, max(CASE kind WHEN 'dirfix' THEN 3 WHEN 'verify' THEN 5 ELSE -1 END) AS present FROM work_items GROUP BY ALL),
es AS (SELECT p.*, (SELECT s FROM rk WHERE r = greatest(k.r, coalesce(present, -1))) AS now_state FROM passes p JOIN rk k ON k.s = p.state LEFT JOIN pr USING (job_id, pass_no))"""
CONV = "(files_copied = 0 AND meta_fixed = 0 AND bytes_copied = 0 OR files_copied + meta_fixed < 40 OR bytes_copied < 500000000)"
COUNTS = "ic AS (SELECT job_id, pass_no, kind, state, count(*) AS n FROM work_items GROUP BY ALL)"
REPORT = """
o AS (SELECT job_id, arg_max(CASE WHEN entries_walked > 0 THEN orphans ELSE 0 END, pass_no) AS orphans, bool_or(entries_walked = 0 AND orphans > 0) AS deleted,
   sum(files_copied) AS files_copied, sum(bytes_copied) AS bytes_copied, sum(meta_fixed) AS meta_fixed, sum(errors) AS errors, sum(verify_ok) AS verify_ok, sum(verify_fail) AS verify_fail FROM passes GROUP BY job_id),
pk AS (SELECT job_id, count(*) AS parked FROM work_items WHERE state = 'PARKED' GROUP BY job_id),
rep AS (SELECT job_id, name, state, coalesce(files_copied, 0)::BIGINT AS files_copied, coalesce(bytes_copied, 0)::BIGINT AS bytes_copied, coalesce(meta_fixed, 0)::BIGINT AS meta_fixed, coalesce(errors, 0)::BIGINT AS errors,
   coalesce(verify_ok, 0)::BIGINT AS verify_ok, coalesce(verify_fail, 0)::BIGINT AS verify_fail, state = 'COMPLETED' AS converged, coalesce(orphans, 0)::BIGINT AS orphans_remaining, coalesce(deleted, false) AS delete_pass_ran, coalesce(parked, 0)::BIGINT AS parked
   FROM jobs LEFT JOIN o USING (job_id) LEFT JOIN pk USING (job_id))"""


def add(name, tables, run, sql=None, more=""):
    R.add(name, tables, run, sql, more)


add("P13_jobs_by_phase", "jobs", lambda j: lg.jobs_by_phase(j, "Running").select("name", "state"), "SELECT name, state FROM jobs WHERE state IN ('RUNNING', 'PAUSED')")
add("S11_purge_jobs", "jobs", lambda j: lg.purge_jobs(j, "TERMINAL", 1000, 996_500_000_000 + 1000).select("name"), "SELECT name FROM jobs WHERE state IN ('COMPLETED', 'CANCELLED', 'FAILED') AND updated_ms < 996500000000")
add("S11_purge_children", "jobs passes", lambda j, p: lg.without_jobs(p, lg.purge_jobs(j, "TERMINAL")).select("job_id", "pass_no"), "SELECT job_id, pass_no FROM passes WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE state IN ('COMPLETED', 'CANCELLED', 'FAILED'))")


def _purged(j, p, w):
    """Names of the victims, and rows left in each table after a purge and after a dry run."""
    names, left = lg.purge({"jobs": j, "passes": p, "work_items": w}, "TERMINAL")
    _, same = lg.purge({"jobs": j, "passes": p, "work_items": w}, "TERMINAL", dry_run=True)
    rows = names.select(F.lit("victim").alias("what"), c("name").alias("of"), F.lit(1).cast("long").alias("n"))
    for what, tables in (("left", left), ("dry run", same)):
        for name, table in tables.items():
            rows = rows.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("of"), "n"))
    return rows


add("S11_purge_all", "jobs passes work_items", _purged,
    """SELECT 'victim' AS what, name AS "of", 1 AS n FROM vi UNION ALL SELECT 'left', 'jobs', count(*) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM vi)
       UNION ALL SELECT 'left', 'passes', count(*) FROM passes WHERE job_id NOT IN (SELECT job_id FROM vi) UNION ALL SELECT 'left', 'work_items', count(*) FROM work_items WHERE job_id NOT IN (SELECT job_id FROM vi)
       UNION ALL SELECT 'dry run', 'jobs', count(*) FROM jobs UNION ALL SELECT 'dry run', 'passes', count(*) FROM passes UNION ALL SELECT 'dry run', 'work_items', count(*) FROM work_items""",
    "vi AS (SELECT * FROM jobs WHERE state IN ('COMPLETED', 'CANCELLED', 'FAILED'))")
add("J11_ledger", "work_items passes jobs", lambda w, p, j: lg.ledger(w, p, j).select("item_id", "name", "pass_state", "job_state"),
    "SELECT item_id, name, p.state AS pass_state, j.state AS job_state FROM work_items w JOIN passes p USING (job_id, pass_no) JOIN jobs j USING (job_id)")
add("A2_accumulate", "work_items", lambda w: lg.accumulate(w.withColumn("bytes", c("wall_ms") * 3), ["wall_ms", "bytes"]), "SELECT job_id, pass_no, sum(wall_ms)::BIGINT AS wall_ms, sum(wall_ms * 3)::BIGINT AS bytes FROM work_items GROUP BY ALL")
add("A3_item_counts", "work_items", lg.item_counts, "SELECT * FROM ic", COUNTS)
add("A3_state_counts", "work_items passes", lg.state_counts, "SELECT job_id, pass_no, state, sum(n)::BIGINT AS n FROM (SELECT job_id, pass_no, state, n FROM ic UNION ALL SELECT job_id, pass_no, 'DONE', items_reaped FROM passes WHERE items_reaped > 0) GROUP BY ALL", COUNTS)
SUMMARY = """SELECT name, count(pass_no) AS n_passes, coalesce(sum(files_copied), 0)::BIGINT AS files, coalesce(sum(bytes_copied), 0)::BIGINT AS bytes, coalesce(sum(errors), 0)::BIGINT AS errors,
  coalesce(max(pass_no), 0)::BIGINT AS last_pass, coalesce(arg_max(now_state, pass_no), '') AS last_state, coalesce(arg_max(entries_walked, pass_no), 0)::BIGINT AS walked FROM jobs LEFT JOIN es USING (job_id) GROUP BY name"""
add("A4_job_summaries", "jobs passes work_items", lg.job_summaries, SUMMARY, EFFECTIVE)
add("J12_jobs_latest", "jobs passes work_items", lambda j, p, w: lg.job_summaries(j, p, w).select("name", "last_pass", "last_state"), f"SELECT name, last_pass, last_state FROM ({SUMMARY})", EFFECTIVE)
add("A13_effective_state", "passes work_items", lg.effective_state, "SELECT job_id, pass_no, now_state AS state FROM es", EFFECTIVE)
add("A9_job_report", "jobs passes work_items", lg.job_report, "SELECT * FROM rep", REPORT)
add("S8_report_json", "jobs passes work_items", lambda j, p, w: lg.report_json(lg.job_report(j, p, w), p).select("name", F.get_json_object("document", "$.orphans_remaining").cast("long").alias("orphans"), F.get_json_object("document", "$.passes[0].delta_files").cast("long").alias("first_delta")),
    "SELECT name, orphans_remaining AS orphans, (SELECT arg_min(files_copied + meta_fixed, pass_no) FROM passes p WHERE p.job_id = rep.job_id) AS first_delta FROM rep", REPORT)
add("A10_report_footer", "passes", lg.report_footer, """SELECT pass_no::VARCHAR AS pass, job_id, files_copied, bytes_copied, errors, orphans FROM passes
    UNION ALL SELECT 'TOTAL', job_id, sum(files_copied), sum(bytes_copied), sum(errors), NULL FROM passes GROUP BY job_id""")
add("A28_pass_detail", "passes work_items", lambda p, w: lg.pass_detail(p, w, NOW).select("job_id", "pass_no", "duration_ms", F.explode_outer("states").alias("state", "n")),
    """SELECT p.job_id, p.pass_no, greatest(0, coalesce(finished_ms, 1000000000000) - started_ms) AS duration_ms, s.state, s.n FROM passes p LEFT JOIN
       (SELECT job_id, pass_no, state, sum(n)::BIGINT AS n FROM (SELECT job_id, pass_no, state, n FROM ic UNION ALL SELECT job_id, pass_no, 'DONE', items_reaped FROM passes WHERE items_reaped > 0) GROUP BY ALL) s USING (job_id, pass_no)""", COUNTS)
add("W1_converged", "passes", lambda p: p.select("job_id", "pass_no", lg.converged(SPEC).alias("converged")), f"SELECT job_id, pass_no, {CONV} AS converged FROM passes")
add("W2_stop_decision", "passes", lambda p: lg.stop_decision(p, SPEC), f"SELECT job_id, min(CASE WHEN {CONV} OR pass_no >= 6 THEN pass_no END) AS stop_pass, CASE WHEN min(CASE WHEN {CONV} OR pass_no >= 6 THEN pass_no END) IS NULL THEN 'CONTINUE' ELSE 'COMPLETED' END AS decision FROM passes GROUP BY job_id")
add("W3_trajectory", "passes", lg.trajectory, """SELECT job_id, pass_no, d AS delta_files, d - b AS change, CASE WHEN b > 0 THEN d::DOUBLE / b::DOUBLE END AS ratio
    FROM (SELECT *, lag(d) OVER (PARTITION BY job_id ORDER BY pass_no) AS b FROM (SELECT *, files_copied + meta_fixed AS d FROM passes))""")
add("W4_latest_pass", "passes", lg.latest_pass, "SELECT job_id, max(pass_no) AS pass_no, arg_max(state, pass_no) AS state FROM passes GROUP BY job_id")
add("W4_active_pass", "passes", lg.active_pass, "SELECT job_id, max(pass_no) AS pass_no, arg_max(state, pass_no) AS state FROM passes WHERE state <> 'COMPLETE' GROUP BY job_id")
add("W5_durations", "passes", lambda p: lg.durations(p, NOW), "SELECT job_id, pass_no, greatest(0, coalesce(finished_ms, 1000000000000) - started_ms) AS duration_ms FROM passes")
add("W5_running_time", "jobs", lambda j: lg.running_time(j, NOW), "SELECT job_id, CASE WHEN state = 'RUNNING' THEN greatest(0, 1000000000000 - created_ms) END AS running_ms FROM jobs")
add("W13_job_status", "jobs passes work_items", lambda j, p, w: lg.job_status(lg.job_report(j, p, w)),
    "SELECT name, CASE WHEN parked > 0 THEN 'needs attention' WHEN errors > 0 OR verify_fail > 0 THEN 'with errors' WHEN converged THEN 'converged' ELSE 'completed' END AS status FROM rep", REPORT)
add("W13_pass_status", "passes jobs", lambda p, j: lg.pass_status(p, j, SPEC), f"SELECT job_id, pass_no, CASE WHEN errors > 0 OR verify_fail > 0 THEN 'with errors' WHEN j.state = 'COMPLETED' AND {CONV} THEN 'converged' ELSE 'ok' END AS status FROM passes JOIN jobs j USING (job_id)")
for _when, _states in lg.HELD.items():
    add(f"J9_dest_conflicts_{_when}", "jobs", lambda j, w=_when: lg.dest_conflicts(j, w),
        f"SELECT a.name, b.name AS other FROM jobs a JOIN jobs b ON a.name <> b.name AND b.state IN {_states} AND (starts_with(a.destination || '/', b.destination || '/') OR starts_with(b.destination || '/', a.destination || '/'))")
QUEUE = """q AS (SELECT DISTINCT * FROM (SELECT name, pass_no, kind, ic.state, n FROM ic JOIN passes p USING (job_id, pass_no) JOIN jobs USING (job_id) WHERE p.state <> 'COMPLETE' OR ic.state = 'PARKED'
   UNION ALL SELECT name, pass_no, 'reaped', 'DONE', items_reaped FROM passes p JOIN jobs USING (job_id) WHERE p.state <> 'COMPLETE' AND items_reaped > 0))"""
add("U1_queue_summary", "work_items passes jobs", lg.queue_summary, "SELECT * FROM q", COUNTS + "," + QUEUE)
add("O3_parked", "work_items passes jobs", lambda w, p, j: lg.parked(w, p, j).select("item_id", "name", "kind", "attempt", "error"), "SELECT item_id, name, kind, attempt, error FROM work_items JOIN passes USING (job_id, pass_no) JOIN jobs USING (job_id) WHERE work_items.state = 'PARKED'")
add("U6_retry_parked", "work_items", lambda w: lg.retry_parked(w, job_id=3).select("item_id", "state", "attempt", "holder", "error"),
    """SELECT item_id, CASE WHEN h THEN 'QUEUED' ELSE state END AS state, CASE WHEN h THEN 0 ELSE attempt END AS attempt, CASE WHEN h THEN NULL ELSE holder END AS holder, CASE WHEN h THEN '' ELSE error END AS error
       FROM (SELECT *, state = 'PARKED' AND job_id = 3 AS h FROM work_items)""")
add("U6_drop_parked", "work_items", lambda w: lg.drop_parked(w, job_id=3).groupBy("state").agg(F.count("*").alias("n")), "SELECT state, count(*) AS n FROM work_items WHERE NOT (state = 'PARKED' AND job_id = 3) GROUP BY state")
add("U6_auto_retry", "work_items passes", lambda w, p: lg.auto_retry(w.withColumn("state", F.when(c("state").isin("QUEUED", "LEASED") & (c("pass_no") % 2 == 0), "DONE").otherwise(c("state"))), p.where("verify_fail > 0")),
    "SELECT job_id, pass_no, count(*) FILTER (state = 'PARKED') AS parked FROM work_items WHERE NOT EXISTS (SELECT 1 FROM passes q WHERE q.job_id = work_items.job_id AND q.pass_no = work_items.pass_no AND q.verify_fail > 0) GROUP BY job_id, pass_no HAVING count(*) FILTER (state IN ('QUEUED', 'LEASED') AND pass_no % 2 <> 0) = 0 AND count(*) FILTER (state = 'PARKED') > 0")
add("A24_compact_items", "work_items", lambda w: lg.compact_items(w, ["dir", "entrylist"])[1], "SELECT job_id, pass_no, count(*) AS items_reaped FROM work_items WHERE state = 'DONE' AND kind IN ('dir', 'entrylist') GROUP BY ALL")
add("A24_remaining_items", "work_items", lambda w: lg.compact_items(w, ["dir", "entrylist"])[0].select("item_id"), "SELECT item_id FROM work_items WHERE NOT (state = 'DONE' AND kind IN ('dir', 'entrylist'))")
add("J16_effective_results", "work_items", lambda w: lg.effective_results(w.unionByName(w).select("item_id", (c("lease_id") + F.when(c("item_id") % 4 == 0, 1).otherwise(0)).alias("lease_id")), w),
    "SELECT item_id, lease_id FROM work_items WHERE state = 'LEASED' AND item_id % 4 <> 0")
add("A14_fleet_load", "work_items passes jobs", lg.fleet_load, "SELECT count(*) FILTER (kind IN ('dir', 'entrylist') AND w.state IN ('QUEUED', 'LEASED')) AS walk_pending, count(*) FILTER (w.state = 'QUEUED') AS queued FROM work_items w JOIN jobs j USING (job_id) WHERE j.state = 'RUNNING'")
add("A21_value_counts", "work_items", lambda w: lg.value_counts(w, "kind"), "SELECT kind AS value, count(*) AS n FROM work_items GROUP BY kind")
add("A21_table_counts", "jobs passes work_items", lambda j, p, w: lg.table_counts({"jobs": j, "passes": p, "work_items": w}), "SELECT 'jobs' AS name, count(*) AS n FROM jobs UNION ALL SELECT 'passes', count(*) FROM passes UNION ALL SELECT 'work_items', count(*) FROM work_items")
add("A9_report_with_journal", "jobs passes work_items journal", lambda j, p, w, n: lg.job_report(j, p, w, jr.type_counts(n)).select("name", F.coalesce("journal_total", F.lit(0)).alias("journal_total")),
    "SELECT name, coalesce(n, 0)::BIGINT AS journal_total FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, pass_no, type, rel_path FROM journal) GROUP BY job_id) USING (job_id)")
