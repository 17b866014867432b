"""Agents and telemetry on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.operators import fleet as fl
from driftline.storage import materialize

R = Registry()
QUERIES, SQL = R.queries, R.sql
c = F.col
NOW = 1_700_000_100_000
EXPIRED = 900_000_000_000


def add(name, tables, run, sql=None, more=""):
    R.add(name, tables, run, sql, more)


add("J14_schedulable", "agents", lambda a: fl.schedulable(a).select("agent_id"), "SELECT agent_id FROM agents WHERE enabled AND connected")
add("J13_stale_probes", "work_items agents", lambda w, a: fl.stale_probes(w, a).select("item_id", "target"), "SELECT item_id, target FROM work_items WHERE kind = 'probe' AND state IN ('QUEUED', 'LEASED') AND target NOT IN (SELECT agent_id FROM agents WHERE enabled AND connected)")
add("J10_covering_mount", "work_items", lambda w: fl.covering_mount(w.select(F.concat(F.lit("/"), c("rel_path")).alias("path")), w.select(F.concat(F.lit("/d"), c("item_id") % 50).alias("mount")).union(w.select(F.lit("/"))).distinct()),
    "SELECT '/' || rel_path AS path, CASE WHEN item_id % 100 < 50 THEN '/d' || item_id % 100 ELSE '/' END AS mount, item_id % 100 < 50 AS live FROM work_items")
add("W16_agent_roster", "agents inflight", lambda a, i: fl.agent_roster(a, i, 3, NOW),
    """SELECT agent_id, host, proto_minor < 3 AS stale, CASE WHEN NOT connected THEN 'disconnected' WHEN enabled THEN 'scheduling' ELSE 'disabled' END AS label, connected, greatest(0, 1700000100000 - heartbeat_ms) AS age_ms,
       (SELECT count(DISTINCT lease_id) FROM inflight i WHERE i.agent_id = agents.agent_id) AS n_inflight FROM agents""")
add("W14_agent_activity", "agents inflight", lambda a, i: fl.agent_activity(a, i),
    """SELECT agent_id, CASE WHEN NOT connected THEN 'disconnected' WHEN proto_minor < 1 THEN 'unsupported' WHEN NOT enabled THEN CASE WHEN b THEN 'draining' ELSE 'drained' END ELSE CASE WHEN b THEN 'active' ELSE 'idle' END END AS activity
       FROM (SELECT *, agent_id IN (SELECT agent_id FROM inflight) AS b FROM agents)""")
add("A27_slot_activity", "inflight", fl.slot_activity, "SELECT agent_id, count(*) FILTER (running AND kind = 'chunk') AS copying, count(*) FILTER (running AND kind <> 'chunk') AS walking FROM inflight GROUP BY agent_id")
add("O2_slowest_inflight", "inflight", lambda i: fl.slowest_inflight(i.groupBy("lease_id").agg(F.max("ts_us").alias("running_ms")), 20).select("lease_id"), "SELECT lease_id FROM (SELECT lease_id, max(ts_us) AS m FROM inflight GROUP BY lease_id ORDER BY m DESC, lease_id LIMIT 20)")
RATES = "d AS (SELECT *, entries - lag(entries) OVER w AS x, ts_us - lag(ts_us) OVER w AS us FROM stats WINDOW w AS (PARTITION BY agent_id ORDER BY ts_us, seq)), rt AS (SELECT *, CASE WHEN x < 0 THEN entries ELSE x END AS delta FROM d WHERE us IS NOT NULL)"
add("W6_counter_rates", "stats", lambda s: fl.counter_rates(s).select("agent_id", "seq", "delta", "us", "rate"), "SELECT agent_id, seq, delta, us, CASE WHEN us > 0 THEN (delta * 1000000)::DOUBLE / us::DOUBLE END AS rate FROM rt", RATES)
add("W6_fleet_rates", "stats", lambda s: fl.fleet_rates(s, 86_400_000_000), "SELECT ts_us - ts_us % 86400000000 AS start_us, sum(delta)::BIGINT AS delta FROM rt GROUP BY 1", RATES)
add("W7_inflight_health", "inflight", lambda i: fl.inflight_health(i).select("seq", "health"),
    """SELECT seq, CASE WHEN NOT running THEN 'queued' WHEN b IS NULL THEN 'new' WHEN entries_done > b THEN 'slow' ELSE 'stuck' END AS health
       FROM (SELECT *, lag(entries_done) OVER (PARTITION BY agent_id, lease_id ORDER BY ts_us, seq) AS b FROM inflight)""")
add("W7_over_granted", "inflight", fl.over_granted, "SELECT agent_id, avg(CASE WHEN running THEN 0.0 ELSE 1.0 END) > 0.5 AS over_granted FROM inflight GROUP BY agent_id")
add("W8_transitions", "work_items", lambda w: fl.transitions(w, ["job_id", "kind"], ["updated_ms", "item_id"]).select("item_id", "was", "state"),
    "SELECT item_id, was, state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id, kind ORDER BY updated_ms, item_id) AS was FROM work_items) WHERE was <> state")
add("W17_lease_gaps", "work_items", lambda w: fl.lease_gaps(w.groupBy(c("holder").alias("agent_id"), c("pass_no").alias("beat")).agg(F.collect_set(c("item_id") % 40 * 3).alias("held")), w).select("agent_id", "lease_id", "beat", "sustained"),
    """SELECT *, coalesce(lag(beat) OVER (PARTITION BY agent_id, lease_id ORDER BY beat) = beat - 1, false) AS sustained FROM (
       SELECT DISTINCT holder AS agent_id, item_id % 40 * 3 AS lease_id, pass_no AS beat FROM work_items) h WHERE NOT EXISTS (SELECT 1 FROM work_items w WHERE w.state = 'LEASED' AND w.holder = h.agent_id AND w.lease_id = h.lease_id)""")
add("A20_expiry_report", "work_items", lambda w: fl.expiry_report(w, EXPIRED), "SELECT holder AS agent, kind, CASE WHEN attempt >= 5 THEN 'parked' ELSE 'requeued' END AS outcome, count(*) AS n FROM work_items WHERE state = 'LEASED' AND lease_expiry_ms < 900000000000 GROUP BY ALL")
add("A20_requeue_rate", "work_items", lambda w: fl.requeue_rate(w, EXPIRED), "SELECT e AS expiries, g AS grants, e::DOUBLE / g::DOUBLE AS rate FROM (SELECT count(*) FILTER (state = 'LEASED' AND lease_expiry_ms < 900000000000) AS e, sum(attempt + 1)::BIGINT AS g FROM work_items)")
EDGES = ", ".join(str(e) for e in fl.DURATION_EDGES)
HIST = f"hs AS (SELECT kind, e AS le, count(*) FILTER (wall_ms <= e * 1000) AS n FROM work_items, unnest([{EDGES}, 'inf'::DOUBLE]) u(e) WHERE wall_ms > 0 GROUP BY ALL)"
add("A15_duration_hist", "work_items", lambda w: fl.duration_hist(w).where("le < 1e300"), "SELECT * FROM hs WHERE le < 1e300", HIST)
add("A16_duration_quantiles", "work_items", lambda w: fl.duration_quantiles(w, accuracy=None), "SELECT kind, quantile_cont(wall_ms / 1000.0::DOUBLE, 0.5) AS p50, quantile_cont(wall_ms / 1000.0::DOUBLE, 0.99) AS p99 FROM work_items WHERE wall_ms > 0 GROUP BY kind")
def _rank_errors(rows, quantiles, by, value, quants):
    """Whether each quantile lies within a hundredth of its rank among all rows of its group."""
    joined = rows.join(quantiles, by)
    ranks = [F.avg(F.when(c(value) < c(f"p{q}"), 1.0).otherwise(0.0)).alias(f"below{q}") for q in quants] + [F.avg(F.when(c(value) <= c(f"p{q}"), 1.0).otherwise(0.0)).alias(f"upto{q}") for q in quants]
    found = joined.groupBy(by).agg(F.count("*").alias("rows"), F.max("n").alias("n"), *ranks)
    return found.select(by, "n", *[((c(f"below{q}") <= q / 100 + 0.01) & (c(f"upto{q}") >= q / 100 - 0.01)).alias(f"p{q}_ok") for q in quants], (c("n") == c("rows")).alias("all_rows"))


def _stored_sketches(df, value, by, part):
    """Sketches per group and part, written and read back before they are merged."""
    return materialize(fl.quantile_sketches(df, value, (by, part)), "sketches")


add("A16_merged_quantiles", "work_items", lambda w: _rank_errors(w.where("wall_ms > 0"), fl.merged_quantiles(_stored_sketches(w.where("wall_ms > 0"), "wall_ms", "kind", "pass_no"), ("kind",)), "kind", "wall_ms", (50, 90, 99)),
    "SELECT kind, count(*) AS n, true AS p50_ok, true AS p90_ok, true AS p99_ok, true AS all_rows FROM work_items WHERE wall_ms > 0 GROUP BY kind")
add("A17_merged_latencies", "op_latency", lambda m: _rank_errors(m, fl.merged_quantiles(_stored_sketches(m, "latency_us", "op", "run"), ("op",)), "op", "latency_us", (50, 90, 99)),
    "SELECT op, count(*) AS n, true AS p50_ok, true AS p90_ok, true AS p99_ok, true AS all_rows FROM op_latency GROUP BY op")
add("A16_bucket_quantile", "work_items", lambda w: fl.bucket_quantile(fl.duration_hist(w), 0.5).select("kind", F.round("value", 6).alias("value")),
    """SELECT kind, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (t * 0.5::DOUBLE - b) / (n - b) END, 6) AS value FROM (
       SELECT *, row_number() OVER (PARTITION BY kind ORDER BY le) AS k FROM (SELECT *, coalesce(lag(n) OVER w, 0) AS b, coalesce(lag(le) OVER w, 0) AS lo, max(n) OVER (PARTITION BY kind) AS t FROM hs WINDOW w AS (PARTITION BY kind ORDER BY le))
       WHERE n >= t * 0.5 AND n > b) WHERE k = 1""", HIST)
add("A17_latency_summary", "op_latency", lambda m: fl.latency_summary(m, accuracy=None).select("op", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), F.round("p99", 6).alias("p99"), "max"),
    'SELECT op, count(*) AS n, round(avg(latency_us), 6) AS mean, round(quantile_cont(latency_us, 0.5), 6) AS p50, round(quantile_cont(latency_us, 0.9), 6) AS p90, round(quantile_cont(latency_us, 0.99), 6) AS p99, max(latency_us) AS "max" FROM op_latency GROUP BY op')
add("A18_hist_merge", "op_latency", lambda m: fl.hist_merge(fl.latency_hist(m, ("op", "run"))).select("op", F.posexplode("buckets").alias("bucket", "n")).where("n > 0"),
    "SELECT op, floor(log2(greatest(latency_us, 1)))::INT AS bucket, count(*) AS n FROM op_latency GROUP BY ALL")
add("A19_scaling", "op_latency", lambda m: fl.scaling(m).select("threads", F.round("per_s", 4).alias("per_s"), F.round("speedup", 6).alias("speedup")),
    "SELECT threads, round(p, 4) AS per_s, round(p / (SELECT count(*) * 1000000.0 / sum(latency_us) FROM op_latency WHERE threads = 1), 6) AS speedup FROM (SELECT threads, count(*) * threads * 1000000.0 / sum(latency_us) AS p FROM op_latency GROUP BY threads)")
add("A19_spread_ratio", "op_latency", lambda m: fl.spread_ratio(m).select(F.round("ratio", 6).alias("ratio")), "SELECT round(avg(latency_us) FILTER (dirs = 0) / avg(latency_us) FILTER (dirs = 1), 6) AS ratio FROM op_latency")
add("A19_ablation", "op_latency", lambda m: fl.ablation(m).select("variant", F.round("speedup", 6).alias("speedup")),
    "SELECT variant, round((SELECT avg(latency_us) FROM op_latency WHERE variant = 'baseline') / avg(latency_us), 6) AS speedup FROM op_latency WHERE variant <> 'baseline' GROUP BY variant")
PARKS = """
pk AS MATERIALIZED (SELECT job_id, item_id, updated_ms AS since, row_number() OVER (PARTITION BY job_id ORDER BY updated_ms NULLS FIRST, item_id) AS rn FROM work_items WHERE state = 'PARKED'),
told AS (WITH RECURSIVE s AS (
   SELECT job_id, rn, item_id, since AS parked_ms, since AS at_ms, since + 2592000000 AS until, false AS held FROM pk WHERE rn = 1
   UNION ALL SELECT job_id, rn, item_id, since, CASE WHEN since > u THEN since ELSE u END, CASE WHEN since > u THEN since + 2592000000 ELSE u END, since <= u
   FROM (SELECT pk.*, CASE WHEN pk.since > s.until AND s.held THEN s.until + 2592000000 ELSE s.until END AS u FROM s JOIN pk ON pk.job_id = s.job_id AND pk.rn = s.rn + 1) z) SELECT * FROM s)"""
_parks = lambda w: w.where("state = 'PARKED'").select("job_id", "item_id", c("updated_ms").alias("parked_ms"))
add("W15_parked_alerts", "work_items", lambda w: fl.parked_alerts(_parks(w), 86_400_000 * 30), "SELECT job_id, at_ms, parked_ms, item_id FROM told", PARKS)
add("W15_parked_digest", "work_items", lambda w: fl.parked_digest(_parks(w), 86_400_000 * 30).select("job_id", "at_ms", F.array_join(c("items").cast("array<string>"), ",").alias("items")),
    "SELECT job_id, at_ms, string_agg(item_id::VARCHAR, ',' ORDER BY parked_ms, item_id) AS items FROM told GROUP BY ALL", PARKS)
