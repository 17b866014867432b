"""Streams over the derived tables, replayed from their files to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.checks.base import Registry
from driftline.checks.diff import PAIRS
from driftline.checks.fleet import PARKS
from driftline.plans.passes import incremental_passes, pass_history, run_passes
from driftline.sources.journal import journal_sink, read_once
from driftline.sources.snapshots import read_snapshot, write_base
from driftline.storage import shared_folder
from driftline.streaming import streams

R = Registry()
QUERIES, SQL = R.queries, R.sql
c = F.col
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _base(df):
    return f"{shared_folder(df.sparkSession)}/driftline/stream-{uuid.uuid4().hex}"


def _replayed(df, build, mode="append", arrivals=None):
    """All rows that build(stream) emits when df's rows arrive as one set of files; or in so many
    sets as `arrivals` has conditions, each by a query that goes on from the checkpoint of the one before.
    """
    spark, base = df.sparkSession, _base(df)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for n, due in enumerate(arrivals or [F.lit(True)]):
        df.where(due).write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))

        def keep(batch, k, n=n):
            batch.write.mode("overwrite").parquet(f"{base}/out/run={n}/batch={k}" if mode == "append" else f"{base}/out/run=0/batch=0")

        out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def _shuffled(n, *keys):
    """Conditions of n arrivals that deal out rows without regard to their time."""
    return [F.pmod(F.hash(*keys), F.lit(n)) == k for k in range(n)]


def _timed(df, us):
    return df.withColumn("ts", F.timestamp_micros(us))


def _twice(j):
    return _timed(j.withColumn("copy", F.explode(F.when(c("seq") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))), (c("ts_ns") / 1000).cast("long")).select("job_id", "pass_no", "agent_id", "seq", "place", "record_count", "event_id", "type", "rel_path", "ts", "copy")


def _sunk(j):
    """The journal through the exactly-once sink: four arrivals without regard to order, replays in others than the first copies."""
    spark, base = j.sparkSession, _base(j)
    rows = _twice(j).withColumn("due", F.pmod(F.hash("agent_id", "seq") + c("copy"), F.lit(4)))
    for n in range(4):
        rows.where(c("due") == n).drop("due", "copy").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.drop("due", "copy").schema).parquet(f"{base}/in")
        stream.writeStream.foreachBatch(journal_sink(f"{base}/journal")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return read_once(spark, f"{base}/journal").select("job_id", "pass_no", "agent_id", "seq", "place", "event_id", "type")


R.add("T1_ingest_journal", "journal", lambda j: _replayed(_twice(j), lambda x: streams.ingest_journal(x, "60 days"), arrivals=_shuffled(4, "seq", "copy")).select("job_id", "pass_no", "agent_id", "seq", "place", "event_id", "type"), "SELECT job_id, pass_no, agent_id, seq, place, event_id, type FROM journal")
R.add("T1_journal_sink", "journal", _sunk, "SELECT job_id, pass_no, agent_id, seq, place, event_id, type FROM journal")
R.add("T2_live_counters", "journal", lambda j: _replayed(j.select("job_id", "pass_no", "type"), streams.live_counters, "complete"), "SELECT job_id, pass_no, type, count(*) AS n FROM journal GROUP BY ALL")
R.add("T3_stream_rates", "stats", lambda s: _replayed(_timed(s, c("ts_us")), lambda x: streams.stream_rates(x, "6 hours")).select(F.unix_micros("start").alias("start_us"), "agent_id", "delta"),
    """SELECT start_us, agent_id, delta FROM (SELECT ts_us // 21600000000 * 21600000000 AS start_us, agent_id, max(entries) - min(entries) AS delta FROM stats GROUP BY ALL)
       WHERE start_us + 21600000000 <= (SELECT max(ts_us) - 600000000 FROM stats)""")
def _flushed(df, key, us, at_us):
    """df with one more row far ahead of all others, under a key of its own, so that the watermark passes them; it comes with the last arrival."""
    end = df.agg((F.max(us) + at_us).alias(us)).withColumn(key, F.lit(None).cast(df.schema[key].dataType))
    return df.unionByName(end, allowMissingColumns=True)


def _late(build, key, order):
    """Rows dealt over four arrivals without regard to their times, and the row that ends the stream after them."""
    def run(rows):
        ends = c(key).isNull()
        return _replayed(rows, build, arrivals=[*[~ends & due for due in _shuffled(4, *order)], ends]).where(c(key).isNotNull())
    return run


_states = lambda i: _timed(i, c("seq")).select(c("agent_id").alias("key"), "ts", F.when(c("running"), c("kind")).otherwise("idle").alias("state"))
def _seconds(i):
    """Samples one second apart in the order of seq, and the end. The first stands at second 1: a stream's watermark begins at 0."""
    return _timed(_flushed(i.withColumn("us", (c("seq") + 1) * 1_000_000), "agent_id", "us", 400 * 86_400_000_000), c("us"))


_transitions_in = lambda i: _seconds(i).select(c("agent_id").alias("key"), "ts", F.when(c("running"), c("kind")).otherwise("idle").alias("state"))
R.add("T4_stream_transitions", "inflight", lambda i: _late(lambda x: streams.stream_transitions(x, "300 days"), "key", ["ts"])(_transitions_in(i)).select("key", (F.unix_micros("ts") / 1_000_000 - 1).cast("long").alias("seq"), "was", "state"),
    """SELECT agent_id AS key, seq, was, state FROM (SELECT *, lag(state) OVER (PARTITION BY agent_id ORDER BY seq) AS was FROM
       (SELECT *, CASE WHEN running THEN kind ELSE 'idle' END AS state FROM inflight)) WHERE was <> state""")
R.add("T4_stats_events", "inflight", lambda i: _replayed(_states(i), lambda x: streams.stats_events(x, "1 millisecond", ("dir", "chunk"), "0 seconds")).select("key", F.unix_micros("tick").alias("tick_us"), "state"),
    """SELECT agent_id AS key, (tick + 1) * 1000 AS tick_us, state FROM (SELECT agent_id, seq // 1000 AS tick, arg_max(CASE WHEN running THEN kind ELSE 'idle' END, seq) AS state FROM inflight GROUP BY ALL)
       WHERE state <> 'idle' AND (tick + 1) * 1000 <= (SELECT max(seq) // 1000 * 1000 FROM inflight)""")
R.add("T5_agent_sessions", "inflight", lambda i: _replayed(_timed(i, c("ts_us")).select("agent_id", "ts", F.array("lease_id").alias("held")), lambda x: streams.agent_sessions(x, "20 minutes")).select("agent_id", F.unix_micros("start").alias("start_us"), "beats"),
    """SELECT agent_id, min(ts_us) AS start_us, count(*) AS beats FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
         FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY agent_id ORDER BY ts_us, seq) AS gap FROM inflight)) GROUP BY agent_id, session
       HAVING max(ts_us) + 1200000000 <= (SELECT max(ts_us) - 60000000 FROM inflight)""")
_parked = lambda w: _timed(_flushed(w.where("state = 'PARKED'").select(c("job_id").cast("long").alias("job_id"), c("item_id").cast("long").alias("item_id"), (c("updated_ms") * 1000).alias("us")), "job_id", "us", 4000 * 86_400_000_000).fillna(0, ["item_id"]), c("us"))
R.add("T6_parked_digest", "work_items", lambda w: _late(lambda x: streams.stream_parked_digest(x, 86_400_000 * 30, "3900 days"), "job_id", ["item_id"])(_parked(w).select("job_id", "item_id", "ts")).select("job_id", "at_ms", F.array_join(c("items").cast("array<string>"), ",").alias("items")),
    "SELECT job_id, at_ms, string_agg(item_id::VARCHAR, ',' ORDER BY parked_ms, item_id) AS items FROM told GROUP BY ALL", PARKS)
R.add("T7_inflight_health", "inflight", lambda i: _late(lambda x: streams.stream_inflight_health(x, "300 days"), "lease_id", ["ts"])(_seconds(i).withColumn("lease_id", F.when(c("agent_id").isNotNull(), c("lease_id"))).select("lease_id", "ts", F.coalesce("running", F.lit(False)).alias("running"), F.coalesce("entries_done", F.lit(0)).alias("entries_done")))
    .select("lease_id", (F.unix_micros("ts") / 1_000_000 - 1).cast("long").alias("seq"), "health"),
    """SELECT lease_id, seq, CASE WHEN NOT running THEN 'queued' WHEN was IS NULL THEN 'new' WHEN entries_done > was THEN 'slow' ELSE 'stuck' END AS health
       FROM (SELECT *, lag(entries_done) OVER (PARTITION BY lease_id ORDER BY seq) AS was FROM inflight)""")
R.add("T9_event_feed", "journal", lambda j: _replayed(j, lambda x: streams.event_feed(x, 2)).select("event_id", "type"), "SELECT event_id, type FROM journal WHERE job_id = 2")


def _upserted(j):
    base, keys = _base(j), ["job_id", "rel_path"]
    rows = j.select(*keys, "event_id", "type")
    write = streams.upsert_by_key(base, keys, "event_id", compact_every=2)
    for n in range(5):
        write(rows.where(F.pmod(F.hash("event_id"), F.lit(5)) == n), n)
    return streams.read_upserts(j.sparkSession, base, keys, "event_id")


R.add("T8_upsert_by_key", "journal", _upserted, "SELECT job_id, rel_path, max(event_id) AS event_id, arg_max(type, event_id) AS type FROM journal GROUP BY ALL")


def _passes(s, d):
    done = run_passes(s.sparkSession, lambda n: s, d, _base(s))
    keep = ("pass_no", "files_copied", "bytes_copied", "meta_fixed", "converged")
    return s.sparkSession.createDataFrame([tuple(r[k] for k in keep) for r in done], "pass_no int, files_copied bigint, bytes_copied bigint, meta_fixed bigint, converged boolean")  # a row per pass


R.add("T10_run_passes", "src dst", _passes,
    """SELECT 1 AS pass_no, count(*) FILTER (action IN ('COPY', 'SYMLINK', 'SPECIAL')) AS files_copied, coalesce(sum(ss) FILTER (action = 'COPY'), 0)::BIGINT AS bytes_copied, count(*) FILTER (action = 'META_FIX') AS meta_fixed, false AS converged FROM pl
       UNION ALL SELECT 2, 0, 0, 0, true""", PAIRS)


def _incremental(s, d):
    """The source in three arrivals, directories first, against the destination as a base; the path of the passes."""
    spark, base = s.sparkSession, _base(s)
    write_base(d, f"{base}/dst", buckets=8)
    due = F.when(c("type") == "DIR", 0).otherwise(F.pmod(c("ino"), F.lit(3)))
    for n in range(3):
        arrived = s.where(due == n).withColumn("removed", F.lit(False))
        arrived.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{base}/in")
        incremental_passes(stream, base, buckets=8).start().awaitTermination()
    return base


def _incremental_counters(s, d):
    counters = pass_history(s.sparkSession, _incremental(s, d))
    return counters.select("pass_no", "files_copied", "bytes_copied", "meta_fixed", "clean", "dirs")


DUE = "due AS (SELECT pl.*, CASE WHEN st = 'DIR' THEN 0 ELSE coalesce(s.ino, 0) % 3 END + 1 AS pass_no FROM pl JOIN src s USING (rel_path))"
R.add("T10_incremental_counters", "src dst", _incremental_counters,
    """SELECT pass_no, count(*) FILTER (action IN ('COPY', 'SYMLINK', 'SPECIAL')) AS files_copied, coalesce(sum(ss) FILTER (action = 'COPY'), 0)::BIGINT AS bytes_copied, count(*) FILTER (action = 'META_FIX') AS meta_fixed,
         count(*) FILTER (action = 'CLEAN') AS clean, count(*) FILTER (action IN ('DIR', 'MKDIR')) AS dirs FROM due GROUP BY pass_no""", f"{PAIRS}, {DUE}")
R.add("T10_incremental_snapshot", "src dst", lambda s, d: read_snapshot(s.sparkSession, f"{_incremental(s, d)}/dst").where("rel_path not like '%.sync.stale.%'").select("rel_path", "type", "size", "mtime_ns", "mode", "uid"),
    """SELECT rel_path, CASE WHEN has_s THEN st ELSE dt END AS type, CASE WHEN action IN ('CLEAN', 'DST_ONLY') THEN ds ELSE ss END AS size, CASE WHEN action IN ('CLEAN', 'DST_ONLY') THEN dn ELSE sn END AS mtime_ns,
         CASE WHEN action IN ('CLEAN', 'DST_ONLY') THEN dm ELSE sm END AS mode, CASE WHEN action IN ('CLEAN', 'DST_ONLY') THEN du ELSE su END AS uid FROM pl WHERE rel_path NOT IN (SELECT rel_path FROM moved)""", PAIRS)
