"""Agents, leases and telemetry: rosters, rates, latencies, transitions, digests."""

from __future__ import annotations

from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftline.operators.slices import SLICES, bounds, lagged, upheld, with_slice
from driftline.shipping import map_in_arrow

ATTEMPT_CAP = 5
#: Edges in seconds of the duration histogram, 0.1 * 3^i for i < 12.
DURATION_EDGES = tuple(round(0.1 * 3**i, 4) for i in range(12))
LATENCY_BUCKETS = 32


def schedulable(agents: DataFrame) -> DataFrame:
    return agents.where("enabled and connected").orderBy("agent_id")


def stale_probes(items: DataFrame, agents: DataFrame) -> DataFrame:
    """Probe items that wait for an agent that is not connected and enabled."""
    waiting = items.where("kind = 'probe' and state in ('QUEUED', 'LEASED') and target is not null and target <> ''")
    return waiting.join(agents.where("enabled and connected").select(F.col("agent_id").alias("target")), "target", "left_anti")


def covering_mount(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """path, mount (the longest that contains it), live: whether that is another than the root. paths: path; mounts: mount."""
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    keys = paths.select("path", F.explode(above).alias("mount"))
    hit = keys.join(mounts.select("mount").distinct(), "mount").groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    return paths.join(hit, "path", "left").select("path", "mount", (F.col("mount") != "/").alias("live"))


def agent_roster(agents: DataFrame, inflight: DataFrame, proto_minor: int, now_ms: int) -> DataFrame:
    """Agents with in-flight items, staleness, scheduling label and age of the last heartbeat."""
    n = inflight.groupBy("agent_id").agg(F.countDistinct("lease_id").alias("n_inflight"))
    label = F.when(~F.col("connected"), "disconnected").when(F.col("enabled"), "scheduling").otherwise("disabled")
    return agents.join(n, "agent_id", "left").select(
        "agent_id", "host", (F.col("proto_minor") < proto_minor).alias("stale"), label.alias("label"), "connected",
        F.greatest(F.lit(0), F.lit(now_ms) - F.col("heartbeat_ms")).alias("age_ms"), F.coalesce("n_inflight", F.lit(0)).alias("n_inflight"),
    )


def agent_activity(agents: DataFrame, inflight: DataFrame, reports_from: int = 1) -> DataFrame:
    """agent_id, activity: disconnected, unsupported (too old to report), active, idle, draining or drained."""
    n = inflight.groupBy("agent_id").agg(F.count("*").alias("n"))
    busy = F.coalesce("n", F.lit(0)) > 0
    state = (
        F.when(~F.col("connected"), "disconnected").when(F.col("proto_minor") < reports_from, "unsupported")
        .when(~F.col("enabled"), F.when(busy, "draining").otherwise("drained")).otherwise(F.when(busy, "active").otherwise("idle"))
    )
    return agents.join(n, "agent_id", "left").select("agent_id", state.alias("activity"))


def slot_activity(inflight: DataFrame) -> DataFrame:
    """Running items per agent: chunks copy, all others walk."""
    count = lambda c: F.sum(F.when(F.col("running") & c, 1).otherwise(0)).cast("long")
    return inflight.groupBy("agent_id").agg(count(F.col("kind") == "chunk").alias("copying"), count(F.col("kind") != "chunk").alias("walking"))


def slowest_inflight(inflight: DataFrame, n: int, order: str = "running_ms") -> DataFrame:
    return inflight.orderBy(F.col(order).desc(), "lease_id").limit(n)


def counter_rates(stats: DataFrame, value: str = "entries", slices: int = SLICES) -> DataFrame:
    """agent_id, ts_us, delta, seconds, rate from cumulative counters; after a reset the new value is the delta. An agent's rows are spread over slices of time."""
    rows = lagged(stats.select("agent_id", "ts_us", "seq", value), ["agent_id"], ["ts_us", "seq"], {"before": value, "ts_before": "ts_us"}, slices)
    rows = rows.withColumn("d", F.col(value) - F.col("before")).withColumn("us", F.col("ts_us") - F.col("ts_before")).where("us is not null")
    delta = F.when(F.col("d") < 0, F.col(value)).otherwise(F.col("d"))
    return rows.select("agent_id", "ts_us", "seq", delta.alias("delta"), "us", F.when(F.col("us") > 0, delta * 1_000_000 / F.col("us")).alias("rate"))


def fleet_rates(stats: DataFrame, window_us: int, value: str = "entries") -> DataFrame:
    """Deltas of all agents summed per window."""
    rates = counter_rates(stats, value)
    start = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(window_us))
    return rates.groupBy(start.alias("start_us")).agg(F.sum("delta").alias("delta"))


def inflight_health(samples: DataFrame) -> DataFrame:
    """agent_id, lease_id, ts_us, health: queued, slow (entries grow), stuck (they do not), new."""
    w = Window.partitionBy("agent_id", "lease_id").orderBy("ts_us", "seq")
    before = F.lag("entries_done").over(w)
    health = F.when(~F.col("running"), "queued").when(before.isNull(), "new").when(F.col("entries_done") > before, "slow").otherwise("stuck")
    return samples.select("agent_id", "lease_id", "ts_us", "seq", health.alias("health"))


def over_granted(samples: DataFrame) -> DataFrame:
    """Agents most of whose items wait."""
    return samples.groupBy("agent_id").agg((F.avg(F.when(F.col("running"), 0.0).otherwise(1.0)) > 0.5).alias("over_granted"))


def transitions(snapshots: DataFrame, key: list[str], order: list[str], state: str = "state", silent_first: tuple[str, ...] = (), slices: int = SLICES) -> DataFrame:
    """Rows where the state of a key differs from its previous one, with the previous as `was`. The first row of a key is silent.

    A key's rows are spread over slices of the first column of `order`, which is a number, a day or a time.
    """
    rows = lagged(snapshots, key, order, {"was": state}, slices).where(f"was is not null and was <> {state}")
    return rows.where(~F.col("was").isin(*silent_first)) if silent_first else rows


def lease_gaps(heartbeats: DataFrame, items: DataFrame) -> DataFrame:
    """agent_id, lease_id, beat, sustained: leases an agent reports that are not its own any more;
    sustained if the beat before had the same gap. heartbeats: agent_id, beat, held (array).
    """
    own = items.where("state = 'LEASED'").select(F.col("holder").alias("agent_id"), "lease_id")
    gaps = heartbeats.select("agent_id", "beat", F.explode("held").alias("lease_id")).join(own, ["agent_id", "lease_id"], "left_anti")
    w = Window.partitionBy("agent_id", "lease_id").orderBy("beat")
    return gaps.withColumn("sustained", F.coalesce(F.lag("beat").over(w) == F.col("beat") - 1, F.lit(False)))


def expiry_report(items: DataFrame, now_ms: int) -> DataFrame:
    """Expired leases by agent, kind and outcome: parked at the cap of attempts, else requeued."""
    gone = items.where(F.col("state") == "LEASED").where(F.col("lease_expiry_ms") < now_ms)
    outcome = F.when(F.col("attempt") >= ATTEMPT_CAP, "parked").otherwise("requeued")
    agent = F.when(F.coalesce("holder", F.lit("")) == "", "unknown").otherwise(F.col("holder"))
    return gone.groupBy(agent.alias("agent"), "kind", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def requeue_rate(items: DataFrame, now_ms: int) -> DataFrame:
    """Expiries over grants (attempts begun) of the fleet."""
    expired = (F.col("state") == "LEASED") & (F.col("lease_expiry_ms") < now_ms)
    return items.agg(F.sum(F.when(expired, 1).otherwise(0)).alias("expiries"), F.sum(F.col("attempt") + 1).alias("grants")).select(
        "expiries", "grants", F.when(F.col("grants") > 0, F.col("expiries") / F.col("grants")).alias("rate")
    )


def duration_hist(results: DataFrame) -> DataFrame:
    """kind, le (seconds), n: cumulative counts of successes that took time."""
    done = results.where("wall_ms > 0").groupBy("kind").agg(*[F.sum(F.when(F.col("wall_ms") <= e * 1000, 1).otherwise(0)).alias(f"b{i}") for i, e in enumerate(DURATION_EDGES)], F.count("*").alias("all"))
    edges = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").cast("long").alias("n")) for i, e in enumerate(DURATION_EDGES)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return done.select("kind", F.explode(edges).alias("e")).select("kind", "e.le", "e.n")


def _quantile(value: Column, q: float, accuracy: int | None) -> Column:
    """Within 1 / accuracy of the rank, in bounded memory; None for the exact one, which holds every distinct value of a group."""
    return F.percentile(value, q) if accuracy is None else F.percentile_approx(value, q, accuracy)


def duration_quantiles(results: DataFrame, quantiles=(0.5, 0.99), accuracy: int | None = 10_000) -> DataFrame:
    """Quantiles of seconds per kind."""
    return results.where("wall_ms > 0").groupBy("kind").agg(*[_quantile(F.col("wall_ms") / 1000, q, accuracy).alias(f"p{round(q * 100)}") for q in quantiles])


def quantile_sketches(measured: DataFrame, value: str, by: tuple[str, ...], k: int = 400) -> DataFrame:
    """One KLL sketch of a whole-number column per group (column sketch), of a size that k bounds. Sketches of passes, days or agents are stored and merged."""
    return measured.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: tuple[str, ...], quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """n and the quantiles of all that went into the sketches of a group; the rank of each is within about 2 / k."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    return merged.select(*by, F.kll_sketch_get_n_bigint("s").alias("n"), *[F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles])


def bucket_quantile(hist: DataFrame, q: float) -> DataFrame:
    """kind, value: the quantile by linear interpolation within its bucket; in the open bucket, its lower edge."""
    w = Window.partitionBy("kind").orderBy("le")
    rows = hist.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("lower", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    rows = rows.withColumn("rank", F.max("n").over(Window.partitionBy("kind")) * q).where((F.col("n") >= F.col("rank")) & (F.col("n") > F.col("below")))
    first = rows.groupBy("kind").agg(F.min_by(F.struct("le", "lower", "n", "below", "rank"), "le").alias("r")).select("kind", "r.*")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return first.select("kind", F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside).alias("value"))


def latency_summary(measured: DataFrame, by: tuple[str, ...] = ("op",), accuracy: int | None = 10_000) -> DataFrame:
    q = [_quantile(F.col("latency_us"), p, accuracy).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)]
    return measured.groupBy(*by).agg(F.count("*").alias("n"), F.avg("latency_us").alias("mean"), *q, F.max("latency_us").alias("max"))


def latency_bucket(us: Column) -> Column:
    """Power of two at or below the microseconds, 0 to 31."""
    return F.least(F.lit(LATENCY_BUCKETS - 1), F.length(F.conv(F.greatest(us, F.lit(1)).cast("string"), 10, 2)) - 1)


def latency_hist(measured: DataFrame, by: tuple[str, ...] = ("op",)) -> DataFrame:
    """An array of 32 counts per key."""
    b = measured.withColumn("b", latency_bucket(F.col("latency_us")))
    return b.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("b") == i, 1).otherwise(0)).cast("long") for i in range(LATENCY_BUCKETS)]).alias("buckets"))


def hist_merge(hists: DataFrame, by: tuple[str, ...] = ("op",)) -> DataFrame:
    """Bucket arrays summed place by place."""
    rows = hists.select(*by, F.posexplode("buckets").alias("pos", "n")).groupBy(*by, "pos").agg(F.sum("n").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "n")))
    return rows.groupBy(*by).agg(packed.alias("p")).select(*by, F.transform("p", lambda x: x["n"]).alias("buckets"))


def scaling(measured: DataFrame) -> DataFrame:
    """threads, per_s (operations a second of busy time times threads), speed-up over one thread."""
    m = measured.groupBy("threads").agg((F.count("*") * F.col("threads") * 1_000_000.0 / F.sum("latency_us")).alias("per_s"))
    one = m.where("threads = 1").select("per_s").scalar()
    return m.select("threads", "per_s", (F.col("per_s") / one).alias("speedup"))


def spread_ratio(measured: DataFrame) -> DataFrame:
    """How much faster many directories are than one (dirs 1: many, 0: one)."""
    mean = lambda d: F.avg(F.when(F.col("dirs") == d, F.col("latency_us")))
    return measured.agg((mean(0) / mean(1)).alias("ratio"))


def ablation(measured: DataFrame) -> DataFrame:
    """Speed-up of each variant over the baseline."""
    m = measured.groupBy("variant").agg(F.avg("latency_us").alias("mean"))
    base = m.where("variant = 'baseline'").select("mean").scalar()
    return m.where("variant <> 'baseline'").select("variant", (base / F.col("mean")).alias("speedup"))


def digest_steps(parks, rollup_ms: int, until: int | None = None):
    """(at_ms, at, item) of a job's parks (at, item) in order, each with the time of its alert; keeps the end of the open window only."""
    held = False  # whether a park waits for `until`
    for at, item in parks:
        if at is None:  # first in order: told at once, opens nothing
            yield at, at, item
            continue
        if until is not None and at > until and held:
            until, held = until + rollup_ms, False
        if until is None or at > until:
            until = at + rollup_ms
            yield at, at, item
        else:
            held = True
            yield until, at, item


def digest_starts(gaps, rollup_ms: int):
    """Times of the alerts that open a chain of rollups in a job. gaps, in order: (the park before or None, how many parks it has, park), more than a rollup apart.

    Parks that are nearer never end a chain, so gaps are all it takes: at most a job's time over the rollup.
    """
    start = None
    for before, n, at in gaps:
        if start is not None:
            told = start if before == start and n == 1 else start + max(1, -(-(before - start) // rollup_ms)) * rollup_ms
            if at <= told + rollup_ms:
                continue
        start = at
        yield at


def parked_alerts(parks: DataFrame, rollup_ms: int = 300_000, slices: int = SLICES) -> DataFrame:
    """job_id, at_ms, parked_ms, item_id: one row per park, with the time of the alert that tells of it; parks as in parked_digest().

    Within a chain of rollups the time of an alert is arithmetic; chains begin at some of the
    gaps longer than a rollup, which alone are followed one by one. A job's parks are spread over slices of time.
    """
    rows = parks.select("job_id", F.col("parked_ms").cast("long").alias("at"), F.col("item_id").cast("long").alias("item"))
    timed = rows.where("at is not null")
    times = timed.groupBy("job_id", "at").agg(F.count("*").alias("n"))
    gaps = lagged(times, ["job_id"], ["at"], {"before": "at", "many": "n"}, slices).where(F.col("before").isNull() | (F.col("at") - F.col("before") > rollup_ms))
    gaps = gaps.select("job_id", "before", "many", "at").repartition("job_id").sortWithinPartitions("job_id", "at")

    def run(batches):
        found = ((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        begun = ((job, at) for job, own in groupby(found, key=lambda r: r[0]) for at in digest_starts((r[1] for r in own), rollup_ms))
        while part := list(islice(begun, 10_000)):
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("job_id", "start"), zip(*part, strict=True), (kind, pa.int64()), strict=True)})

    job = gaps.schema["job_id"].dataType
    kind = to_arrow_type(job)
    cuts = bounds(times, "at", slices)
    starts = upheld(map_in_arrow(gaps, run, f"job_id {job.simpleString()}, start bigint"), "job_id", "start", cuts, slices)
    own = with_slice(timed, "at", cuts).withColumn("own", F.lit(True))
    both = own.unionByName(starts.select("job_id", F.col("start").alias("at"), "_slice", "start", F.lit(False).alias("own")), allowMissingColumns=True)
    w = Window.partitionBy("job_id", "_slice").orderBy("at", "own", "item")
    both = both.withColumn("opens", ~F.lag("own").over(w)).withColumn("start", F.last("start", ignorenulls=True).over(w)).where("own")
    rollups = F.greatest(F.lit(1), F.expr(f"(at - start + {rollup_ms - 1}) div {rollup_ms}"))
    told = F.when((F.col("at") == F.col("start")) & F.col("opens"), F.col("at")).otherwise(F.col("start") + rollups * rollup_ms)
    at_once = rows.where("at is null").select("job_id", F.col("at").alias("at_ms"), F.col("at").alias("parked_ms"), F.col("item").alias("item_id"))
    return both.select("job_id", told.alias("at_ms"), F.col("at").alias("parked_ms"), F.col("item").alias("item_id")).unionByName(at_once)


def parked_digest(parks: DataFrame, rollup_ms: int = 300_000) -> DataFrame:
    """job_id, at_ms, items: alerts about parked items. parks: job_id, item_id, parked_ms, ended_ms (null while parked).

    The first park of a job alerts at once and opens a rollup; parks until it elapses are sent
    together when it does, which opens the next one. An array holds the parks of one alert only.
    """
    told = parked_alerts(parks, rollup_ms).groupBy("job_id", "at_ms").agg(F.array_sort(F.collect_list(F.struct("parked_ms", "item_id"))).alias("parks"))
    return told.select("job_id", "at_ms", F.transform("parks", lambda p: p["item_id"]).alias("items"))
