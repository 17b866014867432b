"""The journal and the fleet's telemetry as streams.

Joins and aggregates are those of the batch form; only transitions, digests and stuck items
need state of their own, kept per key with event-time timers where something must happen later.
They hold a key's rows until the watermark has passed them, so late rows of later micro-batches find their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.shipping import ship
from driftline.sources.journal import IDENTITY
from driftline.storage import complete_numbers, remove


def ingest_journal(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records once each: replays carry the same job, pass, agent, seq and place in the batch. sources.journal.journal_sink() needs no bound of time."""
    lacking = [c for c in IDENTITY if c not in stream.columns]
    if lacking:
        raise ValueError(f"journal records need {', '.join(IDENTITY)}; there is no {', '.join(lacking)}")
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(IDENTITY))


def live_counters(stream: DataFrame) -> DataFrame:
    """Records by job, pass and type; for update mode."""
    return stream.groupBy("job_id", "pass_no", "type").agg(F.count("*").alias("n"))


def stream_rates(stream: DataFrame, window: str = "5 minutes", slide: str | None = None, value: str = "entries", late: str = "10 minutes") -> DataFrame:
    """Rise of each agent's counter per window (largest less smallest); late rows are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    risen = (F.max(value) - F.min(value)).alias("delta")
    return stream.withWatermark("ts", late).groupBy(w.alias("window"), "agent_id").agg(risen).select("window.start", "window.end", "agent_id", "delta")


def agent_sessions(stream: DataFrame, ttl: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of heartbeats: one ends when none comes for ttl; leases of its last heartbeat are at risk."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("s"), "agent_id")
    return grouped.agg(F.count("*").alias("beats"), F.max_by("held", "ts").alias("at_risk")).select("s.start", "s.end", "agent_id", "beats", "at_risk")


def event_feed(stream: DataFrame, job_id: int) -> DataFrame:
    return stream.where(F.col("job_id") == job_id)


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def read_upserts(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The newest row per key over the last base and the batches written since."""
    bases = complete_numbers(spark, f"{path}/base")
    base = bases[-1] if bases else -1
    parts = [f"{path}/base/n={base}"] * bool(bases) + [f"{path}/batch/n={n}" for n in complete_numbers(spark, f"{path}/batch") if n > base]
    return _newest(spark.read.parquet(*parts), keys, order)


def upsert_by_key(path: str, keys: list[str], order: str, compact_every: int = 20):
    """For foreachBatch: the newest row per key. Every event is a whole state, so lost and late ones do no harm.

    A batch writes its own rows only, under its number, so one that is run again replaces itself.
    Every compact_every batches what there is becomes a new base, and what the base before it
    was made of goes; readers of read_upserts() find the last base and two rounds of batches at most.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch/n={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        before = [n for n in complete_numbers(spark, f"{path}/base") if n < batch_id]
        read_upserts(spark, path, keys, order).write.mode("overwrite").parquet(f"{path}/base/n={batch_id}")
        for n in before[:-1]:
            remove(spark, f"{path}/base/n={n}")
        if before:
            for n in complete_numbers(spark, f"{path}/batch"):
                if n <= before[-1]:
                    remove(spark, f"{path}/batch/n={n}")

    return write


def stats_events(stream: DataFrame, tick: str = "2 seconds", running: tuple[str, ...] = ("RUNNING",), late: str = "10 seconds") -> DataFrame:
    """One event per tick and running key, with its newest row of the tick. stream: key, ts, state and counters."""
    rest = [c for c in stream.columns if c not in ("key", "ts")]
    ticks = stream.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("w"), "key").agg(F.max_by(F.struct(*rest), "ts").alias("r"))
    return ticks.where(F.col("r.state").isin(*running)).select("key", F.col("w.end").alias("tick"), "r.*")


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them on in event order.

    A timer stands at the earliest row held; when it fires, every row that the watermark has
    passed is complete, as rows behind the watermark are late and dropped. Rows may come in any
    order and any number of micro-batches. The state of a key is what arrived within the delay
    of the watermark, and `last`.
    """

    #: Columns of a held row after `us` (its time in microseconds), and of the state kept between rows.
    held_schema, last_schema = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"us bigint, {self.held_schema}")
        self.last = handle.getValueState("last", self.last_schema)

    def values(self, rows: pd.DataFrame) -> Iterator[tuple]:
        """The values held of each row, plain Python ones."""
        raise NotImplementedError

    def step(self, key, last, row) -> tuple[tuple | None, tuple]:
        """What a row gives (or None) after the last one, and what is kept of it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for part in rows:
            us = (part["ts"].astype("datetime64[us]").astype("int64")).tolist()
            self.held.appendList([(u, *v) for u, v in zip(us, self.values(part), strict=True)])
            first = min([*us, first] if first is not None else us)
        self._wake(first)
        yield from ()

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.held.get())
        ready, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in ready:
            given, last = self.step(key, last, row)
            if given:
                out.append(given)
        self.held.clear()
        if rest:
            self.held.put(rest)
            self._wake(rest[0][0])
        if last is not None:
            self.last.update(last)
        if out:
            frame = pd.DataFrame(out, columns=self.columns)
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    def close(self) -> None:
        pass


class _Transitions(_InOrder):
    """(key, ts, was, state) when a key's state changes; the first one primes silently."""

    held_schema, last_schema, columns = "state string", "state string", ("key", "ts", "was", "state")

    def values(self, rows):
        return zip(rows["state"].tolist(), strict=True)

    def step(self, key, last, row):
        us, state = row
        return ((key[0], us, last[0], state) if last and last[0] != state else None), (state,)


class _Health(_InOrder):
    """(lease_id, ts, health) per sample against the one before."""

    held_schema, last_schema, columns = "running boolean, entries bigint", "entries bigint", ("lease_id", "ts", "health")

    def values(self, rows):
        return zip(rows["running"].astype(bool).tolist(), rows["entries_done"].astype("int64").tolist(), strict=True)

    def step(self, key, last, row):
        us, running, entries = row
        return (key[0], us, "queued" if not running else "new" if last is None else "slow" if entries > last[0] else "stuck"), (entries,)


def _in_event_order(stream: DataFrame, key: str, processor: _InOrder, schema: str, late: str) -> DataFrame:
    ship(stream.sparkSession)
    return stream.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_transitions(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """stream: key, ts, state. Rows up to `late` behind the newest one are taken in event order, whatever micro-batch brings
    them; of rows of a key at the same time the smaller state counts first. Needs the RocksDB state store.
    """
    return _in_event_order(stream.select("key", "ts", "state"), "key", _Transitions(), "key string, ts timestamp, was string, state string", late)


def stream_inflight_health(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """stream: lease_id, ts, running, entries_done; order as for stream_transitions()."""
    return _in_event_order(stream.select("lease_id", "ts", "running", "entries_done"), "lease_id", _Health(), "lease_id bigint, ts timestamp, health string", late)


class _Digest(_InOrder):
    """Per job: the first parked item alerts at once, later ones are held until the rollup elapses, which opens the next one."""

    held_schema = "item bigint"

    def __init__(self, rollup_ms: int):
        self.rollup_ms = rollup_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"us bigint, {self.held_schema}")
        self.until = handle.getValueState("until", "ms bigint")
        self.waiting = handle.getListState("waiting", "item bigint")

    def values(self, rows):
        return zip(rows["item_id"].astype("int64").tolist(), strict=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        rest = [r for r in held if r[0] > passed * 1000]
        until = self.until.get()[0] if self.until.exists() else None
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        told = []
        for us, item in held[: len(held) - len(rest)]:
            at = us // 1000
            if waiting and at > until:
                told.append((key[0], until, waiting))
                until, waiting = until + self.rollup_ms, []
            if until is None or at > until:
                told.append((key[0], at, [item]))
                until = at + self.rollup_ms
            else:
                waiting = [*waiting, item]
        if waiting and until <= passed:
            told.append((key[0], until, waiting))
            until, waiting = until + self.rollup_ms, []
        self.held.clear()
        self.waiting.clear()
        if rest:
            self.held.put(rest)
            self._wake(rest[0][0])
        if waiting:
            self.waiting.put([(i,) for i in waiting])
            self.handle.registerTimer(until)
        if until is not None:
            self.until.update((until,))
        if told:
            yield pd.DataFrame(told, columns=["job_id", "at_ms", "items"])


def stream_parked_digest(stream: DataFrame, rollup_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """stream: job_id, item_id, ts. Alerts once the watermark has passed them, whatever order parks come in; the batch form is fleet.parked_digest."""
    return _in_event_order(stream.select("job_id", "item_id", "ts"), "job_id", _Digest(rollup_ms), "job_id bigint, at_ms bigint, items array<bigint>", late)
