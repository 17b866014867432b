"""Streams replayed from files give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators import fleet
from driftline.streaming import streams


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def replay(spark, tmp_path, df, build, mode="append", files=2):
    """All rows that the stream build(readStream) emits."""
    source = str(tmp_path / "in")
    df.repartition(files).write.parquet(source)
    stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    name = f"out_{abs(hash(source))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_ingest_drops_replays(spark, tmp_path):
    rows = [(1, 1, "a", i % 10 // 2, i % 2, at(i), "COPIED") for i in range(40)]
    df = spark.createDataFrame(rows, "job_id int, pass_no int, agent_id string, seq bigint, place int, ts timestamp, type string")
    got = replay(spark, tmp_path, df, streams.ingest_journal)
    assert sorted((r["seq"], r["place"]) for r in got) == [(seq, place) for seq in range(5) for place in range(2)]
    with pytest.raises(ValueError, match="place"):
        streams.ingest_journal(df.drop("place"))


def test_live_counters(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "A"), (1, 1, "A"), (1, 2, "B")], "job_id int, pass_no int, type string")
    got = replay(spark, tmp_path, df, streams.live_counters, "complete")
    assert {tuple(r) for r in got} == {(1, 1, "A", 2), (1, 2, "B", 1)}


def test_rates_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", at(s), 10 * s) for s in (0, 1, 2, 60, 61, 4000)], "agent_id string, ts timestamp, entries bigint")
    got = replay(spark, tmp_path / "r", df, lambda s: streams.stream_rates(s, "1 minute"), files=1)
    assert {r["delta"] for r in got} == {20, 10}
    beats = df.withColumn("held", F.array(F.col("entries")))
    got = replay(spark, tmp_path / "s", beats, streams.agent_sessions, files=1)
    assert sorted((r["beats"], r["at_risk"][0]) for r in got) == [(2, 610), (3, 20)]


def late_rows(df, key, parts=4):
    """Rows dealt over files without regard to time, and a last file with a row far ahead under no key."""
    end = spark_row(df, key)
    return [*[df.where(F.pmod(F.hash("ts"), F.lit(parts)) == k) for k in range(parts)], end]


def spark_row(df, key):
    values = {f.name: F.lit(at(10**6)) if f.name == "ts" else F.lit(None) if f.name == key else F.lit({"boolean": False, "string": ""}.get(f.dataType.simpleString(), 0)) for f in df.schema.fields}
    return df.sparkSession.range(1).select(*[v.cast(df.schema[n].dataType).alias(n) for n, v in values.items()])


def replay_late(spark, tmp_path, df, key, build):
    """What build(stream) emits for the keys of df when its rows come late, by a query that starts anew for every file."""
    for n, part in enumerate(late_rows(df, key)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        keep = lambda batch, k, n=n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/r{n}b{k}"))
        out.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    return spark.read.option("recursiveFileLookup", True).schema(out.schema).parquet(str(tmp_path / "out")).where(f"{key} is not null").collect()


def test_transitions_of_late_rows(spark, tmp_path):
    states = "AABBACCCABBBAACA"
    df = spark.createDataFrame([("k", at(i), s) for i, s in enumerate(states)] + [("q", at(0), "Z")], "key string, ts timestamp, state string")
    got = replay_late(spark, tmp_path, df, "key", lambda s: streams.stream_transitions(s, "1 hour"))
    batch = fleet.transitions(df, ["key"], ["ts"])
    assert sorted((r["ts"], r["was"], r["state"]) for r in got) == sorted((r["ts"], r["was"], r["state"]) for r in batch.collect())


def test_inflight_health_of_late_rows(spark, tmp_path):
    rows = [(1, at(0), True, 1), (1, at(1), True, 5), (1, at(2), True, 5), (1, at(3), False, 5), (1, at(4), True, 6), (2, at(3), True, 1), (2, at(9), True, 1)]
    df = spark.createDataFrame(rows, "lease_id bigint, ts timestamp, running boolean, entries_done bigint")
    got = replay_late(spark, tmp_path, df, "lease_id", lambda s: streams.stream_inflight_health(s, "1 hour"))
    assert [r["health"] for r in sorted(got, key=lambda r: (r["lease_id"], r["ts"]))] == ["new", "slow", "stuck", "queued", "slow", "new", "stuck"]


def test_digest_of_late_rows_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 10, 20, 350, 1000, 1300, 1301, 1599, 1600, 5000, 5000])], "job_id bigint, item_id bigint, ts timestamp")
    got = replay_late(spark, tmp_path, df, "job_id", lambda s: streams.stream_parked_digest(s, 300_000, "2 hours"))
    batch = fleet.parked_digest(df.select("job_id", "item_id", F.unix_millis("ts").alias("parked_ms")), 300_000)
    assert sorted((r["at_ms"], r["items"]) for r in got) == sorted((r["at_ms"], r["items"]) for r in batch.collect())


def test_feed_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1)], "job_id int, key string, n int")
    assert len(replay(spark, tmp_path / "f", df, lambda s: streams.event_feed(s, 1))) == 2
    write = streams.upsert_by_key(str(tmp_path / "u"), ["job_id", "key"], "n", compact_every=3)
    seen = lambda: {tuple(r) for r in streams.read_upserts(spark, str(tmp_path / "u"), ["job_id", "key"], "n").select("job_id", "key", "n").collect()}
    write(df.where("n = 2"), 0)
    write(df.where("n = 1"), 1)
    assert seen() == {(1, "a", 2), (2, "b", 1)}
    write(df.where("n = 1"), 1)  # a batch that is run again
    newest = spark.createDataFrame([(2, "b", 9)], df.schema)
    for n in range(2, 9):
        write(newest if n == 4 else df, n)
        assert seen() == ({(1, "a", 2), (2, "b", 9)} if n >= 4 else {(1, "a", 2), (2, "b", 1)})
    assert sorted(p.name for p in (tmp_path / "u" / "base").iterdir()) == ["n=5", "n=8"] and sorted(p.name for p in (tmp_path / "u" / "batch").iterdir()) == ["n=6", "n=7", "n=8"]


def test_stats_events(spark, tmp_path):
    rows = [("j", at(0), "RUNNING", 1), ("j", at(1), "RUNNING", 2), ("j", at(2), "PAUSED", 3), ("j", at(5), "RUNNING", 4), ("k", at(5), "DONE", 1), ("j", at(100), "RUNNING", 9)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, state string, files int")
    got = replay(spark, tmp_path, df, streams.stats_events, files=1)
    assert sorted((r["key"], r["tick"], r["files"]) for r in got) == [("j", at(2), 2), ("j", at(6), 4)]
