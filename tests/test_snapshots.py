"""Snapshots as base and deltas, bucketed joins, and passes over what arrived."""

import re

import pytest
from pyspark.sql import functions as F

from driftline.operators import diff
from driftline.plans import passes
from driftline.sources import snapshots
from driftline.sources.generate import gen_listing
from driftline.sources.journal import append_once, read_once

SCHEMA = "rel_path string, type string, mode int, uid bigint, gid bigint, size bigint, mtime_ns bigint, nlink int"


def listing(spark, *rows):
    """Entries given as (path, type, size)."""
    return spark.createDataFrame([(p, t, 420, 1, 1, n, 5, 1) for p, t, n in rows], SCHEMA)


def arrival(spark, *rows, removed=()):
    return listing(spark, *rows).withColumn("removed", F.lit(False)).unionByName(listing(spark, *[(p, None, None) for p in removed]).withColumn("removed", F.lit(True)))


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def sizes(df):
    return {r["rel_path"]: (r["type"], r["size"]) for r in df.collect()}


def test_base_and_deltas(spark, tmp_path):
    path = str(tmp_path)
    snapshots.write_base(listing(spark, ("a", "FILE", 1), ("b", "FILE", 2), ("d/c", "FILE", 3)), path, 0, 4)
    gone = spark.createDataFrame([("b",), ("a",)], "rel_path string")
    for _ in range(2):  # a write that runs again replaces itself
        snapshots.write_delta(listing(spark, ("a", "FILE", 10), ("n", "FILE", 4)), gone, path, 1, 4)
    want = {"a": ("FILE", 10), "n": ("FILE", 4), "d/c": ("FILE", 3)}
    assert sizes(snapshots.read_snapshot(spark, path)) == want
    assert set(sizes(snapshots.read_snapshot(spark, path, upto=0))) == {"a", "b", "d/c"}
    snapshots.write_delta(listing(spark, ("b", "FILE", 7)), gone.where("false"), path, 2, 4)
    want["b"] = ("FILE", 7)
    assert not snapshots.compact(spark, path, 3, 4) and snapshots.compact(spark, path, 2, 4)
    assert sizes(snapshots.read_snapshot(spark, path)) == want and snapshots._parts(spark, path, None) == (2, [])
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, f"{path}/none")


def test_reads_follow_the_change(spark, tmp_path):
    tree = gen_listing(spark, 400).where("type <> 'DIR'")
    path = str(tmp_path / "dst")
    snapshots.write_base(tree, path)
    changed = tree.where(F.col("rel_path").rlike("/d39[6-9]/[^/]*$"))  # one directory in a hundred
    dirs = changed.select(F.regexp_replace("rel_path", "/[^/]*$", "").alias("d")).distinct().count()
    buckets = snapshots.changed_buckets(changed)
    some, whole = snapshots.read_snapshot(spark, path, buckets), snapshots.read_snapshot(spark, path)
    assert dirs == 4 and len(buckets) <= snapshots.SPREAD * dirs
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(some) / files(whole) < 0.08 and re.search(r"PartitionFilters: \[bucket#\d+ IN", plan_of(some))
    assert changed.join(some, "rel_path", "left_anti").isEmpty()


def test_wide_directory_is_spread(spark):
    rows = spark.range(4000).select(F.concat(F.lit("wide/f"), "id").alias("rel_path"))
    counts = [r["count"] for r in rows.groupBy(snapshots.bucket_of(F.col("rel_path"))).count().collect()]
    assert len(counts) >= snapshots.SPREAD - 1 and max(counts) < 2 * 4000 / snapshots.SPREAD


def test_bucketed_listings_join_without_a_shuffle(spark, tmp_path):
    src = snapshots.store_bucketed(listing(spark, ("a", "FILE", 1), ("b", "FILE", 2)), "bucketed_src", str(tmp_path / "s"), 4)
    dst = snapshots.store_bucketed(listing(spark, ("b", "FILE", 2), ("c", "FILE", 3)), "bucketed_dst", str(tmp_path / "d"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    pairs = diff.tree_diff(src, dst)
    text = plan_of(pairs)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "FullOuter" in text and "Exchange" not in text
    assert {(r["rel_path"], r["in_src"], r["in_dst"]) for r in pairs.collect()} == {("a", True, False), ("b", True, True), ("c", False, True)}
    spark.sql("DROP TABLE bucketed_src")
    spark.sql("DROP TABLE bucketed_dst")


def test_incremental_passes(spark, tmp_path):
    out = str(tmp_path)
    start = listing(spark, ("d", "DIR", 0), ("d/x", "FILE", 1), ("d/sub", "DIR", 0), ("d/sub/deep", "FILE", 9), ("keep", "FILE", 5), ("old", "FILE", 6), ("t", "FILE", 1))
    snapshots.write_base(start, f"{out}/dst", 0, 8)
    first = arrival(spark, ("new", "FILE", 3), ("keep", "FILE", 5), ("t", "SYMLINK", 0), removed=("old",))
    for _ in range(2):  # a pass that is run again gives the same
        c = passes.incremental_pass(first, out, 1, buckets=8)
    assert (c["files_copied"], c["clean"], c["orphans"]) == (2, 1, 1)
    orphans = lambda n: {r["rel_path"] for r in spark.read.parquet(f"{out}/pass={n}/journal").where("type = 'ORPHAN'").collect()}
    assert orphans(1) == {"old"}
    now = sizes(snapshots.read_snapshot(spark, f"{out}/dst"))
    assert now["new"] == ("FILE", 3) and now["t"] == ("SYMLINK", 0) and "old" in now and now["d/x"] == ("FILE", 1)
    delta = spark.read.parquet(f"{out}/dst/delta/n=1")
    assert {r["rel_path"] for r in delta.collect()} == {"new", "t"}  # what is written follows the change

    # a file takes the place of a directory: what lies beneath, however deep, is set aside with it
    c = passes.incremental_pass(arrival(spark, ("d", "FILE", 8), removed=("d/x",)), out, 2, buckets=8)
    now = sizes(snapshots.read_snapshot(spark, f"{out}/dst"))
    stale = [p for p in now if ".sync.stale." in p]
    assert now["d"] == ("FILE", 8) and len(stale) == 4 and sorted(p.split("/", 1)[1] for p in stale if "/" in p) == ["sub", "sub/deep", "x"]
    assert not any(p.startswith("d/") for p in now) and c["orphans"] == 1 and len(orphans(2)) == 1
    # nothing to do
    c = passes.incremental_pass(arrival(spark, ("d", "FILE", 8), ("new", "FILE", 3)), out, 3, buckets=8)
    assert (c["files_copied"], c["meta_fixed"], c["clean"]) == (0, 0, 2)
    # the newest of several states of a path counts
    two = arrival(spark, ("z", "FILE", 1)).withColumn("ts_ns", F.lit(1)).unionByName(arrival(spark, ("z", "FILE", 2)).withColumn("ts_ns", F.lit(2)))
    passes.incremental_pass(two, out, 4, buckets=8, compact_every=2)
    assert sizes(snapshots.read_snapshot(spark, f"{out}/dst"))["z"] == ("FILE", 2) and snapshots._parts(spark, f"{out}/dst", None)[1] == []


def test_incremental_pass_moves_what_changed(spark, tmp_path):
    """What lies beneath a directory in the way is planned beside the arrivals' plan, and the delta is what applying the whole plan would alter."""
    out = str(tmp_path)
    start = listing(spark, *[(p, "FILE" if p[-1].isdigit() else "DIR", 1) for p in ("d", "d/1", "d/e", "d/e/2", "e", "e/3", "f", "f/g", "f/g/4", "same5", "size6")])
    snapshots.write_base(start, f"{out}/dst", 0, 8)
    arrived = arrival(spark, ("d", "FILE", 8), ("f/g", "SYMLINK", 0), ("same5", "FILE", 1), ("size6", "FILE", 2), removed=("d/1", "none"))
    passes.incremental_pass(arrived, out, 1, buckets=8)
    assert {r["rel_path"] for r in spark.read.parquet(f"{out}/pass=1/plan-deep").collect()} == {"d/e", "d/e/2", "f/g/4"}
    planned = spark.read.parquet(f"{out}/pass=1/plan", f"{out}/pass=1/plan-deep")
    changed, gone = diff.plan_changes(start, planned, diff.set_aside(planned))
    whole = start.where(~F.col("rel_path").isin(*[r["rel_path"] for r in planned.select("rel_path").collect()])).select("rel_path", "type", "size")
    want = whole.unionByName(diff.apply_plan(start, planned).select("rel_path", "type", "size"))
    got = start.join(gone.unionByName(changed.select("rel_path")), "rel_path", "left_anti").select("rel_path", "type", "size").unionByName(changed.select("rel_path", "type", "size"))
    assert sorted(want.collect()) == sorted(got.collect()) == sorted(snapshots.read_snapshot(spark, f"{out}/dst").select("rel_path", "type", "size").collect())
    assert {r["rel_path"] for r in gone.collect()} == {"d/1", "d/e", "d/e/2", "f/g/4"} and "same5" not in {r["rel_path"] for r in changed.collect()}


def test_journal_is_taken_once(spark, tmp_path):
    """Several records per batch, gaps, parts of batches, replays of old and new ones, and a delivery that runs again."""
    path = str(tmp_path / "journal")
    schema = "job_id int, pass_no int, agent_id string, seq bigint, place int, record_count int, type string"
    batch = lambda agent, seq, places=(0, 1, 2): [(1, 1, agent, seq, k, 3, "COPIED") for k in places]
    deliver = lambda n, *rows: {r["agent_id"]: r["acked_seq"] for r in append_once(spark.createDataFrame(sum(rows, []), schema), path, n).collect()}
    assert deliver(0, batch("a", 1), batch("a", 3), batch("b", 2)) == {"a": 1, "b": 0}
    assert deliver(1, batch("a", 1), batch("a", 2, (0, 1)), batch("a", 3), batch("b", 1)) == {"a": 1, "b": 2}
    for _ in range(2):
        assert deliver(2, batch("a", 2), batch("a", 4), batch("c", 1, (0,))) == {"a": 4, "b": 2, "c": 0}
    stored = sorted((r["agent_id"], r["seq"], r["place"]) for r in read_once(spark, path).collect())
    assert stored == sorted([("a", s, k) for s in (1, 2, 3, 4) for k in range(3)] + [("b", s, k) for s in (1, 2) for k in range(3)] + [("c", 1, 0)])
    assert read_once(spark, path, 2).count() == 0
