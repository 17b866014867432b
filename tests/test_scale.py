"""What queries move between tasks, measured by Spark's own counters."""

import os

from conftest import SF_DIR

from pyspark.sql import functions as F

from driftline import fixtures, storage
from driftline.checks import diff as checked
from driftline.checks import journal
from driftline.operators import diff, tree
from driftline.plans.passes import run_passes
from driftline.sources.listing import as_listing, slice_listing

COLUMNS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""
    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        summaries = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.length()))

    before = so_far()
    run()
    return so_far() - before


def stored(df):
    df.write.format("noop").mode("overwrite").save()


def copied(tmp_path):
    """The supplied tables under another name, of which nothing is derived yet."""
    for f in os.listdir(SF_DIR):
        os.symlink(f"{SF_DIR}/{f}", tmp_path / f)
    return str(tmp_path)


def test_listings_take_one_shuffle_of_the_rows(spark, tmp_path):
    once = shuffled(spark, lambda: stored(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(*COLUMNS).repartition("l_orderkey")))
    sf_dir = copied(tmp_path)
    derived = shuffled(spark, lambda: [fixtures.table(spark, sf_dir, name) for name in ("src", "dst")])
    assert 0 < derived < 1.5 * once


def _sides(spark):
    """A source and a destination of many files, with a directory and a left-over temporary name."""
    files = spark.range(20000).select(F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("rel_path"), F.lit("FILE").alias("type"), F.col("id").alias("size"), F.xxhash64("id").alias("mtime_ns"))
    rest = spark.createDataFrame([("d", "DIR", 0, 0), ("e", "DIR", 0, 0)], files.schema)
    left = spark.createDataFrame([("d", "DIR", 0, 0), ("d/.sync.tmp.1-1.5.0", "FILE", 0, 0), ("d/.sync.tmp.2-1.5.0", "FILE", 0, 0), ("x/.sync.tmp.2-1.5.0", "FILE", 0, 0)], files.schema)
    return as_listing(files.union(rest)), as_listing(files.union(left))


def _unbroadcast(spark, run):
    """run() as it goes with tables too large to be sent to all tasks by their size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, 4000)
    try:
        return run()
    finally:
        spark.conf.unset(name)


def test_few_entries_leave_the_destination_where_it_is(spark):
    src, dst = _sides(spark)
    found = diff.plan_of(src.where("type = 'DIR'"), dst).select("rel_path", "action", "reason")
    assert {tuple(r) for r in found.collect()} == {("d", "DIR", None), ("e", "MKDIR", "absent")}
    assert _unbroadcast(spark, lambda: shuffled(spark, lambda: stored(found))) < 10_000


def test_temporary_names_are_looked_at_first(spark):
    src, dst = _sides(spark)
    found = diff.temp_residue(src, dst, 1, 1)
    assert {tuple(r) for r in found.collect()} == {("d/.sync.tmp.1-1.5.0", False), ("d/.sync.tmp.2-1.5.0", True)}
    assert _unbroadcast(spark, lambda: shuffled(spark, lambda: stored(found))) < 20_000


def test_texts_of_a_language_are_many_files(spark):
    texts = spark.range(500).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("text")).coalesce(1)
    rows = journal.scan_objects(spark, journal._tree(texts, 100), "part-*.txt").select("size", F.octet_length("content").alias("read")).collect()
    assert len(rows) == 5 and sum(r["size"] for r in rows) == sum(r["read"] for r in rows) == 500 * 4 - 110


def test_slices_move_paths_only(spark):
    src, _ = _sides(spark)
    names = spark.createDataFrame([("d", "f1"), ("d", "f20001"), ("", "d"), ("", "d/f2"), (None, "f3")], "parent string, name string")
    assert {r["rel_path"] for r in slice_listing(src, names).collect()} == {"d/f1", "d"}
    every = src.select(F.substring_index("rel_path", "/", -1).alias("name"), F.when(F.contains("rel_path", F.lit("/")), "d").otherwise("").alias("parent"))
    paths = shuffled(spark, lambda: stored(src.select("rel_path").repartition("rel_path")))
    assert _unbroadcast(spark, lambda: shuffled(spark, lambda: stored(slice_listing(src, every).select("rel_path")))) < 2.5 * paths


def test_passes_move_both_sides_once_each(spark, tmp_path):
    """Directories in the way are set aside without another look at the whole plan."""
    src, dst = _sides(spark)
    in_the_way = dst.where("rel_path <> 'd/f7'").unionByName(as_listing(spark.createDataFrame([("d/f7", "DIR"), ("d/f7/kid", "FILE")], "rel_path string, type string")))
    both = shuffled(spark, lambda: [stored(side.repartition("rel_path")) for side in (src, in_the_way)])
    found = []
    moved = _unbroadcast(spark, lambda: shuffled(spark, lambda: found.extend(run_passes(spark, lambda n: src, in_the_way, str(tmp_path)))))
    assert [(r["files_copied"], r["orphans"], r["converged"]) for r in found] == [(1, 1, False), (0, 1, True)] and moved < 2.4 * both
    left = {r["rel_path"]: r["type"] for r in spark.read.parquet(f"{tmp_path}/pass=2/snapshot").where("rel_path = 'd/f7' or rel_path like 'd/f7/%' or rel_path like 'd/.sync.stale.%'").collect()}
    assert left.pop("d/f7") == "FILE" and sorted(left.values()) == ["DIR", "FILE"] and "d/f7/kid" not in left


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 1000)
    src = as_listing(spark.range(20000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("rel_path"), F.lit("FILE").alias("type"), (F.col("id") % 10000).alias("ino"), F.lit(2).alias("nlink")))
    groups, members = tree.link_groups(src).withColumn("anchor_state", F.lit("copied")), tree.link_members(src)
    assert groups.rdd.getNumPartitions() == members.rdd.getNumPartitions() == 20
    links = tree.pending_links(groups, members).select("ino", "rel_path", "anchor_path").collect()
    assert len(links) == 10000 and all(r["anchor_path"] == min(f"f{r['ino']}", f"f{r['ino'] + 10000}") != r["rel_path"] for r in links)


def test_links_need_the_source_only(spark, tmp_path):
    sf_dir = copied(tmp_path)
    assert checked.QUERIES["J4_pending_links"](spark, sf_dir).count() > 0
    assert {name for _, of, name in fixtures._MADE if of == sf_dir} == {"src", "files", "dirs"}


def test_listings_read_the_same_written_files(spark, tmp_path):
    sf_dir = copied(tmp_path)
    src, dst = (set(fixtures.table(spark, sf_dir, name).inputFiles()) for name in ("src", "dst"))
    files = set(fixtures._MADE[spark.sparkContext.applicationId, sf_dir, "files"].inputFiles())
    assert files < src and files < dst and src & dst == files


def test_counted_sides_are_not_sorted(spark):
    src, dst = _sides(spark)
    found = _unbroadcast(spark, lambda: diff.plan(src, dst, rows=40_000)._jdf.queryExecution().executedPlan().toString())
    assert "ShuffledHashJoin" in found and "Sort" not in found
    same = lambda df: sorted((r["rel_path"], r["action"], r["reason"] or "") for r in df.select("rel_path", "action", "reason").collect())
    assert same(diff.plan(src, dst, rows=40_000)) == same(diff.plan(src, dst))
