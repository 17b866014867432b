"""Diff, application, links, verification and passes on hand-made listings."""

import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from driftline.operators import chunks, diff, fleet, journal, ledger, slices, tree
from driftline.options import SyncOptions
from driftline.plans.passes import delete_pass, run_passes
from driftline.sources.generate import gen_listing
from driftline.sources.journal import append_journal, read_journal
from driftline.sources.listing import read_listing, scan_objects

SCHEMA = (
    "rel_path string, type string, mode int, uid bigint, gid bigint, size bigint, mtime_ns bigint, ino bigint, nlink int, link_target string, "
    "rdev_major bigint, rdev_minor bigint, blocks bigint, stat_errno int, xattrs map<string,binary>, content binary"
)


def entry(path, type_="FILE", mode=0o644, uid=1, size=10, mtime=0, ino=1, nlink=1, target=None, minor=0, errno=0, xattrs=None, content=b"0123456789"):
    return (path, type_, mode, uid, 1, size, mtime, ino, nlink, target, 0, minor, 1, errno, xattrs, content)


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def sides(spark):
    acl = {"user.a": b"1", "security.selinux": b"x", "system.posix_acl_access": b"y"}
    src = listing(
        spark, entry("d", "DIR"), entry("d/new"), entry("d/same", xattrs=acl), entry("d/x", xattrs={"user.a": b"1"}), entry("d/slop", mtime=900_000), entry("d/late", mtime=1_000_001),
        entry("d/edge", mtime=1_000_000), entry("l", "SYMLINK", target="t"), entry("p", "FIFO", minor=1), entry("bad", errno=13), entry("gone", errno=2), entry("far"), entry("was_dir"), entry("was_empty"),
        entry("skip", "DIR"), entry("skip/in"),
    )
    dst = listing(
        spark, entry("d", "DIR"), entry("d/same", xattrs={"user.a": b"1", "security.selinux": b"other", "system.posix_acl_access": b"y"}), entry("d/x", xattrs={"user.b": b"1"}),
        entry("d/slop"), entry("d/late"), entry("d/edge"), entry("l", "SYMLINK", target="t", mode=0o700), entry("p", "FIFO"), entry("far", errno=5), entry("was_dir", "DIR"), entry("was_dir/kid"),
        entry("was_empty", "DIR"), entry("o", "DIR"), entry("o/deep"), entry("d/.sync.tmp.1-1.a.0"), entry("d/.sync.tmp.1-2.a.0"), entry("skip", "DIR"), entry("skip/lost"), entry("skip2"),
    )
    return src, dst


OPTS = SyncOptions(rules=(("exclude", "skip/**"), ("exclude", "skip2")))


def test_classes(spark):
    src, dst = sides(spark)
    got = {r["rel_path"]: (r["action"], r["reason"]) for r in diff.plan(src, dst, OPTS).collect()}
    assert got["d/new"] == ("COPY", "absent") and got["d/same"] == ("CLEAN", None) and got["d/x"] == ("META_FIX", "xattrs")
    assert got["d/slop"] == got["d/edge"] == ("CLEAN", None) and got["d/late"] == ("COPY", "mtime")
    assert got["l"] == ("CLEAN", None) and got["p"] == ("SPECIAL", "rdev") and got["bad"][0] == "ERROR" and got["gone"][0] == "VANISHED"
    assert got["far"] == ("COPY", "absent") and got["was_dir"] == ("COPY", "type") and got["skip/in"][0] == "EXCLUDED" and got["skip"] == ("DIR", None)


def test_orphans_and_residue(spark):
    src, dst = sides(spark)
    # only the topmost; not below a directory that is excluded; an excluded name does not shield itself
    assert {r[0] for r in diff.orphans(src, dst, OPTS).select("rel_path").collect()} == {"o", "skip2", "skip/lost"}
    pruned = SyncOptions(rules=(("exclude", "skip"),))
    assert "skip/lost" not in {r[0] for r in diff.orphans(src, dst, pruned).select("rel_path").collect()}
    assert {tuple(r) for r in diff.temp_residue(src, dst, 1, 1, OPTS).collect()} == {("d/.sync.tmp.1-1.a.0", False), ("d/.sync.tmp.1-2.a.0", True)}


def test_type_change(spark):
    src, dst = sides(spark)
    rows = {r["rel_path"]: r for r in diff.type_changes(diff.tree_diff(src, dst), dst, 1, 1).collect()}
    assert rows["was_dir"]["step"] == "SET_ASIDE" and rows["was_dir"]["stale_path"].startswith(".sync.stale.1-1.") and rows["was_dir"]["journal_type"] == "ORPHAN"
    assert rows["was_empty"]["step"] == "REMOVE"
    assert {r["step"] for r in diff.type_changes(diff.tree_diff(src, dst), dst, 1, 1, SyncOptions(dry_run=True)).collect()} == {"NONE"}


def test_xattr_delta(spark):
    src, dst = sides(spark)
    pairs = diff.tree_diff(src, dst)
    assert {tuple(r) for r in diff.xattr_delta(pairs).where("rel_path = 'd/x'").collect()} == {("d/x", "user.a", "set", None), ("d/x", "user.b", "remove", None)}
    warned = diff.xattr_delta(pairs, SyncOptions(), ["user.a"]).where("name = 'user.a'").first()
    assert (warned["step"], warned["type"]) == ("skip", "FIDELITY_EXCEPTION")


def test_apply_empties_the_diff_whatever_the_order(spark):
    src, dst = sides(spark)
    once = diff.apply_plan(dst, diff.plan(src, dst))
    again = diff.plan(src.orderBy(F.rand(3)), once.orderBy(F.rand(4)))
    assert {r[0] for r in again.select("action").distinct().collect()} <= {"CLEAN", "DIR", "DST_ONLY", "ERROR", "VANISHED"}
    assert once.where("rel_path = 'd/new'").first()["content"] == b"0123456789"


def test_run_passes(spark, tmp_path):
    src, dst = sides(spark)
    done = run_passes(spark, lambda n: src, dst, str(tmp_path), SyncOptions())
    assert [d["converged"] for d in done] == [False, True] and done[0]["files_copied"] == 7 and done[1]["files_copied"] == 0
    assert len(run_passes(spark, lambda n: src.withColumn("size", F.col("size") + n), dst, str(tmp_path / "b"), SyncOptions(max_passes=3))) == 3


def test_links(spark):
    high = -(2**62)
    rows = [entry("b", ino=high, nlink=3), entry("a", ino=high, nlink=3), entry("c", ino=high, nlink=3), entry("z", ino=5)]
    groups = tree.link_groups(listing(spark, *rows, rows[0]), 2).collect()
    assert len(groups) == 1 and groups[0]["anchor_path"] == "a" and groups[0]["members_seen"] == 3 and groups[0]["fallback"]
    ready = tree.link_groups(listing(spark, *rows)).withColumn("anchor_state", F.lit("copied"))
    links = tree.pending_links(ready, tree.link_members(listing(spark, *rows)))
    dst = listing(spark, entry("a", ino=7), entry("b", ino=7)).withColumn("dev", F.lit(1))
    assert {tuple(r)[:2] for r in tree.link_outcomes(links, dst).collect()} == {("b", None), ("c", "LINK_CREATED")}


def test_verify_order(spark):
    src = listing(spark, entry("ok"), entry("size", size=1), entry("time", mtime=10**9), entry("mode", mode=1), entry("sum", content=b"other"), entry("none"))
    dst = listing(spark, entry("ok"), entry("size", mtime=5), entry("time"), entry("mode"), entry("sum"), entry("vanished"))
    rows = spark.createDataFrame([(p, True) for p in ("ok", "size", "time", "mode", "sum", "none", "vanished")], "rel_path string, sampled boolean")
    got = {r["rel_path"]: r["detail"] for r in journal.verify(rows, src, dst).collect()}
    assert got == {"ok": "", "size": "size mismatch", "time": "mtime mismatch", "mode": "mode mismatch", "sum": "checksum mismatch", "none": "missing", "vanished": ""}
    assert {r[0] for r in journal.recopy(journal.verify(rows, src, dst), src).collect()} == {"size", "time", "mode", "sum", "none"}


def test_sample_has_a_floor(spark):
    j = spark.createDataFrame([(1, 1, "COPIED", f"p{i}") for i in range(20)] + [(1, 1, "META_FIXED", "m")], "job_id int, pass_no int, type string, rel_path string")
    rows = journal.verify_sample(j, 0.000001).collect()
    assert [r["rel_path"] for r in rows if r["sampled"]] == ["p0"]
    assert sum(r["sampled"] for r in journal.verify_sample(j, 1.0).collect()) == 20


def test_digest(spark):
    parks = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 10, 20, 350, 1000])], "job_id bigint, item_id bigint, parked_ms bigint")
    rows = [(r["at_ms"], r["items"]) for r in fleet.parked_digest(parks, 300).orderBy("at_ms").collect()]
    assert rows == [(0, [0]), (300, [1, 2]), (600, [3]), (1000, [4])]


def test_parked_alerts_stream(spark):
    """Memory of a job is one window's end: the fold takes parks without an end; rows equal the digest."""
    endless = fleet.digest_steps(((5 * i, i) for i in itertools.count()), 300)
    first = list(itertools.islice(endless, 50_000))
    assert first[0] == (0, 0, 0) and first[1] == (300, 5, 1) and first[60] == (300, 300, 60) and first[61] == (600, 305, 61)
    parks = spark.range(30_000).selectExpr("id % 2 as job_id", "id as item_id", "id * 7 as parked_ms", "cast(null as bigint) as ended_ms")
    rows = fleet.parked_alerts(parks, 300)
    assert rows.count() == 30_000 and "collect_list" not in rows._jdf.queryExecution().toString()
    got = {(r["job_id"], r["at_ms"]): r["n"] for r in rows.groupBy("job_id", "at_ms").agg(F.count("*").alias("n")).collect()}
    assert got == {(r["job_id"], r["at_ms"]): len(r["items"]) for r in fleet.parked_digest(parks, 300).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_alerts_follow_the_fold(spark, seed):
    """Parks with dense runs, gaps near one and two rollups, ties, repeats and nulls get the alerts of the plain fold, in any number of slices."""
    rng, rows = random.Random(seed), []
    for job in (1, 2, None):
        at = 0
        for i in range(400):
            at += rng.choice((0, 0, 1, 3, 9, 10, 11, 12, 15, 19, 20, 21, 22, 45))
            rows.append((job, rng.choice((i, i, 7, None)), at if rng.random() > 0.02 else None))
    parks = spark.createDataFrame(rows, "job_id bigint, item_id bigint, parked_ms bigint")
    first = lambda v: (v is not None, v or 0)
    expected = [(job, *told) for job in (1, 2, None) for told in fleet.digest_steps(sorted(((t, i) for j, i, t in rows if j == job), key=lambda r: (first(r[0]), first(r[1]))), 10)]
    for slices in (2, 9):
        assert sorted(map(str, fleet.parked_alerts(parks, 10, slices).collect())) == sorted(str(Row(job_id=a, at_ms=b, parked_ms=c, item_id=d)) for a, b, c, d in expected)
    assert fleet.parked_alerts(parks.where("false"), 10).count() == 0


def test_lag_over_a_hot_key(spark):
    """Values of the row before, over slices, equal lag(); a key with most of the rows lies in many partitions of the window."""
    df = spark.range(4000).selectExpr("case when id % 10 = 0 then id % 7 when id % 10 < 9 then -1 end as k", "case when id % 97 > 0 then cast(hash(id) % 500 as bigint) end as at", "id as seq", "case when id % 5 > 0 then id end as v")
    w = Window.partitionBy("k").orderBy("at", "seq")
    plain = df.withColumn("before", F.lag("v").over(w)).withColumn("was_at", F.lag("at").over(w))
    got = slices.lagged(df, ["k"], ["at", "seq"], {"before": "v", "was_at": "at"}, 8)
    assert got.columns == plain.columns and got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    cut = slices.with_slice(df.where("k = -1"), "at", slices.bounds(df, "at", 8)).groupBy("_slice").count()
    assert cut.count() == 8 and cut.agg(F.max("count")).first()[0] < 700
    assert slices.lagged(df.where("false"), ["k"], ["at", "seq"], {"before": "v"}).count() == 0


def test_objects_in_pieces(spark, tmp_path):
    """Pieces in any order are checked and written; repeats count once; gaps, overlaps and nulls leave nothing behind."""
    big = [("d/big", i * 65536, bytes([i % 251]) * 65536) for i in range(300)]
    rows = [*big, ("empty", 0, b""), ("twice", 0, b"ab"), ("twice", 0, b"ab"), ("twice", 2, b"c"), ("gap", 0, b"a"), ("gap", 2, b"b"), ("over", 0, b"abc"), ("over", 2, b"d"), ("null", 0, None), ("late", 5, b"x")]
    random.Random(1).shuffle(rows)
    pieces = spark.createDataFrame(rows, "rel_path string, offset bigint, data binary")
    contents = {"d/big": b"".join(p[2] for p in big), "empty": b"", "twice": b"abc"}
    want = {p: (len(c), hashlib.sha256(c).hexdigest(), True) for p, c in contents.items()} | {p: (None, None, False) for p in ("gap", "over", "null", "late")}
    assert {r[0]: tuple(r[1:]) for r in chunks.stream_sums(pieces).collect()} == want
    for _ in range(2):  # a second run replaces the files
        assert {r[0]: tuple(r[1:]) for r in chunks.write_objects(pieces, str(tmp_path)).collect()} == want
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == contents
    other = pieces.where("not (rel_path = 'd/big' and offset = 65536)")
    assert {r[0] for r in chunks.verify_pieces(pieces, other).where("ok").collect()} == {"empty", "twice"}
    assert chunks.stream_sums(pieces.where("false")).count() == 0
    with pytest.raises(Exception, match="refused path"):
        chunks.write_objects(spark.createDataFrame([("../x", 0, b"a")], "rel_path string, offset bigint, data binary"), str(tmp_path)).collect()


def test_totals_are_summed_by_parent_first(spark):
    df = spark.createDataFrame([("", 9), ("a", 1), ("a/b", 2), ("a/b/c", 3), ("a/b/d", None), ("z", 4)], "rel_path string, size bigint")
    assert {tuple(r) for r in tree.subtree_totals(df).collect()} == {("", 5, 10), ("a", 3, 5), ("a/b", 2, 3)}
    plan = tree.subtree_totals(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate"):]  # beneath the explode


def test_convergence_cases(spark):
    p = spark.createDataFrame([(1, 1, 0, 0, 0), (2, 1, 42, 0, 9), (3, 1, 0, 3, 0), (4, 3, 99, 0, 9), (5, 1, 5, 0, 9)], "job_id int, pass_no int, files_copied bigint, meta_fixed bigint, bytes_copied bigint")
    flags = lambda o: [r[0] for r in p.orderBy("job_id").select(ledger.converged(o)).collect()]
    assert flags(SyncOptions()) == [True, False, False, False, False]
    assert flags(SyncOptions(delta_files_below=10)) == [True, False, True, False, True]
    assert ledger.stop_decision(p, SyncOptions(max_passes=3)).where("job_id = 4").first()["decision"] == "COMPLETED"


def test_journal_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", 1, 0, "COPIED", "x"), (1, 1, "a", 1, 0, "COPIED", "x"), (1, 1, "a", 1, 1, "COPIED", "y"), (1, 2, "a", 2, 0, "ERROR", "x"), (2, 1, "a", 3, 0, "COPIED", "x")], "job_id int, pass_no int, agent_id string, seq bigint, place int, type string, rel_path string")
    path = str(tmp_path / "journal")
    append_journal(rows, path)
    assert read_journal(spark, path, 1).count() == 4 and read_journal(spark, path, 1, [2]).count() == 1 and read_journal(spark, path, 1, once=True).count() == 3
    with pytest.raises(ValueError, match="place"):
        append_journal(rows.drop("place"), path)
    counts = str(tmp_path / "counts")
    journal.persist_type_counts(rows, counts)
    journal.persist_type_counts(rows.where("job_id = 2"), counts)
    assert spark.read.parquet(counts).count() == 3
    journal.export_jsonl(rows.withColumns({c: F.lit(None).cast(t) for c, t in (("ts_ns", "long"), ("mode", "int"), ("sum_hi", "long"), ("sum_lo", "long"), ("errno", "int"), ("detail", "string"))}), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_listing_files_and_generator(spark, tmp_path):
    made = gen_listing(spark, 50, 7)
    assert made.count() == gen_listing(spark, 50, 7).count() == made.select("rel_path").distinct().count()
    per_dir = made.where("type = 'FILE' and rel_path not like '%hard'").groupBy(F.regexp_replace("rel_path", "/?[^/]*$", "")).count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert per_dir[0] >= 3 and per_dir[1] <= 7 and per_dir[2] == 50
    made.drop("content").write.parquet(str(tmp_path / "l"))
    assert read_listing(spark, str(tmp_path / "l")).count() == made.count()
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "f.txt").write_text("hello")
    (root / "g.bin").write_bytes(b"\0\1")
    found = {r["rel_path"]: (r["size"], bytes(r["content"])) for r in scan_objects(spark, str(root)).collect()}
    assert found == {"a/f.txt": (5, b"hello"), "g.bin": (2, b"\0\1")}


def test_posix_listing(spark, tmp_path):
    from driftline.sources.posix import read_posix

    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f").write_text("x")
    (tmp_path / "top").write_text("yy")
    os.symlink("nowhere", tmp_path / "d" / "link")
    os.mkfifo(tmp_path / "d" / "pipe")
    df = read_posix(spark, str(tmp_path))
    rows = {r["rel_path"]: r for r in df.collect()}
    assert {k: r["type"] for k, r in rows.items()} == {"d": "DIR", "d/e": "DIR", "d/e/f": "FILE", "d/link": "SYMLINK", "d/pipe": "FIFO", "top": "FILE"}
    assert rows["d/link"]["link_target"] == "nowhere" and rows["top"]["size"] == 2
    assert {r[0] for r in df.where(F.col("rel_path").startswith("d/e")).select("rel_path").collect()} == {"d/e", "d/e/f"}


def test_wide_directories_and_xattrs(spark, tmp_path):
    """A directory wider than a slice is read in slices, each entry once, with all beneath it; attributes come along."""
    from driftline.sources.posix import PosixReader, read_posix

    for i in range(25):
        (tmp_path / "wide" / f"d{i}" / "deep").mkdir(parents=True)
        (tmp_path / "wide" / f"d{i}" / "deep" / "f").write_text("x")
        (tmp_path / "wide" / f"f{i}").write_text("x")
    (tmp_path / "wide" / "link").symlink_to(tmp_path / "wide")
    expected = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))
    try:
        os.setxattr(tmp_path / "wide" / "f3", "user.note", b"kept")
        noted = b"kept"
    except OSError:
        noted = None
    for depth in (0, 1, 2):
        df = read_posix(spark, str(tmp_path), depth, names=7)
        assert sorted(r[0] for r in df.select("rel_path").collect()) == expected
    assert len(PosixReader(str(tmp_path), 1, 7, True).partitions()) == 9
    rows = {r["rel_path"]: r for r in read_posix(spark, str(tmp_path)).collect()}
    assert (rows["wide/f3"]["xattrs"] or {}).get("user.note") == noted and rows["wide/f3"]["xattrs"] is not None
    assert read_posix(spark, str(tmp_path), xattrs=False).where("xattrs is not null").count() == 0


def without_parent(snapshot):
    """Rows whose directory is missing or is no directory."""
    kinds = {r["rel_path"]: r["type"] for r in snapshot.collect()}
    return [p for p in kinds if "/" in p and kinds.get(p.rsplit("/", 1)[0]) != "DIR"]


def test_apply_moves_and_deletes_whole_subtrees(spark):
    src, dst = sides(spark)
    dst = dst.unionByName(listing(spark, entry("was_dir/sub", "DIR"), entry("was_dir/sub/f"), entry("o/deep2", "DIR"), entry("o/deep2/f")))
    planned = diff.plan(src, dst)
    lost = diff.plan_orphans(planned)
    assert {r[0] for r in diff.orphans(src, dst).select("rel_path").collect()} == {"o", "skip/lost", "skip2"}
    stale = next(r[0] for r in lost.select("rel_path").collect() if r[0].startswith(".sync.stale."))
    assert {r[0] for r in lost.select("rel_path").collect()} == {"o", "skip/lost", "skip2", stale}
    kept = diff.apply_plan(dst, planned)
    paths = {r["rel_path"]: r["type"] for r in kept.collect()}
    assert paths["was_dir"] == "FILE" and paths[stale] == "DIR" and paths[f"{stale}/sub"] == "DIR" and f"{stale}/sub/f" in paths and f"{stale}/kid" in paths
    assert not any(p.startswith("was_dir/") for p in paths) and "o/deep2/f" in paths and len(paths) == kept.count()
    assert without_parent(kept) == []
    gone = diff.apply_plan(dst, planned, lost)
    assert not any(p == "o" or p.startswith("o/") or p.startswith("skip2") for p in (r[0] for r in gone.select("rel_path").collect())) and without_parent(gone) == []


def test_delete_pass(spark, tmp_path):
    src, dst = sides(spark)
    out = str(tmp_path)
    run_passes(spark, lambda n: src, dst, out, SyncOptions(max_passes=1))
    snapshot = spark.read.parquet(f"{out}/pass=1/snapshot")
    for wrong in ("", "other"):
        with pytest.raises(ValueError):
            delete_pass(spark, out, 1, snapshot, "job", wrong)
    assert delete_pass(spark, out, 1, snapshot, "job", "job", dry_run=True) is snapshot
    left = delete_pass(spark, out, 1, snapshot, "job", "job")
    again = {r["action"]: r["count"] for r in diff.plan(src, left).groupBy("action").count().collect()}
    assert again.pop("DST_ONLY") == 2 and set(again) <= {"CLEAN", "DIR", "ERROR", "VANISHED"}  # temporary names are no orphans
    assert without_parent(left) == []
    journalled = spark.read.parquet(f"{out}/pass=2-delete/journal")
    assert journalled.count() == snapshot.count() - left.count() and {r[0] for r in journalled.select("type").distinct().collect()} == {"DELETED"}
    with pytest.raises(ValueError):
        run_passes(spark, lambda n: src, left, out + "/b", SyncOptions(max_passes=1))
        delete_pass(spark, out + "/b", 1, left, "job", "job")


def test_wide_directory_of_orphans(spark):
    """Most entries lie in one directory: they meet it under several keys."""
    src = listing(spark, entry("d", "DIR"))
    dst = listing(spark, entry("d", "DIR"), *[entry(f"d/x{i}") for i in range(200)])
    assert diff.orphans(src, dst).count() == diff.plan_orphans(diff.plan(src, dst)).count() == 200


def test_dirfix_follows_the_options(spark):
    src = listing(spark, entry("a", "DIR"), entry("b", "DIR", mode=0o755), entry("c", "DIR", mtime=5))
    dst = listing(spark, entry("a", "DIR", uid=9), entry("b", "DIR", mode=0o700), entry("c", "DIR"))
    planned = diff.plan(src, dst)
    rows = diff.to_journal(planned, diff.plan_orphans(planned), 1, 1)
    assert {r[0] for r in diff.dirfix(rows, dst).select("rel_path").collect()} == {"a", "b", "c"}
    assert {r[0] for r in diff.dirfix(rows, dst, SyncOptions(owner=False, times=False)).select("rel_path").collect()} == {"b"}


def test_quantiles_by_sketch(spark):
    rows = spark.range(20_000).selectExpr("'k' as kind", "id + 1 as wall_ms")
    exact, near = fleet.duration_quantiles(rows, accuracy=None).first(), fleet.duration_quantiles(rows).first()
    assert abs(exact["p50"] - near["p50"]) < 0.01 and abs(exact["p99"] - near["p99"]) < 0.01


def test_plan_shapes(spark):
    src, dst = sides(spark)
    text = diff.plan(src, dst)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    counted = diff.pass_counters(diff.plan(src, dst), diff.plan_orphans(diff.plan(src, dst)))
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in text and len(text) < 60_000
    text = tree.expand_deletes(diff.orphans(src, dst), dst)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scope_releases_what_is_not_kept(spark):
    from driftline import storage

    with storage.scope("outer"):
        with storage.scope("kept", "outer"):
            gone, kept, outer = (storage.materialize(spark.range(3), n) for n in ("gone", "kept", "outer"))
        assert not os.path.exists(gone._driftline_path) and os.path.exists(kept._driftline_path)
    assert not os.path.exists(kept._driftline_path) and outer.count() == 3
    storage.release(outer)
    assert not os.path.exists(outer._driftline_path)


def test_plans_hold_what_is_read(spark):
    """A narrow plan gives the journal, counters and orphans of the whole one, and its files hold no other fields; an outline gives the orphans from paths and types."""
    rows = lambda *r: spark.createDataFrame([(p, t, 420, 1, 1, n, 5, k) for p, t, n, k in r], "rel_path string, type string, mode int, uid bigint, gid bigint, size bigint, mtime_ns bigint, nlink int")
    src = rows(("d", "DIR", 0, 1), ("d/a", "FILE", 1, 1), ("d/b", "FILE", 2, 2), ("d/c", "FILE", 3, 1), ("d/t", "FILE", 4, 1))
    dst = rows(("d", "DIR", 0, 1), ("d/a", "FILE", 1, 1), ("d/b", "FILE", 2, 1), ("d/c", "FILE", 9, 1), ("d/t", "DIR", 0, 1), ("d/t/x", "FILE", 1, 1), ("d/lost", "FILE", 1, 1))
    whole = diff.plan(src, dst)
    narrow = diff.written_plan(src, dst, fields=("nlink",), clean=False)
    counted = diff.written_plan(src, dst, fields=("nlink", "size"))
    outline = diff.outline(src, dst)
    assert narrow.schema["src"].dataType.names == ["type", "nlink"] and outline.schema["src"].dataType.names == ["type"]
    assert {r["rel_path"] for r in narrow.collect()} == {r["rel_path"] for r in whole.collect()} - {"d/a"}
    found = lambda p: sorted(map(tuple, diff.plan_orphans(p).collect()))
    assert found(whole) == found(narrow) == found(outline) and len(found(outline)) == 2
    journal = lambda p: sorted(map(tuple, diff.to_journal(p, diff.plan_orphans(p).select("rel_path"), 1, 1).select("type", "rel_path").collect()))
    assert journal(whole) == journal(narrow)
    assert diff.pass_counters(whole, diff.plan_orphans(whole)).first() == diff.pass_counters(counted, diff.plan_orphans(counted)).first()
