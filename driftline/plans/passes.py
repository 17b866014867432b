"""Repeated passes: diff, journal, apply, until the delta converges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.paths import root_above
from driftline.operators.diff import apply_plan, pass_counters, plan, plan_changes, plan_of_changes, plan_orphans, rows_aside, set_aside, to_journal
from driftline.operators.tree import delete_journal, expand_deletes
from driftline.options import SyncOptions
from driftline.sources.snapshots import BUCKETS, changed_buckets, compact, read_snapshot, write_delta
from driftline.storage import complete_numbers


def _kept(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """rows, written; in place of what an earlier run left there."""
    rows.write.mode("overwrite").parquet(path, compression="zstd")
    return spark.read.schema(rows.schema).parquet(path)


def run_passes(spark: SparkSession, src: Callable[[int], DataFrame], dst: DataFrame, out: str, opts: SyncOptions = SyncOptions(), job: int = 1) -> list[dict]:
    """Reconcile dst with src(pass_no) pass by pass until a pass changes nothing (or less than
    the thresholds), at most opts.max_passes. Every pass writes its plan, its journal and the new
    snapshot below `out`, so a pass that fails is run again from its predecessor's snapshot.
    Both sides are counted before they meet (stored listings by their footers), the plan is the
    one join of them, and what is few is written once: directories set aside, and orphans.

    Returns the counters of each pass, one row of numbers each.
    """
    done = []
    for pass_no in range(1, opts.max_passes + 1):
        source = src(pass_no)
        base = f"{out}/pass={pass_no}"
        kept = lambda rows, name: _kept(spark, rows, f"{base}/{name}")
        planned = kept(plan(source, dst, opts, source.count() + dst.count()), "plan")
        aside = kept(rows_aside(planned, job, pass_no, opts), "aside")
        lost = kept(plan_orphans(planned, job, pass_no, opts, aside), "orphans")
        kept(to_journal(planned, lost.select("rel_path"), job, pass_no, opts), "journal")
        counters = pass_counters(planned, lost).first().asDict() | {"pass_no": pass_no}
        if not opts.dry_run:
            dst = kept(apply_plan(dst, planned, None, job, pass_no, opts, aside), "snapshot")
        files = counters["files_copied"] + counters["meta_fixed"]
        counters["converged"] = (
            (files == 0 and counters["bytes_copied"] == 0)
            or (opts.delta_files_below > 0 and files < opts.delta_files_below)
            or (opts.delta_bytes_below > 0 and counters["bytes_copied"] < opts.delta_bytes_below)
        )
        done.append(counters)
        if counters["converged"] or opts.dry_run:
            break
    return done


def delete_pass(spark: SparkSession, out: str, pass_no: int, dst: DataFrame, job_name: str, confirm: str, job: int = 1, dry_run: bool = False) -> DataFrame:
    """Delete what pass `pass_no` reported as orphans, with all beneath it, from the snapshot dst.

    Nothing is scanned again: the roots are those of the pass's journal. The journal of the
    delete pass and the new snapshot are written below `out`; a dry run reports the roots only
    and leaves dst. The caller must name the job, and there must be orphans.
    """
    if confirm != job_name:
        raise ValueError("a delete pass needs a confirmation equal to the job name")
    roots = spark.read.parquet(f"{out}/pass={pass_no}/journal").where("type = 'ORPHAN'").select("rel_path").distinct()
    if roots.isEmpty():
        raise ValueError("the previous pass reported no orphans")
    base, removed = f"{out}/pass={pass_no + 1}-delete", expand_deletes(roots, dst)
    rows = delete_journal(removed, roots, dry_run).select(F.lit(job).alias("job_id"), F.lit(pass_no + 1).alias("pass_no"), "type", "rel_path")
    rows.write.mode("overwrite").parquet(f"{base}/journal")
    if dry_run:
        return dst
    dst.join(removed.select("rel_path"), "rel_path", "left_anti").write.mode("overwrite").parquet(f"{base}/snapshot")
    return spark.read.parquet(f"{base}/snapshot")


def _in_the_way(pairs: DataFrame) -> DataFrame:
    """Directories of the destination that something else of the source is to replace."""
    return pairs.where("in_src and in_dst and dst.type = 'DIR' and src.type <> 'DIR'").select(F.col("rel_path").alias("root"))


def _topmost_lost(planned: DataFrame, aside: DataFrame) -> DataFrame:
    """rel_path and type of what the source lost and the destination still has, as far as nothing above it is so, and of directories set aside."""
    lost = planned.where("action = 'DST_ONLY'").select("rel_path", F.col("dst.type").alias("type"))
    above = lost.select(F.col("rel_path").alias("root")).unionByName(aside.select(F.col("rel_path").alias("root")))
    beneath = root_above(lost.select("rel_path"), above, beneath=True).select("rel_path")
    return lost.join(beneath, "rel_path", "left_anti").unionByName(aside.select(F.col("stale_path").alias("rel_path"), F.lit("DIR").alias("type")))


def incremental_pass(arrived: DataFrame, out: str, number: int, opts: SyncOptions = SyncOptions(), job: int = 1, buckets: int = BUCKETS, compact_every: int = 10) -> dict:
    """Reconcile what arrived, and nothing else: the paths of the batch are joined with their buckets of the destination.

    arrived: entries of the source that are new or changed, and removed (true for a path that is
    gone there); a path that comes more than once counts with its largest `ts_ns` if there is one.
    The destination is the snapshot <out>/dst (base and deltas), of which only the buckets of
    those paths are read, and to which a delta with the changes is written. Directories in the
    way of something else are rare and deep: only if there are any, what lies beneath them is
    looked up in the other buckets. A pass that fails is run again under its number from the
    snapshot before it. Returns the counters of the pass.
    """
    spark, base = arrived.sparkSession, f"{out}/pass={number}"
    kept = lambda rows, name: _kept(spark, rows, f"{base}/{name}")

    order = [F.col(c).desc() for c in ("ts_ns", "removed") if c in arrived.columns]
    newest = arrived.withColumn("__k", F.row_number().over(Window.partitionBy("rel_path").orderBy(*order))).where("__k = 1").drop("__k", "ts_ns")
    dst = read_snapshot(spark, f"{out}/dst", changed_buckets(arrived, buckets), number - 1)
    planned = kept(plan_of_changes(newest, dst, opts), "plan")  # both sides meet by their paths once
    roots = _in_the_way(planned)
    if not roots.isEmpty():
        whole = read_snapshot(spark, f"{out}/dst", None, number - 1)
        beneath = root_above(whole, roots, beneath=True).drop("root").dropDuplicates(["rel_path"]).join(planned.select("rel_path"), "rel_path", "left_anti")
        kept(plan(newest.where("false").drop("removed"), beneath, opts), "plan-deep")
        planned = spark.read.schema(planned.schema).parquet(f"{base}/plan", f"{base}/plan-deep")
    aside = kept(set_aside(planned, job, number, opts), "aside")
    lost = kept(_topmost_lost(planned, aside), "orphans")
    to_journal(planned, lost.select("rel_path"), job, number, opts).write.mode("overwrite").parquet(f"{base}/journal")
    counters = pass_counters(planned, lost).first().asDict() | {"pass_no": number}
    if not opts.dry_run:
        changed, gone = plan_changes(dst, planned, aside)
        changed = changed.select(*[c for c in dst.columns if c in changed.columns])
        write_delta(changed, gone, f"{out}/dst", number, buckets)
        compact(spark, f"{out}/dst", compact_every, buckets)
    return counters


def incremental_passes(changes: DataFrame, out: str, opts: SyncOptions = SyncOptions(), job: int = 1, buckets: int = BUCKETS, compact_every: int = 10):
    """A streaming query over the changes of the source: each trigger reconciles what arrived since the last one.

    Passes are numbered from 1 by micro-batch; start() it with a checkpoint below `out`, so that
    a query that ends goes on where it stopped. Counters are written to <out>/counters.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        row = incremental_pass(batch, out, batch_id + 1, opts, job, buckets, compact_every)
        spark.createDataFrame([row], ", ".join(f"{k} bigint" for k in row)).write.mode("overwrite").parquet(f"{out}/counters/n={batch_id + 1}")  # one row

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True)


def pass_history(spark: SparkSession, out: str) -> DataFrame:
    """The counters of all incremental passes."""
    return spark.read.parquet(*[f"{out}/counters/n={n}" for n in complete_numbers(spark, f"{out}/counters")])
