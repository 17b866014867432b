"""Jobs, passes and work items: summaries, reports, convergence, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import trimmed
from driftline.options import SyncOptions

#: Job states that are final, and those a running or waiting job is in.
TERMINAL = ("COMPLETED", "CANCELLED", "FAILED")
HELD = {"submit": ("CREATED", "READY", "RUNNING", "PAUSED"), "start": ("RUNNING", "PAUSED")}
PHASES = {"Ready": ("CREATED", "READY"), "Running": ("RUNNING", "PAUSED"), "Finished": TERMINAL}
#: Pass states in order of rank, and the state a kind of work belongs to.
PASS_STATES = ("PENDING", "PROBING", "SCANNING", "DIRFIX", "LINKFIX", "VERIFY", "DELETE", "COMPLETE")
KIND_STATES = {"dirfix": "DIRFIX", "linkfix": "LINKFIX", "verify": "VERIFY", "delete": "DELETE"}
WALK_KINDS = ("dir", "entrylist")
_PASS = ["job_id", "pass_no"]


def jobs_by_phase(jobs: DataFrame, phase: str) -> DataFrame:
    """phase: active, terminal, Ready, Running or Finished."""
    if phase == "active":
        return jobs.where(~F.col("state").isin(*TERMINAL))
    return jobs.where(F.col("state").isin(*(TERMINAL if phase == "terminal" else PHASES[phase])))


def purge_jobs(jobs: DataFrame, state: str = "COMPLETED", older_than_ms: int | None = None, now_ms: int = 0) -> DataFrame:
    """Finished jobs to remove; with older_than_ms, only those not updated since then."""
    states = TERMINAL if state == "TERMINAL" else (state,)
    if not set(states) <= set(TERMINAL):
        raise ValueError("only finished jobs can be purged")
    found = jobs.where(F.col("state").isin(*states))
    return found if older_than_ms is None else found.where(F.col("updated_ms") < now_ms - older_than_ms)


def without_jobs(child: DataFrame, victims: DataFrame) -> DataFrame:
    """A table that hangs on jobs, less the rows of purged ones."""
    return child.join(victims.select("job_id"), "job_id", "left_anti")


def purge(tables: dict[str, DataFrame], state: str = "COMPLETED", older_than_ms: int | None = None, now_ms: int = 0, dry_run: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The jobs that go (job_id, name), and all tables (jobs and whatever hangs on a job_id) less their rows; in a dry run the tables as they are."""
    victims = purge_jobs(tables["jobs"], state, older_than_ms, now_ms)
    left = tables if dry_run else {name: without_jobs(table, victims) for name, table in tables.items()}
    return victims.select("job_id", "name"), left


def ledger(items: DataFrame, passes: DataFrame, jobs: DataFrame) -> DataFrame:
    named = jobs.select("job_id", "name", F.col("state").alias("job_state"))
    return items.join(passes.select(*_PASS, F.col("state").alias("pass_state")), _PASS).join(named, "job_id")


def accumulate(results: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of items summed into their pass."""
    return results.groupBy(*_PASS).agg(*[F.sum(c).alias(c) for c in counters])


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(*_PASS, "kind", "state").agg(F.count("*").alias("n"))


def state_counts(items: DataFrame, passes: DataFrame) -> DataFrame:
    """Items by pass and state; finished items that were compacted away count as DONE again."""
    live = item_counts(items).select(*_PASS, "state", "n")
    reaped = passes.where("items_reaped > 0").select(*_PASS, F.lit("DONE").alias("state"), F.col("items_reaped").alias("n"))
    return live.unionByName(reaped).groupBy(*_PASS, "state").agg(F.sum("n").alias("n"))


def _rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PASS_STATES)), state)


def effective_state(passes: DataFrame, items: DataFrame) -> DataFrame:
    """job_id, pass_no, state: the later of the stored state and the phase of any kind of work present."""
    of_kind = F.create_map(*[F.lit(x) for kv in KIND_STATES.items() for x in kv])
    present = items.where(F.col("kind").isin(*KIND_STATES)).groupBy(*_PASS).agg(F.max(_rank(F.element_at(of_kind, F.col("kind")))).alias("present"))
    joined = passes.join(present, _PASS, "left")
    rank = F.greatest(_rank(F.col("state")), F.coalesce("present", F.lit(0)))
    return joined.select(*_PASS, F.element_at(F.array(*map(F.lit, PASS_STATES)), rank.cast("int")).alias("state"))


def job_summaries(jobs: DataFrame, passes: DataFrame, items: DataFrame) -> DataFrame:
    """Per job: passes, lifetime files, bytes and errors, and the latest pass; zeros where there is none."""
    states = effective_state(passes, items).withColumnRenamed("state", "now")
    last = F.max_by(F.struct("pass_no", "now", "entries_walked"), "pass_no")
    totals = passes.join(states, _PASS).groupBy("job_id").agg(
        F.count("*").alias("n_passes"), F.sum("files_copied").alias("files"), F.sum("bytes_copied").alias("bytes"), F.sum("errors").alias("errors"), last.alias("last")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return jobs.join(totals, "job_id", "left").select(
        "name", zero(F.col("n_passes")).alias("n_passes"), zero(F.col("files")).alias("files"), zero(F.col("bytes")).alias("bytes"), zero(F.col("errors")).alias("errors"),
        zero(F.col("last.pass_no")).alias("last_pass"), F.coalesce("last.now", F.lit("")).alias("last_state"), zero(F.col("last.entries_walked")).alias("walked"),
    )


def pass_report(passes: DataFrame) -> DataFrame:
    """Per pass: delta_files, delta_bytes and duration (null while it runs)."""
    return passes.select(
        *_PASS, (F.col("files_copied") + F.col("meta_fixed")).alias("delta_files"), F.col("bytes_copied").alias("delta_bytes"),
        (F.col("finished_ms") - F.col("started_ms")).alias("duration_ms"),
    )


def job_report(jobs: DataFrame, passes: DataFrame, items: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per job: totals, convergence, orphans that remain, whether a delete pass ran, parked items.

    Orphans are those of the last pass that walked; a later pass that walked nothing but
    counts orphans was a delete pass and leaves none.
    """
    matters = (F.col("entries_walked") > 0) | (F.col("orphans") > 0)
    left = F.when(F.col("entries_walked") > 0, F.col("orphans")).otherwise(0)
    deleted = (F.col("entries_walked") == 0) & (F.col("orphans") > 0)
    sums = [F.sum(c).alias(c) for c in ("files_copied", "bytes_copied", "meta_fixed", "errors", "verify_ok", "verify_fail")]
    totals = passes.groupBy("job_id").agg(
        *sums, F.max_by(F.when(matters, left), F.when(matters, F.col("pass_no"))).alias("orphans"), F.bool_or(deleted).alias("delete_pass_ran")
    )
    parked = items.where("state = 'PARKED'").groupBy("job_id").agg(F.count("*").alias("parked"))
    report = jobs.join(totals, "job_id", "left").join(parked, "job_id", "left").select(
        "job_id", "name", "state", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files_copied", "bytes_copied", "meta_fixed", "errors", "verify_ok", "verify_fail")],
        (F.col("state") == "COMPLETED").alias("converged"), F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans_remaining"),
        F.coalesce("delete_pass_ran", F.lit(False)).alias("delete_pass_ran"), F.coalesce("parked", F.lit(0)).cast("long").alias("parked"),
    )
    if counts is None:
        return report
    summary = counts.groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("journal_summary"), F.sum("n").alias("journal_total"))
    return report.join(summary, "job_id", "left")


def report_json(report: DataFrame, passes: DataFrame) -> DataFrame:
    """One JSON document per job, its passes nested in order."""
    nested = pass_report(passes).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("pass_no", "delta_files", "delta_bytes", "duration_ms"))).alias("passes"))
    return report.join(nested, "job_id", "left").select("name", F.to_json(F.struct("*")).alias("document"))


def report_footer(passes: DataFrame) -> DataFrame:
    """The passes of a report and a TOTAL of what adds up; orphans are a census and do not."""
    rows = passes.select(F.col("pass_no").cast("string").alias("pass"), "job_id", "files_copied", "bytes_copied", "errors", F.col("orphans").cast("long").alias("orphans"))
    total = rows.groupBy("job_id").agg(F.sum("files_copied").alias("files_copied"), F.sum("bytes_copied").alias("bytes_copied"), F.sum("errors").alias("errors"))
    return rows.unionByName(total.select(F.lit("TOTAL").alias("pass"), "*", F.lit(None).cast("long").alias("orphans")))


def pass_detail(passes: DataFrame, items: DataFrame, now_ms: int) -> DataFrame:
    """Counters, duration and a map of item states per pass."""
    states = state_counts(items, passes).groupBy(*_PASS).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("states"))
    lasted = F.greatest(F.lit(0), F.coalesce("finished_ms", F.lit(now_ms)) - F.col("started_ms"))
    return passes.join(states, _PASS, "left").withColumn("duration_ms", lasted)


def converged(opts: SyncOptions = SyncOptions()) -> Column:
    """Nothing was copied or fixed, or less than a threshold that is set."""
    files = F.col("files_copied") + F.col("meta_fixed")
    out = (F.col("files_copied") == 0) & (F.col("meta_fixed") == 0) & (F.col("bytes_copied") == 0)
    if opts.delta_files_below > 0:
        out = out | (files < opts.delta_files_below)
    if opts.delta_bytes_below > 0:
        out = out | (F.col("bytes_copied") < opts.delta_bytes_below)
    return out


def stop_decision(passes: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """job_id, stop_pass, decision: the first pass that converged or reached the maximum completes the job; else a manual job waits and others go on."""
    stop = F.when(converged(opts) | (F.col("pass_no") >= opts.max_passes), F.col("pass_no"))
    found = passes.groupBy("job_id").agg(F.min(stop).alias("stop_pass"))
    otherwise = "WAIT" if opts.mode_name == "manual" else "CONTINUE"
    return found.withColumn("decision", F.when(F.col("stop_pass").isNotNull(), "COMPLETED").otherwise(otherwise))


def trajectory(passes: DataFrame) -> DataFrame:
    """delta_files per pass, its change and its ratio to the pass before."""
    w = Window.partitionBy("job_id").orderBy("pass_no")
    delta = pass_report(passes).withColumn("before", F.lag("delta_files").over(w))
    return delta.select(
        *_PASS, "delta_files", (F.col("delta_files") - F.col("before")).alias("change"),
        F.when(F.col("before") > 0, F.col("delta_files") / F.col("before")).alias("ratio"),
    )


def latest_pass(passes: DataFrame) -> DataFrame:
    return passes.groupBy("job_id").agg(F.max_by(F.struct("pass_no", "state"), "pass_no").alias("p")).select("job_id", "p.*")


def active_pass(passes: DataFrame) -> DataFrame:
    """The newest pass that is not complete."""
    return latest_pass(passes.where("state <> 'COMPLETE'"))


def durations(passes: DataFrame, now_ms: int) -> DataFrame:
    """Finished passes as they lasted, running ones until now, never negative."""
    return passes.select(*_PASS, F.greatest(F.lit(0), F.coalesce("finished_ms", F.lit(now_ms)) - F.col("started_ms")).alias("duration_ms"))


def running_time(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Running time of jobs that run; null for others."""
    return jobs.select("job_id", F.when(F.col("state") == "RUNNING", F.greatest(F.lit(0), F.lit(now_ms) - F.col("created_ms"))).alias("running_ms"))


def job_status(report: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("parked") > 0, "needs attention").when((F.col("errors") > 0) | (F.col("verify_fail") > 0), "with errors")
        .when(F.col("converged"), "converged").otherwise("completed")
    )
    return report.select("name", status.alias("status"))


def pass_status(passes: DataFrame, jobs: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    done = jobs.select("job_id", (F.col("state") == "COMPLETED").alias("done"))
    status = F.when((F.col("errors") > 0) | (F.col("verify_fail") > 0), "with errors").when(F.col("done") & converged(opts), "converged").otherwise("ok")
    return passes.join(done, "job_id").select(*_PASS, status.alias("status"))


def dest_conflicts(jobs: DataFrame, when: str) -> DataFrame:
    """name, other: jobs whose destination equals, contains or lies in that of another live job.

    Each destination is exploded into the directories above it, so overlap is an equi-join.
    """
    base = jobs.select("name", trimmed(F.col("destination")).alias("d"), "state")
    parts = F.split("d", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = base.select("name", "state", F.explode(above).alias("at"))
    own = base.select(F.col("name").alias("other"), F.col("state").alias("o_state"), F.col("d").alias("at"))
    inside = up.join(own, "at").where("name <> other")
    live = F.col("o_state").isin(*HELD[when])
    one = inside.where(live).select("name", "other")
    two = inside.where(F.col("state").isin(*HELD[when])).select(F.col("other").alias("name"), F.col("name").alias("other"))
    return one.unionByName(two).distinct()


def queue_summary(items: DataFrame, passes: DataFrame, jobs: DataFrame) -> DataFrame:
    """job, pass_no, kind, state, n: live items of passes that run, parked ones of any pass, and those compacted away."""
    named = passes.select(*_PASS, F.col("state").alias("pass_state"), "items_reaped").join(jobs.select("job_id", "name"), "job_id")
    counts = item_counts(items).join(named, _PASS)
    live = counts.where("pass_state <> 'COMPLETE'").select("name", "pass_no", "kind", "state", "n")
    parked = counts.where("state = 'PARKED'").select("name", "pass_no", "kind", "state", "n")
    reaped = named.where("pass_state <> 'COMPLETE' and items_reaped > 0").select("name", "pass_no", F.lit("reaped").alias("kind"), F.lit("DONE").alias("state"), F.col("items_reaped").cast("long").alias("n"))
    return live.unionByName(parked).unionByName(reaped).distinct().orderBy("name", "pass_no", "kind", "state")


def parked(items: DataFrame, passes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Parked items with their job, oldest first."""
    return ledger(items.where("state = 'PARKED'"), passes, jobs).orderBy("updated_ms", "item_id")


def retry_parked(items: DataFrame, job_id: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Parked items, by job or id, back in the queue with attempt, holder and error reset."""
    hit = _parked(job_id, ids)
    return items.withColumns({
        "attempt": F.when(hit, 0).otherwise(F.col("attempt")), "holder": F.when(hit, F.lit(None)).otherwise(F.col("holder")),
        "error": F.when(hit, "").otherwise(F.col("error")), "state": F.when(hit, "QUEUED").otherwise(F.col("state")),
    })


def drop_parked(items: DataFrame, job_id: int | None = None, ids: list[int] | None = None) -> DataFrame:
    return items.where(~_parked(job_id, ids))


def _parked(job_id: int | None, ids: list[int] | None) -> Column:
    hit = F.col("state") == "PARKED"
    hit = hit & (F.col("job_id") == job_id) if job_id is not None else hit
    return hit & F.col("item_id").isin(ids) if ids is not None else hit


def auto_retry(items: DataFrame, retried: DataFrame) -> DataFrame:
    """Passes that get their one automatic retry: nothing queued or leased, something parked, not retried before (retried: job_id, pass_no)."""
    state = lambda *s: F.sum(F.when(F.col("state").isin(*s), 1).otherwise(0))
    idle = items.groupBy(*_PASS).agg(state("QUEUED", "LEASED").alias("open"), state("PARKED").alias("parked")).where("open = 0 and parked > 0")
    return idle.join(retried, _PASS, "left_anti").select(*_PASS, "parked")


def compact_items(items: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The items less finished ones of some kinds, and how many of each pass were dropped."""
    gone = (F.col("state") == "DONE") & F.col("kind").isin(kinds)
    return items.where(~gone), items.where(gone).groupBy(*_PASS).agg(F.count("*").alias("items_reaped"))


def effective_results(results: DataFrame, items: DataFrame) -> DataFrame:
    """Results whose lease is the item's current one; stale and repeated results are dropped."""
    current = items.where("state = 'LEASED'").select("item_id", "lease_id")
    return results.join(current, ["item_id", "lease_id"], "left_semi").dropDuplicates(["item_id", "lease_id"])


def fleet_load(items: DataFrame, passes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Walk items that are queued or leased, and all queued items, of running jobs."""
    rows = ledger(items, passes, jobs).where("job_state = 'RUNNING'")
    walk = F.col("kind").isin(*WALK_KINDS) & F.col("state").isin("QUEUED", "LEASED")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(count(walk).alias("walk_pending"), count(F.col("state") == "QUEUED").alias("queued"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
