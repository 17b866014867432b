"""The journal of actions: filters, views, histograms, errors, verification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.formats import errno_class, octal_mode, sum_hex
from driftline.functions.hashing import content_sum, in_sample, sample_ppm
from driftline.operators.diff import mode_differs, mtime_equal, xattrs_equal
from driftline.options import SyncOptions

ERROR_TYPES = ("ERROR", "FIDELITY_EXCEPTION", "VERIFY_FAIL")
DEFAULT_PAGE, LARGEST_PAGE = 1000, 10_000


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("rel_path").startswith(prefix))


def by_type(journal: DataFrame, kind: str) -> DataFrame:
    """Case does not matter, nor does a leading JR_."""
    return journal.where(F.col("type") == re.sub("^JR_", "", kind.upper()))


def error_class() -> Column:
    return F.when(F.col("type") == "VERIFY_FAIL", "VERIFY_FAIL").otherwise(errno_class(F.col("errno")))


def errors(journal: DataFrame, cls: str | None = None, prefix: str | None = None) -> DataFrame:
    """Errors with their class, optionally one class and one path prefix."""
    found = journal.where(F.col("type").isin(*ERROR_TYPES)).withColumn("class", error_class())
    found = by_prefix(found, prefix) if prefix else found
    return found.where(F.col("class") == cls) if cls else found


def errors_by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(F.count("*").alias("n"))


def select_passes(df: DataFrame, which: str | int = "all", key: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """All passes, the latest of each job, or one number."""
    if which in ("", "all"):
        return df
    if which == "latest":
        last = df.groupBy(*key).agg(F.max("pass_no").alias("pass_no"))
        return df.join(last, [*key, "pass_no"], "left_semi")
    return df.where(F.col("pass_no") == int(which))


def page(df: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, order_by: tuple[str, ...] = ("pass_no", "ts_ns", "rel_path")) -> tuple[DataFrame, DataFrame]:
    """A page of rows in order, and one row telling whether more remain. The limit counts after all filters."""
    limit = min(max(limit, 1), LARGEST_PAGE)
    rows = df.orderBy(*order_by).offset(offset).limit(limit + 1)
    return rows.limit(limit), rows.agg((F.count("*") > limit).alias("truncated"))


def record_view(journal: DataFrame) -> DataFrame:
    """How a record is shown: octal mode, 32 hexadecimal digits, errno symbol, null for what is absent."""
    some = lambda c, when: F.when(when, c)
    return journal.select(
        "pass_no", F.regexp_replace("type", "^JR_", "").alias("type"), "rel_path", "ts_ns",
        some(octal_mode(F.col("mode")), F.col("mode").isNotNull()).alias("mode"),
        some(sum_hex(F.col("sum_hi"), F.col("sum_lo")), (F.col("sum_hi") != 0) | (F.col("sum_lo") != 0)).alias("sum"),
        some(errno_class(F.col("errno")), F.col("errno") != 0).alias("errno"), some(F.col("detail"), F.col("detail") != "").alias("detail"),
    )


def adhoc_filter(df: DataFrame, text: str) -> DataFrame:
    """Terms `column op value` joined by commas (and); ops = != > < and ~ (contains, any case). Blank keeps all."""
    for term in filter(None, (t.strip() for t in text.split(","))):
        m = re.fullmatch(r"(\w+)\s*(!=|=|>|<|~)\s*(.*)", term, re.S)
        if not m:
            raise ValueError(f"malformed term {term!r}")
        name, op, value = m.groups()
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
        c, kind = F.col(name), df.schema[name].dataType
        v = F.lit(value).cast(kind)
        if op == "~":
            df = df.where(F.instr(F.lower(c.cast("string")), F.lit(value.lower())) > 0)
        else:
            df = df.where({"=": c == v, "!=": c != v, ">": c > v, "<": c < v}[op])
    return df


def split_suspicious(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows refused because their path is empty or holds two dots in a row."""
    bad = F.col("rel_path").isNull() | (F.col("rel_path") == "") | F.col("rel_path").contains("..")
    return df.where(~bad), df.where(bad)


def type_hist(journal: DataFrame, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """Records by type as they are, repeats included."""
    journal = by_type(journal, kind) if kind else journal
    return (by_prefix(journal, prefix) if prefix else journal).groupBy("type").agg(F.count("*").alias("n"))


def type_counts(journal: DataFrame, key: tuple[str, ...] = ("job_id", "pass_no")) -> DataFrame:
    """Distinct (pass, type, path), since retries repeat records; types that do not occur are left out."""
    once = journal.select(*key, "type", "rel_path").distinct()
    return once.groupBy(*key, "type").agg(F.count("*").alias("n"))


def job_type_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("job_id", "type").agg(F.sum("n").alias("n"))


def persist_type_counts(journal: DataFrame, path: str) -> None:
    """Write the histogram partitioned by job and pass; writing a pass again replaces it, others stay."""
    type_counts(journal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "pass_no").parquet(path)


def orphan_paths(journal: DataFrame) -> DataFrame:
    return journal.where("type = 'ORPHAN'").select("rel_path").distinct().orderBy("rel_path")


def verify_sample(journal: DataFrame, rate: float) -> DataFrame:
    """Copied and fixed rows once each, and whether their content is compared: a sample of copied
    files by path hash, and always the smallest path of a pass that copied anything.
    """
    ppm = sample_ppm(rate)
    rows = journal.where("type in ('COPIED', 'META_FIXED')").select("job_id", "pass_no", "type", "rel_path").distinct()
    hit = (F.col("type") == "COPIED") & in_sample(F.col("rel_path"), ppm)
    rows = rows.withColumn("sampled", hit)
    first = rows.where("type = 'COPIED'").groupBy("job_id", "pass_no").agg(F.min("rel_path").alias("rel_path"), F.max("sampled").alias("some"))
    floor = first.where(~F.col("some")).select("job_id", "pass_no", F.lit("COPIED").alias("type"), "rel_path", F.lit(ppm > 0).alias("floor"))
    joined = rows.join(floor, ["job_id", "pass_no", "type", "rel_path"], "left")
    return joined.select("job_id", "pass_no", "type", "rel_path", (F.col("sampled") | F.coalesce("floor", F.lit(False))).alias("sampled"))


def verify(rows: DataFrame, src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """rel_path, type (VERIFY_OK, VERIFY_FAIL), detail: the first check that fails. rows: rel_path,
    sampled. A source that has vanished is ok.
    """
    def packed(df: DataFrame, side: str) -> DataFrame:
        return df.select("rel_path", F.struct(*[c for c in df.columns if c != "rel_path"]).alias(side))

    both = rows.join(packed(src, "src"), "rel_path", "left").join(packed(dst, "dst"), "rel_path", "left")
    s, d = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    has = set(src.columns) & set(dst.columns)
    is_file = s("type") == "FILE"
    why = F.when(F.col("dst").isNull(), "missing").when(s("type") != d("type"), "type mismatch").when(is_file & (s("size") != d("size")), "size mismatch")
    why = why.when(is_file & ~mtime_equal(s("mtime_ns"), d("mtime_ns"), opts.mtime_slop_ns), "mtime mismatch")
    why = why.when((s("uid") != d("uid")) | (s("gid") != d("gid")), "owner mismatch").when(mode_differs(s("mode"), d("mode")), "mode mismatch")
    if "xattrs" in has:
        why = why.when(~xattrs_equal(s("xattrs"), d("xattrs"), opts), "xattr mismatch")
    if "content" in has:
        why = why.when(is_file & F.col("sampled") & (content_sum(s("content")) != content_sum(d("content"))), "checksum mismatch")
    detail = F.when(F.col("src").isNotNull(), why)
    return both.select("rel_path", F.when(detail.isNull(), "VERIFY_OK").otherwise("VERIFY_FAIL").alias("type"), F.coalesce(detail, F.lit("")).alias("detail"))


def recopy(verified: DataFrame, src: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Regular files that failed verification and are to be copied again."""
    if opts.dry_run or opts.on_mismatch == "fail":
        return verified.where("false").select("rel_path")
    files = src.where("type = 'FILE'").select("rel_path")
    return verified.where("type = 'VERIFY_FAIL'").join(files, "rel_path", "left_semi").select("rel_path")


def audit_sums(journal: DataFrame, dst: DataFrame) -> DataFrame:
    """rel_path, state (match, differs, missing) of recorded checksums against the destination's content. journal: rel_path, sum."""
    now = dst.select("rel_path", content_sum(F.col("content")).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sum"), "match").otherwise("differs")
    return journal.join(now, "rel_path", "left").select("rel_path", state.alias("state"))


def export_jsonl(journal: DataFrame, path: str) -> None:
    record_view(journal).write.mode("overwrite").json(path)
