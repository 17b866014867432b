"""Trees: directory sizes, deletes, batches, chunks and hard links.

Containment is an equi-join: a path is exploded into the directories above it, and only
key columns are carried through the explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import depth, parent, prefixes, root_above
from driftline.storage import dealt


def directory_sizes(listing: DataFrame) -> DataFrame:
    return listing.groupBy(parent(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("n"))


def wide_dirs(listing: DataFrame, threshold: int = 50_000, batch: int = 4000) -> DataFrame:
    """Directories with more than threshold entries, and the slices of `batch` they fall into (deletes: 200,000 and 20,000)."""
    wide = directory_sizes(listing).where(F.col("n") > threshold)
    return wide.withColumn("slices", F.ceil(F.col("n") / F.lit(float(batch))).cast("long"))


def subtree_totals(listing: DataFrame) -> DataFrame:
    """dir, objects and bytes of everything beneath each directory, the root included. Entries are summed by their parent first; only parents are exploded."""
    own = listing.where("rel_path <> ''").groupBy(parent(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    rows = own.select(F.explode(F.concat(F.array(F.lit("")), prefixes(F.col("parent")))).alias("dir"), "n", "size")
    return rows.groupBy("dir").agg(F.sum("n").alias("objects"), F.sum("size").alias("bytes"))


def over_budget(listing: DataFrame, budget: int = 2000) -> DataFrame:
    """Subtrees with more objects than the budget (deletes: 250,000)."""
    return subtree_totals(listing).where(F.col("objects") > budget)


def expand_deletes(roots: DataFrame, dst: DataFrame) -> DataFrame:
    """Every destination row that is an orphan root or lies beneath one; each once."""
    hit = root_above(dst.select("rel_path"), roots.select(F.col("rel_path").alias("root")).distinct()).select("rel_path").distinct()
    return dst.join(hit, "rel_path", "left_semi")


def deepest_first(df: DataFrame) -> DataFrame:
    return df.withColumn("depth", depth(F.col("rel_path"))).orderBy(F.col("depth").desc(), "rel_path")


#: Batch sizes by kind of work.
BATCH_SIZES = {"verify": 500, "dirfix": 1000, "delete": 1000, "linkfix": 2000, "entrylist": 4000}


def batches(df: DataFrame, size: int, key: list[str], order: list[str]) -> DataFrame:
    """Numbers batches of at most `size` rows within each key, from 0. For work without a key
    of its own a hash bucket is the key (bucketed), never one window over everything.
    """
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("batch", ((number - number % size) / size).cast("long"))


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("rel_path"), F.lit(buckets)).cast("int"))


def delete_plan(roots: DataFrame, dst: DataFrame, job_name: str, confirm: str, size: int = 1000, buckets: int = 64) -> DataFrame:
    """Objects to delete, deepest first within numbered batches; the caller must name the job, and there must be orphans."""
    if confirm != job_name:
        raise ValueError("a delete pass needs a confirmation equal to the job name")
    if roots.isEmpty():
        raise ValueError("the previous pass reported no orphans")
    rows = bucketed(expand_deletes(roots.distinct(), dst).withColumn("depth", depth(F.col("rel_path"))), buckets)
    return batches(rows.withColumn("up", -F.col("depth")), size, ["bucket"], ["up", "rel_path"]).drop("up")


def delete_journal(removed: DataFrame, roots: DataFrame, dry_run: bool) -> DataFrame:
    """DELETED per object removed; a dry run reports WOULD_DELETE per root only."""
    rows = roots if dry_run else removed
    return rows.select(F.lit("WOULD_DELETE" if dry_run else "DELETED").alias("type"), "rel_path")


def delete_closure(work: DataFrame) -> DataFrame:
    """dir, closed: a directory closes when its own batches and those of all directories beneath it are done. work: dir, done."""
    own = work.groupBy("dir").agg(F.bool_and("done").alias("done"))
    rows = own.select(F.explode(prefixes(F.col("dir"))).alias("dir"), "done")
    return rows.groupBy("dir").agg(F.bool_and("done").alias("closed"))


def chunk_ranges(files: DataFrame, chunk_size: int) -> DataFrame:
    """rel_path, size, chunk, offset, length, kind: the first chunk creates the temporary file, a finalize row ends each."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(float(chunk_size)))).cast("long")
    rows = files.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    offset = F.col("chunk") * chunk_size
    last = F.col("chunk") == F.col("n")
    return rows.select(
        "rel_path", "size", "chunk", F.when(~last, offset).alias("offset"), F.when(~last, F.least(F.lit(chunk_size), F.col("size") - offset)).alias("length"),
        F.when(last, "finalize").when(F.col("chunk") == 0, "create").otherwise("data").alias("kind"),
    )


def chunk_progress(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """n_chunks, n_done, ready and aborted per file. results: rel_path, chunk, drifted; repeats count once."""
    done = results.groupBy("rel_path", "chunk").agg(F.max("drifted").alias("drifted"))
    joined = chunks.where("kind <> 'finalize'").join(done, ["rel_path", "chunk"], "left")
    counted = joined.groupBy("rel_path").agg(
        F.count("*").alias("n_chunks"), F.count("drifted").alias("n_done"), F.coalesce(F.max("drifted"), F.lit(False)).alias("aborted")
    )
    return counted.select("rel_path", "n_chunks", "n_done", ((F.col("n_done") == F.col("n_chunks")) & ~F.col("aborted")).alias("ready"), "aborted")


def unfinalized(progress: DataFrame, finalized: DataFrame) -> DataFrame:
    """Files whose chunks were begun but not finalized: their temporary files are to be reclaimed."""
    return progress.join(finalized.select("rel_path"), "rel_path", "left_anti").select("rel_path")


def split_content(objects: DataFrame, size: int) -> DataFrame:
    """rel_path, offset, data: content (binary) in pieces of `size` bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / F.lit(float(size)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))
    rows = objects.select("rel_path", F.posexplode(pieces).alias("i", "data"))  # the array holds an object once, its rows a piece each
    return rows.select("rel_path", (F.col("i") * F.lit(size).cast("long")).alias("offset"), "data")


def assemble(pieces: DataFrame) -> DataFrame:
    """rel_path and content, the pieces joined in order of their offsets; for small objects, as each is one row. Large ones: operators/chunks.py."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("data").alias("data"))))
    return pieces.groupBy("rel_path").agg(parts.alias("parts")).select("rel_path", F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), "")).alias("content"))


def _with_order(listing: DataFrame) -> DataFrame:
    seen = F.col("ts_ns") if "ts_ns" in listing.columns else F.lit(0)
    dev = F.col("dev") if "dev" in listing.columns else F.lit(1)
    return listing.withColumn("dev", dev).withColumn("seen", seen)


def _linked(listing: DataFrame, *fields: str) -> DataFrame:
    """Sightings of files with further links, those of a number in one place. They are counted, so that partitions are small enough to
    be sorted in memory, and moved as they are. The device is often a constant, which Spark takes out of keys, so it is none here.
    """
    rows = _with_order(listing.where("type = 'FILE' and nlink > 1"))
    return dealt(rows.select("dev", "ino", "rel_path", *fields), rows.count(), "ino")


def link_groups(listing: DataFrame, max_group_scan: int = 0) -> DataFrame:
    """Hard-link groups on (dev, ino). The anchor is the first sighting, by time and then path,
    so replays and another order of rows change nothing. A group with more distinct members
    than max_group_scan falls back to plain copies (0: no limit).
    """
    rows = _linked(listing, "seen", "size", "mtime_ns", "nlink")
    anchor = F.min(F.struct("seen", "rel_path", "size", "mtime_ns"))
    groups = rows.groupBy("dev", "ino").agg(anchor.alias("anchor"), F.max("nlink").alias("nlink_expected"), F.countDistinct("rel_path").alias("members_seen"))
    over = (F.col("members_seen") > max_group_scan) if max_group_scan else F.lit(False)
    return groups.select(
        "dev", "ino", F.col("anchor.rel_path").alias("anchor_path"), F.col("anchor.size").alias("anchor_size"),
        F.col("anchor.mtime_ns").alias("anchor_mtime_ns"), "nlink_expected", "members_seen", over.alias("fallback"),
    )


def link_members(listing: DataFrame) -> DataFrame:
    """dev, ino, rel_path, state of every sighting, once each."""
    return _linked(listing).distinct().withColumn("state", F.lit("pending"))


def pending_links(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Pending members of groups whose anchor is copied, with the anchor; the anchor itself is not one."""
    ready = groups.where("anchor_state = 'copied' and not fallback")
    joined = members.where("state = 'pending'").join(ready, ["dev", "ino"])
    return joined.where("rel_path <> anchor_path").select("dev", "ino", "rel_path", "anchor_path", "anchor_size", "anchor_mtime_ns")


def link_outcomes(links: DataFrame, dst: DataFrame, dry_run: bool = False) -> DataFrame:
    """rel_path, type, detail: ERROR if the anchor is missing, SRC_CHANGED if it drifted, null if
    the member is linked already, else LINK_CREATED. A dry run links nothing.
    """
    a = dst.select(F.col("rel_path").alias("anchor_path"), F.col("size").alias("a_size"), F.col("mtime_ns").alias("a_mtime"), F.col("dev").alias("a_dev"), F.col("ino").alias("a_ino"))
    m = dst.select("rel_path", F.col("dev").alias("m_dev"), F.col("ino").alias("m_ino"))
    joined = links.join(a, "anchor_path", "left").join(m, "rel_path", "left")
    kind = (
        F.when(F.col("a_ino").isNull(), "ERROR")
        .when((F.col("a_size") != F.col("anchor_size")) | (F.col("a_mtime") != F.col("anchor_mtime_ns")), "SRC_CHANGED")
        .when((F.col("m_dev") == F.col("a_dev")) & (F.col("m_ino") == F.col("a_ino")), F.lit(None))
        .otherwise(F.lit(None) if dry_run else "LINK_CREATED")
    )
    return joined.select("rel_path", kind.alias("type"), F.col("anchor_path").alias("detail"))
