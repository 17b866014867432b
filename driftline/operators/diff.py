"""Diff of two listings: filters, pairs, classes, orphans, plans, and their application.

Both sides are joined once on the path; everything else is an expression over the pair, a
semi or anti join on paths, or an aggregate. What follows from a plan (orphans, counters,
journal, the next snapshot) is taken from the plan, which is best written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.formats import tag_matches, temp_name
from driftline.functions.globs import first_match_excludes
from driftline.functions.paths import join, leaf, parent, prefixes, root_above
from driftline.options import SyncOptions
from driftline.sources.listing import SPECIAL_TYPES, as_listing
from driftline.storage import dealt, materialize

ENOENT = 2
PERMISSIONS = 0o7777


def excluded(path: Column, rules) -> Column:
    """Whether the rules exclude the entry or a directory above it."""
    if not rules:
        return F.lit(False)
    return F.exists(prefixes(path), lambda p: first_match_excludes(p, list(rules)))


def apply_filters(listing: DataFrame, rules, keep_excluded: bool = False) -> DataFrame:
    """Entries the ordered rules include; with keep_excluded all of them and a flag."""
    flagged = listing.withColumn("excluded", excluded(F.col("rel_path"), rules))
    return flagged if keep_excluded else flagged.where(~F.col("excluded")).drop("excluded")


def both_sides(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Paths that both sides have."""
    return src.select("rel_path").join(dst.select("rel_path"), "rel_path", "left_semi")


def dst_only(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Paths that only the destination has."""
    return dst.select("rel_path").join(src.select("rel_path"), "rel_path", "left_anti")


def tree_diff(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions(), rows: int = 0) -> DataFrame:
    """rel_path, src and dst (structs, null where absent), in_src, in_dst and excluded. Excluded
    source entries stay in, so that they shield their destination twins.

    Presence has columns of its own: whoever asks for them and for single fields leaves the
    other fields to be pruned before the shuffle. Whoever knows how many rows both sides have
    has them dealt into partitions of so few that the destination's part is held as a hash table, and neither side is sorted.
    """

    own = _packed(src, "src").withColumn("excluded", excluded(F.col("rel_path"), opts.rules))
    twins = _packed(dst, "dst")
    if rows:
        own, twins = dealt(own, rows, "rel_path"), dealt(twins, rows, "rel_path").hint("shuffle_hash")
    return _pairs(own.join(twins, "rel_path", "full_outer"))


def _packed(df: DataFrame, side: str, *more: str) -> DataFrame:
    have = [c for c in as_listing(df).columns if c in df.columns and c != "rel_path"]
    return as_listing(df, *more).select("rel_path", F.struct(*have).alias(side), F.lit(True).alias(f"in_{side}"), *more)


def _pairs(joined: DataFrame) -> DataFrame:
    absent = F.lit(False)
    return joined.select("rel_path", "src", "dst", *[F.coalesce(c, absent).alias(c) for c in ("in_src", "in_dst", "excluded")])


def mtime_equal(a: Column, b: Column, slop_ns: int) -> Column:
    return F.abs(a - b) <= slop_ns


def mode_differs(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.lit(PERMISSIONS)) != b.bitwiseAND(F.lit(PERMISSIONS))


def is_sparse(size: Column, blocks: Column) -> Column:
    """Fewer bytes on disk than the size, by more than one page."""
    return blocks * 512 + 4096 < size


def copyable_xattrs(xattrs: Column, opts: SyncOptions = SyncOptions()) -> Column:
    """What can be carried over: all names but security.selinux and system.*, of which the two kinds of ACL follow the options."""
    acls = [n for n, on in (("system.posix_acl_access", opts.posix_acl), ("system.posix_acl_default", opts.posix_acl), ("system.nfs4_acl", opts.nfs4_acl)) if on]
    return F.map_filter(xattrs, lambda k, v: ((k != "security.selinux") & ~k.startswith("system.")) | k.isin(acls))


def xattrs_equal(a: Column, b: Column, opts: SyncOptions = SyncOptions()) -> Column:
    """Equal over the names that can be carried over; a side that could not be read counts as equal."""
    one, two = (F.array_sort(F.map_entries(copyable_xattrs(x, opts))) for x in (a, b))
    return F.coalesce(one == two, F.lit(True))


#: Why an object is not as its source; the first that applies counts.
REASONS = ("absent", "type", "size", "mtime", "owner", "mode", "xattrs", "target", "rdev")
#: Outcomes that need no comparison, and what follows from a reason for each kind of entry.
UNCOMPARED = ("DST_ONLY", "EXCLUDED", "VANISHED", "ERROR", "SKIPPED")
KINDS = {"FILE": "COPY", "DIR": "MKDIR", "SYMLINK": "SYMLINK", "special": "SPECIAL"}


def _outcomes() -> tuple[list[str], list[str | None]]:
    """Actions and reasons by code: the uncompared ones, then for each kind no reason and each reason."""
    actions, reasons = list(UNCOMPARED), [None] * len(UNCOMPARED)
    for kind, change in KINDS.items():
        actions.append("DIR" if kind == "DIR" else "CLEAN")
        actions += ["META_FIX" if kind == "FILE" and r in ("owner", "mode", "xattrs") else change for r in REASONS]
        reasons += [None, *REASONS]
    return actions, reasons


def classify(pairs: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Adds action, reason (the first that applies) and strategy (of copies) to the pairs.

    All follow from one small number, which tables of constants turn into names, so that a
    filter on any of them stays one comparison over the columns of the scan.
    """
    s, d = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    own, twin = (set(pairs.schema[side].dataType.names) for side in ("src", "dst"))
    failed = F.coalesce(s("stat_errno"), F.lit(0)) if "stat_errno" in own else F.lit(0)
    absent = ~F.col("in_dst")
    if "stat_errno" in twin:
        absent = absent | (F.coalesce(d("stat_errno"), F.lit(0)) != 0)
    is_file, is_link, is_special = s("type") == "FILE", s("type") == "SYMLINK", s("type").isin(*SPECIAL_TYPES)
    differs = {"absent": absent, "type": s("type") != d("type"), }
    if "size" in own & twin:  # fields that the listings lack are not compared
        differs["size"] = is_file & (s("size") != d("size"))
    if opts.times and "mtime_ns" in own & twin:
        differs["mtime"] = is_file & ~mtime_equal(s("mtime_ns"), d("mtime_ns"), opts.mtime_slop_ns)
    if opts.owner and {"uid", "gid"} <= own & twin:
        differs["owner"] = is_file & ((s("uid") != d("uid")) | (s("gid") != d("gid")))
    if opts.mode and "mode" in own & twin:
        differs["mode"] = is_file & mode_differs(s("mode"), d("mode"))
    if opts.xattrs and "xattrs" in own & twin:
        differs["xattrs"] = is_file & ~xattrs_equal(s("xattrs"), d("xattrs"), opts)
    if "link_target" in own & twin:
        differs["target"] = is_link & ~s("link_target").eqNullSafe(d("link_target"))
    if {"rdev_major", "rdev_minor"} <= own & twin:
        differs["rdev"] = is_special & ((s("rdev_major") != d("rdev_major")) | (s("rdev_minor") != d("rdev_minor")))
    why = F.lit(0)
    for k, reason in reversed(list(enumerate(REASONS, 1))):
        why = F.when(differs[reason], k).otherwise(why) if reason in differs else why
    width, first = len(REASONS) + 1, len(UNCOMPARED)
    kind = F.when(is_file, first).when(s("type") == "DIR", first + width).when(is_link, first + 2 * width).otherwise(first + 3 * width)
    code = F.when(~F.col("in_src"), UNCOMPARED.index("DST_ONLY")).when(F.col("excluded"), UNCOMPARED.index("EXCLUDED"))
    code = code.when(failed == ENOENT, UNCOMPARED.index("VANISHED")).when(failed != 0, UNCOMPARED.index("ERROR"))
    if not opts.specials:
        code = code.when(is_special, UNCOMPARED.index("SKIPPED"))
    actions, reasons = (F.array(*[F.lit(x).cast("string") for x in names]) for names in _outcomes())
    coded = pairs.withColumn("outcome", code.otherwise(kind + why))
    named = coded.withColumn("reason", F.get(reasons, F.col("outcome"))).withColumn("action", F.get(actions, F.col("outcome")))
    strategy = F.when(
        F.col("action") == "COPY",
        F.lit("TEMP_RENAME") if "size" not in own else F.when((s("size") >= opts.chunk_threshold) & (s("size") > opts.chunk_size), "CHUNKED")
        .when(F.lit(opts.direct_write) & (F.col("reason") == "absent"), "DIRECT")
        .otherwise("TEMP_RENAME"),
    )
    return named.drop("outcome").withColumn("strategy", strategy)


def plan(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions(), rows: int = 0) -> DataFrame:
    return classify(tree_diff(src, dst, opts, rows), opts)


def plan_of(entries: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """plan() of some of the source's entries: their twins are looked up in the destination. Their paths are written first, so
    that Spark knows how few they are and moves nothing else of the destination; many are joined by a shuffle.
    """
    twins = dst.join(materialize(entries.select("rel_path"), "entries"), "rel_path", "left_semi")
    return plan(entries, twins, opts).where("in_src")


def plan_of_changes(changes: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """plan() of the paths that changed at the source, each once: entries, and `removed` for what is gone there. What else the destination has is left out."""
    here = F.col("removed").eqNullSafe(F.lit(False))
    own = _packed(changes, "src", "removed").withColumn("excluded", here & excluded(F.col("rel_path"), opts.rules))
    own = own.withColumn("src", F.when(here, F.col("src"))).withColumn("in_src", here)
    return classify(_pairs(own.join(_packed(dst, "dst"), "rel_path", "left")).where("in_src or in_dst"), opts)


def written_plan(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions(), fields: tuple[str, ...] | None = None, clean: bool = True) -> DataFrame:
    """plan() in the shared folder: one join of the listings serves the journal, the counters, the orphans and the application.

    Whoever knows what is read of it names the fields of both sides that are kept (`type` always is), so that neither the join
    nor the files hold the others. Without `clean`, clean entries that no journal names, those with a single link, are left out: for
    the journals of trees with directories, as the root has a record if the plan has any row.
    """
    planned = plan(src, dst, opts)
    if not clean:
        planned = planned.where((F.col("action") != "CLEAN") | journaled_twin())
    if fields is None:
        return materialize(planned, "plan")

    def kept(side: str) -> Column:
        held = [f for f in planned.schema[side].dataType.names if f in ("type", "stat_errno", *fields)]
        return F.when(F.col(f"in_{side}"), F.struct(*[F.col(f"{side}.{f}") for f in held])).alias(side)

    return materialize(planned.select("rel_path", kept("src"), kept("dst"), "in_src", "in_dst", "excluded", "action", "reason"), "plan")


def journaled_twin() -> Column:
    """Whether a file has further links, of which the journal keeps account whatever else becomes of it."""
    return F.coalesce((F.col("src.type") == "FILE") & (F.col("src.nlink") > 1), F.lit(False))


def outline(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """The rows of plan() that orphans and directories set aside follow from: what only the destination has, directories, and entries
    of another type. They follow from paths and types, so nothing else of the listings is compared or moved.
    """
    narrow = lambda df: df.select(*[c for c in ("rel_path", "type", "stat_errno") if c in df.columns])
    return plan(narrow(src), narrow(dst), opts).where(F.col("action").isin("DST_ONLY", "DIR", "MKDIR") | (F.col("reason") == "type"))


#: Parts into which the entries of a wide directory are split where they meet their directory.
SALTS = 16


def in_directories(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Entries whose parent is among the directories (rel_path). A directory with most of the entries is spread over SALTS keys."""
    keyed = entries.withColumn("__parent", parent(F.col("rel_path")))
    used = keyed.select("__parent").distinct().join(directories.select(F.col("rel_path").alias("__parent")), "__parent", "left_semi")
    spread = used.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("__salt", F.pmod(F.hash("rel_path"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["__parent", "__salt"], "left_semi").drop("__parent", "__salt")


def _with_root(directories: DataFrame) -> DataFrame:
    return directories.unionByName(directories.sparkSession.range(1).select(F.lit("").alias("rel_path")))


def plan_orphans(planned: DataFrame, job: int = 1, pass_no: int = 1, opts: SyncOptions = SyncOptions(), aside: DataFrame | None = None) -> DataFrame:
    """rel_path and type of the topmost destination-only entries, from the plan alone, and (but in
    a dry run) the directories it sets aside, under their new names. aside: rows_aside(), if they are at hand.
    """
    walked = planned.where(F.col("action").isin("DIR", "MKDIR")).select("rel_path")
    only = planned.where(F.col("action") == "DST_ONLY").select("rel_path", F.col("dst.type").alias("type"))
    found = in_directories(only.where(~leaf(F.col("rel_path")).startswith(opts.temp_prefix)), _with_root(walked))
    if opts.dry_run:
        return found
    aside = set_aside(planned, job, pass_no, opts) if aside is None else aside
    return found.unionByName(aside.select(F.col("stale_path").alias("rel_path"), F.lit("DIR").alias("type")))


def _orphan_candidates(src: DataFrame, dst: DataFrame, opts: SyncOptions, temporary: bool) -> DataFrame:
    """Destination-only entries in directories that were walked: those with temporary names, which are few, or the others."""
    walked = apply_filters(as_listing(src), opts.rules).where("type = 'DIR' and coalesce(stat_errno, 0) = 0").select("rel_path")
    own = leaf(F.col("rel_path")).startswith(opts.temp_prefix)
    if not temporary:
        return in_directories(dst.where(~own).join(src.select("rel_path"), "rel_path", "left_anti"), _with_root(walked))
    # the few rows meet the source's in a semi join, whose small side is sent to the large one where it lies
    named = in_directories(dst.where(own), _with_root(walked))
    kept = src.where(own).select("rel_path").join(named.select("rel_path"), "rel_path", "left_semi")
    return named.join(kept, "rel_path", "left_anti")


def orphans(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Topmost destination-only entries; rules do not shield them, temporary names are none."""
    return _orphan_candidates(src, dst, opts, temporary=False)


def temp_residue(src: DataFrame, dst: DataFrame, job: int, pass_no: int, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Left-over temporary names, and whether to reclaim them: those of the running job and pass stay."""
    name = leaf(F.col("rel_path"))
    found = _orphan_candidates(src, dst, opts, temporary=True)
    tail = F.substring(name, len(opts.temp_prefix) + 1, F.length(name))
    return found.select("rel_path", (~tag_matches(tail, F.lit(job), F.lit(pass_no))).alias("reclaim"))


def stale_path(path: Column, job: int, pass_no: int, opts: SyncOptions = SyncOptions()) -> Column:
    """Where a directory in the way is set aside: in its own parent, under a name that is no temporary one."""
    item = F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long")
    return join(parent(path), temp_name(opts.stale_prefix, F.lit(job), F.lit(pass_no), item, F.lit(0)))


def type_changes(pairs: DataFrame, dst: DataFrame, job: int, pass_no: int, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Destinations of another type: a directory with children in the way of something else is
    set aside under a stale name and reported, all else is removed. In a dry run nothing moves.
    """
    changed = pairs.where("not excluded and in_src and in_dst and src.type <> dst.type")
    parents = dst.select(parent(F.col("rel_path")).alias("rel_path")).distinct().withColumn("full", F.lit(True))
    marked = changed.join(parents, "rel_path", "left")
    aside = F.coalesce("full", F.lit(False)) & (F.col("dst.type") == "DIR")
    step = F.when(F.lit(opts.dry_run), "NONE").when(aside, "SET_ASIDE").otherwise("REMOVE")
    moved = marked.withColumn("step", step)
    return moved.select(
        "rel_path", F.col("src.type").alias("src_type"), F.col("dst.type").alias("dst_type"), "step",
        F.when(F.col("step") == "SET_ASIDE", stale_path(F.col("rel_path"), job, pass_no, opts)).alias("stale_path"), F.when(F.col("step") == "SET_ASIDE", "ORPHAN").alias("journal_type"),
    )


def set_aside(planned: DataFrame, job: int = 1, pass_no: int = 1, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """rel_path, stale_path of the directories that a plan sets aside, from the plan alone: what lies beneath them is the destination's only."""
    return rows_aside(planned, job, pass_no, opts).select("rel_path", "stale_path")


def rows_aside(planned: DataFrame, job: int = 1, pass_no: int = 1, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """set_aside() with what the destination has there (dst), so that nobody looks them up in the plan again."""
    beneath = planned.where(F.col("action") == "DST_ONLY").select(parent(F.col("rel_path")).alias("rel_path")).distinct()
    in_the_way = planned.where(F.col("action").isin("COPY", "SYMLINK", "SPECIAL") & (F.col("reason") == "type")).where("dst.type = 'DIR'").select("rel_path", "dst")
    found = in_the_way.join(beneath, "rel_path", "left_semi")
    return found.select("rel_path", stale_path(F.col("rel_path"), job, pass_no, opts).alias("stale_path"), "dst")


def to_journal(planned: DataFrame, orphan_rows: DataFrame, job: int, pass_no: int, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """job_id, pass_no, type, rel_path, src, dst, errno, detail: one row per outcome that is not clean."""
    a = F.col("action")
    if opts.dry_run:
        kind = F.when(a == "COPY", "WOULD_COPY")
    else:
        kind = F.when(a.isin("COPY", "SYMLINK", "SPECIAL"), "COPIED").when(a == "META_FIX", "META_FIXED")
    kind = kind.when(a.isin("DIR", "MKDIR"), "DIR_META").when(a == "ERROR", "ERROR")
    twin = F.when(a.isin("COPY", "META_FIX", "CLEAN") & (F.col("src.type") == "FILE") & (F.col("src.nlink") > 1), "NLINK_DUP")
    rows = planned.select(
        F.explode(F.array_compact(F.array(kind, twin))).alias("type"), "rel_path", "src", "dst",
        (F.when(a == "ERROR", F.col("src.stat_errno")).otherwise(0) if "stat_errno" in planned.schema["src"].dataType.names else F.lit(0)).alias("errno"), F.lit("").alias("detail"),
    )
    root = planned.limit(1).select(F.lit("DIR_META").alias("type"), F.lit("").alias("rel_path"), F.lit(0).alias("errno"), F.lit("").alias("detail"))
    lost = orphan_rows.select(F.lit("ORPHAN").alias("type"), "rel_path", F.lit(0).alias("errno"), F.lit("").alias("detail"))
    out = rows.unionByName(root, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    return out.select(F.lit(job).alias("job_id"), F.lit(pass_no).alias("pass_no"), "type", "rel_path", "src", "dst", "errno", "detail")


def pass_counters(planned: DataFrame, orphan_rows: DataFrame) -> DataFrame:
    """One row of counters of a pass, from counts by action, type and whether the entry has further links."""
    linked = (F.col("src.type") == "FILE") & (F.col("src.nlink") > 1)
    by = planned.groupBy("action", F.col("src.type").alias("type"), F.coalesce(linked, F.lit(False)).alias("linked"))
    by = by.agg(F.count("*").alias("n"), F.sum("src.size").alias("size"))
    a = F.col("action")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size")).otherwise(0)), F.lit(0)).cast("long")
    dup = ~a.isin("EXCLUDED", "ERROR", "VANISHED") & F.col("linked")
    return by.agg(
        count(a != "DST_ONLY").alias("entries_walked"),
        count(a.isin("COPY", "SYMLINK", "SPECIAL")).alias("files_copied"),
        total(a == "COPY").alias("bytes_copied"),
        count(a == "META_FIX").alias("meta_fixed"),
        count(a == "CLEAN").alias("clean"),
        count(a == "ERROR").alias("errors"),
        count(a.isin("DIR", "MKDIR")).alias("dirs"),
        count(a == "SYMLINK").alias("symlinks"),
        count(a.isin("SPECIAL", "SKIPPED") | ((a == "CLEAN") & F.col("type").isin(*SPECIAL_TYPES))).alias("specials"),
        count(dup).alias("nlink_dup_files"),
        total(dup).alias("nlink_dup_bytes"),
    ).withColumn("orphans", orphan_rows.agg(F.count("*")).scalar())


def nlink_cost(listing: DataFrame) -> DataFrame:
    """Files and bytes of hard-linked files."""
    return listing.where("type = 'FILE' and nlink > 1").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def drift(planned: DataFrame, fresh: DataFrame) -> DataFrame:
    """Planned copies whose source is not as planned any more: rel_path, detail."""
    now = fresh.select("rel_path", F.col("size").alias("new_size"), F.col("mtime_ns").alias("new_mtime_ns"))
    left = planned.where("action = 'COPY'").join(now, "rel_path", "left")
    detail = F.when(F.col("new_size").isNull(), "missing").when(F.col("new_size") != F.col("src.size"), "size").when(F.col("new_mtime_ns") != F.col("src.mtime_ns"), "mtime")
    return left.select("rel_path", detail.alias("detail")).where("detail is not null").withColumn("type", F.lit("SRC_CHANGED"))


def xattr_delta(pairs: DataFrame, opts: SyncOptions = SyncOptions(), unsupported: list[str] = ()) -> DataFrame:
    """rel_path, name, step (set, remove), type (null, ERROR, FIDELITY_EXCEPTION) per attribute that differs."""
    def entries(side: str) -> DataFrame:
        return pairs.where("in_src and in_dst").select("rel_path", F.explode(F.map_entries(copyable_xattrs(F.col(f"{side}.xattrs"), opts))).alias("e")).select(
            "rel_path", F.col("e.key").alias("name"), F.col("e.value").alias(side)
        )

    both = entries("src").join(entries("dst"), ["rel_path", "name"], "full_outer").where(~F.col("src").eqNullSafe(F.col("dst")))
    step = F.when(F.col("src").isNull(), "remove").otherwise("set")
    cannot = F.col("name").isin(*unsupported) & (step == "set")
    outcome = {"fail": "ERROR", "warn": "FIDELITY_EXCEPTION", "skip": None}[opts.untranslatable]
    return both.select(
        "rel_path", "name", F.when(cannot, "skip").otherwise(step).alias("step"), F.when(cannot, F.lit(outcome).cast("string")).alias("type")
    )


def dirfix(journal: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """Directories whose owner, mode or exact mtime (as far as the options carry them) is not that of this pass's DIR_META record; vanished ones are skipped."""
    wanted = journal.where("type = 'DIR_META' and rel_path <> ''").groupBy("rel_path").agg(F.max_by("src", "ts_ns").alias("src") if "ts_ns" in journal.columns else F.any_value("src").alias("src"))
    now = dst.where("type = 'DIR'").select("rel_path", F.col("uid").alias("d_uid"), F.col("gid").alias("d_gid"), F.col("mode").alias("d_mode"), F.col("mtime_ns").alias("d_mtime"))
    joined = wanted.join(now, "rel_path")
    no = F.lit(False)
    fix = joined.select(
        "rel_path",
        (((F.col("src.uid") != F.col("d_uid")) | (F.col("src.gid") != F.col("d_gid"))) if opts.owner else no).alias("owner"),
        (mode_differs(F.col("src.mode"), F.col("d_mode")) if opts.mode else no).alias("mode"),
        ((F.col("src.mtime_ns") != F.col("d_mtime")) if opts.times else no).alias("mtime"),
    )
    return fix.where("owner or mode or mtime")


def apply_plan(
    dst: DataFrame, planned: DataFrame, deletes: DataFrame | None = None, job: int = 1, pass_no: int = 1, opts: SyncOptions = SyncOptions(), aside: DataFrame | None = None
) -> DataFrame:
    """The destination after the whole plan made for it: copied and new objects and fixed
    attributes from the source, directories in the way moved aside with all beneath them, the
    rest as it was, less deletes (roots) and all beneath them.

    The plan holds both sides of every path, so the listings are not joined again; dst gives the
    schema. Applying a plan twice gives the same snapshot. Written to a new path, it replaces
    the old one at once. aside: rows_aside(), if they are at hand.
    """
    after, was = _applied(planned, dst)
    stay = planned.where(F.col("action").isin(*ALTERED) | F.expr("in_src and in_dst")).select("rel_path", *after)
    only = planned.where(F.col("action") == "DST_ONLY")
    aside = rows_aside(planned, job, pass_no, opts) if aside is None else aside
    keys = aside.select(F.col("rel_path").alias("root"), "stale_path", F.lit(False).alias("gone"))
    if deletes is not None:
        keys = keys.unionByName(deletes.select(F.col("rel_path").alias("root"), F.lit(None).cast("string").alias("stale_path"), F.lit(True).alias("gone")))
    hit = root_above(only.select("rel_path"), keys, beneath=deletes is None).groupBy("rel_path").agg(F.bool_or("gone").alias("gone"), F.min_by(F.struct("root", "stale_path"), F.length("root")).alias("to"))
    kept = only.join(hit, "rel_path", "left").where("not coalesce(gone, false)")
    moved = F.when(F.col("to.stale_path").isNotNull(), _new_path()).otherwise(F.col("rel_path"))
    return stay.unionByName(kept.select(moved.alias("rel_path"), *was)).unionByName(aside.select(F.col("stale_path").alias("rel_path"), *was))


def plan_changes(dst: DataFrame, planned: DataFrame, aside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What apply_plan() adds to dst or alters in it, as rows, and the paths (rel_path) that it takes away, without the rest of dst.
    aside: set_aside() of the plan. Only the aside and what lies beneath them is joined.
    """
    after, was = _applied(planned, dst)
    roots = aside.select(F.col("rel_path").alias("root"), "stale_path")
    only = planned.where(F.col("action") == "DST_ONLY").select("rel_path", "dst")
    hit = root_above(only.select("rel_path"), roots, beneath=True).groupBy("rel_path").agg(F.min_by(F.struct("root", "stale_path"), F.length("root")).alias("to"))
    at_root = planned.where("in_src and dst.type = 'DIR' and src.type <> 'DIR'").join(aside, "rel_path").select(F.col("stale_path").alias("rel_path"), *was)
    moved = only.join(hit, "rel_path").select(_new_path().alias("rel_path"), *was)
    return planned.where(F.col("action").isin(*ALTERED)).select("rel_path", *after).unionByName(moved).unionByName(at_root), hit.select("rel_path")


#: Outcomes whose entry is as its source once the plan is applied.
ALTERED = ("COPY", "SYMLINK", "SPECIAL", "MKDIR", "META_FIX", "DIR")


def _applied(planned: DataFrame, dst: DataFrame) -> tuple[list[Column], list[Column]]:
    """The columns of a listing after a plan, and as they were; dst gives the schema."""
    have = {side: set(planned.schema[side].dataType.names) for side in ("src", "dst")}
    fields = [f for f in as_listing(dst).schema.fields if f.name != "rel_path"]

    def old(c: str) -> Column:
        return F.col(f"dst.{c}") if c in have["dst"] else F.lit(None)

    def value(c: str, kind: T.DataType) -> Column:
        new = F.col(f"src.{c}") if c in have["src"] else F.lit(None)
        if c == "content":
            return F.when(F.col("action") == "COPY", new).otherwise(old(c)).cast(kind).alias(c)
        return F.when(F.col("action").isin(*ALTERED), F.coalesce(new, old(c)) if c == "xattrs" else new).otherwise(old(c)).cast(kind).alias(c)

    return [value(f.name, f.dataType) for f in fields], [old(f.name).cast(f.dataType).alias(f.name) for f in fields]


def _new_path() -> Column:
    """Where an entry beneath a directory that is set aside (`to`: its root and stale_path) lies afterwards."""
    return F.concat("to.stale_path", F.substring("rel_path", F.length("to.root") + 1, F.length("rel_path")))


#: Attributes of the fidelity report; ctime cannot be carried over and is left out.
FIDELITY = ("type", "size", "mtime", "owner", "mode", "xattrs", "sparse", "rdev", "link_target")


def fidelity(src: DataFrame, dst: DataFrame, opts: SyncOptions = SyncOptions()) -> DataFrame:
    """attribute, n_match, n_differ, n_not_preservable over objects that both sides have."""
    both = tree_diff(src, dst, opts).where("not excluded and in_src and in_dst")
    s, d = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    is_file = (s("type") == "FILE") & (d("type") == "FILE")
    has_xattrs = all("xattrs" in both.schema[side].dataType.names for side in ("src", "dst"))
    equal = {
        "type": s("type") == d("type"),
        "size": F.when(is_file, s("size") == d("size")),
        "mtime": F.when(is_file, mtime_equal(s("mtime_ns"), d("mtime_ns"), opts.mtime_slop_ns)),
        "owner": (s("uid") == d("uid")) & (s("gid") == d("gid")),
        "mode": ~mode_differs(s("mode"), d("mode")),
        "xattrs": xattrs_equal(s("xattrs"), d("xattrs"), opts) if has_xattrs else F.lit(True),
        "sparse": F.when(is_file, is_sparse(s("size"), s("blocks")) == is_sparse(d("size"), d("blocks"))),
        "rdev": F.when(s("type").isin(*SPECIAL_TYPES), (s("rdev_major") == d("rdev_major")) & (s("rdev_minor") == d("rdev_minor"))),
        "link_target": F.when(s("type") == "SYMLINK", s("link_target").eqNullSafe(d("link_target"))),
    }
    lost = F.lit(False)
    if has_xattrs:
        lost = F.coalesce(F.exists(F.map_keys(s("xattrs")), lambda k: (k == "security.selinux") | k.startswith("system.")), F.lit(False))
    rows = both.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("attribute"), equal[k].alias("same"), (lost if k == "xattrs" else F.lit(False)).alias("lost")) for k in FIDELITY
    ])).alias("r")).select("r.*")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("attribute").agg(count(F.col("same")).alias("n_match"), count(~F.col("same")).alias("n_differ"), count(F.col("lost")).alias("n_not_preservable"))
