"""A synthetic listing: mixed sizes, sparse files, special modes, hard links, symlinks, specials, long names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.listing import as_listing


def _draw(what: str, n: int, *keys: str) -> Column:
    """A number from 0 to n - 1 by hash of a seed, a purpose and the keys."""
    return F.pmod(F.xxhash64("seed", F.lit(what), *keys), F.lit(n))


def gen_listing(spark: SparkSession, n_dirs: int, seed: int = 1) -> DataFrame:
    """Directories numbered as a binary heap, so each path follows from its number: parent i // 2.

    Each directory has 3 to 7 files (70 % up to 2 KiB, 25 % up to 258 KiB, 5 % 1 to 9 MiB; 1 in
    6 sparse; each special mode bit 1 in 20), a hard link to its first file, three symlinks
    (sound, dangling, with a newline) and a FIFO; two shallow directories have 255-byte names.
    """
    dirs = spark.range(1, n_dirs + 1).withColumn("seed", F.lit(seed))
    bits = F.length(F.conv(F.col("id").cast("string"), 10, 2))
    name = lambda i: F.when(i.isin(2, 3), F.rpad(F.concat(F.lit("d"), i.cast("string")), 255, "x")).otherwise(F.concat(F.lit("d"), i.cast("string")))
    ids = F.transform(F.sequence(F.lit(2), F.greatest(bits, F.lit(2))), lambda k: F.floor(F.col("id") / F.pow(F.lit(2.0), bits - k)).cast("long"))
    path = F.when(bits < 2, "").otherwise(F.array_join(F.transform(ids, name), "/"))
    dirs = dirs.withColumn("dir", path)
    inside = lambda leaf: F.when(F.col("dir") == "", leaf).otherwise(F.concat("dir", F.lit("/"), leaf))

    files = dirs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), 2 + _draw("files", 5, "id"))))
    kind = _draw("kind", 100, "id", "k")
    size = F.when(kind < 70, _draw("small", 2049, "id", "k")).when(kind < 95, 2049 + _draw("middle", 262_144, "id", "k")).otherwise((1 << 20) + _draw("large", 8 << 20, "id", "k"))
    special = lambda bit, what: F.when(_draw(what, 20, "id", "k") == 0, bit).otherwise(0)
    full = F.floor((F.col("size") + 511) / 512).cast("long")
    files = files.withColumn("size", size).select(
        "id", "k", inside(F.concat(F.lit("f"), F.col("k").cast("string"))).alias("rel_path"), F.lit("FILE").alias("type"), "size",
        (F.lit(0o644) + special(0o4000, "setuid") + special(0o2000, "setgid") + special(0o1000, "sticky")).cast("int").alias("mode"),
        F.when(_draw("sparse", 6, "id", "k") == 0, 0).otherwise(full).cast("long").alias("blocks"), F.lit(None).cast("string").alias("link_target"),
        F.when(F.col("k") == 0, 2).otherwise(1).alias("nlink"), (F.col("id") * 16 + F.col("k")).alias("ino"), _draw("mtime", 10**9, "id", "k").alias("s"),
    )
    link = files.where("k = 0").withColumn("rel_path", F.concat(F.regexp_replace("rel_path", "f0$", ""), F.lit("hard")))

    def more(leaf: str, type_: str, target: Column, place: int) -> DataFrame:
        return dirs.select(
            "id", F.lit(None).cast("long").alias("k"), inside(F.lit(leaf)).alias("rel_path"), F.lit(type_).alias("type"), F.lit(0).cast("long").alias("size"), F.lit(0o777 if type_ == "SYMLINK" else 0o600).alias("mode"),
            F.lit(0).cast("long").alias("blocks"), target.cast("string").alias("link_target"), F.lit(1).alias("nlink"), (F.col("id") * 16 + place).alias("ino"), F.lit(0).cast("long").alias("s"),
        )

    own = dirs.where("dir <> ''").select(
        "id", F.lit(None).cast("long").alias("k"), F.col("dir").alias("rel_path"), F.lit("DIR").alias("type"), F.lit(0).cast("long").alias("size"), F.lit(0o755).alias("mode"), F.lit(0).cast("long").alias("blocks"),
        F.lit(None).cast("string").alias("link_target"), F.lit(2).alias("nlink"), (F.col("id") * 16 + 15).alias("ino"), F.lit(0).cast("long").alias("s"),
    )
    out = files.unionByName(link).unionByName(own)
    for leaf, type_, target, place in (("ok", "SYMLINK", F.lit("f0"), 10), ("gone", "SYMLINK", F.lit("nowhere"), 11), ("odd", "SYMLINK", F.lit("a\nb"), 12), ("pipe", "FIFO", F.lit(None), 13)):
        out = out.unionByName(more(leaf, type_, target, place))
    return as_listing(out.withColumn("mtime_ns", (F.lit(1_600_000_000) + F.col("s")) * 1_000_000_000).withColumn("uid", F.lit(1000)).withColumn("gid", F.lit(1000)))
