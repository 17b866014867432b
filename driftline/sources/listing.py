"""Listings: one row per object, the same schema on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAT = [
    T.StructField("type", T.StringType()), T.StructField("mode", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("atime_ns", T.LongType()), T.StructField("mtime_ns", T.LongType()), T.StructField("dev", T.LongType()),
    T.StructField("ino", T.LongType()), T.StructField("nlink", T.IntegerType()), T.StructField("rdev_major", T.LongType()), T.StructField("rdev_minor", T.LongType()),
    T.StructField("blocks", T.LongType()), T.StructField("link_target", T.StringType()), T.StructField("xattrs", T.MapType(T.StringType(), T.BinaryType())),
    T.StructField("stat_errno", T.IntegerType()),
]
LISTING = T.StructType([T.StructField("rel_path", T.StringType()), *STAT])
#: The entry types.
ENTRY_TYPES = ("FILE", "DIR", "SYMLINK", "CHARDEV", "BLOCKDEV", "FIFO", "SOCKET")
SPECIAL_TYPES = ("CHARDEV", "BLOCKDEV", "FIFO", "SOCKET")


def as_listing(df: DataFrame, *more: str) -> DataFrame:
    """df with the columns of a listing; missing ones are null (stat_errno 0, dev 1), and an own `content` stays, as do those in `more`."""
    missing = {"stat_errno": F.lit(0), "dev": F.lit(1)}
    columns = [
        (F.col(f.name) if f.name in df.columns else missing.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in LISTING.fields
    ]
    return df.select(*columns, *[c for c in ("content", *more) if c in df.columns])


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A listing stored as Parquet, JSON lines or CSV with a header (CSV holds no xattrs)."""
    if fmt == "csv":
        flat = T.StructType([f for f in LISTING.fields if not isinstance(f.dataType, T.MapType)])
        return as_listing(spark.read.schema(flat).option("header", True).option("nullValue", "\\N").csv(path))
    return as_listing(spark.read.schema(LISTING).format(fmt).load(path))


def scan_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A listing of the files below root, with content; sizes and times come from the store."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z0-9+]+:/*|/+$", "")
    path = F.regexp_replace("path", "^[a-z0-9+]+:/*", "")
    return as_listing(
        found.select(
            F.substring(path, F.length(F.regexp_replace(base, "^/+", "")) + 2, F.length(path)).alias("rel_path"),
            F.lit("FILE").alias("type"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content",
        )
    )


def slice_listing(listing: DataFrame, names: DataFrame) -> DataFrame:
    """The entries of a listing named by names (parent, name); what is missing is simply absent."""
    from driftline.functions.paths import join

    # the path alone is the key; a name with a slash is none
    paths = names.where("not contains(name, '/')").select(join(F.col("parent"), F.col("name")).alias("rel_path"))
    return listing.join(paths, "rel_path", "left_semi").select(*listing.columns)
