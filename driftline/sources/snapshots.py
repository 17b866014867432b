"""Snapshots of a listing as a base and numbered deltas, in buckets of directories; and listings bucketed for joins without a shuffle.

A snapshot is <path>/base/n=K and <path>/delta/n=K', K' > K. Rows are kept in buckets by
the hash of their directory, so that what changes together lies together; the entries of one
directory are spread over SPREAD buckets by their names, so a directory with most of the
entries is no single bucket. A delta holds the rows that change and the paths that go; the
newest row of a path counts (merge on read). Each write is a folder of its own that is
complete once it is closed and replaces itself when run again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.paths import leaf, parent
from driftline.storage import complete_numbers, remove

BUCKETS, SPREAD = 256, 4


def bucket_of(path: Column, buckets: int = BUCKETS, spread: int = SPREAD) -> Column:
    return F.pmod(F.xxhash64(parent(path), F.pmod(F.hash(leaf(path)), F.lit(spread))), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col("rel_path"), buckets))
    # a bucket's rows meet in a few tasks, whatever the number of input partitions; a large one is split
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "rel_path").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_base(listing: DataFrame, path: str, number: int = 0, buckets: int = BUCKETS) -> None:
    """The whole snapshot as of write `number`."""
    _write(listing, f"{path}/base/n={number}", buckets)


def write_delta(changed: DataFrame, gone: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Rows that are new or changed, and paths (rel_path) that are no more, as write `number`. A path in both stays."""
    rows = changed.withColumn("removed", F.lit(False))
    lost = gone.select("rel_path").distinct().join(changed.select("rel_path"), "rel_path", "left_anti").withColumn("removed", F.lit(True))
    _write(rows.unionByName(lost, allowMissingColumns=True), f"{path}/delta/n={number}", buckets)


def _parts(spark: SparkSession, path: str, upto: int | None) -> tuple[int, list[int]]:
    within = lambda n: upto is None or n <= upto
    bases = [n for n in complete_numbers(spark, f"{path}/base") if within(n)]
    if not bases:
        raise ValueError(f"there is no snapshot in {path}")
    return bases[-1], [n for n in complete_numbers(spark, f"{path}/delta") if n > bases[-1] and within(n)]


def read_snapshot(spark: SparkSession, path: str, buckets: Iterable[int] | None = None, upto: int | None = None) -> DataFrame:
    """The listing after all writes (up to number `upto`); with buckets, those only are read.

    Paths that no delta names come from the base as they are: its rows meet the paths of the
    deltas in an anti join whose small side Spark broadcasts, and are not aggregated.
    """
    base, deltas = _parts(spark, path, upto)
    of = lambda df: df if buckets is None else df.where(F.col("bucket").isin(sorted(buckets)))
    read = spark.read.option("basePath", f"{path}/base")
    old = of(read.parquet(f"{path}/base/n={base}")).drop("n", "bucket")
    if not deltas:
        return old
    names = old.columns
    schema = T.StructType([*old.schema.fields, T.StructField("removed", T.BooleanType()), T.StructField("n", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    new = of(spark.read.option("basePath", f"{path}/delta").schema(schema).parquet(*[f"{path}/delta/n={n}" for n in deltas]))
    newest = new
    if len(deltas) > 1:  # a delta has a path once
        newest = new.withColumn("__k", F.row_number().over(Window.partitionBy("rel_path").orderBy(F.col("n").desc()))).where("__k = 1")
    return old.join(new.select("rel_path"), "rel_path", "left_anti").select(*names).unionByName(newest.where("not removed").select(*names))


def compact(spark: SparkSession, path: str, every: int = 10, buckets: int = BUCKETS) -> bool:
    """Fold the deltas into a new base if there are `every` of them; the base and deltas before the last base go. Readers that began earlier find theirs."""
    base, deltas = _parts(spark, path, None)
    if len(deltas) < every:
        return False
    write_base(read_snapshot(spark, path), path, deltas[-1], buckets)
    for kind in ("base", "delta"):
        for n in complete_numbers(spark, f"{path}/{kind}"):
            if n < base or (kind == "delta" and n == base):
                remove(spark, f"{path}/{kind}/n={n}")
    return True


def changed_buckets(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that paths lie in: at most `buckets` numbers."""
    return [r["b"] for r in rows.select(bucket_of(F.col("rel_path"), buckets).alias("b")).distinct().collect()]


def store_bucketed(listing: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The listing as a table bucketed and sorted by path. Two such tables with equally many buckets are joined on the path without a shuffle."""
    spark = listing.sparkSession
    one_file_each = listing.repartition(buckets, "rel_path")  # the bucketing's own hash
    one_file_each.write.mode("overwrite").bucketBy(buckets, "rel_path").sortBy("rel_path").option("path", path).saveAsTable(table)
    return spark.table(table)
