"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_OPEN: list[list[DataFrame]] = []


@contextmanager
def scope(*kept: str) -> Iterator[None]:
    """Releases, at its end, all tables made inside it but those of the names to be kept. Results must have been written or read by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        made = _OPEN.pop()
        release(*[t for t in made if t._driftline_name not in kept])
        if _OPEN:
            _OPEN[-1].extend(t for t in made if t._driftline_name in kept)


#: Rows that a partition of a listing takes, about.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """df shuffled by keys into partitions of about ROWS rows; few rows are left to Spark, which joins partitions up to 64 MB as
    they are compressed. A listing's rows take some 20 bytes there and ten times as much where they are sorted, and would spill.
    """
    n = -(-rows // ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df.repartition(*keys)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage, fixes what is computed once, and survives lost executors.
    The files stay under <spark.checkpoint.dir>/driftline until released or removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path, out._driftline_name = path, name
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_driftline_path", None)
        if path:
            remove(df.sparkSession, path)


def complete_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the finished writes path/n=..., in order."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    found = fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/n=*/_SUCCESS")) if fs.exists(target) else []
    return sorted(int(f.getPath().getParent().getName().removeprefix("n=")) for f in found or [])


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
