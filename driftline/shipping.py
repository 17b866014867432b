"""Sends this package to the executors, for functions that run in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_driftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="driftline-py-")) / "driftline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._driftline_shipped = True


def map_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with this package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
