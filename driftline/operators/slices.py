"""Values of earlier rows of a key, in slices of the order, so that a key with most of the rows is spread over tasks.

The first column of the order (a number, a day or a time) is cut at quantiles of all rows. Windows
work within a key and slice; what a slice needs of those before it comes as one row more,
taken from an aggregate of a row per key and slice. Rows that are equal in the first column
of the order stay together. Keys and values may be null; nulls of the order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def bounds(rows: DataFrame, by: str, slices: int = SLICES) -> Column:
    """The quantiles that part the rows into slices, as a scalar subquery: an array of slices - 1 values."""
    return rows.agg(F.percentile_approx(by, [i / slices for i in range(1, slices)]).alias("bounds")).scalar()


def with_slice(rows: DataFrame, by: str, cuts: Column) -> DataFrame:
    """Adds _slice, from 0: how many of the cuts are at or below the value."""
    cut = rows.withColumn("_cuts", cuts)
    return cut.withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda b: b <= F.col(by))), F.lit(0))).drop("_cuts")


def lagged(rows: DataFrame, key: list[str], order: list[str], names: dict[str, str], slices: int = SLICES) -> DataFrame:
    """rows with new columns: for each name its column's value in the key's row before, null in the first. Equal to lag() over (key, order)."""
    kept = rows.columns
    marked = with_slice(rows, order[0], bounds(rows, order[0], slices))
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names.values())])
    last = marked.groupBy(*key, "_slice").agg(F.max_by(values, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("_last"))
    later = last.select(*key, F.lead("_slice").over(Window.partitionBy(*key).orderBy("_slice")).alias("_slice"), "_last").where("_slice is not null")
    sources = [F.col(c).alias(f"_v{i}") for i, c in enumerate(names.values())]
    carried = later.select(*key, "_slice", *[F.col(f"_last.v{i}").alias(f"_v{i}") for i in range(len(names))], F.lit(False).alias("_own"))
    both = marked.select(*kept, "_slice", *sources, F.lit(True).alias("_own")).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*key, "_slice").orderBy("_own", *order)
    return both.select(*kept, "_own", *[F.lag(f"_v{i}").over(w).alias(name) for i, name in enumerate(names)]).where("_own").drop("_own")


def upheld(marks: DataFrame, key: str, mark: str, cuts: Column, slices: int = SLICES) -> DataFrame:
    """marks (key, mark) with their slice, and each slice's last mark again in the slices after it up to the next that has one: key, _slice, mark."""
    own = with_slice(marks.select(key, mark), mark, cuts)
    last = own.groupBy(key, "_slice").agg(F.max(mark).alias(mark))
    upto = F.coalesce(F.lead("_slice").over(Window.partitionBy(key).orderBy("_slice")), F.lit(slices - 1))
    later = last.withColumn("_upto", upto).where("_slice < _upto").select(key, F.explode(F.expr("sequence(_slice + 1, _upto)")).alias("_slice"), mark)
    return own.unionByName(later)
