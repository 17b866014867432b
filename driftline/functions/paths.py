"""Path strings: "" is the root, components are separated by "/", no leading slash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """The directory of an entry; "" for an entry of the root."""
    return F.left(path, F.greatest(F.length(path) - F.length(leaf(path)) - 1, F.lit(0)))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    """Number of components; 0 for the root."""
    return F.when(path == "", 0).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"))) + 1).cast("int")


def join(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def prefixes(path: Column) -> Column:
    """The path and all directories above it but the root, shortest first."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(depth(path), F.lit(1))), lambda i: F.call_function("substring_index", path, F.lit("/"), i))
    )


def ancestors(path: Column) -> Column:
    """All directories above a path, the root first; none for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit("")), F.slice(prefixes(path), 1, F.greatest(depth(path) - 1, F.lit(0))))
    )


def trimmed(path: Column) -> Column:
    """An absolute path without trailing slashes; "/" becomes ""."""
    return F.regexp_replace(path, "/+$", "")


def paths_overlap(a: Column, b: Column) -> Column:
    """Equal, or one contains the other by whole components."""
    x, y = F.concat(trimmed(a), F.lit("/")), F.concat(trimmed(b), F.lit("/"))
    return x.startswith(y) | y.startswith(x)


def root_above(paths: DataFrame, roots: DataFrame, beneath: bool = False) -> DataFrame:
    """paths (rel_path, and more) joined to the roots (column root, and more) that they are or lie beneath; one row per such
    root. With `beneath` a path is not its own root, and paths no deeper than the highest root leave before they are moved.

    Only prefixes as deep as some root are made, so a path gives as many keys as there are depths of roots.
    """
    at = depth(F.col("rel_path"))
    if beneath:
        paths = paths.where(at > roots.agg(F.min(depth(F.col("root")))).scalar())
    keyed = paths.withColumn("__depths", roots.agg(F.collect_set(depth(F.col("root")))).scalar())
    each = F.filter("__depths", (lambda n: n < at) if beneath else (lambda n: n <= at))
    keys = keyed.select(*paths.columns, F.explode(F.transform(each, lambda n: F.call_function("substring_index", F.col("rel_path"), F.lit("/"), n))).alias("root"))
    return keys.join(roots, "root")
