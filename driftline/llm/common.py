"""What the operators share: tables in the shared folder, words, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.storage import materialize, release, shared_folder  # noqa: F401

#: A word is a run of characters outside this class (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class WordCache(dict):
    """What a function says of words, kept for short ones up to a bound, so that a worker's memory stays bounded."""

    LONGEST, MOST = 48, 500_000

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, word: bytes):
        found = self.function(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values, thoroughly mixed, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of an edge, component being the smallest id reachable.

    edges: columns u, v (long, not null); direction, repeats and loops do not matter.
    Alternating large-star and small-star steps: each hangs the neighbours of a node on
    the smallest of them, so a chain halves per round and a hub stays one aggregate.
    Minima are combined before the shuffle; joins that hit a hub are split by adaptive
    execution. Each round is a table in the shared folder; the old one is removed.
    """
    now = materialize(_forward(edges), "edges")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        new = materialize(_forward(_star(_star(both, larger=True), larger=False)), "edges")
        release(now)
        now = new
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _forward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger id to the smaller; loops go."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: neighbours above u hang on the smallest neighbour; small star: those below u, and u."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = edges.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
        least.select("u", F.col("low").alias("v"))
    )


def _all_stars(edges: DataFrame) -> bool:
    """Every id hangs on one other, on which nothing but such ids hang."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    ends = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()
