"""Periodic runs: maximal stretches of words that repeat with some period.

The dictionary of basic factors names every factor whose length is a power of two, level by
level, each from two names of the level below; a factor that occurs once in its document is
named no further. At the level of length L, a period q with L <= q < 2 L shows as two
occurrences of one factor q places apart. Occurrences at most L / 2 apart form arithmetic
progressions, which are taken as one (their steps are periods of lower levels), so a factor
has at most four progressions within 2 L; the distances between progressions are the periods
proposed. Each proposal is extended to both sides by the names of all levels, in as many
steps as there are levels, and stretches found more than once are kept with their smallest
period.

A document is one row and its words one array of a task, with 4 bytes per word and level;
documents are taken together up to CHUNK words, so a worker holds one chunk or one document.

Defined cases: null, empty and blank texts have no words and no runs; a very long text is
searched whole; repeated rows give repeated results; null doc_ids are kept; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import read, words_of

#: A run has at least so many words, and at least two periods.
MIN_WORDS = 12
#: Words of the documents that are named together.
CHUNK = 1 << 18


def basic_factors(words: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By level k: a name for the factor of length 2**k at each place, -1 if it occurs once or
    leaves the sequence; and the places of those that occur again, by name and then by place.
    """
    n = len(words)
    places, keys, levels, occurrences = np.arange(n), words, [], []
    while len(places):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        name = np.cumsum(new) - 1
        again = np.bincount(name)[name] > 1
        names = np.full(n, -1, np.int32)
        names[places[order[again]]] = name[again]
        if not again.any():
            break
        levels.append(names)
        occurrences.append(places[order[again]])
        length = 1 << (len(levels) - 1)
        places = np.flatnonzero(names >= 0)
        places = places[places + length < n]
        places = places[names[places + length] >= 0]
        keys = names[places].astype(np.int64) * n + names[places + length]
    return levels, occurrences


def proposals(names: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q, length <= q < 2 * length, such that the factor at i stands again at i + q."""
    named = names[places]
    tight = (named[1:] == named[:-1]) & (2 * (places[1:] - places[:-1]) <= length)
    first = np.flatnonzero(np.r_[True, ~tight])
    last = np.r_[first[1:] - 1, len(places) - 1]
    start, end, name, size = places[first], places[last], named[first], last - first + 1
    step = np.where(size > 1, places[np.minimum(first + 1, len(places) - 1)] - start, 0)
    found_i, found_q = [], []

    def propose(i: np.ndarray, q: np.ndarray) -> None:
        fits = (q >= length) & (q < 2 * length)
        found_i.append(i[fits])
        found_q.append(q[fits])

    for ahead in (1, 2, 3):  # progressions are over length / 2 apart
        one = np.flatnonzero((name[ahead:] == name[:-ahead]) & (start[ahead:] - end[:-ahead] < 2 * length))
        two = one + ahead
        propose(end[one], end[two] - end[one])
        several = (size[one] > 1) | (size[two] > 1)
        one, two = one[several], two[several]
        propose(start[one], start[two] - start[one])
        by = np.maximum(step[one], step[two])
        touching = start[two] - end[one] < length + 2 * by
        one, two, by = one[touching], two[touching], by[touching]
        # every distance between the two progressions, as far as it can be a period of this level
        nearest = start[two] - end[one]
        lowest = np.maximum(0, -((nearest - length) // by))
        highest = np.minimum(size[one] + size[two] - 2, (2 * length - 1 - nearest) // by)
        many = np.maximum(0, highest - lowest + 1)
        t = np.repeat(lowest - (np.cumsum(many) - many), many) + np.arange(many.sum())
        one, two, by, nearest = (np.repeat(v, many) for v in (one, two, by, nearest))
        propose(end[one] - by * np.maximum(0, t - (size[two] - 1)), nearest + t * by)
    i, q = np.concatenate(found_i), np.concatenate(found_q)
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    fresh = np.r_[True, (q[1:] != q[:-1]) | (i[1:] > i[:-1] + 1)][: len(i)]  # neighbours lie in the same run
    return i[fresh], q[fresh]


def _extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from i and j on are equal, and the words before them."""
    n = len(levels[0])
    after, before = np.zeros_like(i), np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        length, names = 1 << k, levels[k]
        a, b = i + after, np.minimum(j + after, n - 1)  # the factor at the last place is named at level 0 only
        after += length * ((j + after < n) & (names[a] >= 0) & (names[a] == names[b]))
        a, b = i - before - length, j - before - length
        before += length * ((a >= 0) & (names[np.maximum(a, 0)] >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)]))
    return after, before


def periodic_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of all runs, by start and then period; words: numbers, equal ones for equal words."""
    levels, occurrences = basic_factors(words)
    found = [np.empty((3, 0), np.int64)]
    for k, places in enumerate(occurrences):
        i, q = proposals(levels[k], places, 1 << k)
        if len(i):
            after, before = _extend(levels, i, i + q)
            start, end = i - before, i + q + after
            long_enough = end - start >= np.maximum(2 * q, min_words)
            found.append(np.stack([start, end, q])[:, long_enough])
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _chunk(texts: list[list[bytes]], min_words: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs, and kept words joined, of each document. Words of different documents never have one number."""
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    numbers = np.empty(sizes.sum(), np.int64)
    used = 0
    for words, at in zip(texts, first.tolist(), strict=True):
        own: dict[bytes, int] = {}
        numbers[at : at + len(words)] = [own.setdefault(w, len(own)) for w in words]
        numbers[at : at + len(words)] += used
        used += len(own)
    start, end, period = periodic_runs(numbers, min_words) if len(numbers) else np.empty((3, 0), np.int64)
    document = np.searchsorted(first + sizes, start, side="right")
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    keep = np.cumsum(dropped[:-1]) == 0
    runs: list[list[dict]] = [[] for _ in texts]
    at = start - first[document] if len(start) else start
    for d, s, n, q in zip(document.tolist(), at.tolist(), (end - start).tolist(), period.tolist(), strict=True):
        runs[d].append({"start": s, "length": n, "period": q})
    kept = [b" ".join(compress(w, keep[at : at + len(w)].tolist()) if r else w) for w, at, r in zip(texts, first.tolist(), runs, strict=True)]
    return runs, kept


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period in words, by start and period) and
    collapsed: the words joined by single spaces, each run cut to its first period.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, column, begun, texts, n = batch.column(0), batch.column(1), 0, [], 0
            for k, text in enumerate(column):
                texts.append(text.as_buffer().to_pybytes().split() if text.is_valid else [])  # splits at the white space of the contract
                n += len(texts[-1])
                if n >= CHUNK or k + 1 == len(column):
                    runs, kept = _chunk(texts, min_words)
                    for at in range(0, len(texts), 1024):
                        part = slice(at, at + 1024)
                        yield pa.RecordBatch.from_arrays(
                            [ids.slice(begun + at, len(texts[part])), pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(runs[part], kind), pa.array(kept[part], pa.binary())],
                            names=["doc_id", "n_words", "runs", "collapsed"],
                        )
                    begun, texts, n = k + 1, [], 0

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    found = map_in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the repetition that the query plants in a tenth of the documents; words joined by single spaces there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = words_of(text)
    n = F.size(words).cast("long")
    g = F.floor(h / 10).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = collapse_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.length")).alias("length"),
        F.col("longest.period").alias("period"), F.floor(-1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
