"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct shingles (runs of `k` words, A-Z lower-cased). 128
multiply-add permutations give minima; 25 bands of five minima make keys, and two bits of
each minimum's hash are packed into 256 bits. Two sets agree in a slot with probability
J + (1 - J) / 4, so the share m of agreeing slots, counted by bits, estimates J as
(m - 1/4) / (3/4). Pairs of a band whose estimate is 0.2 or more below the threshold
(over four standard deviations) are not linked; all others, and all pairs whose smaller set
has fewer than 200 shingles, are confirmed on full sets, as estimates of few shingles vary more.
Bands find a pair at similarity 0.8 with probability 1 - (1 - 0.8^5)^25 = 0.99995.

Equal sets are one node, with a number of its own, so exact copies never pair. Within a bucket nodes are first
compared with the smallest node only, then, where a bucket still has nodes of different
components, with two nodes drawn by hash; the draws of a node's buckets differ, so a large
group of near copies grows together by a few comparisons a node. Only pairs that then still
lie in different components are all compared, small sets by their shingles and others by
an estimate from 1024 further slots (within 0.09, over five deviations) that is part of the join. So every pair of a bucket is either compared or already connected, and groups of near copies
do not become all their pairs. Where more than LARGE nodes of a bucket are still open (copies of one text that
differ from each other by just too much), pairs are no rows at all: nodes lie in blocks, and the full sets of two blocks that
share such a bucket are compared in one task, which gives the links only.

Defined cases: null texts and texts without words have an empty set and link with nothing;
fewer than k words are one shingle; texts are read whole whatever their length; rows that
repeat are a row each in the result; rows that share a doc_id are one document, which links
with all that any of its texts links with; a row without doc_id links like any other and has
the smallest id of its component (null if no row of it has one, and then kept); an empty
table gives an empty result; other columns of the input are not read. one_per_group() keeps
texts that share a doc_id apart: of each group of near-duplicates it leaves the row with the
smallest doc_id (nulls last, then by hash of the text, then of the row), and all rows without words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import WORD, WordCache, connected_components, materialize, mixed, read, release

SLOTS = 128
BANDS, ROWS = 25, 5
BITS = 2
MARGIN = 0.2
#: Slots of the finer estimate of documents that share a bucket, and its margin.
FINE_SLOTS = 1024
FINE_MARGIN = 0.09
#: Pairs whose smaller set has fewer shingles are confirmed without an estimate.
SMALL = 200
#: Buckets with more open nodes are compared in blocks, of so many nodes and shingles at most, about.
LARGE = 64
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _word_hashes() -> WordCache:
    import xxhash

    return WordCache(xxhash.xxh64_intdigest)


@lru_cache(maxsize=4)
def _permutations(slots: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([7, slots])
    a = random.integers(0, 2**31, slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, random.integers(0, 2**32, slots, dtype=np.uint32)


def shingle_set(text: bytes, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = text.lower().split()  # of bytes: A-Z, and the white space of the contract
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out + h[i : i + len(out)])
    return np.unique(out)


def _minima(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    a, b = _permutations(slots)
    low = np.full(slots, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = (1 << 18) // slots
    for i in range(0, len(x), step):
        np.minimum(low, (x[i : i + step, None] * a + b).min(axis=0), out=low)
    return low


def _packed(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum's hash, 32 slots to a 64-bit word; the minimum's own low bits agree in all slots or in none."""
    pairs = (mixed(minima.astype(np.uint64)) & np.uint64(3)).reshape(-1, 32)
    return (pairs << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for i in range(ROWS):
        key = mixed(key + rows[:, i])
    return key


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, two hashes of the set, the packed slots and the band keys."""

    def run(batches):
        hashes = _word_hashes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n, one, two, slots, keys = [], [], [], [], []
                for text in part.column(2):
                    s = shingle_set(_bytes(text), k, hashes)
                    n.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append(mixed(s ^ _MIX).sum(dtype=np.uint64))
                    minima = _minima(s) if len(s) else None
                    slots.append(_packed(minima) if len(s) else np.empty(0, np.uint64))
                    keys.append(_band_keys(minima) if len(s) else np.empty(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (one, two)), _longs(slots), _longs(keys)],
                    names=["doc_id", "th", "n_shingles", "set_a", "set_b", "slots", "bands"],
                )
        hashes.clear()  # the worker lives on, beside others

    return map_in_arrow(_keyed(docs), run, "doc_id bigint, th bigint, n_shingles bigint, set_a bigint, set_b bigint, slots array<bigint>, bands array<bigint>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, the sorted shingle hashes and the finer slots of each row of id and text."""

    def run(batches):
        hashes = _word_hashes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(_bytes(text), k, hashes) for text in part.column(1)]
                fine = [_packed(_minima(s, FINE_SLOTS)) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), _longs(sets), _longs(fine)], names=["id", "shingles", "fine"])
        hashes.clear()

    return map_in_arrow(texts.select("id", "text"), run, "id bigint, shingles array<bigint>, fine array<bigint>")


def estimate(x: str, y: str, slots: int = SLOTS) -> Column:
    """Similarity from the packed slots in columns x and y, corrected for slots that agree by chance."""
    apart = [f"bit_count(({d} | shiftrightunsigned({d}, 1)) & {0x5555555555555555}L)" for d in (f"(get({x}, {i}) ^ get({y}, {i}))" for i in range(slots // 32))]
    chance = 2.0**-BITS
    return F.expr(f"((1 - ({' + '.join(apart)}) / {slots}) - {chance}D) / {1 - chance}D")  # one text, parsed at once


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, and what else they carry) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v"
    )
    sized = both.withColumn("common", F.size(F.array_intersect("su", "sv"))).select(
        *pairs.columns, "common", (F.size("su") + F.size("sv") - F.col("common")).alias("either")
    )
    return sized.where(100 * F.col("common").cast("long") >= percent * F.col("either").cast("long")).select(*pairs.columns)


def _in_common(shingles: np.ndarray, sizes: np.ndarray, left: int) -> np.ndarray:
    """How many shingles each of the first `left` sets shares with each of the rest; if there is no rest, sets with later ones among themselves."""
    start = left % len(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(shingles, kind="stable")
    row, value = row[order], shingles[order]
    column = np.cumsum(np.append(False, value[1:] != value[:-1]))
    count = np.bincount(column)
    often = count > max(2, len(sizes) // 32)
    out = np.zeros((left, len(sizes) - start), np.float32)  # whole numbers, exact up to 2**24
    at = often[column]
    r, c = row[at], (np.cumsum(often) - 1)[column[at]]
    for low in range(0, int(often.sum()), 1024):  # frequent ones by products of matrices
        own = slice(*np.searchsorted(c, [low, low + 1024]))
        holds = np.zeros((len(sizes), 1024), np.float32)
        holds[r[own], c[own] - low] = 1
        out += holds[:left] @ holds[start:].T
    at = ~at & (count[column] > 1)
    r, c, step = row[at], column[at], 1
    while len(same := np.flatnonzero(c[step:] == c[:-step])):  # rare ones by their pairs
        x, y = r[same], r[same + step]
        if start:
            across = (x < left) & (y >= left)
            x, y = x[across], y[across]
        np.add.at(out, (x, y - start), 1)
        step += 1
    return out


def _linked_components(sets: pa.ListArray, component: np.ndarray, left: int, percent: int) -> np.ndarray:
    """The pairs of components that a link between two sets joins; of the first `left` sets with the rest, or of all if there is no rest."""
    n = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    start = left % len(n)
    common = _in_common(sets.flatten().to_numpy().view(np.uint64), n, left).astype(np.int64)
    linked = (100 + percent) * common >= percent * (n[:left, None] + n[None, start:])
    linked &= component[:left, None] != component[None, start:]
    u, v = np.nonzero(linked if start else np.triu(linked, 1))
    return np.unique(np.stack([component[u], component[v + start]], axis=1), axis=0)


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """cu, cv from rows (a, b, side, component, shingles): the sets of two blocks a and b, or of one."""

    def groups(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            a, b = held.column("a").to_numpy(), held.column("b").to_numpy()
            ends = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for at, to in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=False):
                yield held.slice(at, to - at)
            held = held.slice(ends[-1]) if len(ends) else held  # a pair of blocks may go on in the next batch
        if held is not None and len(held):
            yield held

    def run(batches):
        for table in groups(batches):
            left = len(table) - int(table.column("side").to_numpy().sum())
            found = _linked_components(pa.concat_arrays(table.column("shingles").chunks), table.column("component").to_numpy(), left, percent)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["cu", "cv"])

    return map_in_arrow(rows.repartition("a", "b").sortWithinPartitions("a", "b", "side"), run, "cu bigint, cv bigint")


def crowded_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (cu, cv) between components, from all pairs of each bucket of members (key, id, component, m: nodes of the bucket), compared on full sets.

    A node's home is the largest bucket among its own and those of the nodes it meets; homes are cut into blocks. Nodes
    of a group of near copies share most buckets, so they have one home, and a pair is compared once whatever it shares.
    """
    met = members.select("key", "id", F.struct("m", "key").alias("home"))
    largest = met.groupBy("id").agg(F.max("home").alias("home"))
    near = met.select("key", "id").join(largest, "id").groupBy("key").agg(F.max("home").alias("home"))
    homes = members.select("key", "id", "component").join(near, "key").groupBy("id").agg(F.max("home").alias("home"), F.any_value("component").alias("component"))
    homes = materialize(homes.join(sets.select("id", F.size("shingles").alias("n")), "id").select("id", "component", "n", F.col("home.key").alias("home")), "homes")
    cut = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = homes.join(cut, "home").select("id", "component", F.xxhash64("home", F.pmod(F.xxhash64("id"), "blocks")).alias("block"))
    there = members.select("key", "id").join(placed, "id").select("key", "block").distinct()
    pairs = there.select("key", F.col("block").alias("a")).join(there.select("key", F.col("block").alias("b")), "key").where("a <= b").select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.where("a < b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))
    found = materialize(_block_links(sides.join(placed.join(sets.select("id", "shingles"), "id"), "block").select("a", "b", "side", "component", "shingles"), percent).distinct(), "found")
    release(homes, pairs)
    return found


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, component) after links between components (cu, cv) have joined some; an id without a group is its own component.

    Only the components that links touch are joined anew, not the links that made them.
    """
    joined = materialize(connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "joined")
    relabelled = groups.join(joined.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
    alone = joined.join(groups.select("id"), "id", "left_anti")
    out = materialize(relabelled.select("id", F.coalesce("least", "component").alias("component")).unionByName(alone), "groups")
    release(joined, groups)
    return out


def linked_sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of sketches(), and node, low (smallest doc_id of its rows) and component (a node) of each set."""
    made = materialize(sketches(docs, k), "sketches")
    own = F.struct("doc_id", "th")
    nodes = made.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(
        F.min("doc_id").alias("low"), F.min(own).alias("rep"), F.any_value("slots").alias("slots"), F.any_value("bands").alias("bands")
    )
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    slots = nodes.select("id", "slots", F.col("n_shingles").alias("n"))
    members = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    buckets = materialize(members.join(shared.select("key", "low"), "key"), "buckets")
    candidates = nodes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    found = _keyed(docs).join(candidates, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sets = materialize(
        shingle_sets(found, k).groupBy("id").agg(F.any_value("shingles").alias("shingles"), F.any_value("fine").alias("fine")), "sets"
    )
    like_sizes = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")  # else even the smaller set is too small a part
    small = F.least("nu", "nv") < SMALL
    may_link = like_sizes & (small | (estimate("x", "y") >= percent / 100 - MARGIN))

    def close(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (u, v) whose estimate is near the threshold or above."""
        return (
            pairs.distinct()
            .join(slots.select(F.col("id").alias("u"), F.col("slots").alias("x"), F.col("n").alias("nu")), "u")
            .join(slots.select(F.col("id").alias("v"), F.col("slots").alias("y"), F.col("n").alias("nv")), "v")
            .where(may_link)
            .select(*pairs.columns)
        )

    def still_open(groups: DataFrame, members: DataFrame) -> DataFrame:
        """key, band, id, component, m (open nodes of the bucket) of buckets whose members lie in different components."""
        placed = members.select("key", "band", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ends = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m"))
        return materialize(placed.join(ends.where("a < b").select("key", "m"), "key"), "open")

    stars = close(buckets.where("low < id").select(F.col("low").alias("u"), F.col("id").alias("v")))
    links = materialize(confirmed(stars, sets, percent), "links")
    groups = materialize(connected_components(links), "groups")

    open_ = still_open(groups, buckets)
    member = F.struct(F.col("id").alias("id"), F.col("component").alias("component"))
    draw = F.xxhash64("id", "key")
    drawn = open_.groupBy("key").agg(F.min_by(member, draw).alias("a"), F.max_by(member, draw).alias("b")).select("key", F.explode(F.array("a", "b")).alias("c"))
    tried = open_.join(drawn, "key").where("component <> c.component").select(F.col("id").alias("u"), F.col("c.id").alias("v"), F.col("component").alias("cu"), F.col("c.component").alias("cv"))
    groups = merged(groups, confirmed(close(tried), sets, percent))

    opened = still_open(groups, open_)
    release(open_)
    crowded = opened.where(F.col("m") > LARGE)
    rest = opened.where(F.col("m") <= LARGE)
    rest = rest.join(slots, "id").join(sets.select("id", "fine", F.when(F.size("shingles") * percent < SMALL * 100, F.col("shingles")).alias("few")), "id").join(nodes.select("id", "bands"), "id")
    first_band = F.expr("case " + " ".join(f"when bx[{i}] = by[{i}] then {i}" for i in range(BANDS)) + " end")  # a pair is one row whatever it shares
    nearly = estimate("fx", "fy", FINE_SLOTS) >= percent / 100 - FINE_MARGIN
    common = F.size(F.array_intersect("sx", "sy"))
    alike = F.when(small, 100 * common >= percent * (F.col("nu") + F.col("nv") - common)).otherwise(nearly)
    left = rest.select("key", "band", F.col("bands").alias("bx"), F.col("id").alias("u"), F.col("component").alias("cu"), F.col("slots").alias("x"), F.col("n").alias("nu"), F.col("fine").alias("fx"), F.col("few").alias("sx"))
    right = rest.select(F.col("key").alias("k"), F.col("bands").alias("by"), F.col("id").alias("v"), F.col("component").alias("cv"), F.col("slots").alias("y"), F.col("n").alias("nv"), F.col("fine").alias("fy"), F.col("few").alias("sy"))
    others = left.join(right, (F.col("key") == F.col("k")) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & may_link & (first_band == F.col("band")) & alike)
    links_left = confirmed(others.select("u", "v", "cu", "cv"), sets, percent).select("cu", "cv")
    if not crowded.isEmpty():
        links_left = links_left.unionByName(crowded_links(crowded, sets, percent))
    groups = merged(groups, links_left)
    release(buckets, sets, links, opened)

    placed = nodes.select("n_shingles", "set_a", "set_b", "id", "low").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return made, placed


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs."""
    made, placed = linked_sets(docs, k, percent)
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = placed.join(least, "component").select("n_shingles", "set_a", "set_b", "component_id")
    rows = made.select("doc_id", "n_shingles", "set_a", "set_b").join(labels, ["n_shingles", "set_a", "set_b"], "left")
    rows = materialize(rows.select("doc_id", "n_shingles", "component_id"), "rows")
    several = rows.groupBy("doc_id").agg(F.min("component_id").alias("v"), F.max("component_id").alias("last")).where("doc_id is not null and v < last")
    joined = materialize(rows.join(several, "doc_id").select(F.col("component_id").alias("u"), "v").where("u is not null"), "joined")
    if not joined.isEmpty():  # documents of several texts join what these link with
        whole = connected_components(joined).select(F.col("id").alias("component_id"), F.col("component").alias("least"))
        rows = rows.join(whole, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, and all rows without words."""
    made, placed = linked_sets(docs, k, percent)
    key = ["n_shingles", "set_a", "set_b"]
    rows = made.select("doc_id", "th", *key).join(placed.select(*key, "component"), key)
    rows = rows.groupBy("component", "doc_id", "th").agg(F.count("*").alias("copies"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "copies")).alias("w"))
    first = materialize(first.select(F.col("w.doc_id").alias("w_id"), F.col("w.th").alias("w_th"), F.col("w.copies").alias("w_copies")), "first")
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    held = docs.where(worded).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    held = held.join(first, (F.col("th") == F.col("w_th")) & F.col("d").eqNullSafe(F.col("w_id")))
    repeated = held.where("w_copies > 1").groupBy("d", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return docs.where(~worded).unionByName(held.where("w_copies = 1").select("row.*")).unionByName(repeated.select("row.*"))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
k AS MATERIALIZED (SELECT rid, doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS h, g FROM g),
s AS MATERIALIZED (SELECT h, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS low FROM k WHERE h IS NOT NULL GROUP BY h),
x AS MATERIALIZED (SELECT h, n, unnest(g) AS x FROM s),
p AS MATERIALIZED (SELECT a.h AS u, b.h AS v FROM x a JOIN x b ON a.x = b.x AND a.h <> b.h GROUP BY a.h, a.n, b.h, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT h AS a, h AS b FROM s UNION SELECT r.a, p.v FROM r JOIN p ON r.b = p.u),
c AS (SELECT a AS h, min(low) AS component_id FROM r JOIN s ON s.h = r.b GROUP BY a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM k LEFT JOIN c USING (h)
"""
