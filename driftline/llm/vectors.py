"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

A table gives a vector the signs of its products with `bits` random planes as a code;
vectors of one label meet in a bucket if their codes in a table are equal. Every pair that
meets is compared by cosine in double precision, so nothing below the threshold is linked.
Bits grow with the vectors of the largest label, so that unrelated vectors share a bucket
about BUCKET at a time whatever their number, and tables grow with the bits, so that a pair
at the threshold c meets in at least one with probability 1 - (1 - (1 - acos(c) / pi)^bits)^tables
>= RECALL, and nearer ones more surely. A pair is
counted in the first table in which it meets, told by the codes both carry, so pairs are
never rows: a bucket gives each vector its number of links there and the smallest id of
its local component, and these stars are joined by distributed connected components.

Equal vectors of a label are one node with a count. A bucket of more than `block` nodes is
split into blocks and compared block pair by block pair in tasks of their own, all of it,
so a hot bucket is spread and no task holds more than about two blocks.

Cosines are of vectors divided by their largest component first, so that very large and
very small numbers neither overflow nor vanish. Buckets of one vector are dropped by their
keys before any vector moves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and
all with a null label, link with nothing (n_links 0, component their own id, kept);
vectors of different lengths do not link; rows that repeat in id, vector and label count
as one vector and give a row each; rows that share a vec_id but not the vector are vectors of their own; a row without vec_id is not counted and takes its
node's component (null if no row of it has an id); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import connected_components, materialize, read, release

COSINE = 0.98
RECALL = 0.999
#: The fewest bits, the most (codes are ints), and the vectors of one label per code aimed at.
BITS, MOST_BITS, BUCKET = 12, 30, 64
BLOCK = 1024
SEED = 11


@lru_cache(maxsize=8)
def planes(dimensions: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, tables * bits))


def tables_for(cosine: float, bits: int) -> int:
    """Tables in which a pair at this cosine meets at least once with probability RECALL."""
    meet = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return 1 if meet >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; scaled by their largest component first, whatever its size."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def with_codes(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """nodes (id, label, vector, copies, least) with codes, an int per table."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            codes = np.zeros((len(batch), tables), np.int32)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                signs = _directions(_matrix(vectors.take(pa.array(at)))) @ planes(int(d), tables, bits) > 0
                codes[at] = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int32))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "codes"])

    label = nodes.schema["label"].dataType.simpleString()
    return map_in_arrow(nodes, run, f"id bigint, label {label}, vector array<double>, copies bigint, least bigint, codes array<int>")


def _compare(ids, vectors, copies, codes, block, table: int, pair: tuple[int, int], cosine: float):
    """Links of one bucket, or of one pair of its blocks: index, links and smallest id of the local component."""
    directions = _directions(vectors)
    linked = directions @ directions.T >= cosine
    if pair[0] != pair[1]:
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    for t in range(table):
        linked &= codes[:, t, None] != codes[None, :, t]
    hit = np.flatnonzero(linked.any(axis=1))
    if not len(hit):
        return None
    linked = linked[np.ix_(hit, hit)]
    links = linked @ copies[hit]
    low = ids[hit]
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], top).min(axis=1))
        if (new == low).all():
            return ids[hit], links, low
        low = new


def _bucket_links(buckets: DataFrame, tables: int, cosine: float) -> DataFrame:
    """id, links, low from rows sorted by bucket; a bucket may go on in the next batch."""
    names = ["label", "dims", "t", "code", "i", "j", "block", "id", "copies", "codes", "vector"]

    def groups(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ends = _ends(held)
            if len(ends) > 1:
                yield held.slice(0, ends[-2]).combine_chunks(), ends[:-1]
                held = held.slice(ends[-2])
        if held is not None and len(held):
            yield held.combine_chunks(), _ends(held)

    def _ends(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names[:6]])
        return np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, len(table))

    def run(batches):
        for table, ends in groups(batches):
            starts = np.append(0, ends[:-1])
            out = []
            column = {c: table.column(c).to_numpy() for c in ("t", "i", "j", "block", "id", "copies", "dims")}
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(table), tables)
            vectors = table.column("vector").combine_chunks()
            for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
                if z - a > 1:
                    own = slice(a, z)
                    found = _compare(
                        column["id"][own], _matrix(vectors.slice(a, z - a)), column["copies"][own], codes[own], column["block"][own],
                        int(column["t"][a]), (column["i"][a], column["j"][a]), cosine,
                    )
                    if found:
                        out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "low"])

    key = names[:6]
    return map_in_arrow(buckets.select(*names).repartition(*key).sortWithinPartitions(*key), run, "id bigint, links bigint, low bigint")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(_usable(F.col("vector"), F.col("label")), F.lit(False)))
    if bits is None:
        largest = rows.where("usable").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, largest / BUCKET)))))
    tables = tables or tables_for(cosine, bits)
    usable = rows.where("usable and vec_id is not null").dropDuplicates(["vec_id", "label", "vector"])
    nodes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id())
    nodes = materialize(with_codes(nodes.select("id", "label", "vector", "copies", "least"), tables, bits), "nodes")

    key = ["label", "dims", "t", "code"]
    slim = nodes.select("id", "label", F.size("vector").alias("dims"), F.posexplode("codes").alias("t", "code"))
    sizes = slim.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = slim.join(sizes, key).select(*key, "blocks", F.col("id").alias("own"), F.col("label").alias("own_label"))
    members = shared.join(nodes.drop("label"), F.col("own") == F.col("id"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = materialize(_bucket_links(members, tables, cosine), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = materialize(connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v"))), "groups")
    placed = nodes.select("id", "label", "vector", "copies", "least").join(links, "id", "left").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    smallest = placed.groupBy("group").agg(F.min("least").alias("component"))
    judged = materialize(
        placed.drop("component").join(smallest, "group").select(
            F.col("label").alias("n_label"), F.col("vector").alias("n_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("linked"), "component"
        ),
        "judged",
    )
    release(nodes)
    release(found)
    own = F.when(F.col("vec_id").isNull(), 0).otherwise(1)
    return rows.join(judged, F.col("usable") & (F.col("label") == F.col("n_label")) & (F.col("vector") == F.col("n_vector")), "left").select(
        "vec_id",
        F.coalesce(F.col("linked") - own, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98)
"""
OP4_SQL = "WITH RECURSIVE" + OP4_SQL.strip().removeprefix("WITH") + """,
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.v FROM r JOIN p ON r.b = p.u),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM p WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
