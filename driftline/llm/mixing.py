"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Every source gets a target (its weight's share of the whole mix, at most `epochs` times
its size, the excess shared again). The documents of a source lie in seeded order in
shards; a shard is a row of blocks of `block` words. Blocks are apportioned by highest
quotients, first to sources by their targets, then within a source to its shards by their
words; both results are integer quotas. In a shard of n blocks with quota q the blocks are
taken evenly from a seeded start: block j is taken floor(((j+1)q+s)/n) - floor((jq+s)/n)
times, so what a document gives follows from its place alone and no block is made a row.

A hot source is split over shards (at most `max_shards` a source); sums are combined before
the shuffle. The table of sources is small and is ordered in one task; nothing else is.

Defined cases: a null text has size 0 and takes 0; null sources form one source, ordered
last; rows without a doc_id are placed by their text, and rows that share one are ordered by it;
rows that repeat are rows of their own; a document may miss its even share by a block, and a
source smaller than a few blocks its target; an empty table gives an empty result; columns of the input that carry the names of results do not
matter, only doc_id, source and text are read (mix_documents keeps all columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read, word_count

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_WORDS = 262_144
MAX_SHARDS = 4096
EPOCHS = 2
SEED = "mix-1"


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Seats by highest quotients votes / (2 s - 1), for each group on its own.

    parties: group and party columns, votes (0 or more), seats (the same within a group).
    Returns group and party columns and `quota` (long). Ties go to the smaller party, nulls
    last. Seats that are certain are given by the rounded lower bound of the divisor; only
    about four quotients a party are ranked for the rest.
    """
    whole = Window.partitionBy(*group)
    v, k = F.col("__v"), F.col("__n")
    base = (
        parties.select(*group, *party, F.col(votes).cast("double").alias("__v"), F.col(seats).cast("long").alias("__k"))
        .withColumn("__sum", F.sum("__v").over(whole))
        .withColumn("__n", F.sum(F.when(v > 0, 1).otherwise(0)).over(whole))
    )

    def at(seats_total: Column) -> Column:
        return F.when(F.col("__sum") > 0, F.floor(seats_total * v / F.col("__sum") + 0.5)).otherwise(0)

    base = base.withColumn("__low", F.greatest(F.lit(0), at(F.greatest(F.lit(0.0), F.col("__k") - k / 2)) - 1)).withColumn(
        "__high", at(F.col("__k") + k / 2) + 1
    )
    base = base.withColumn("__rest", F.col("__k") - F.sum("__low").over(whole))
    tried = base.where((v > 0) & (F.col("__k") > 0)).select(
        *group, *party, "__v", "__rest", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__s")
    )
    order = Window.partitionBy(*group).orderBy(
        (v / (2 * F.col("__s") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in party], "__s"
    )
    won = (
        tried.withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= F.col("__rest"))
        .select(*[F.col(c).alias(f"__{c}") for c in group + party])
        .groupBy(*[f"__{c}" for c in group + party])
        .agg(F.count("*").alias("__won"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group + party]
    return base.join(won, same, "left").select(
        *group, *party, (F.col("__low") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota")
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, share=(3, 2), epochs=EPOCHS) -> DataFrame:
    """source, source_size and target (double); one row per source.

    The level L with sum(min(epochs * size, L * weight)) = share * total is the largest of
    (share * total - caps before) / weights from here on, in the order of cap / weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_rows = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn(
        "__rank", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    cap = epochs * F.col("source_size")
    order = all_rows.orderBy(cap / F.col("__w"), "__rank")
    level = (share[0] * F.col("__all") - share[1] * F.col("__caps")).cast("double") / (share[1] * F.col("__left")).cast("double")
    return (
        ranked.withColumn("__all", F.sum("source_size").over(all_rows))
        .withColumn("__caps", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", F.max(level).over(all_rows))
        .withColumn("target", F.least(cap.cast("double"), F.col("__w").cast("double") * F.col("__level")))
        .select("source", "source_size", "target", "__all")
    )


def _placed(sized: DataFrame, weights, block, shard_words, max_shards, epochs, seed, share) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and the shard, start, quota, blocks and seeded start."""
    targets = materialize(source_targets(sized, weights, share, epochs), "targets")
    quotas = sainte_lague(
        targets.withColumn("seats", F.floor(F.lit(share[0]) * F.col("__all") / (share[1] * block)).cast("long")).withColumn("every", F.lit(0)),
        ["every"], ["source"], "target", "seats",
    ).select(F.col("source").alias("q_source"), F.col("quota").alias("source_quota"))
    sources = materialize(
        targets.drop("__all")
        .join(quotas, F.col("source").eqNullSafe(F.col("q_source")))
        .select(
            F.col("source").alias("s_source"), "source_size", "target", "source_quota",
            F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("n_shards"),
        ),
        "sources",
    )
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("th"))))
    docs = (
        sized.withColumn("mix_key", key)
        .join(sources, F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("shard", F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    )
    shards = docs.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("source_quota").alias("seats"))
    shards = sainte_lague(shards, ["source"], ["shard"], "words", "seats").select(
        F.col("source").alias("k_source"), F.col("shard").alias("k_shard"), "quota"
    )
    shards = materialize(shards, "quotas")
    shard = Window.partitionBy("source", "shard")
    return (
        docs.withColumn("stop", F.sum("size").over(shard.orderBy("mix_key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.sum("size").over(shard) / block)).cast("long"))
        .join(shards, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("shard") == F.col("k_shard")))
        .withColumn("quota", F.least(F.col("quota"), epochs * F.col("n_blocks")))
        .withColumn("seed", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("\0")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n_blocks"))
        .drop("s_source", "k_source", "k_shard", "n_shards", "source_quota")
    )


#: Words taken of the first x words of a shard: whole blocks, then the block that x lies in.
_TAKEN = (
    "(({x} div {b}) * quota + seed) div n_blocks * {b}"
    " + ((({x} div {b} + 1) * quota + seed) div n_blocks - (({x} div {b}) * quota + seed) div n_blocks) * ({x} % {b})"
)


def _text_hash() -> Column:
    """Tells rows with one doc_id apart, and rows without one."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, block=BLOCK, shard_words=SHARD_WORDS, max_shards=MAX_SHARDS, epochs=EPOCHS, seed=SEED, share=(3, 2)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), shard, quota."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_hash().alias("th")), "sized")
    placed = _placed(sized, weights, block, shard_words, max_shards, epochs, seed, share)
    taken = F.expr(_TAKEN.format(x="stop", b=block)) - F.expr(_TAKEN.format(x="start", b=block))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "quota")


def mix_documents(docs: DataFrame, weights=WEIGHTS, block=BLOCK, shard_words=SHARD_WORDS, max_shards=MAX_SHARDS, epochs=EPOCHS, seed=SEED, share=(3, 2)) -> DataFrame:
    """The mix itself, with the columns of docs: a document comes once per whole copy, and
    once more cut to the blocks that are taken once more often; a document of which nothing
    is taken goes. n_chars, where docs has it, is the length of the text that is left.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_hash().alias("th"), F.struct("*").alias("doc")), "sized")
    placed = _placed(sized, weights, block, shard_words, max_shards, epochs, seed, share)
    words = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    kept = F.filter("words", lambda w, i: _in_extra(i, block))
    whole = F.array_repeat(F.col("doc.text"), F.expr("cast(quota div n_blocks as int)"))
    rows = (
        placed.where("size > 0")
        .withColumn("words", F.when(F.expr("quota % n_blocks > 0"), words).otherwise(F.array().cast("array<string>")))
        .withColumn("kept", kept)
        .withColumn("part", F.when(F.size("kept") == F.col("size"), F.col("doc.text")).otherwise(F.array_join("kept", "")))
        .withColumn("mixed_text", F.explode(F.concat(whole, F.when(F.size("kept") > 0, F.array("part")).otherwise(F.array().cast("array<string>")))))
    )
    changed = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("long")}
    return rows.select(*[(changed[c] if c in changed else F.col("doc")[c]).alias(c) for c in docs.columns])


def _in_extra(i: Column, block: int) -> Column:
    """Whether the part of the quota that is no whole copy takes the block of the document's word i."""
    quota, n, seed = F.col("quota") % F.col("n_blocks"), F.col("n_blocks"), F.col("seed")
    j = F.floor((F.col("start") + i) / F.lit(block))
    return F.pmod(j * quota + seed, n) + quota >= n


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The same mix by plain counting: every quotient of every party is ranked.
OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS th FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rk, sum(source_size) OVER () AS total FROM src),
lv AS (SELECT *, (3 * total - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (2 * sum(w) OVER (ORDER BY 2 * source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM w),
tg AS (SELECT source, source_size, total, least((2 * source_size)::DOUBLE, w::DOUBLE * max(lv) OVER ()) AS target FROM lv),
seats AS (SELECT any_value(3 * total // (2 * {BLOCK})) AS k FROM tg),
sq AS (SELECT source, row_number() OVER (ORDER BY target / (2 * s - 1) DESC, source NULLS LAST, s) AS r
       FROM tg, unnest(range(1, (2 * source_size // {BLOCK} + 10)::BIGINT)) u(s) WHERE target > 0),
sk AS (SELECT source, count(*) AS n FROM sq, seats WHERE r <= k GROUP BY source),
so AS (SELECT tg.source, source_size, target, coalesce(n, 0) AS n, least({MAX_SHARDS}, greatest(1, ceil(source_size / {SHARD_WORDS})))::BIGINT AS shards
       FROM tg LEFT JOIN sk ON tg.source IS NOT DISTINCT FROM sk.source),
d AS (SELECT sized.*, source_size, target, n, md5('{SEED}:' || coalesce(doc_id::VARCHAR, th)) AS h FROM sized JOIN so ON sized.source IS NOT DISTINCT FROM so.source),
ds AS (SELECT d.*, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard FROM d JOIN so ON d.source IS NOT DISTINCT FROM so.source),
sh AS (SELECT source, shard, sum(size) AS words, any_value(n) AS n, greatest(1, ceil(sum(size) / {BLOCK}))::BIGINT AS blocks FROM ds GROUP BY source, shard),
hq AS (SELECT source, shard, n, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * s - 1) DESC, shard, s) AS r
       FROM sh, unnest(range(1, 2 * blocks + 10)) u(s) WHERE words > 0),
hk AS (SELECT source, shard, count(*) AS q FROM hq WHERE r <= n GROUP BY source, shard),
qq AS (SELECT sh.source, sh.shard, blocks, least(2 * blocks, coalesce(q, 0)) AS q,
              ('0x' || substr(md5('{SEED}:' || coalesce(sh.source, chr(0)) || ':' || sh.shard), 1, 8))::BIGINT % blocks AS seed
       FROM sh LEFT JOIN hk ON sh.source IS NOT DISTINCT FROM hk.source AND sh.shard = hk.shard),
p AS (SELECT ds.*, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size, th ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS z FROM ds),
f AS (SELECT p.*, blocks, q, seed, [z - size, z] AS ends FROM p JOIN qq ON p.source IS NOT DISTINCT FROM qq.source AND p.shard = qq.shard),
t AS (SELECT *, list_transform(ends, lambda x: ((x // {BLOCK}) * q + seed) // blocks * {BLOCK}
             + (((x // {BLOCK} + 1) * q + seed) // blocks - ((x // {BLOCK}) * q + seed) // blocks) * (x % {BLOCK})) AS f FROM f)
SELECT doc_id, source, size, source_size, target, (f[2] - f[1])::BIGINT AS taken FROM t
"""
