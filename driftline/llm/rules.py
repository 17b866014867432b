"""Quality rules: every rule is judged once per document and kept as a bit of a ledger.

The ledger holds the measurements, `fail_bits` and the version of the rule set that set them.
It is written once (to the shared folder, or where the caller says) and read by all that
follows: a policy is a named, versioned mask of bits, and a document passes it if it fails
none of the rules in the mask; ablations are read off the ledger by bitwise aggregation.
Neither goes back to the texts.

Measurements stay in SQL functions inside one row: windows of three words are hashed and
sorted as one array of longs, so only texts that do repeat a window go on to place them.

Defined cases: null and empty texts have no words, and every measure is 0; a text without
words fails `few_words` only; very long texts are measured whole; repeated rows are judged
alike; an empty table gives an empty ledger; other columns of the input, whatever their
names, are left alone (the ledger selects doc_id and text only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, words_of

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "[#*$%&|<>]"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "is", "for", "der", "die", "und", "den", "mit", "le", "la", "les", "et", "que", "el", "los", "y", "en", "de")
#: The version of the rules below: it changes whenever a rule or its place does.
RULE_SET = 2
#: name -> SQL condition for failing it; bit i is the i-th name.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "few_letters": "10 * n_letter_words < 7 * n_words",
    "bullets": "10 * n_bullets > 9 * n_lines",
    "ellipses": "10 * n_ellipses > 3 * n_lines",
    "unfinished_lines": "n_lines >= 3 and 10 * n_finished < n_lines",
    "few_stop_words": "n_words >= 50 and n_stop_words < 2",
    "short_lines": "n_lines >= 3 and n_words < 3 * n_lines",
}
#: version -> names of the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "word_length", "repeated_lines"),
    "v3": tuple(RULES),
}


def mask_of(version: str, rules=RULES, policies=POLICIES) -> int:
    return sum(1 << list(rules).index(name) for name in policies[version])


#: Measures of lines: how many match.
LINE_PATTERNS = {"n_bullets": r"^[\x20\x09-\x0D]*[-*\x{2022}]", "n_ellipses": r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$", "n_finished": r"[.!?][\"')]?[\x20\x09-\x0D]*$"}


def _no_longs() -> Column:
    return F.array().cast("array<bigint>")


def with_repeat_words(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds n_repeat_words: words lying in three-word windows that the array has twice or more.

    Windows are hashed and, where two are equal, sorted with their places; equal neighbours
    keep their places, and each place covers up to three words anew. Every step is a column
    of its own: a lambda would evaluate an expression it captures once per element.
    """
    size = F.size(words)
    hashes = F.when(
        size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    ).otherwise(_no_longs())
    df = df.withColumn("__h", hashes)
    pairs = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:bigint>>")
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(pairs)).otherwise(none))
    places = F.transform(
        "__p",
        lambda p, k: F.when(
            F.get("__p", k - 1)["h"].eqNullSafe(p["h"]) | F.get("__p", k + 1)["h"].eqNullSafe(p["h"]), p["i"]
        ),
    )
    df = df.withColumn("__i", F.sort_array(F.array_compact(places)))
    covered = F.aggregate(
        "__i",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
    )
    return df.withColumn("n_repeat_words", covered["n"]).drop("__h", "__p", "__i")


def _matching(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda x: x.rlike(pattern))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, one row per document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), words_of(F.col("text")).alias("words"))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return with_repeat_words(base).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.regexp_count("text", F.lit(r"\p{L}[^\x20\x09-\x0D]*")).cast("long").alias("n_letter_words"),  # once a word: a match takes the rest of it
        F.size(F.filter("words", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        *[_matching(pattern).alias(name) for name, pattern in LINE_PATTERNS.items()],
    )


def rule_ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measurements, `fail_bits` (long; bit i is set if the i-th rule fails) and `rule_set`."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits).withColumn("rule_set", F.lit(RULE_SET))


def stored_ledger(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger, written as Parquet to path (anew) or to the shared folder, and read from there."""
    if path is None:
        return materialize(rule_ledger(docs), "ledger")
    rule_ledger(docs).write.mode("overwrite").parquet(path)
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark, path: str) -> DataFrame:
    """A stored ledger; one of another rule set is refused, as its bits mean other rules."""
    ledger = spark.read.parquet(path)
    other = ledger.where(F.col("rule_set") != RULE_SET).select("rule_set").first()
    if other:
        raise ValueError(f"the ledger is of rule set {other[0]}, not {RULE_SET}")
    return ledger


def apply_policy(ledger: DataFrame, version: str, rules=RULES, policies=POLICIES) -> DataFrame:
    """The ledger with `kept`: no rule of the policy fails."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(version, rules, policies))) == 0)


def ablations(ledger: DataFrame, rules=RULES, policies=POLICIES) -> DataFrame:
    """Per policy and rule of it: documents failing the rule, failing it alone, kept by the
    policy, and kept without the rule. One aggregate by fail_bits, then at most
    2^rules rows.
    """
    counts = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    asked = [(v, name, mask_of(v, rules, policies), 1 << list(rules).index(name)) for v, names in policies.items() for name in names]
    grid = counts.select("fail_bits", "n", F.explode(F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, name, m, b in asked
    ])).alias("r")).select("fail_bits", "n", "r.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return grid.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = apply_policy(stored_ledger(read(spark, sf_dir, "documents")), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of("base"))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "fail_bits", "rule_set",
        *[(F.col("fail_bits").bitwiseAND(F.lit(mask_of(v))) == 0).alias(f"passes_{v}") for v in ("v1", "v3")],
    )


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the stored ledger of all documents."""
    return ablations(stored_ledger(read(spark, sf_dir, "documents")))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT rid, i, [words[i], words[i + 1], words[i + 2]] AS g FROM w, unnest(range(1, greatest(1, len(words) - 1))) u(i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM t),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words, len(list_filter(words, lambda x: lower(x) IN (STOPS)))::BIGINT AS n_stop_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipses,
             len(list_filter(lines, lambda x: regexp_matches(x, '[.!?]["'')]?[\x20\x09-\x0D]*$')))::BIGINT AS n_finished
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
b AS MATERIALIZED (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 2 * n_words)::BIGINT
             + 8 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT
             + 16 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 32 * (10 * n_letter_words < 7 * n_words)::BIGINT + 64 * (10 * n_bullets > 9 * n_lines)::BIGINT
             + 128 * (10 * n_ellipses > 3 * n_lines)::BIGINT + 256 * (n_lines >= 3 AND 10 * n_finished < n_lines)::BIGINT
             + 512 * (n_words >= 50 AND n_stop_words < 2)::BIGINT + 1024 * (n_lines >= 3 AND n_words < 3 * n_lines)::BIGINT AS fail_bits FROM m)
""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS))
ABLATIONS_SQL = OP8_SQL + """,
p AS (SELECT policy, unnest(rules) AS rule, mask FROM (SELECT 'base' AS policy, ['few_words', 'repeated_words'] AS rules, 3 AS mask UNION ALL SELECT 'v1', ['few_words', 'repeated_words', 'symbols'], 7
   UNION ALL SELECT 'v2', ['few_words', 'repeated_words', 'symbols', 'word_length', 'repeated_lines'], 31
   UNION ALL SELECT 'v3', ['few_words', 'repeated_words', 'symbols', 'word_length', 'repeated_lines', 'few_letters', 'bullets', 'ellipses', 'unfinished_lines', 'few_stop_words', 'short_lines'], 2047)),
n AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'word_length', 'repeated_lines', 'few_letters', 'bullets', 'ellipses', 'unfinished_lines', 'few_stop_words', 'short_lines']) AS rule, unnest(range(11)) AS i)
SELECT policy, rule, count(*) FILTER (fail_bits >> i & 1 = 1) AS n_failed, count(*) FILTER (fail_bits & mask = 1 << i) AS n_failed_alone,
       count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & mask IN (0, 1 << i)) AS n_kept_without FROM b, p JOIN n USING (rule) GROUP BY policy, rule
"""
OP8_SQL += """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 31 = 0 AS kept, n_lines, fail_bits, 2 AS rule_set,
       fail_bits & 7 = 0 AS passes_v1, fail_bits & 2047 = 0 AS passes_v3 FROM b
"""
