"""Line dedup: later copies of repeated runs of lines are deleted.

A document is the sequence of its lines that have a word; an id stands for a line's text.
A run of lines of one document is a later copy if the same run of ids begins earlier in
the corpus (order: doc_id, then the text's hash, then the line) and has at least
`min_words` words; all lines of later copies go, each with the blank lines
after it.

The suffix array comes from prefix doubling: suffixes are ranked by their first line, then
by their first 2, 4, ... lines, a round ranking the pairs (rank here, rank 2^k lines on) by
a distributed sort of the distinct pairs. Only suffixes whose prefix occurs twice stay in,
so the rounds work on the repeated part alone. Two facts bound the rounds by the
parameter, not by the longest copy: a repeated run is the union of its windows that just
reach min_words (counted from either end), and such a window has at most min_words lines.
Suffixes that share a window's ranks are an interval of the suffix array whose common
prefix is at least the window; all of it but its first suffix are later copies, and
windows that overlap or touch make up the maximal runs.

Line ids are 128-bit hashes. A line that a third of all documents have is one row a task after
the partial counts; the joins that bring counts back are equi-joins that adaptive
execution splits.

Defined cases: a null text stays null with no lines; empty and blank texts stay as they
are; rows that repeat in doc_id and text are copies, the first of them (by a hash of the
other columns) stays; a null doc_id comes last; a text that loses all its lines is empty;
an empty table gives an empty result; a column named n_lines or n_removed is replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read, release

MIN_WORDS = 8
_KEY = ["doc", "th"]


def _doc_key(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, th, seq (among lines with a word, from 0), line_no, the next such line's number (stop), words and
    the two halves of the line's hash."""
    split = _doc_key(docs.select("doc_id", "text")).where("text is not null").select(*_KEY, F.split("text", "\n").alias("lines"))
    worded = split.select(
        *_KEY,
        F.size("lines").alias("n"),
        F.filter(
            F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
            lambda x: x["words"] > 0,
        ).alias("worded"),
    )
    nexts = F.concat(F.slice(F.transform("worded", lambda x: x["line_no"]), F.lit(2), F.greatest(F.size("worded") - 1, F.lit(0))), F.array("n"))
    placed = worded.select(*_KEY, F.posexplode(F.arrays_zip("worded", nexts.alias("stop"))).alias("seq", "l"))
    line = F.col("l.worded.line")
    return placed.select(*_KEY, "seq", "l.worded.line_no", "l.stop", "l.worded.words", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _ranks(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The key combinations that occur twice or more, with a rank that follows their order."""
    twice = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return materialize(twice.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()), name)


def repeated_suffixes(docs: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Positions whose line occurs twice or more, with ranks r0, r1, ... of their first 1, 2, 4, ... lines
    (null where that prefix occurs once) up to `depth` lines; and the number of rank columns.
    """
    lines = materialize(_lines(docs), "lines")
    now = lines.join(_ranks(lines, ["h1", "h2"], "r0"), ["h1", "h2"]).drop("h1", "h2")
    now = materialize(now.dropDuplicates([*_KEY, "seq"]), "suffixes")
    release(lines)
    k = 1
    while 2**k <= depth:
        step = 2 ** (k - 1)
        ahead = Window.partitionBy(*_KEY).orderBy("seq").rangeBetween(step, step)
        paired = materialize(now.withColumn("a", F.col(f"r{k - 1}")).withColumn("b", F.max(f"r{k - 1}").over(ahead)), "pairs")
        ranks = _ranks(paired.where("a is not null and b is not null"), ["a", "b"], f"r{k}")
        new = materialize(paired.join(ranks, ["a", "b"], "left").drop("a", "b"), "suffixes")
        release(now)
        release(paired)
        now, k = new, k + 1
    return now, k


def _window_name(m: int, at: int) -> list[Column]:
    """The ranks that name the window of m lines that begins `at` rows from here: its first and its last 2^k lines."""
    k = m.bit_length() - 1
    order = Window.partitionBy(*_KEY).orderBy("seq")
    return [F.lead(f"r{k}", at).over(order), F.lead(f"r{k}", at + m - 2**k).over(order)]


def _named(m: int, at: int) -> Column:
    a, b = _window_name(m, at)
    order = Window.partitionBy(*_KEY).orderBy("seq")
    return F.struct(F.lit(m).alias("m"), a.alias("a"), b.alias("b"), F.lead("seq", at).over(order).alias("first"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, th and the array of line numbers to delete, for documents that lose lines."""
    suffixes, _ = repeated_suffixes(docs, min_words)
    order = Window.partitionBy(*_KEY).orderBy("seq")

    def reaches(m: int, at: int) -> Column:
        """The m rows that begin `at` rows from here are consecutive lines with min_words words."""
        upto = F.sum("words").over(order.rowsBetween(at, at + m - 1))
        return (F.lead("seq", at + m - 1).over(order) - F.lead("seq", at).over(order) == m - 1) & (upto >= min_words)

    ahead = F.lit(None)
    back = F.lit(None)
    for m in range(min_words, 0, -1):
        ahead = F.when(reaches(m, 0), _named(m, 0)).otherwise(ahead)
        back = F.when(reaches(m, 1 - m), _named(m, 1 - m)).otherwise(back)
    windows = materialize(
        suffixes.select(*_KEY, "seq", F.array(ahead, back).alias("w"))
        .select(*_KEY, F.explode("w").alias("w"))
        .where("w.a is not null and w.b is not null")
        .select(*_KEY, "w.*")
        .distinct(),
        "windows",
    )
    place = F.struct("doc", "th", "first")
    first = windows.groupBy("m", "a", "b").agg(F.min(place).alias("origin"), F.max(place).alias("other")).where("origin < other").select("m", "a", "b", "origin")
    copies = windows.join(first, ["m", "a", "b"]).where(place > F.col("origin"))
    covered = copies.select(*_KEY, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1)).alias("seq")).distinct()
    lost = suffixes.join(covered, [*_KEY, "seq"], "left_semi").select(*_KEY, F.sequence("line_no", F.col("stop") - 1).alias("span"))
    return lost.groupBy(*_KEY).agg(F.flatten(F.collect_list("span")).alias("gone"), F.count("*").alias("n_gone"))


def _numbered(held: DataFrame) -> DataFrame:
    """held with `copy`: 1 for the first of the rows that repeat in doc_id and text (by a hash of the row), more for the others.

    Only keys that repeat are grouped, equal rows combine before the shuffle, and no group of rows is ever in one task.
    """
    repeated = materialize(held.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY), "repeated")
    once = held.join(repeated, _KEY, "left_anti").withColumn("copy", F.lit(1))
    equal = held.join(repeated, _KEY, "left_semi").withColumn("of_row", F.xxhash64("row")).groupBy(*_KEY, "of_row")
    equal = equal.agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.any_value("row").alias("row"), F.count("*").alias("n"))
    first = equal.groupBy(*_KEY).agg(F.min("of_row").alias("first"))
    copies = equal.join(first, _KEY).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copy = F.when((F.col("of_row") == F.col("first")) & (F.col("i") == 1), 1).otherwise(2)
    return once.unionByName(copies.withColumn("copy", copy).select(*once.columns))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` less its later copies, and n_lines and n_removed (lines, blank ones too)."""
    gone = materialize(later_copies(docs, min_words).select(F.col("doc").alias("g_doc"), F.col("th").alias("g_th"), "gone", "n_gone"), "gone")
    held = _numbered(_doc_key(docs.select("doc_id", "text", F.struct("*").alias("row")))).join(gone, (F.col("doc") == F.col("g_doc")) & (F.col("th") == F.col("g_th")), "left")
    held = held.withColumn("lines", F.split("text", "\n")).withColumn(
        "left", F.array_except(F.sequence(F.lit(0), F.greatest(F.size("lines"), F.lit(1)) - 1), "gone")
    )
    n_worded = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    empty = (
        F.when((F.col("copy") > 1) & (F.regexp_count("text", F.lit(WORD)) >= min_words), True)
        .when(F.col("gone").isNotNull(), F.col("n_gone") == n_worded)
        .otherwise(False)
    )
    held = held.withColumn("empty", empty)
    text = (
        F.when(F.col("empty"), "")
        .when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("empty"), n_lines).when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return held.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP7_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line, len(regexp_extract_all(lines[i], '[^ 	-
]+')) AS words FROM s, unnest(range(1, len(lines) + 1)) t(i)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM u WHERE words > 0),
a AS (SELECT doc_id, list(line ORDER BY seq) AS ls, list(words ORDER BY seq) AS ws FROM w GROUP BY doc_id),
c AS (SELECT doc_id, ls, ws, s, m, list_sum(ws[s:s + m - 1]) AS n FROM a, unnest(range(1, len(ls) + 1)) t(s), unnest(range(1, {MIN_WORDS + 1})) k(m) WHERE s + m - 1 <= len(ls)),
win AS (SELECT doc_id, s, m, array_to_string(ls[s:s + m - 1], chr(10)) AS body FROM c WHERE n >= {MIN_WORDS} AND (n - ws[s + m - 1] < {MIN_WORDS} OR n - ws[s] < {MIN_WORDS})),
r AS (SELECT *, row_number() OVER (PARTITION BY m, body ORDER BY doc_id, s) AS r FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS seq FROM r WHERE r > 1),
gone AS (SELECT u.doc_id, u.line_no FROM u JOIN (SELECT w.* FROM w JOIN cov USING (doc_id, seq)) g
         ON u.doc_id = g.doc_id AND u.line_no >= g.line_no AND (g.stop IS NULL OR u.line_no < g.stop)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, sum(words) AS words, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id),
e AS (SELECT s.doc_id, coalesce(len(s.lines), 0)::BIGINT AS n_lines, s.text AS old, k.text, k.n, coalesce(k.words, 0) AS words,
             s.doc_id IN (SELECT doc_id FROM gone) AS cut FROM s LEFT JOIN k USING (doc_id))
SELECT doc_id, n_lines, CASE WHEN NOT cut THEN 0 WHEN words = 0 THEN n_lines ELSE n_lines - n END AS n_removed,
       CASE WHEN NOT cut THEN old WHEN words = 0 THEN '' ELSE text END AS text FROM e
"""
