"""URL filter: rules for hosts and paths, and trust spread over the link graph of hosts.

A page that a rule fits gets the rule's verdict (the longest rule wins). The others get
their host's. Hosts most of whose pages are allowed by rules are trusted seeds, hosts most
of whose pages are blocked are blocked seeds. Trust is personalised PageRank from the
trusted seeds along links; distrust is the same from the blocked seeds against them, since
who links to blocked hosts vouches for them. A host is blocked if its distrust is greater
than its trust times `most_distrust`. Rounds end when one adds next to nothing (`tolerance`).

Links of one pair of hosts are one weighted edge, counted before the shuffle; both
spreads run as one table, a join and a sum a round, written to the shared folder. Mass is
whole numbers (10^15 for all seeds of a side), so sums do not depend on their order and
reruns agree. Mass of hosts without links leaves the graph. A hot host is one row after
the partial sums; the join on its links is one that adaptive execution splits.

Defined cases: a null url or one without :// has empty host and path, fits no rule, is in
no graph and is allowed; a null or empty html has no links; relative links and links to
the own host are no edges; rows that repeat count as often as they come and give a row
each; with no seeds, no links or an empty table everything unruled is allowed; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, release

#: Fixed values of the contract: verdict, host and path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rounds end when one adds no more than this share of a side's mass.
TOLERANCE = 1e-5
DAMPING = 0.85
UNIT = 10**15
#: The host of an absolute link.
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(host: Column) -> Column:
    return F.translate(host, _UPPER, _LOWER)


def with_host(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", _lower(F.regexp_extract(url, parts, 1))).withColumn("path", F.regexp_extract(url, parts, 2))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (the longest that fits, as host and path; else null) and rule_verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _total(masses: DataFrame) -> int:
    return masses.agg(F.sum("mass")).first()[0] or 0


def host_scores(judged: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust for hosts that have any.

    Mass starts at the seeds' own share and only grows, in whole numbers, so the rounds end for every
    graph: what a round adds falls by the damping.
    """
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]
    )
    sides = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), (2 * F.col(v) > F.col("n")).alias("seed")) for k, v in enumerate(("allow", "block"))])).alias("s"))
    seeds = sides.where("s.seed").select("s.side", "host")
    totals = seeds.groupBy("side").agg(F.count("*").alias("m"))
    seeds = materialize(seeds.join(totals, "side").select("side", "host", F.floor(UNIT / F.col("m")).cast("long").alias("mass")), "seeds")
    both = edges.select(F.lit(0).alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("side", "src").agg(F.sum("n").alias("out"))
    both = materialize(both.join(out, ["side", "src"]), "links")
    base = seeds.select("side", "host", F.floor(F.col("mass") * (1 - damping)).cast("long").alias("mass"))
    now = base = materialize(base, "base")
    before, total = 0, _total(base)
    while total - before > tolerance * UNIT:
        sent = now.join(both, (now["side"] == both["side"]) & (now["host"] == both["src"])).select(
            both["side"], F.col("dst").alias("host"), F.floor(F.col("mass").cast("double") * F.col("n") / F.col("out") * damping).cast("long").alias("mass")
        )
        new = materialize(base.unionByName(sent).groupBy("side", "host").agg(F.sum("mass").alias("mass")), "mass")
        if now is not base:
            release(now)
        now, before, total = new, total, _total(new)
    one = [F.sum(F.when(F.col("side") == k, F.col("mass")).otherwise(0)).alias(c) for k, c in enumerate(("trust", "distrust"))]
    return now.groupBy("host").agg(*one)


def filter_pages(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, damping: float = DAMPING, most_distrust: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row per page."""
    judged = with_rule(with_host(pages.select("page_id", "url", "html")), rules)
    edges = materialize(host_edges(judged), "host_edges")
    judged = judged.drop("html", "url")
    scores = host_scores(judged, edges, tolerance, damping)
    named = judged.join(scores.withColumnRenamed("host", "s_host"), F.col("host") == F.col("s_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    verdict = F.coalesce("rule_verdict", F.when(distrust > trust * most_distrust, "block").otherwise("allow"))
    return named.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_pages(read(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same with a recursive table: its rows are those of one round, with the sums of the masses before and after it."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN" for _, h, p in rules]
    case = lambda values: "CASE " + " ".join(f"{f} '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE h AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT page_id, html, host, path, {case([h + p for _, h, p in rules])} AS rule, {case([v for v, _, _ in rules])} AS rv FROM h),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM j WHERE host <> '')
      WHERE src <> dst GROUP BY src, dst),
b AS (SELECT 0 AS side, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
l AS (SELECT *, sum(n) OVER (PARTITION BY side, src) AS o FROM b),
hs AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS a, count(*) FILTER (rv = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
sd AS (SELECT 0 AS side, host FROM hs WHERE 2 * a > n UNION ALL SELECT 1, host FROM hs WHERE 2 * b > n),
b0 AS (SELECT side, host, floor(floor({UNIT} / count(*) OVER (PARTITION BY side))::BIGINT * (1 - {DAMPING}::DOUBLE))::BIGINT AS mass FROM sd),
m AS (SELECT side, host, mass, 0 AS i, 0::BIGINT AS before, (sum(mass) OVER ())::BIGINT AS total FROM b0
  UNION ALL SELECT side, host, sum(mass)::BIGINT, i, before, (sum(sum(mass)) OVER ())::BIGINT FROM (
    SELECT b0.side, b0.host, b0.mass, p.i + 1 AS i, p.total AS before FROM b0, (SELECT DISTINCT i, total FROM m WHERE total - before > {TOLERANCE * UNIT}) p
    UNION ALL SELECT l.side, dst, floor(mass::DOUBLE * n / o * {DAMPING}::DOUBLE)::BIGINT, i + 1, total FROM m JOIN l ON m.side = l.side AND m.host = l.src WHERE total - before > {TOLERANCE * UNIT})
  GROUP BY side, host, i, before),
s AS (SELECT host, coalesce(sum(mass) FILTER (side = 0), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (side = 1), 0)::BIGINT AS distrust FROM m WHERE i = (SELECT max(i) FROM m) GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN s ON j.host = s.host
"""


OP3_SQL = _sql()
