"""Pure functions on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from driftline.functions import formats as fm
from driftline.functions import globs, hashing, paths

#: pattern -> paths it matches, paths it does not.
GLOBS = {
    "data/part-?.csv": (["data/part-1.csv", "data/part-é.csv", "data/part-?.csv"], ["data/part-.csv", "data/part-12.csv", "data/part-/.csv", "x/data/part-1.csv"]),
    "*": (["name", ".hidden", "new\nline"], ["dir/name", "dir/"]),
    "logs/*": (["logs/today", "logs/"], ["logs", "logs/2024/today", "oldlogs/today"]),
    "year=*/month=1*": (["year=2024/month=1", "year=/month=12"], ["year=2024/day=1/month=1", "year=2024/month=2"]),
    "**": (["x", "x/y/z", ""], []),
    "cache/**": (["cache/x", "cache/x/y", "cache/"], ["cache", "mycache/x"]),
    "**/*.bak": (["old.bak", "u/v/w.bak", ".bak"], ["old.bak2", "old.bak/keep"]),
    "home/**/core": (["home/core", "home/u/core", "home/u/v/core"], ["home/core/dump", "core", "home/xcore2"]),
    "**/build/**": (["build/o", "p/build/o", "p/q/build/r/o"], ["p/rebuilt/o", "p/build"]),
    "v1.2+(x)[0-9]{2}|^$": (["v1.2+(x)[0-9]{2}|^$"], ["v1.2+(x)07", "v1x2+(x)[0-9]{2}|^$", ""]),
    "plain": (["plain"], ["plain/more", "plainer", "Plain", "plain\n", "a plain"]),
}
#: Destinations that overlap, written in several ways, and pairs that do not.
SAME_TREE = [("/mnt/a", "/mnt/a///"), ("/mnt", "/mnt/a/b"), ("/", "/mnt"), ("/mnt/a/", "/mnt/a/b"), ("", "/x")]
APART = [("/mnt/a", "/mnt/a1"), ("/mnt/a/b", "/mnt/b/a"), ("/mnt/x", "/net/x"), ("/mnt/a b", "/mnt/a")]


def test_globs(spark):
    for pattern, (hits, misses) in GLOBS.items():
        rows = spark.createDataFrame([(p, True) for p in hits] + [(p, False) for p in misses], "path string, expected boolean")
        wrong = rows.where(globs.glob_match(F.col("path"), pattern) != F.col("expected")).collect()
        assert not wrong, (pattern, wrong)


def test_globs_against_a_matcher(spark):
    """All paths of up to five characters over a small alphabet, against a matcher by recursion."""

    def matches(pattern, path):
        if not pattern:
            return not path
        if pattern.startswith("**/"):
            return matches(pattern[3:], path) or any(matches(pattern[3:], path[i:]) for i in range(len(path) + 1))
        if pattern.startswith("**"):
            return any(matches(pattern[2:], path[i:]) for i in range(len(path) + 1))
        if pattern[0] == "*":
            return any(matches(pattern[1:], path[i:]) for i in range(len(path) + 1) if "/" not in path[:i])
        return bool(path) and (pattern[0] == path[0] or pattern[0] == "?" and path[0] != "/") and matches(pattern[1:], path[1:])

    paths_ = ["".join(t) for n in range(6) for t in itertools.product("a/.", repeat=n)]
    rows = spark.createDataFrame([(p,) for p in paths_], "path string").coalesce(1).cache()
    for pattern in ("a*", "?a", "*/a", "a/?", "**a", "a/**", "*.a", "a?*"):
        got = {r[0] for r in rows.where(globs.glob_match(F.col("path"), pattern)).collect()}
        assert got == {p for p in paths_ if matches(pattern, p)}, pattern
    rows.unpersist()


def test_rules_are_checked():
    with pytest.raises(ValueError):
        globs.check_rules([("exclude", "")])
    with pytest.raises(ValueError):
        globs.check_rules([("exclude", "a" * 256)])
    with pytest.raises(ValueError):
        globs.check_rules([("exclude", "a")] * 65)
    with pytest.raises(ValueError):
        globs.check_rules([("drop", "a")])


def test_overlaps(spark):
    rows = spark.createDataFrame([(a, b, True) for a, b in SAME_TREE] + [(a, b, False) for a, b in APART], "a string, b string, e boolean")
    both = rows.unionByName(rows.selectExpr("b as a", "a as b", "e"))
    assert both.where(paths.paths_overlap(F.col("a"), F.col("b")) != F.col("e")).count() == 0


def test_paths(spark):
    row = spark.createDataFrame([("a/b/c",), ("top",), ("",)], "p string").select(
        paths.parent(F.col("p")), paths.leaf(F.col("p")), paths.depth(F.col("p")), paths.ancestors(F.col("p")), paths.prefixes(F.col("p"))
    ).collect()
    assert [tuple(r) for r in row] == [
        ("a/b", "c", 3, ["", "a", "a/b"], ["a", "a/b", "a/b/c"]), ("", "top", 1, [""], ["top"]), ("", "", 0, [], []),
    ]


def _fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv1a(spark):
    texts = ["", "a", "foobar", "päth/ü", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.fnv1a_halves(F.col("t")).alias("h"), hashing.fnv1a_ppm(F.col("t")).alias("p")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert (r["h"]["hi"] << 32) + r["h"]["lo"] == _fnv(t)
        assert r["p"] == _fnv(t) % 1_000_000


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(fm.human_bytes(F.lit(n).cast("long"))) for n in (0, 1023, 1024, 1536, 1 << 30, 5 << 60)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 GiB", "5.0 EiB"]
    assert [one(fm.human_duration(F.lit(n).cast("long"))) for n in (0, -5, 59_999, 61_000, 3_660_000)] == ["0s", "0s", "59s", "1m 1s", "1h 1m"]
    assert [one(fm.parse_byte_size(F.lit(t))) for t in ("5", " 1.5KiB ", "2 GiB", "1 KB", "", "-1")] == [5, 1536, 2 << 30, None, None, None]
    assert one(fm.sum_hex(F.lit(-1), F.lit(1))) == "f" * 16 + "0" * 15 + "1"
    assert int(one(fm.unsigned(F.lit(-1)))) == 2**64 - 1
    assert one(fm.octal_mode(F.lit(0o4755))) == "4755" and one(fm.octal_mode(F.lit(5))) == "0005"
    tag = lambda t: tuple(spark.range(1).select(*fm.temp_tag(F.lit(t))).first())
    assert tag("1a-2.3.4") == ("1a", "2") and tag("01-0.x") == ("1", "0") and tag("+1-2.") == (None, None) and tag("A-1.") == (None, None)
    assert tag("f" * 17 + "-1.") == (None, "1") or tag("f" * 17 + "-1.")[0] is None
    assert one(fm.tag_matches(F.lit("1a-2.3.4"), F.lit(26), F.lit(2))) and not one(fm.tag_matches(F.lit("x"), F.lit(1), F.lit(1)))
    assert one(fm.journal_label(F.lit("COPIED"))) == "copied" and one(fm.type_category(F.lit("ODD"))) == "unknown"


def test_human_bytes_rounds_as_c(spark):
    numbers = [1280, 1792, 21760, 452864, (1 << 20) - 1, (5 << 30) + (1 << 28), (1 << 63) - 1, *[(7 << k) + (b << (k - 2)) for k in (20, 40, 50, 60) for b in range(4)]]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", fm.human_bytes(F.col("n")).alias("t")).collect()
    unit = lambda n: (n.bit_length() - 1) // 10
    assert [r["t"] for r in rows] == [f"{float(r['n']) / (1 << (10 * unit(r['n']))):.1f} {'KMGTPE'[unit(r['n']) - 1]}iB" for r in rows]


def test_root_above(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("ab",), ("d/e/f/g",), ("",)], "rel_path string")
    roots = spark.createDataFrame([("a/b", 1), ("d/e/f/g", 2), ("d", 3), ("nowhere", 4)], "root string, n int")
    assert {(r["rel_path"], r["root"], r["n"]) for r in paths.root_above(rows, roots).collect()} == {("a/b", "a/b", 1), ("a/b/c", "a/b", 1), ("d/e/f/g", "d/e/f/g", 2), ("d/e/f/g", "d", 3)}
    assert paths.root_above(rows, roots.where("false")).count() == 0
