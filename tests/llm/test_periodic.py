"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import periodic, queries
from .test_llm import SF, documents, odd_texts


def plain_runs(words, least):
    """Every period, every maximal stretch of equal words that far apart; a stretch has the smallest of its periods."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def fibonacci(k):
    a, b = "a", "ab"
    for _ in range(k):
        a, b = b, b + a
    return b


def periodic_sequences():
    r = random.Random(1)
    yield from ([ord(c) for c in fibonacci(9)], [1] * 100, [1, 2] * 40 + [2, 1] * 40, [1, 1, 2] * 30 + [1] * 9, [])
    for _ in range(1500):
        n, k = r.randint(0, 120), r.choice([1, 2, 2, 3, 4])
        x = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 4) if n > 4 else 0):
            a, p = r.randrange(n), r.randint(1, max(1, n // 3))
            for i in range(a + p, min(n, a + r.randint(0, 6 * p))):
                x[i] = x[i - p]
        yield x


@pytest.mark.parametrize("least", [1, 12])
def test_runs_of_sequences(least):
    for x in periodic_sequences():
        got = list(zip(*[v.tolist() for v in periodic.periodic_runs(np.array(x, np.int64), least)], strict=True)) if x else []
        assert sorted(got) == plain_runs(x, least), x


def plain_planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = sorted(((s, e - s, q) for s, e, q in plain_runs(words, 12)), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_by_brute_force(spark, tmp_path):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 90)))) for i in range(300)] + odd_texts() + ["a b " * 9 + "c d e " * 8 + "f " * 14, "q\nr s " * 5 + "s q"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(*row)) for row in rows)
    assert any(row["n_runs"] > 1 for row in got)


def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is null or length(text) < 6000").collect()
    want = sorted(repr(plain_row(*row)) for row in rows)
    ids = {row["doc_id"] for row in rows}
    got = [tuple(row) for row in queries.QUERIES["op12_periodic_runs"](spark, SF).collect() if row["doc_id"] in ids]
    assert sorted(map(repr, got)) == want


def test_runs_and_collapsed_text(spark):
    docs = documents(spark, ["x a b a b a b a b a b a b a y", "one\ntwo", None])
    found = {row["doc_id"]: row for row in periodic.collapse_runs(docs).collect()}
    assert [tuple(x) for x in found[0]["runs"]] == [(1, 13, 2)] and found[0]["collapsed"] == "x a b y"
    assert found[1]["collapsed"] == "one two" and found[2]["collapsed"] == "" and found[2]["n_words"] == 0
    assert periodic.collapse_runs(docs.where("false")).collect() == []


def test_documents_stay_apart_in_small_chunks(spark, monkeypatch):
    texts = [f"{'a b ' * 8}" for _ in range(9)]
    monkeypatch.setattr(periodic, "CHUNK", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    rows = periodic.collapse_runs(documents(spark, texts)).select(F.size("runs").alias("n"), "collapsed").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(row) for row in rows] == [(1, "a b")] * 9
