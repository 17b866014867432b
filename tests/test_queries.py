"""Every query that SQL can express gives DuckDB's rows on the smallest input."""

import datetime
import decimal
import os

import duckdb
import pytest
from conftest import SF_DIR

from driftline import queries


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in queries.SQL:
        assert got
        return
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in rel.fetchall())


def test_entry_without_llm(spark, monkeypatch):
    import importlib
    import sys

    for module in [m for m in sys.modules if m.startswith("driftline.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.SQL)
    assert {r["action"] for r in entry.entry(spark).collect()} >= {"COPY", "CLEAN", "META_FIX", "DST_ONLY", "DIR"}
    monkeypatch.delitem(sys.modules, "__spark_entry__")
