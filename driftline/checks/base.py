"""Registration of a query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from driftline.fixtures import duckdb_with, table


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, tables: str, run: Callable, sql: str | None = None, more: str = "") -> None:
        """run gets the named derived tables as DataFrames; sql may read them, after further common tables in `more`."""
        names = tables.split()
        self.queries[name] = lambda spark, sf_dir: run(*[table(spark, sf_dir, t) for t in names])
        if sql:
            self.sql[name] = duckdb_with(*names) + (f", {more}" if more else "") + " " + sql
