"""Queries over the derived tables, one per operator, and their DuckDB twins.

QUERIES maps a name to f(spark, sf_dir); SQL maps it to the text DuckDB runs. The modules
in driftline/checks fill both.
"""

from __future__ import annotations

from driftline.checks import diff, fleet, functions, journal, ledger, streams

QUERIES: dict = {}
SQL: dict = {}
for part in (diff, functions, journal, ledger, fleet, streams):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
