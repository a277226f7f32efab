"""All registered queries and their SQL."""

from __future__ import annotations

from checks import lake_queries, report_queries, resolution_queries, run_queries

_PARTS = [report_queries, lake_queries, resolution_queries, run_queries]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
