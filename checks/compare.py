"""Run a query on Spark and its SQL on DuckDB and compare the rows, ignoring order."""

from __future__ import annotations

import math
from typing import Any

import duckdb
from pyspark.sql import DataFrame

from checks.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB in this process with the given tables as views."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return value


def _lines(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty when the results agree."""
    relation = connection.sql(sql)
    ours, theirs = list(df.columns), list(relation.columns)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    left, right = _lines(ours, df.collect()), _lines(theirs, relation.fetchall())
    if left == right:
        return []
    only_left = [x for x in left if x not in set(right)][:3]
    only_right = [x for x in right if x not in set(left)][:3]
    return [f"{len(left)} rows against {len(right)}", f"only Spark: {only_left}", f"only SQL: {only_right}"]
