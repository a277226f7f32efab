"""Unions of many DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the parts, which have the same columns, by a balanced tree: the plan is as deep as the logarithm of
    their number."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2], strict=False)
        parts = [a.unionByName(b) for a, b in pairs] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]
