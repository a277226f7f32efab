"""Joins that stay balanced when one key, or no key, holds a large share of all rows.

Adaptive execution splits a partition that a hot key makes large, for inner, left, left semi and left anti joins, if each
side's shuffle stands right below the join. An aggregate on the other side stands in the way. So the side with one line
per key is written first and read back; the rows are read once, whatever their keys, and null keys are split like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from kinweave.sources.shared import materialise


def join_by_key(rows: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows.join(right, keys, how)`` for ``inner``, ``left``, ``left_semi`` or ``left_anti``, where ``right`` holds at
    most one line per key and ``rows`` may hold any number. ``right`` is written below the shared folder."""
    return rows.join(materialise(right, "right").df, list(keys), how)
