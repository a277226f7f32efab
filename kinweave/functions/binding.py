"""Giving an expression a name inside another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    A column of its own does not do that: where a filter on the result is pushed down, Spark puts the whole expression
    in place of each use, and a long chain of conditions then repeats it until it is too large to compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
