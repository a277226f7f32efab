"""Evidence of personal data in the values themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.unions import union_all
from kinweave.functions.patterns import VALUE_PATTERNS, ValuePattern, any_pattern, holds, may_hold, value_kind


def content_evidence(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], patterns: Mapping[str, ValuePattern] = VALUE_PATTERNS
) -> DataFrame:
    """``table_name, column_name, pattern, non_null, matches, share`` for text columns of many tables.

    ``tables`` gives for each name the table and its text columns. Each table is read once, whatever the number of
    columns and patterns, and only one line of counts leaves each task.
    """
    parts = []
    for table, (df, columns) in tables.items():
        counts = [F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)]
        counts += [
            F.count_if(holds(F.col(c), p)).alias(f"m_{i}_{j}")
            for i, c in enumerate(columns)
            for j, p in enumerate(patterns.values())
        ]
        lines = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(name).alias("pattern"),
                F.col(f"n_{i}").alias("non_null"),
                F.col(f"m_{i}_{j}").alias("matches"),
            )
            for i, c in enumerate(columns)
            for j, name in enumerate(patterns)
        ]
        parts.append(df.agg(*counts).select(F.lit(table).alias("table_name"), F.inline(F.array(*lines))))
    share = F.round(F.try_divide(F.col("matches").cast("double"), F.col("non_null").cast("double")), 6)
    return union_all(parts).withColumn("share", share)


def text_columns(df: DataFrame) -> list[str]:
    """The string columns of a table, by its schema."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def text_findings(
    df: DataFrame, key: str, column: str, patterns: Mapping[str, ValuePattern] = VALUE_PATTERNS
) -> DataFrame:
    """``key, kind, value, hits``: values in a text column that look like personal data, and how often each occurs.

    A whole text is searched once, left to right, with all patterns joined, so a card number is not also reported
    as a phone number. Texts that cannot hold any are set aside by a quick search first.
    """
    value = F.explode(F.regexp_extract_all(F.col(column), F.lit(any_pattern(patterns)), F.lit(0)))
    return (
        df.filter(may_hold(F.col(column), patterns))
        .select(key, value.alias("value"))
        .groupBy(key, value_kind(F.col("value"), patterns).alias("kind"), "value")
        .agg(F.count("*").alias("hits"))
    )
