"""Profiles of columns that are stored and merged batch by batch, and keys that must look like keys in their values.

A profile is a line per column: exact counts, lengths, and mergeable sketches of distinct values (HyperLogLog) and, for
numbers, of quantiles (KLL). A table is read once whatever its width; a task sends one line. A new batch is profiled alone
and merged with what is stored, so no row is read twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.skew import join_by_key
from kinweave.functions.unions import union_all

#: Logarithm of the registers of a distinct sketch: 16 KB, a standard error below 1 %.
REGISTERS = 14
#: Distinct values of a key, as a share of its rows; leaves room for five standard errors.
NEAR_UNIQUE = 0.95
_KEYS = ["table_name", "column_name"]


def column_profiles(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``table_name, column_name, n_rows, n_null, min_length, max_length, distinct_sketch, quantile_sketch`` of the named
    columns of many tables. Lengths are those of the values as text, null without values; numbers alone have a quantile
    sketch, in which null and NaN do not count. A table without rows has lines with zeros."""
    parts = []
    for table, (df, columns) in tables.items():
        kinds = [df.schema[c].dataType for c in columns]
        plain = df.select(*[F.col(c).alias(f"v_{i}") for i, c in enumerate(columns)])
        aggregates, lines = [F.count(F.lit(1)).alias("n_rows")], []
        for i, (column, kind) in enumerate(zip(columns, kinds, strict=True)):
            text = F.col(f"v_{i}").cast("string")
            aggregates += [
                F.count(text).alias(f"n_{i}"),
                F.min(F.char_length(text)).alias(f"low_{i}"),
                F.max(F.char_length(text)).alias(f"high_{i}"),
                F.hll_sketch_agg(text, REGISTERS).alias(f"distinct_{i}"),
            ]
            quantiles = F.lit(None).cast("binary")
            if isinstance(kind, T.NumericType):
                number = F.col(f"v_{i}").cast("double")
                aggregates.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number)).alias(f"quantiles_{i}"))
                quantiles = F.col(f"quantiles_{i}")
            lines.append(
                F.struct(
                    F.lit(column).alias("column_name"),
                    "n_rows",
                    (F.col("n_rows") - F.col(f"n_{i}")).alias("n_null"),
                    F.col(f"low_{i}").alias("min_length"),
                    F.col(f"high_{i}").alias("max_length"),
                    F.col(f"distinct_{i}").alias("distinct_sketch"),
                    quantiles.alias("quantile_sketch"),
                )
            )
        if lines:
            counted = plain.agg(*aggregates).select(F.lit(table).alias("table_name"), F.explode(F.array(*lines)).alias("line"))
            parts.append(counted.select("table_name", "line.*"))
    return union_all(parts)


def merge_profiles(*stored: DataFrame) -> DataFrame:
    """One line per column from the profiles of several batches."""
    return (
        union_all(list(stored))
        .groupBy(*_KEYS)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_null").alias("n_null"),
            F.min("min_length").alias("min_length"),
            F.max("max_length").alias("max_length"),
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        )
    )


def read_profiles(profiles: DataFrame, near_unique: float = NEAR_UNIQUE) -> DataFrame:
    """The profiles with ``n_distinct`` and ``median``, both estimated, and ``may_be_key`` in place of the sketches. A key has
    no nulls, has rows, and nearly as many distinct values as rows; a few repeated values go unseen."""
    distinct = F.hll_sketch_estimate("distinct_sketch")
    has_numbers = F.kll_sketch_get_n_double("quantile_sketch") > 0
    median = F.when(has_numbers, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5)))
    may_be_key = (F.col("n_rows") > 0) & (F.col("n_null") == 0) & (distinct >= near_unique * F.col("n_rows"))
    return profiles.withColumns({"n_distinct": distinct, "median": median, "may_be_key": may_be_key}).drop(
        "distinct_sketch", "quantile_sketch"
    )


def confirm_keys(scan: DataFrame, profiles: DataFrame, near_unique: float = NEAR_UNIQUE) -> DataFrame:
    """``scan`` without the semantic ``pk`` on columns whose profile says that they are no key. Columns without a profile keep
    theirs. Columns are matched by table and column name."""
    told = read_profiles(profiles, near_unique).select(*_KEYS, "may_be_key")
    joined = join_by_key(scan, told, _KEYS, "left")
    refuted = (F.col("semantic") == "pk") & ~F.coalesce("may_be_key", F.lit(True))
    return joined.withColumn("semantic", F.when(~F.coalesce(refuted, F.lit(False)), F.col("semantic"))).select(*scan.columns)
