"""Running numpy code over the Arrow batches of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, of_batch: Callable[[pa.RecordBatch], Iterator[list]], schema: T.StructType) -> DataFrame:
    """Rows made from Arrow batches of ``df``; ``of_batch`` yields lists of columns in the order of ``schema``.

    Columns of ``df`` are reached by position, so that equal names do no harm.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in of_batch(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else to_array(c, f.type) for c, f in zip(columns, target, strict=True)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def to_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind)
    return pa.array(values, kind)


def added(df: DataFrame, name: str) -> str:
    """``name``, or the name with as many underscores as make it new to ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(df: DataFrame, column: str):
    """A text column as a string that is never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
