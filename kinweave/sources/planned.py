"""Two data sources whose reads are planned from a listing: ordered result chunks, and files by ranges of a key.

A listing is a small stored table with a line per chunk (``chunk_index, path, rows``) or per row group (``row_groups``).
Planning reads the listing, leaves out what the query's filters exclude, and makes one partition per chunk, or per run of
row groups of about ``rows_per_task`` rows. Row numbers come from the counts in the listing, so nothing is sorted or numbered
to find a page, and a read may be repeated at any time. A missing or short chunk fails the job.

Filters reach a Python data source only if ``spark.sql.python.filterPushdown.enabled`` is on, which ``register`` sees to.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

from kinweave.sources.footers import locate, open_file

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
ROWS_PER_TASK = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the formats ``result_chunks`` and ``key_ranges`` known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    spark.dataSource.register(RangeSource)


@dataclass
class Bounds:
    """An interval of whole numbers, narrowed by filters."""

    low: int = _LEAST
    high: int = _MOST

    def take(self, f: Filter) -> bool:
        """Narrow by a filter on the column; whether it is dealt with by that in full."""
        if isinstance(f, IsNotNull):
            return True
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
            return False
        values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
        if not values:
            return False
        if isinstance(f, (EqualTo, GreaterThanOrEqual, In)):
            self.low = max(self.low, min(values))
        if isinstance(f, (EqualTo, LessThanOrEqual, In)):
            self.high = min(self.high, max(values))
        if isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        if isinstance(f, LessThan):
            self.high = min(self.high, f.value - 1)
        return not isinstance(f, In)


def _listing(path: str, columns: Sequence[str]) -> list[tuple]:
    """Lines of a stored listing (parquet files in a folder), by the first two columns."""
    system, root = locate(path)
    table = pq.read_table(root, filesystem=system, columns=list(columns))
    return sorted(zip(*(table[c].to_pylist() for c in columns), strict=True), key=lambda line: line[:2])


@dataclass
class ChunkPartition(InputPartition):
    index: int
    path: str
    start: int
    rows: int


class ChunkSource(DataSource):
    """Options: ``listing`` (where the listing lies), ``columns`` (names, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "result_chunks"

    def _names(self) -> list[str]:
        return self.options["columns"].split(",")

    def schema(self) -> T.StructType:
        numbers = [T.StructField(c, T.LongType()) for c in ("chunk_index", "row_number")]
        return T.StructType([*numbers, *[T.StructField(c, T.StringType()) for c in self._names()]])

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(self.options["listing"], self._names())


class ChunkReader(DataSourceReader):
    def __init__(self, listing: str, names: list[str]):
        self.listing, self.names = listing, names
        self.rows, self.chunks = Bounds(), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            on = {("row_number",): self.rows, ("chunk_index",): self.chunks}.get(getattr(f, "attribute", None))
            if on is None or not on.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        start, out = 0, []
        for index, path, rows in _listing(self.listing, ["chunk_index", "path", "rows"]):
            inside = start <= self.rows.high and start + rows > self.rows.low and self.chunks.low <= index <= self.chunks.high
            if inside and rows:
                out.append(ChunkPartition(index, path, start, rows))
            start += rows
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ChunkPartition):  # Nothing is left to read.
            return
        schema = pa.schema([("chunk_index", pa.int64()), ("row_number", pa.int64()), *[(n, pa.string()) for n in self.names]])
        at = partition.start
        for batch in _csv_batches(partition.path, self.names):
            low, high = max(self.rows.low, at) - at, min(self.rows.high, at + batch.num_rows - 1) - at + 1
            if low < high:
                part = batch.slice(low, high - low)
                n = part.num_rows
                numbers = pa.array(range(at + low, at + low + n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([partition.index] * n, pa.int64()), numbers, *part.columns], schema=schema)
            at += batch.num_rows
            if at > self.rows.high:
                return
        if at != partition.start + partition.rows:
            raise ValueError(f"{partition.path} holds {at - partition.start} rows, not {partition.rows}")


def _csv_batches(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a CSV file without header, as strings; an empty value without quotes is null."""
    with open_file(path) as source:
        if not source.size():
            return
        reader = csv.open_csv(
            source, csv.ReadOptions(column_names=names), csv.ParseOptions(newlines_in_values=True),
            csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
        )
        yield from reader


def read_chunks(spark: SparkSession, listing: str, columns: Sequence[str]) -> DataFrame:
    """``chunk_index, row_number`` (from 0, through all chunks in order of their index) and the columns, as strings."""
    register(spark)
    return spark.read.format("result_chunks").option("listing", listing).option("columns", ",".join(columns)).load()


@dataclass
class RangePartition(InputPartition):
    #: Paths and numbers of row groups.
    groups: list[tuple[str, int]]


class RangeSource(DataSource):
    """Options: ``listing`` (of ``row_groups``), ``key``, ``rows_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "key_ranges"

    def schema(self) -> T.StructType:
        lines = _listing(self.options["listing"], ["path"])
        if not lines:
            raise ValueError("the listing has no files; give a schema")
        with open_file(lines[0][0]) as source:
            return from_arrow_schema(pq.read_schema(source), prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self.options["listing"], self.options["key"], int(self.options.get("rows_per_task", ROWS_PER_TASK)), schema.names)


class RangeReader(DataSourceReader):
    def __init__(self, listing: str, key: str, rows_per_task: int, names: list[str]):
        self.listing, self.key, self.rows_per_task, self.names = listing, key, rows_per_task, names
        self.bounds, self.filtered = Bounds(), False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # A null key passes no filter, so the interval alone decides.
            if getattr(f, "attribute", None) != (self.key,) or not self.bounds.take(f):
                yield f
            else:
                self.filtered = True

    def partitions(self) -> list[InputPartition]:
        lines = _listing(self.listing, ["path", "row_group", "rows", "low", "high"])
        told = sorted(lines, key=lambda x: (x[3] is None, x[3] or 0, x[0], x[1]))
        out: list[InputPartition] = []
        own, held = [], 0
        for path, group, rows, low, high in told:
            if low is not None and (high < self.bounds.low or low > self.bounds.high):
                continue
            if own and held + rows > self.rows_per_task:
                out.append(RangePartition(own))
                own, held = [], 0
            own.append((path, group))
            held += rows
        return [*out, RangePartition(own)] if own else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, group in partition.groups if isinstance(partition, RangePartition) else []:
            with open_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(row_groups=[group], columns=self.names):
                    if self.filtered:
                        key = batch.column(batch.schema.get_field_index(self.key))
                        inside = pc.and_(pc.greater_equal(key, self.bounds.low), pc.less_equal(key, self.bounds.high))
                        batch = batch.filter(pc.fill_null(inside, False))
                    if batch.num_rows:
                        yield batch.select(self.names)


def read_ranges(spark: SparkSession, listing: str, key: str, schema: T.StructType | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All rows of the files of a stored ``row_groups`` listing. Filters on the key leave out row groups when the read is
    planned, and rows when they are read."""
    register(spark)
    reader = spark.read.format("key_ranges").option("listing", listing).option("key", key).option("rows_per_task", rows_per_task)
    return (reader.schema(schema) if schema else reader).load()


def range_bounds(lowest: int, highest: int, rows: int, key: str, rows_per_task: int = ROWS_PER_TASK) -> Mapping[str, str]:
    """Options that make Spark's JDBC source read a table by ranges of an integer key, from its smallest and largest
    value and number of rows (one query of the warehouse: ``SELECT min(k), max(k), count(*)``)."""
    parts = max(1, min(-(-rows // rows_per_task), highest - lowest + 1))
    return {"partitionColumn": key, "lowerBound": str(lowest), "upperBound": str(highest + 1), "numPartitions": str(parts)}
