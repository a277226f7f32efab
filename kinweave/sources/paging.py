"""Paging through a large result.

A result is sorted and stored once, in files that follow one another. Beside them lies a *zone map*: a line per file with
the rows before it and its first and last key, itself stored in order. A page looks up the few lines it touches (filters
that reach the map's own scan) and reads those files alone; nothing about the other files comes to the driver.
(``ORDER BY ... LIMIT n OFFSET m`` on the result itself would bring m + n rows of every task into a single one.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.unions import union_all
from kinweave.sources.readers import csv_chunks
from kinweave.sources.shared import materialise, scratch_path

#: Lines of the zone map that are numbered by one task.
_RUN = 4096


@dataclass(frozen=True)
class PagedResult:
    """A stored result: where it lies, its order, its columns, how many rows it has.

    ``zones`` is its zone map: ``file, start, stop, low, high``, where ``start`` rows stand before the file, ``stop`` up to
    its end, and ``low`` and ``high`` are its first and last key.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    schema: T.StructType
    total_rows: int

    @property
    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/zones")

    def _read(self, touched: DataFrame) -> tuple[DataFrame, int]:
        """The rows of some files, and how many rows stand before the first of them."""
        found = touched.select("file", "start").orderBy("start").collect()  # no more than rows of a page, and one
        if not found:
            return self.spark.createDataFrame([], self.schema), 0
        files = [f"{self.path}/rows/{r.file}" for r in found]
        return self.spark.read.schema(self.schema).parquet(*files), found[0].start

    def page(self, start: int, n: int = 50) -> DataFrame:
        """Rows ``start`` to ``start + n``, in order. Past the end it is empty."""
        part, before = self._read(self.zones.filter((F.col("start") < start + n) & (F.col("stop") > start)))
        return part.orderBy(*self.key).offset(max(start - before, 0)).limit(n)

    def page_after(self, last: Sequence[object], n: int = 50) -> DataFrame:
        """The next ``n`` rows after a key (values in the order of the key's columns), which need not occur."""
        if len(last) != len(self.key):
            raise ValueError(f"a key has {len(self.key)} values")
        given = F.struct(*[F.lit(v).cast(self.schema[c].dataType).alias(c) for c, v in zip(self.key, last, strict=True)])
        first = self.zones.filter(F.col("high") > given).agg(F.min("start"), F.min("stop")).first()
        if first[0] is None:
            return self.spark.createDataFrame([], self.schema)
        part, _ = self._read(self.zones.filter((F.col("start") >= first[0]) & (F.col("start") < first[1] + n)))
        return part.filter(_key_of(self.key) > given).orderBy(*self.key).limit(n)

    def pages(self, n: int = 50) -> Iterator[tuple[list[Row], bool]]:
        """The rows of each page in turn, and whether more follow."""
        for start in range(0, self.total_rows, n):
            yield self.page(start, n).collect(), start + n < self.total_rows


def chunk_page(
    spark: SparkSession, chunks: Sequence[tuple[int, str, int]], columns: Sequence[str] | int, start: int, n: int = 50
) -> DataFrame:
    """Rows ``start`` to ``start + n`` of an ordered result that came in CSV chunks, each ``(index, path, rows)``.

    The chunks' counts tell which of them a page touches; only those files are read, and nothing is sorted but the page.
    A chunk is one file read by one task, so its rows are numbered as they stand in it.
    """
    names = [f"column_{i + 1}" for i in range(columns)] if isinstance(columns, int) else list(columns)
    at, parts = 0, []
    for index, path, rows in sorted(chunks):
        low, high = max(start - at, 0), min(start + n - at, rows)
        if low < high:
            place = F.monotonically_increasing_id()
            part = csv_chunks(spark, path, names).select("*", F.lit(index).alias("_index"), place.alias("_place"))
            parts.append(part.filter(F.col("_place").between(low, high - 1)))
        at += rows
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return union_all(parts).orderBy("_index", "_place").drop("_index", "_place")


def _key_of(key: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in key])


def _zone_map(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """A line per file of ordered rows. Reads the key columns; sums of runs of files give the rows before each."""
    place = F.regexp_extract("file", r"^part-(\d+)-.*?(?:-c(\d+))?\.", 1).cast("long")
    split = F.coalesce(F.nullif(F.regexp_extract("file", r"^part-(\d+)-.*?(?:-c(\d+))?\.", 2), F.lit("")).cast("long"), F.lit(0))
    held = rows.select(F.col("_metadata.file_name").alias("file"), _key_of(key).alias("key"))
    files = held.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    files = materialise(files.withColumns({"place": place, "split": split, "run": F.floor(place / _RUN)}), "files")
    runs = files.df.groupBy("run").agg(F.sum("n").alias("of_run"))
    before = F.sum("of_run").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))  # a line per 4096 files
    runs = runs.select("run", F.coalesce(before, F.lit(0)).alias("before"))
    through = F.sum("n").over(Window.partitionBy("run").orderBy("place", "split").rowsBetween(Window.unboundedPreceding, 0))
    stop = (F.col("before") + through).alias("stop")
    zones = files.df.join(runs, "run").select("file", (stop - F.col("n")).alias("start"), stop, "low", "high")
    return zones.orderBy("start")


def open_pages(spark: SparkSession, path: str) -> PagedResult:
    """A result that ``store_pages`` stored below ``path``, in this or another application."""
    zones = spark.read.parquet(f"{path}/zones")
    rows = zones.agg(F.coalesce(F.max("stop"), F.lit(0))).first()[0]
    key = tuple(zones.schema["low"].dataType.names)
    return PagedResult(spark, path, key, spark.read.parquet(f"{path}/rows").schema, rows)


def store_pages(
    df: DataFrame, key: Sequence[str], path: str | None = None, chunks: int | None = None
) -> PagedResult:
    """Sort ``df`` by ``key`` (top-level columns), which must be unique, and store it below ``path`` (default: the shared
    folder). Nulls in the key come first.

    Spark chooses the number of files by size unless ``chunks`` is given.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "pages")
    ordered = df.repartitionByRange(chunks, *key).sortWithinPartitions(*key) if chunks else df.orderBy(*key)
    ordered.write.parquet(f"{path}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{path}/rows")
    _zone_map(stored, key).write.parquet(f"{path}/zones")
    return open_pages(spark, path)
