"""What parquet files say of themselves, read from their footers by tasks: columns, types, row groups and key ranges.

The driver lists nothing but folders (as any Spark read does) and opens no file. Files are dealt to tasks by path; a task
reads the footers of its files, a few kilobytes each. Schemas of many files are merged by an aggregate that combines on
the map side, and files that disagree are reported as lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Files of a task, and how many tasks there are at most.
FILES, TASKS = 32, 8192


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a URI (as Spark writes it) or an absolute path."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def open_file(path: str):
    """A file for reading."""
    system, name = locate(path)
    return system.open_input_file(name)


def list_files(spark: SparkSession, folder: str | list[str], glob: str = "*.parquet") -> DataFrame:
    """``path, bytes`` of all files below some folders; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def _dealt(files: DataFrame) -> DataFrame:
    n = max(1, min(TASKS, -(-files.count() // FILES)))
    return files.select("path").repartition(n, "path")


_COLUMNS = "path string, rows long, column_name string, data_type string, nullable boolean, position long"


def file_columns(files: DataFrame) -> DataFrame:
    """``path, rows, column_name, data_type, nullable, position``: a line per file (``path``) and top-level column. A file
    without columns has no line; one that is no parquet file fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    footer = pq.read_metadata(source)
                schema = footer.schema.to_arrow_schema()
                kinds = [from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString() for field in schema]
                n = len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([footer.num_rows] * n, pa.int64()), pa.array(schema.names, pa.string()),
                     pa.array(kinds, pa.string()), pa.array([field.nullable for field in schema], pa.bool_()), pa.array(range(n), pa.int64())],
                    names=["path", "rows", "column_name", "data_type", "nullable", "position"],
                )

    return _dealt(files).mapInArrow(run, _COLUMNS)


def merged_columns(columns: DataFrame, table: str = "table_name") -> DataFrame:
    """One line per table and column of many files: ``data_type`` if all files agree (else null), ``types`` that occur,
    ``nullable`` if it is in any file, ``position`` (the smallest), ``files`` that have the column, ``conflict``.

    ``columns`` is ``file_columns`` with the name of each file's table. ``conflict`` is ``type`` if types differ,
    ``missing`` if some files of the table lack the column, else null.
    """
    of_table = columns.groupBy(table).agg(F.countDistinct("path").alias("all_files"))
    merged = columns.groupBy(table, "column_name").agg(
        F.sort_array(F.collect_set("data_type")).alias("types"),
        F.max("nullable").alias("nullable"),
        F.min("position").alias("position"),
        F.count("*").alias("files"),
    )
    conflict = F.when(F.size("types") > 1, "type").when(F.col("files") < F.col("all_files"), "missing")
    return merged.join(of_table, table).select(
        table, "column_name", F.when(F.size("types") == 1, F.get("types", F.lit(0))).alias("data_type"), "types", "nullable", "position", "files",
        conflict.alias("conflict"),
    )


def row_groups(files: DataFrame, key: str) -> DataFrame:
    """``path, row_group, rows, bytes, low, high`` of every row group: the smallest and largest value of an integer key
    column by the footer; null where the footer does not tell (the group may then hold any value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    footer = pq.read_metadata(source)
                at = footer.schema.to_arrow_schema().get_field_index(key)
                if at < 0 or not pa.types.is_integer(footer.schema.to_arrow_schema().field(at).type):
                    raise ValueError(f"{path} has no integer column {key}")
                leaf = [footer.schema.column(i).path for i in range(footer.num_columns)].index(key)
                lines = []
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    told = group.column(leaf).statistics
                    ends = (told.min, told.max) if told is not None and told.has_min_max and told.null_count == 0 else (None, None)
                    lines.append((path, g, group.num_rows, group.total_byte_size, *ends))
                if lines:
                    kinds = [pa.string(), *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names=["path", "row_group", "rows", "bytes", "low", "high"]
                    )

    return _dealt(files).mapInArrow(run, "path string, row_group long, rows long, bytes long, low long, high long")
