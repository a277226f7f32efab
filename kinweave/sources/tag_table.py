"""The tag table as immutable files and a log of commits.

A commit stores the tags of its batch and the names of the tables that the batch tags anew, below a folder of its own, and
then claims the next number of the log by renaming a small file to it. Only one writer can claim a number; one that comes
second looks at the commits since the version it began from, fails if one of them tags a table of its own, and else tries
the next number. Files are never changed, so a crash before the rename leaves the old state, and older versions can be read.

What a version holds follows from the log alone: a tag counts if no later commit names its table. A commit costs what its
batch holds, not what the table holds; ``compact`` stores a version as one commit, from which reads begin.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.skew import join_by_key
from kinweave.operators import tags
from kinweave.sources.shared import claim, materialise

_VERSION = "_version"


class Conflict(RuntimeError):
    """Another writer has tagged a table of this batch since it began."""


@dataclass(frozen=True)
class Entry:
    version: int
    folder: str
    #: Whether the commit holds a whole version.
    whole: bool


@dataclass(frozen=True)
class TagTable:
    """The tag table below ``path``, a folder that executors reach."""

    spark: SparkSession
    path: str

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _log(self) -> Iterator[Entry]:
        """All commits, newest first; the few bytes of each are read when it is reached."""
        log = self._hadoop("log")
        files = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(log):
            return
        names = [s.getPath().getName() for s in files.listStatus(log)]
        for name in sorted((n for n in names if n.endswith(".json")), reverse=True):
            stream = files.open(self._hadoop(f"log/{name}"))
            body = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            yield Entry(int(name.removesuffix(".json")), body["folder"], body["whole"])

    def entries(self, version: int | None = None) -> list[Entry]:
        """Commits that make up a version (default: the newest), from the last whole one on; empty before the first."""
        out: list[Entry] = []
        for entry in self._log():
            if version is None or entry.version <= version:
                out.append(entry)
                if entry.whole:
                    break
        if version and (not out or out[0].version != version):
            raise ValueError(f"no version {version}")
        return out[::-1]

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        found = self.entries()
        return found[-1].version if found else 0

    def _stored(self, entries: Sequence[Entry], part: str, columns: Sequence[T.StructField]) -> DataFrame:
        """Lines of some commits with their version."""
        schema = T.StructType(list(columns))
        if not entries:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(_VERSION, T.LongType())]))
        lines = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{e.folder}/{part}" for e in entries])
        folder = F.regexp_extract(F.col("_metadata.file_path"), f"/data/([0-9a-f]+)/{part}/", 1)
        # A line per commit since the last whole one.
        numbers = self.spark.createDataFrame([(e.folder, e.version) for e in entries], f"_folder string, {_VERSION} bigint")
        return lines.select("*", folder.alias("_folder")).join(F.broadcast(numbers), "_folder").drop("_folder")

    def read(self, version: int | None = None) -> DataFrame:
        """The tags of a version (default: the newest)."""
        entries = self.entries(version)
        fields = T.StructType.fromDDL(tags.TAG_SCHEMA)
        lines = self._stored(entries, "tags", fields)
        if len(entries) < 2:
            return lines.drop(_VERSION)
        keys = T.StructType.fromDDL(", ".join(f"{k} string" for k in tags.TABLE_KEYS))
        newest = self._stored(entries, "tables", keys).groupBy(*tags.TABLE_KEYS).agg(F.max(_VERSION).alias(_VERSION))
        return join_by_key(lines, newest, [*tags.TABLE_KEYS, _VERSION], "left_semi").select(*fields.names)

    def commit(self, batch: DataFrame, at: Column, since: int | None = None) -> int:
        """Store a batch (see ``tags.upsert_tags``), stamped ``at``, and return the new version. A batch that names no table
        changes nothing. ``since`` is the version the batch was made from (default: the newest now).

        Raises ``Conflict`` if a commit after ``since`` names a table of the batch; nothing is changed then.
        """
        since = self.version() if since is None else since
        kept = materialise(batch.select(*tags.TAG_KEYS, "semantic_type"), "batch")
        folder = uuid.uuid4().hex
        schema = T.StructType.fromDDL(tags.TAG_SCHEMA)
        tables = tags.retagged_tables(kept.df)
        fresh = tags.storable_tags(kept.df).withColumn("updated_at", at).select(*schema.names)
        self._write(folder, fresh, tables)
        kept.drop()
        own = self.spark.read.schema(tables.schema).parquet(f"{self.path}/data/{folder}/tables")
        if own.isEmpty():
            return since
        seen = since
        while True:
            newest = self.version()
            # Also commits that a whole one has taken in since.
            later = [e for e in takewhile(lambda e: e.version > seen, self._log()) if not e.whole]  # noqa: B023
            if later:
                others = self._stored(later, "tables", tables.schema.fields).drop(_VERSION)
                clash = own.intersect(others).first()
                if clash is not None:
                    raise Conflict(f"{'.'.join(clash)} was tagged by another commit since version {since}")
            if self._claim(newest + 1, folder, whole=False):
                return newest + 1
            seen = newest

    def _write(self, folder: str, lines: DataFrame, tables: DataFrame) -> None:
        lines.write.parquet(f"{self.path}/data/{folder}/tags")
        tables.write.parquet(f"{self.path}/data/{folder}/tables")

    def _claim(self, number: int, folder: str, whole: bool) -> bool:
        """Take a number of the log; false if another writer has it."""
        return claim(self.spark, f"{self.path}/log", f"{number:012d}.json", json.dumps({"folder": folder, "whole": whole}))

    def compact(self) -> int:
        """Store the newest version as one commit and return its number. Older versions can still be read. If others
        commit meanwhile, it begins anew."""
        while True:
            entries = self.entries()
            if len(entries) < 2:
                return entries[-1].version if entries else 0
            newest, folder = entries[-1].version, uuid.uuid4().hex
            lines = self.read(newest)
            self._write(folder, lines, lines.select(*tags.TABLE_KEYS).distinct())
            if self._claim(newest + 1, folder, whole=True):
                return newest + 1
