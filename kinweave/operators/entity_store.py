"""Resolution that grows by batches: stored keys, members and merges, so that a batch costs what it touches.

Records that share a key of a match rule are one entity, so what a later batch has to know of all earlier records is the
entity of each of *its* keys. The store keeps

* ``keys``: two hashes of every key seen, the entity it belongs to, in ``BUCKETS`` folders by hash; a batch reads the
  buckets its keys fall in, and adds the keys that are new. A record's id is a key as well, so a record that comes again
  meets its entity;
* ``members``: a line per record, the entity it was put in;
* ``merges``: a line per entity that a later batch found to be the same as another, and the entity that stands for it now.

An entity is named by its smallest record id when it is first seen and keeps that name until it merges; of entities that
merge, the smallest name stays. Lines of keys and members are never changed, merges are told apart at reading. So components
are found over a batch's records and the entities it touches, by numbers, however large the store is.

A commit is a folder and a line of a log, claimed by a rename (see ``sources.shared.claim``): a crash leaves the old state, of
two writers that began from the same version the second fails, and older versions can be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key
from kinweave.operators.components import components_of_numbers
from kinweave.operators.resolution import match_rules, record_keys
from kinweave.sources.shared import claim, materialise

#: Folders that the stored keys are dealt into.
BUCKETS = 64
_KEYS = "high long, low long, entity_id string"
_MEMBERS = "record_id string, entity_id string"
_MERGES = "retired string, entity_id string"


class Commit(NamedTuple):
    version: int
    folder: str
    #: Whether it holds a whole version.
    whole: bool
    #: Those with keys of this commit.
    buckets: list[int]


class Conflict(RuntimeError):
    """Another batch was stored since this one began."""


@dataclass(frozen=True)
class EntityStore:
    """Entities below ``path``, a folder that executors reach. All batches must use the same ``rules`` (default:
    ``match_rules()``)."""

    spark: SparkSession
    path: str
    rules: tuple[tuple[str, ...], ...] = ()
    buckets: int = BUCKETS

    # ---- versions ----

    def _log(self) -> list[str]:
        """Names of the commits in order, a few bytes each."""
        log = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        files = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(log):
            return []
        return sorted(n for s in files.listStatus(log) if (n := s.getPath().getName()).endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 before the first batch."""
        return len(self._log())

    def _commits(self, version: int | None) -> list[Commit]:
        """The commits of a version, from its last whole one on."""
        names = self._log()
        if version is not None:
            if not 0 <= version <= len(names):
                raise ValueError(f"no version {version}")
            names = names[:version]
        if not names:
            return []
        bodies = self.spark.read.text([f"{self.path}/log/{n}" for n in names]).select("value").collect()  # a line per batch
        commits = sorted((Commit(**json.loads(r.value)) for r in bodies), key=lambda c: c.version)
        since = max((i for i, c in enumerate(commits) if c.whole), default=0)
        return commits[since:]

    def _read(self, commits: Sequence[Commit], part: str, schema: str) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{c.folder}/{part}" for c in commits])

    def _keys_in(self, commits: Sequence[Commit], buckets: Iterable[int]) -> DataFrame:
        """Stored keys of some buckets; other buckets are not opened."""
        wanted = set(buckets)
        paths = [f"{self.path}/data/{c.folder}/keys/bucket={b}" for c in commits for b in c.buckets if b in wanted]
        if not paths:
            return self.spark.createDataFrame([], _KEYS)
        return self.spark.read.schema(_KEYS).parquet(*paths)

    # ---- reading ----

    def merges(self, version: int | None = None) -> DataFrame:
        """``retired, entity_id``: entities that are no more, and the one that stands for each."""
        return self._read(self._commits(version)[-1:], "merges", _MERGES)

    def entities(self, version: int | None = None) -> DataFrame:
        """``record_id, entity_id`` of every record stored up to a version (default: the newest)."""
        commits = self._commits(version)
        return _standing(self._read(commits, "members", _MEMBERS), self._read(commits[-1:], "merges", _MERGES))

    # ---- writing ----

    def add(self, records: DataFrame, since: int | None = None) -> int:
        """Store a batch of standardised records (``record_id`` and the fields of the rules) and return the new version.

        A record without an id is left out; one that was stored before adds its new keys. A batch without records changes
        nothing. ``since`` is the version the batch was made from (default: the newest now); ``Conflict`` is raised, and
        nothing changed, if it is no longer the newest when the batch is stored.
        """
        since = self.version() if since is None else since
        commits = self._commits(since)
        rules = self.rules or match_rules()
        fields = sorted({f for rule in rules for f in rule})
        # Written once: both the numbers and the keys read it, and what made the records may be dear.
        batch = materialise(records.filter("record_id IS NOT NULL").select("record_id", *fields), "batch")
        given = batch.df
        # Records get numbers from 0 on, entities of the store that they meet numbers below 0.
        numbers = materialise(given.select("record_id").distinct().withColumn("node", F.monotonically_increasing_id()), "numbers")
        if numbers.df.isEmpty():
            for table in (batch, numbers):
                table.drop()
            return since
        own = F.array(F.struct(F.lit("").alias("rule"), F.col("record_id").alias("block_key")))
        # Tables that lie in files already, with a line per key, are joined as they are (see ``join_by_key``).
        keyed = given.join(numbers.df, "record_id").select("node", F.inline(F.concat(own, record_keys(rules))))
        text = F.concat_ws("\0", "rule", "block_key")
        lines = keyed.select("node", (F.col("rule") == "").alias("is_id"), F.xxhash64(text).alias("high"), F.xxhash64(F.lit(1), text).alias("low"))
        lines = materialise(lines, "lines")
        bucket = F.pmod("high", F.lit(self.buckets)).cast("int").alias("bucket")
        keys = materialise(lines.df.groupBy("high", "low").agg(F.min("node").alias("first")).select("*", bucket), "keys")
        met = sorted(r.bucket for r in keys.df.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        merges = self._read(commits[-1:], "merges", _MERGES)
        found = self._keys_in(commits, met).join(keys.df.select("high", "low"), ["high", "low"])
        known = materialise(_standing(found, merges), "known")
        touched = materialise(known.df.select("entity_id").distinct().withColumn("number", -1 - F.monotonically_increasing_id()), "touched")
        meets = known.df.join(touched.df, "entity_id").select("high", "low", "number")
        hubs = keys.df.join(meets, ["high", "low"], "left").select("high", "low", F.coalesce("number", "first").alias("id_b"))
        edges = join_by_key(lines.df.select(F.col("node").alias("id_a"), "high", "low"), hubs, ["high", "low"], "inner")
        parts = components_of_numbers(edges.select("id_a", "id_b"))
        # A component has a negative number exactly if it holds a stored entity.
        of_store = touched.df.join(parts.df.withColumnRenamed("node", "number"), "number").select("entity_id", "component")
        of_batch = numbers.df.join(parts.df, "node")
        named = of_store.groupBy("component").agg(F.min("entity_id").alias("name"))
        fresh = of_batch.filter("component >= 0").groupBy("component").agg(F.min("record_id").alias("name"))
        names = materialise(named.unionByName(fresh), "names")
        placed = materialise(of_batch.join(names.df, "component").select("node", "record_id", F.col("name").alias("entity_id")), "placed")
        again = lines.df.filter("is_id").join(known.df, ["high", "low"]).select("node").distinct()
        members = placed.df.join(again, "node", "left_anti").select("record_id", "entity_id")
        unseen = keys.df.join(known.df, ["high", "low"], "left_anti")
        held = unseen.withColumnRenamed("first", "node").join(placed.df, "node")
        moved = of_store.join(names.df, "component").filter("entity_id <> name").select(F.col("entity_id").alias("retired"), "name")
        moved = materialise(moved, "moved")
        # Entities that stood for others and are retired now hand those on.
        later = moved.df.withColumnRenamed("retired", "entity_id")
        handed = merges.join(later, "entity_id", "left").select("retired", F.coalesce("name", "entity_id").alias("entity_id"))
        self._store(held, members, handed.unionByName(moved.df.withColumnRenamed("name", "entity_id")), since, whole=False)
        for table in (batch, numbers, lines, keys, known, touched, parts, names, placed, moved):
            table.drop()
        return since + 1

    def compact(self) -> int:
        """Store the newest version as one commit and return its number. Older versions can still be read."""
        since = self.version()
        commits = self._commits(since)
        if len(commits) < 2:
            return since
        merges = self._read(commits[-1:], "merges", _MERGES)
        keys = _standing(self._keys_in(commits, range(self.buckets)), merges)
        keys = keys.select("*", F.pmod("high", F.lit(self.buckets)).cast("int").alias("bucket"))
        self._store(keys, self.entities(since), merges, since, whole=True)
        return since + 1

    def _store(self, keys: DataFrame, members: DataFrame, merges: DataFrame, since: int, whole: bool) -> None:
        folder = uuid.uuid4().hex
        base = f"{self.path}/data/{folder}"
        # Hashes are even, so a bucket is no larger than others; a large one is written by several tasks.
        keys.select("high", "low", "entity_id", "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{base}/keys")
        members.select("record_id", "entity_id").write.parquet(f"{base}/members")
        merges.select("retired", "entity_id").write.parquet(f"{base}/merges")
        written = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/keys")
        names = [s.getPath().getName() for s in written.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(written)]
        stored = sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))
        body = json.dumps(Commit(since + 1, folder, whole, stored)._asdict())
        if not claim(self.spark, f"{self.path}/log", f"{since + 1:012d}.json", body):
            raise Conflict(f"another batch was stored since version {since}")


def _standing(lines: DataFrame, merges: DataFrame) -> DataFrame:
    """``lines`` with ``entity_id`` replaced by the entity that stands for it now."""
    now = merges.select(F.col("retired").alias("entity_id"), F.col("entity_id").alias("now"))
    joined = lines.join(now, "entity_id", "left")  # both lie in files, merges with a line per retired entity
    return joined.withColumn("entity_id", F.coalesce("now", "entity_id")).select(*lines.columns)
