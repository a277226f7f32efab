"""The latest observation of every job as keyed state, with expiry.

The state of a job is its latest observation, held in RocksDB by the task that owns the job's partition. A micro-batch
touches the jobs that it brings and those whose timers fire, nothing else, and the driver keeps no list of past batches.
Changes go to an append-only table through Spark's file sink, whose log makes them exactly-once over restarts.

Observations are first reduced within each Arrow batch to one line per job, so that a job with a third of all
observations sends its owner few lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_LINE = "job_id string, seen timestamp, at long, tie long, body string"
_CHANGE = "job_id string, at long, tie long, body string, change string"


class _Latest(StatefulProcessor):
    """State of one job: time (microseconds), tie and body of its latest observation."""

    def __init__(self, expire_seconds: int | None):
        self.expire_ms = None if expire_seconds is None else expire_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at bigint, tie bigint, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = max((line for frame in rows for line in zip(frame["at"], frame["tie"], frame["body"], strict=True)), default=None)
        known = tuple(self.latest.get()) if self.latest.exists() else None
        if best is None or (known is not None and best <= known):
            return
        if self.expire_ms is not None:
            if known is not None:
                self.handle.deleteTimer(int(known[0]) // 1000 + self.expire_ms)
            self.handle.registerTimer(int(best[0]) // 1000 + self.expire_ms)
        self.latest.update((int(best[0]), int(best[1]), best[2]))
        yield _change(key, best, "new" if known is None else "newer")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            known = tuple(self.latest.get())
            self.latest.clear()
            yield _change(key, known, "expired")

    def close(self) -> None:
        pass


def _change(key: tuple, line: tuple, change: str) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [key[0]], "at": [int(line[0])], "tie": [int(line[1])], "body": [line[2]], "change": [change]})


def _best_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by([("job_id", "ascending"), ("at", "descending"), ("tie", "descending"), ("body", "descending")])
        if table.num_rows:
            names = table["job_id"].to_pylist()
            first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            yield from table.take(first).combine_chunks().to_batches()


def start_keyed_runs(
    observations: DataFrame, target: str, checkpoint: str, *, order: Sequence[str] = ("seen_at", "obs_id"), delay: str = "7 days",
    expire_seconds: int | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Run a stream that appends to ``target`` a line whenever the latest observation of a job (``job_id``) changes.

    ``order`` names the time of an observation (a timestamp) and a whole number that breaks ties. An observation older than
    the newest time seen before less ``delay`` is late and counts for nothing, as does one without a job, time or number.
    With ``expire_seconds`` a job whose latest observation is so much older than the watermark expires: its state goes, a
    line tells so, and an observation that still comes begins anew. Repeated and older observations change nothing.
    """
    time, tie = order
    seen = F.col(time).cast("timestamp")
    lines = observations.select(
        F.col("job_id").cast("string").alias("job_id"), seen.alias("seen"), F.unix_micros(seen).alias("at"), F.col(tie).cast("long").alias("tie"),
        F.to_json(F.struct(*observations.columns), _FORMATS).alias("body"),
    ).dropna(subset=["job_id", "seen", "tie"])
    keyed = lines.mapInArrow(_best_of_batch, _LINE).withWatermark("seen", delay).groupBy("job_id")
    schema = T.StructType.fromDDL(_CHANGE)
    mode = "none" if expire_seconds is None else "EventTime"
    changes = keyed.transformWithStateInPandas(_Latest(expire_seconds), schema, "Append", mode)
    writer = changes.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    # A query keeps the store that the session names when it starts.
    spark = observations.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def read_keyed_runs(spark: SparkSession, target: str, schema: str, *, expired: bool = False) -> DataFrame:
    """The latest observation of every job by the changes so far; with ``expired`` those of expired jobs too."""
    changes = spark.read.schema(_CHANGE).parquet(target)
    # Of one observation the expiry comes after the news of it.
    number = F.struct("at", "tie", (F.col("change") == "expired").alias("gone"))
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("body", "change"), number).alias("last"))
    kept = last if expired else last.filter("last.change <> 'expired'")
    return kept.select(F.from_json("last.body", T.StructType.fromDDL(schema), _FORMATS).alias("o")).select("o.*")
