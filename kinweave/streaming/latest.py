"""Keeping the latest observation of every job while observations arrive.

Jobs are dealt to ``BUCKETS`` buckets by hash. A micro-batch reads and writes the buckets it touches, each as a new version
below the batch's number; a bucket's newest complete version is its state. Versions are never changed, so a batch that is
run again after a failure makes its own versions anew from those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.runs import latest_runs

BUCKETS = 64
_BUCKET = "_bucket"


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[str]]:
    """The paths of each bucket's versions, oldest first, of all batches, or of those before a number. A version counts
    once Spark has written its batch's success file."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[str]] = {}
    if not files.exists(path_of(target)):
        return found
    states = [s.getPath() for s in files.listStatus(path_of(target)) if s.getPath().getName().startswith("state-")]
    for state in sorted(states, key=lambda p: p.getName()):
        if (before is None or int(state.getName()[6:]) < before) and files.exists(path_of(state, "_SUCCESS")):
            for part in files.listStatus(state):
                name = part.getPath().getName()
                if name.startswith(f"{_BUCKET}="):
                    found.setdefault(int(name.partition("=")[2]), []).append(part.getPath().toString())
    return found


def start_latest_runs(
    observations: DataFrame,
    target: str,
    checkpoint: str,
    order: Sequence[str] = ("seen_at", "obs_id"),
    available_now: bool = False,
) -> StreamingQuery:
    """Run a stream that keeps ``target`` up to date with the latest observation per job (column ``job_id``)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")
        newest = latest_runs(batch, order=order)
        touched = {r[0] for r in newest.select(bucket).distinct().collect()}
        known = [paths[-1] for k, paths in _versions(spark, target, number).items() if k in touched]
        if known:
            newest = latest_runs(newest.unionByName(spark.read.schema(batch.schema).parquet(*known)), order=order)
        out = newest.withColumn(_BUCKET, bucket).write.mode("overwrite").partitionBy(_BUCKET)
        out.parquet(f"{target}/state-{number:012d}")

    writer = observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_latest_runs(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The newest state of the stream, empty before the first batch."""
    paths = [versions[-1] for versions in _versions(spark, target).values()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def drop_old_states(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions of each bucket (at least two, as a repeated batch needs the one
    before)."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [p for versions in _versions(spark, target).values() for p in versions[: -max(keep, 2)]]
    for path in old:
        files.delete(path_of(path), True)
    return len(old)
