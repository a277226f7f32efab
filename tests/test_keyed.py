"""Keyed state over several micro-batches: late, repeated and expired jobs, restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinweave.operators import runs
from kinweave.streaming import keyed

SCHEMA = "job_id string, obs_id bigint, seen_at timestamp, state string"
START = datetime(2025, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Add a file of observations (job, number, hours, state) and run the stream over what is new."""
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def run(rows, **more):
        made = [(job, obs, (START + timedelta(hours=h)).isoformat(" ") if h is not None else None, s) for job, obs, h, s in rows]
        df = spark.createDataFrame(made, SCHEMA.replace("timestamp", "string")).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        keyed.start_keyed_runs(arriving, target, log, available_now=True, **more).awaitTermination()
        return spark.read.parquet(target), keyed.read_keyed_runs(spark, target, SCHEMA)

    return run


def test_same_rows_as_the_batch_job(spark, stream, rows):
    """Out of order and repeated, over restarts: the rows of ``latest_runs`` over everything."""
    draw = random.Random(3)
    everything = []
    for size in (60, 30, 0, 20):
        part = [(f"j{draw.randrange(9)}", draw.randrange(50), draw.randrange(100), draw.choice("ab")) for _ in range(size)]
        part += part[:5] + [(None, 1, 1, "x"), ("no time", 1, None, "x")]
        everything += [r for r in part if r[0] and r[2] is not None]
        _, got = stream(part, delay="100 days")
        plain = spark.createDataFrame([(j, o, START + timedelta(hours=h), s) for j, o, h, s in everything], SCHEMA)
        assert rows(got) == rows(runs.latest_runs(plain))


def test_late_and_expired(spark, stream, rows):
    more = {"delay": "2 hours", "expire_seconds": 10 * 3600}
    _, got = stream([("a", 1, 0, "s"), ("b", 1, 5, "s")], **more)
    assert rows(got, "job_id", "obs_id") == [("a", 1), ("b", 1)]
    # The watermark goes to hour 18: a, last seen at 0, and b, at 5, have expired once the next batch comes.
    stream([("c", 1, 20, "s"), ("c", 1, 20, "s"), ("c", 0, 19, "s")], **more)
    changes, got = stream([("d", 1, 21, "s"), ("e", 1, 3, "late"), ("b", 2, 20, "again")], **more)
    assert rows(got, "job_id", "obs_id") == [("b", 2), ("c", 1), ("d", 1)]
    counted = {(r.job_id, r.change): r["count"] for r in changes.groupBy("job_id", "change").count().collect()}
    assert counted[("a", "expired")] == 1 and ("e", "new") not in counted and ("c", "newer") not in counted
    everyone = keyed.read_keyed_runs(spark, changes.inputFiles()[0].rsplit("/", 1)[0], SCHEMA, expired=True)
    assert rows(everyone, "job_id") == [("a",), ("b",), ("c",), ("d",)]


def test_hot_jobs_are_reduced_before_the_shuffle(spark):
    lines = spark.range(20_000, numPartitions=4).selectExpr("IF(id % 3 = 0, 'hot', concat('j', id % 7)) AS job_id", "timestamp_micros(id) AS seen", "id AS at", "id AS tie", "'x' AS body")
    best = lines.mapInArrow(keyed._best_of_batch, keyed._LINE)
    assert best.count() <= 8 * 4 and best.filter("job_id = 'hot'").agg(F.max("at")).first()[0] == 19_998
