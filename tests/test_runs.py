import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import runs
from kinweave.streaming import latest as stream

SCHEMA = (
    "job_id string, run_id string, obs_id bigint, seen_at timestamp, state string, created_at string, "
    "start_time string, end_at timestamp, record_count bigint, credits double"
)


def observed(spark, *entries):
    rows = []
    for i, e in enumerate(entries):
        row = {"job_id": "j", "run_id": f"r{i}", "obs_id": i, "seen_at": f"2025-01-01 00:00:{i:02d}", **e}
        rows.append([row.get(c.split()[0]) for c in SCHEMA.split(", ")])
    text = SCHEMA.replace("timestamp", "string")
    df = spark.createDataFrame(rows, text)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ["seen_at", "end_at"]})


def test_latest_and_newest(spark):
    df = observed(spark, {"state": "RUNNING"}, {"job_id": "k", "state": "FAILED"}, {"state": "SUCCEEDED"})
    assert {(r.job_id, r.state) for r in runs.latest_runs(df).collect()} == {("j", "SUCCEEDED"), ("k", "FAILED")}
    assert [r.job_id for r in runs.latest_runs(df, keep=1).collect()] == ["j"]


def test_recent_order(spark):
    df = observed(
        spark,
        {"job_id": "old", "start_time": "2025-10-29T10:01:00Z"},
        {"job_id": "new", "start_time": "2025-10-29T13:00:00+02:00"},
        {"job_id": "made", "created_at": "2025-10-29 10:30:00"},
        {"job_id": "bad", "start_time": "soon", "created_at": "2030-01-01 00:00:00"},
        {"job_id": "none"},
    )
    got = [(r.job_id, r.started_text) for r in runs.recent_runs(df).collect()]
    assert got == [
        ("new", "2025-Oct-29 13:00"),
        ("made", "2025-Oct-29 10:30"),
        ("old", "2025-Oct-29 10:01"),
        ("bad", "-"),
        ("none", "-"),
    ]
    assert runs.last_job(df).first().job_id == "new"
    assert runs.last_job(df.filter("job_id IN ('bad', 'none')")).first().job_id == "none"


@pytest.mark.parametrize(
    "text, instant",
    [
        ("2025-10-29T10:01:00Z", "2025-10-29 10:01:00"),
        ("2025-10-29T10:01:00.5+02:00", "2025-10-29 08:01:00.5"),
        ("2025-10-29 10:01:00", "2025-10-29 10:01:00"),
        ("2025-10-29", "2025-10-29 00:00:00"),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_instants_do_not_depend_on_the_session_zone(spark, text, instant):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([(text,)], "t string").select(runs.instant(F.col("t")).alias("t"))
        shown = df.select(F.date_format(F.to_utc_timestamp("t", "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss.S")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (shown and shown.removesuffix(".0")) == instant


@pytest.mark.parametrize(
    "state, status, text, terminal, stops",
    [
        ("succeeded", "SUCCEEDED", "✓ Success", True, True),
        (":failed", ":FAILED", "◷ :failed", True, True),
        ("RUNNING", "RUNNING", "◷ Running", False, False),
        ("submitted", "SUBMITTED", "◷ Submitted", False, False),
        ("unauthorized", "UNAUTHORIZED", "◷ Unauthorized", False, True),
        (None, "UNKNOWN", "◷ Unknown", False, True),
        ("unknown", "UNKNOWN", "◷ Unknown", True, True),
        ("", "UNKNOWN", "◷ Unknown", False, True),
    ],
)
def test_status(spark, state, status, text, terminal, stops):
    row = runs.run_status(observed(spark, {"state": state})).first()
    assert (row.status, row.is_terminal, row.stops_monitor) == (status, terminal, stops)
    assert row.status_text.lower() == text.lower()


def test_durations_and_totals(spark):
    df = observed(
        spark,
        {"start_time": "2025-01-01T00:00:00Z", "end_at": "2025-01-01 00:14:22", "record_count": 5000, "credits": 25.0},
        {"job_id": "k", "start_time": "2025-01-01T00:00:00Z", "end_at": "2025-01-01 00:00:07", "credits": 10.0},
        {"job_id": "l", "start_time": "x"},
    )
    assert [r.duration for r in runs.run_duration(df).orderBy("obs_id").collect()] == ["14m 22s", "7s", None]
    assert runs.run_totals(df).first()[:] == (3, 1, 5000, 2, 35.0)
    assert [r.records_text for r in runs.run_cells(df).orderBy("obs_id").collect()] == ["5,000", "-", "-"]
    assert runs.run_totals(df.limit(0)).first()[:] == (0, 0, 0, 0, 0.0)


def test_lookup(spark, rows):
    df = observed(spark, {"run_id": "x"}, {"job_id": "k", "run_id": "x"})
    wanted = spark.createDataFrame([("j", None), (None, "x"), ("none", "none")], "job_id string, run_id string")
    assert set(rows(runs.lookup_runs(df, wanted), "job_id", "run_id", "found_run_id", "found_job_id")) == {
        ("j", None, "x", None),
        (None, "x", None, "k"),
        ("none", "none", None, None),
    }


def test_tasks_from_json(spark, rows):
    body = json.dumps([{"task_key": "a", "state": {"life_cycle_state": "TERMINATED", "result_state": "SUCCESS"}, "execution_duration": 9}, {"task_key": "b"}])
    df = spark.createDataFrame([("r1", body), ("r2", None)], "run_id string, body string")
    nested = df.select("run_id", F.from_json("body", runs.TASK_SCHEMA).alias("tasks"))
    got = rows(runs.run_tasks(nested), "run_id", "task_key", "state", "result_state", "execution_duration")
    assert got == [("r1", "a", "TERMINATED", "SUCCESS", 9), ("r1", "b", None, None, None), ("r2", None, None, None, None)]


def test_stream_keeps_the_latest(spark, tmp_path, rows):
    """Several micro-batches, out of order, then a second run from the checkpoint."""
    schema = "job_id string, obs_id bigint, seen_at timestamp, state string"
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rnd = random.Random(5)
    everything = []

    def add(n):
        part = [(f"j{rnd.randrange(9)}", rnd.randrange(10**6), f"2025-01-{rnd.randrange(1, 29):02d} 00:00:00", "s") for _ in range(n)]
        everything.extend(part)
        df = spark.createDataFrame(part, schema.replace("timestamp", "string"))
        df.withColumn("seen_at", F.col("seen_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.start_latest_runs(arriving, target, log, available_now=True).awaitTermination()
        return stream.read_latest_runs(spark, target, schema)

    assert stream.read_latest_runs(spark, target, schema).count() == 0
    for size in (40, 30, 20):
        add(size)
    for _ in range(2):
        got = run()
        best = {}
        for job, obs, seen, _state in everything:
            best[job] = max(best.get(job, ("", 0)), (seen, obs))
        assert {(r.job_id, str(r.seen_at), r.obs_id) for r in got.collect()} == {(j, s, o) for j, (s, o) in best.items()}
        add(25)
    assert stream.drop_old_states(spark, target) > 0
    assert stream.read_latest_runs(spark, target, schema).count() == got.count()
