"""Registered queries and SQL on job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import SCHEMAS, view, with_views
from kinweave.operators import runs
from kinweave.sources.shared import scratch_path
from kinweave.streaming import keyed
from kinweave.streaming import latest as stream


def _latest(s: SparkSession, d: str) -> DataFrame:
    return runs.latest_runs(view(s, d, "runs"))


def _wanted(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "runs").select(
        F.expr("CASE WHEN obs_id % 2 = 0 THEN job_id END").alias("job_id"),
        F.expr("CASE WHEN obs_id % 2 = 1 THEN run_id END").alias("run_id"),
    )


def _nested_tasks(s: SparkSession, d: str) -> DataFrame:
    """Runs whose tasks are given as nested data: one task for errors, two for purchases, else none."""
    task = """named_struct('task_key', concat('task-', CAST({i} AS STRING)), 'state',
      named_struct('life_cycle_state', 'TERMINATED', 'result_state', state), 'start_time', obs_id,
      'setup_duration', obs_id * {i}, 'execution_duration', obs_id % 1000, 'cleanup_duration', CAST(NULL AS BIGINT))"""
    one, two = task.format(i=1), task.format(i=2)
    tasks = f"CASE state WHEN 'FAILED' THEN array({one}) WHEN 'SUCCEEDED' THEN array({one}, {two}) END"
    return view(s, d, "runs").select("run_id", F.expr(tasks).cast(runs.TASK_SCHEMA).alias("tasks"))


def _observed(s: SparkSession, d: str) -> DataFrame:
    """The events file as a stream of observations."""
    events = s.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("obs_id"),
        F.col("ts").alias("seen_at"),
        F.col("event_type").alias("state"),
    )


_OBSERVED = "job_id string, obs_id bigint, seen_at timestamp_ntz, state string"


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The latest runs kept by a stream over the events file."""
    target = scratch_path(s, "latest")
    query = stream.start_latest_runs(_observed(s, d), f"{target}/table", f"{target}/log", available_now=True)
    query.awaitTermination()
    return stream.read_latest_runs(s, f"{target}/table", _OBSERVED)


def _keyed(s: SparkSession, d: str) -> DataFrame:
    """The same, kept as keyed state."""
    target = scratch_path(s, "keyed")
    query = keyed.start_keyed_runs(_observed(s, d), f"{target}/table", f"{target}/log", available_now=True)
    query.awaitTermination()
    return keyed.read_keyed_runs(s, f"{target}/table", _OBSERVED)


QUERIES = {
    "runs_latest": _latest,
    "runs_newest": lambda s, d: runs.latest_runs(view(s, d, "runs"), keep=20),
    "runs_recent": lambda s, d: runs.recent_runs(_latest(s, d)).select("job_id", "started", "started_text", "last_known"),
    "runs_last_job": lambda s, d: runs.last_job(_latest(s, d)).select("job_id", "last_known"),
    "runs_status": lambda s, d: runs.run_status(view(s, d, "runs")).select(
        "obs_id", "status", "status_text", "is_terminal", "stops_monitor"
    ),
    "runs_duration": lambda s, d: runs.run_duration(view(s, d, "runs"), start="created_at").select(
        "obs_id", "seconds", "minutes", "rest_seconds", "duration"
    ),
    "runs_duration_ms": lambda s, d: runs.milliseconds_text(view(s, d, "runs").select("obs_id"), ["obs_id"]),
    # A sum of doubles depends on the order of the rows in its last digits.
    "runs_totals": lambda s, d: runs.run_totals(_latest(s, d)).withColumn("total_credits", F.round("total_credits", 6)),
    "runs_cells": lambda s, d: runs.run_cells(_latest(s, d)).select("job_id", "records_text", "credits_text"),
    "runs_lookup": lambda s, d: runs.lookup_runs(_latest(s, d), _wanted(s, d)),
    "runs_tasks": lambda s, d: runs.run_tasks(_nested_tasks(s, d)),
    "runs_latest_stream": _stream,
    "runs_latest_keyed": _keyed,
}

_RUNS = with_views(["runs"])
_LATEST = f"""{_RUNS}, latest AS (SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seen_at DESC, obs_id DESC) = 1)"""
_DATED = """dated AS (SELECT *, try_cast(coalesce(start_time, created_at) AS TIMESTAMP) AS t FROM latest)"""


def _duration(seconds: str) -> str:
    return (
        f"CASE WHEN {seconds} >= 60 THEN concat({seconds} // 60, 'm ', {seconds} % 60, 's') "
        f"WHEN {seconds} IS NOT NULL THEN concat({seconds}, 's') END"
    )


ORACLES = {
    "runs_latest": f"{_LATEST} SELECT * FROM latest",
    "runs_newest": f"{_LATEST} SELECT * FROM latest ORDER BY seen_at DESC, obs_id DESC LIMIT 20",
    "runs_recent": f"""{_LATEST}, {_DATED} SELECT job_id, t AS started,
  coalesce(strftime(t, '%Y-%b-%d %H:%M'), '-') AS started_text, coalesce(t, seen_at) AS last_known FROM dated""",
    "runs_last_job": f"""{_LATEST}, {_DATED} SELECT job_id, coalesce(t, seen_at) AS last_known FROM dated
ORDER BY last_known DESC, job_id LIMIT 1""",
    "runs_status": f"""{_RUNS} SELECT obs_id, coalesce(state, 'UNKNOWN') AS status, CASE coalesce(state, 'UNKNOWN')
  WHEN 'SUCCEEDED' THEN '✓ Success' WHEN 'FAILED' THEN '✗ Failed' WHEN 'RUNNING' THEN '◷ Running'
  WHEN 'PENDING' THEN '◷ Pending' ELSE '◷ Unknown' END AS status_text,
  coalesce(state IN ('SUCCEEDED', 'FAILED'), FALSE) AS is_terminal,
  coalesce(state, 'UNKNOWN') IN ('SUCCEEDED', 'FAILED', 'UNKNOWN') AS stops_monitor FROM runs""",
    "runs_duration": f"""{_RUNS}, s AS (SELECT obs_id,
  CAST(floor(epoch(end_at) - epoch(try_cast(created_at AS TIMESTAMP))) AS BIGINT) AS seconds FROM runs)
SELECT obs_id, seconds, seconds // 60 AS minutes, seconds % 60 AS rest_seconds, {_duration('seconds')} AS duration FROM s""",
    "runs_duration_ms": f"{_RUNS}, s AS (SELECT obs_id, obs_id // 1000 AS seconds FROM runs) "
    f"SELECT obs_id, {_duration('seconds')} AS obs_id_text FROM s",
    "runs_totals": f"""{_LATEST} SELECT count(*) AS jobs, count(record_count) AS jobs_with_records,
  CAST(coalesce(sum(record_count), 0) AS BIGINT) AS total_records, count(credits) AS jobs_with_credits,
  round(coalesce(sum(credits), 0), 6) AS total_credits FROM latest""",
    "runs_cells": f"""{_LATEST} SELECT job_id, coalesce(format('{{:,}}', record_count), '-') AS records_text,
  coalesce(CAST(credits AS VARCHAR), '-') AS credits_text FROM latest""",
    "runs_lookup": f"""{_LATEST}, wanted AS (SELECT CASE WHEN obs_id % 2 = 0 THEN job_id END AS job_id,
    CASE WHEN obs_id % 2 = 1 THEN run_id END AS run_id FROM runs)
SELECT w.job_id, w.run_id, j.run_id AS found_run_id, r.job_id AS found_job_id FROM wanted w
  LEFT JOIN latest j ON w.job_id = j.job_id LEFT JOIN latest r ON w.run_id = r.run_id""",
    "runs_tasks": f"""{_RUNS}, t AS (SELECT run_id, unnest(CASE state WHEN 'FAILED' THEN [1] WHEN 'SUCCEEDED' THEN [1, 2]
    ELSE [0] END) AS i, state AS result, obs_id FROM runs)
SELECT run_id, CASE WHEN i > 0 THEN concat('task-', i) END AS task_key, CASE WHEN i > 0 THEN 'TERMINATED' END AS state,
  CASE WHEN i > 0 THEN result END AS result_state, CASE WHEN i > 0 THEN obs_id END AS start_time,
  CASE WHEN i > 0 THEN obs_id * i END AS setup_duration, CASE WHEN i > 0 THEN obs_id % 1000 END AS execution_duration,
  CAST(NULL AS BIGINT) AS cleanup_duration FROM t""",
    "runs_latest_stream": """SELECT concat('job-', user_id) AS job_id, event_id AS obs_id, ts AS seen_at, event_type AS state
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
}
ORACLES["runs_latest_keyed"] = ORACLES["runs_latest_stream"]
