"""Accounting of job runs.

Observations have ``job_id, run_id, obs_id, seen_at, state, created_at, start_time`` (ISO texts as the service gives
them), ``end_at, record_count, credits``. The latest of a job is found by a maximum that is combined on the map side,
so a job with most of the observations is no heavier than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key

# States after which a job does not change any more, as the listing and the monitor see them.
TERMINAL_STATES = ["succeeded", "success", "failed", "error", "unknown"]
MONITOR_STOPS = [*TERMINAL_STATES, "unauthorized"]

# Symbols shown for a state.
DONE, BROKEN, OPEN = "✓", "✗", "◷"


def latest_runs(
    observations: DataFrame, keep: int | None = None, order: Sequence[str] = ("seen_at", "obs_id")
) -> DataFrame:
    """The latest observation of each job; with ``keep`` only the newest that many jobs."""
    rest = [c for c in observations.columns if c not in (*order, "job_id")]
    latest = (
        observations.groupBy("job_id")
        .agg(F.max(F.struct(*order, *rest)).alias("last"))
        .select("job_id", "last.*")
        .select(*observations.columns)
    )
    return latest if keep is None else latest.orderBy(*[F.desc(c) for c in order]).limit(keep)


def instant(text: Column) -> Column:
    """An ISO text as a timestamp; a text without zone is UTC whatever the session's zone, an unreadable one null."""
    text = F.trim(text)
    zoned = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(
        text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), text
    )
    return F.coalesce(zoned, F.concat(text, F.lit("Z"))).try_cast("timestamp")


def recent_runs(latest: DataFrame) -> DataFrame:
    """``latest`` with ``started``: start time, else creation time; newest first, unreadable times last.

    ``started_text`` shows the time as given, in its own zone. ``last_known`` falls back to the time the job was seen,
    as the search for the last job does.
    """
    # A job with a start text is dated by it alone, even when it cannot be read.
    dated = F.coalesce(F.nullif("start_time", F.lit("")), F.nullif("created_at", F.lit("")))
    shown = F.when(instant(dated).isNotNull(), dated.try_cast("timestamp_ntz"))
    return latest.withColumns(
        {
            "started": instant(dated),
            "started_text": F.coalesce(F.date_format(shown, "yyyy-MMM-dd HH:mm"), F.lit("-")),
            "last_known": F.coalesce(instant(dated), F.col("seen_at").cast("timestamp")),
        }
    ).orderBy(F.desc_nulls_last("started"), "job_id")


def last_job(latest: DataFrame) -> DataFrame:
    """The one job most recently started, created or, failing that, seen."""
    return recent_runs(latest).orderBy(F.desc_nulls_last("last_known"), "job_id").limit(1)


def run_status(df: DataFrame) -> DataFrame:
    """``df`` with ``status`` (upper case, UNKNOWN if none), ``status_text``, ``is_terminal``, ``stops_monitor``.

    A job without a state is not terminal (it may be asked again), but there is nothing to monitor.
    """
    status = F.upper(F.coalesce(F.nullif("state", F.lit("")), F.lit("UNKNOWN")))
    given = F.coalesce("state", F.lit(""))
    plain = F.replace(F.lower(given), F.lit(":"), F.lit(""))
    text = (
        F.when(status == "SUCCEEDED", F.lit(f"{DONE} Success"))
        .when(status == "FAILED", F.lit(f"{BROKEN} Failed"))
        .when(status == "RUNNING", F.lit(f"{OPEN} Running"))
        .otherwise(F.concat(F.lit(f"{OPEN} "), F.initcap(status)))
    )
    return df.withColumns(
        {
            "status": status,
            "status_text": text,
            "is_terminal": plain.isin(TERMINAL_STATES),
            "stops_monitor": plain.isin(MONITOR_STOPS) | (given == ""),
        }
    )


def duration_text(seconds: Column) -> Column:
    """``14m 22s``, or ``22s`` below a minute."""
    minutes, rest = F.floor(seconds / 60), F.pmod(seconds, F.lit(60))
    tail = F.concat(rest.cast("string"), F.lit("s"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), tail)).otherwise(tail)


def run_duration(df: DataFrame, start: str = "start_time", end: str = "end_at") -> DataFrame:
    """``df`` with ``seconds, minutes, rest_seconds, duration`` between start and end, null if either is missing."""
    seconds = F.timestamp_diff("SECOND", instant(F.col(start).cast("string")), instant(F.col(end).cast("string")))
    return df.withColumns(
        {
            "seconds": seconds,
            "minutes": F.floor(seconds / 60),
            "rest_seconds": F.pmod(seconds, F.lit(60)),
            "duration": duration_text(seconds),
        }
    )


def milliseconds_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_text`` for durations in milliseconds."""
    whole = {f"{c}_text": duration_text(F.floor(F.col(c) / 1000)) for c in columns}
    return df.withColumns(whole)


def run_totals(latest: DataFrame) -> DataFrame:
    """``jobs, total_records, total_credits`` and how many jobs report each."""
    return latest.agg(
        F.count("*").alias("jobs"),
        F.count("record_count").alias("jobs_with_records"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
        F.count("credits").alias("jobs_with_credits"),
        F.coalesce(F.sum("credits"), F.lit(0.0)).alias("total_credits"),
    )


def run_cells(latest: DataFrame) -> DataFrame:
    """``latest`` with ``records_text`` and ``credits_text``, "-" where nothing is known."""
    return latest.withColumns(
        {
            "records_text": F.coalesce(F.format_number("record_count", 0), F.lit("-")),
            "credits_text": F.coalesce(F.col("credits").cast("string"), F.lit("-")),
        }
    )


def lookup_runs(latest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``job_id``, ``run_id``, either null) with ``found_run_id`` and ``found_job_id``.

    A run id that several jobs carry gives the job seen last.
    """
    by_job = latest.select("job_id", F.col("run_id").alias("found_run_id"))
    by_run = (
        latest.filter("run_id IS NOT NULL")
        .groupBy("run_id")
        .agg(F.max(F.struct("seen_at", "job_id")).getField("job_id").alias("found_job_id"))
    )
    return join_by_key(join_by_key(wanted, by_job, ["job_id"], "left"), by_run, ["run_id"], "left")


TASK_SCHEMA = (
    "array<struct<task_key: string, state: struct<life_cycle_state: string, result_state: string>, "
    "start_time: bigint, setup_duration: bigint, execution_duration: bigint, cleanup_duration: bigint>>"
)


def run_tasks(df: DataFrame, tasks: str = "tasks") -> DataFrame:
    """One line per task of a run (``run_id`` and the nested ``tasks``); a run without tasks keeps one line."""
    return df.select("run_id", F.explode_outer(tasks).alias("task")).select(
        "run_id",
        "task.task_key",
        F.col("task.state.life_cycle_state").alias("state"),
        F.col("task.state.result_state").alias("result_state"),
        "task.start_time",
        "task.setup_duration",
        "task.execution_duration",
        "task.cleanup_duration",
    )
