"""Streams over the given tables, processed with ``availableNow``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import monitoring as mon
from checks.base import cte, entry, twin
from trajecta.functions.numeric import rounded
from trajecta.session import scratch_path
from trajecta.streaming import online, sources, windows


def _event_stream(spark, sf_dir, copies: int = 1, close: timedelta | None = None):
    """The events as a file stream; ``copies`` repeats every reading.  With ``close`` a last
    file moves the watermark that far past the last event."""
    static = fx.table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").cast("string").alias("batch_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("variable"), "value")
    path = scratch_path(spark, "events")
    for _ in range(copies):
        static.write.mode("append").parquet(path)
    if close is not None:
        sources.heartbeat(spark, path, static.schema, static.agg(F.max("ts")).first()[0] + close)
    return sources.reading_stream(spark, path, static.schema)


@entry("deduplicated_stream", """
  SELECT event_type AS variable, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def deduplicated_stream(spark, sf_dir):
    """Every reading arrives twice; one stays."""
    stream = _event_stream(spark, sf_dir, copies=2)
    once = sources.deduplicated(stream, ["event_id", "batch_id", "ts", "variable"])
    return sources.run_to_table(once, "once").groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def window_sql(size_us: int, slide_us: int) -> str:
    return f"""
  SELECT s AS window_start, s + {size_us} AS window_end, event_type AS variable, count(value) AS n,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
  FROM (SELECT event_type, value, unnest(generate_series(
      (epoch_us(ts) // {slide_us} - {size_us // slide_us - 1}) * {slide_us}, epoch_us(ts) // {slide_us} * {slide_us},
      {slide_us})) AS s FROM events) GROUP BY s, event_type"""


def _micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


HOUR = 3_600_000_000


def _week():
    return F.date_format(F.date_trunc("week", F.col("window_start")), "yyyy-MM-dd")


@entry("tumbling_summary", window_sql(6 * HOUR, 6 * HOUR))
def tumbling_summary(spark, sf_dir):
    out = windows.window_summary(_event_stream(spark, sf_dir), "6 hours")
    table = sources.upsert_now(out, "tumbling", ["window_start", "window_end", "variable"], part=_week())
    return rounded(_micros(table, "window_start", "window_end"), 6, "mean", "std")


@entry("sliding_summary", window_sql(12 * HOUR, 4 * HOUR))
def sliding_summary(spark, sf_dir):
    out = windows.window_summary(_event_stream(spark, sf_dir), "12 hours", "4 hours")
    table = sources.upsert_now(out, "sliding", ["window_start", "window_end", "variable"], part=_week())
    return rounded(_micros(table, "window_start", "window_end"), 6, "mean", "std")


@entry("run_sessions", f"""
  SELECT batch_id, min("at") AS session_start, max("at") + {6 * HOUR} AS session_end, count(*) AS n,
    round(avg(value), 6) AS mean
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY batch_id ORDER BY "at") AS g FROM (
    SELECT CAST(user_id AS VARCHAR) AS batch_id, epoch_us(ts) AS "at", value,
      CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < {6 * HOUR} THEN 0 ELSE 1 END AS fresh
    FROM events))
  GROUP BY batch_id, g""")
def run_sessions(spark, sf_dir):
    """All sessions, in append mode; a pause of six hours ends one."""
    return rounded(_micros(_sessions(spark, sf_dir), "session_start", "session_end"), 6, "mean")


def _sessions(spark, sf_dir, progress: list | None = None):
    out = windows.run_sessions(_event_stream(spark, sf_dir, close=timedelta(hours=9)), "6 hours")
    return sources.run_to_table(out, "sessions", progress=progress)


def _live_runs(spark, sf_dir):
    """Start and duration of every user's run."""
    span = fx.event_readings(spark, sf_dir).groupBy("batch_id").agg(
        F.min("time_index").alias("start"), (F.max("time_index") - F.min("time_index")).alias("duration"))
    return span.where("duration > 0")


def _reading_files(spark, sf_dir):
    """Long readings as six files by time, in any order inside a file; a last file closes the clock."""
    static = fx.event_readings(spark, sf_dir).withColumn("variable", F.lit("value")).withColumn(
        "ts", F.timestamp_micros(F.col("time_index").cast("long")))
    path = scratch_path(spark, "readings")
    first, last, end = static.agg(F.min("time_index"), F.max("time_index"), F.max("ts")).first()
    part = F.least(F.floor((F.col("time_index") - first) / (last - first) * 6), F.lit(5))
    for k in range(6):  # one after the other, as files are read in the order of their times
        static.where(part == k).coalesce(1).write.mode("append").parquet(path)
    sources.heartbeat(spark, path, static.schema, end + timedelta(days=1))
    return sources.reading_stream(spark, path, static.schema, files_per_trigger=2)


@entry("online_alignment", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(value, 6) AS value FROM event_aligned""", "event_aligned"))
def online_alignment(spark, sf_dir):
    """Steps in append mode over several micro-batches, as their segments close."""
    return rounded(_live_steps(spark, sf_dir), 6, "time_norm", "value")


def _live_steps(spark, sf_dir, progress: list | None = None):
    readings, runs = _reading_files(spark, sf_dir), _live_runs(spark, sf_dir)
    steps = online.aligned_stream(readings, runs, delay="1 hour", unit_ms=0.001)
    return sources.run_to_table(steps, "live-steps", progress=progress)


@entry("online_cells", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(value, 6) AS value FROM event_aligned""", "event_aligned"))
def online_cells(spark, sf_dir):
    """Cells updated over several micro-batches, however late, then the steps they close."""
    cells = online.cell_stream(_reading_files(spark, sf_dir), _live_runs(spark, sf_dir))
    table = sources.upsert_now(cells, "cells", ["batch_id", "variable", "cell"])
    return rounded(online.steps_of_cells(table), 6, "time_norm", "value")


def _watched(spark, sf_dir, disorder: bool = False, progress: list | None = None):
    """The monitor over the aligned steps in files by step; with ``disorder``
    every reading comes twice, in files that mix all steps."""
    runs = fx.aligned(spark, sf_dir).withColumn("ts", F.timestamp_seconds(946_684_800 + F.col("step") * 60))
    path = scratch_path(spark, "aligned")
    if disorder:
        runs.union(runs).repartition(5, F.xxhash64("batch_id", "variable", "step", F.rand(3))).write.parquet(path)
    else:
        runs.repartitionByRange(4, "step").write.parquet(path)
    sources.heartbeat(spark, path, runs.schema, datetime(2000, 1, 2), variable=fx.VARIABLES[0], step=-1)
    stream = sources.reading_stream(spark, path, runs.schema, files_per_trigger=1)
    out = online.monitor_stream(
        stream, mon.model_terms(spark, sf_dir), mon.model_meta(spark, sf_dir), fx.VARIABLES, mon.COMPONENTS)
    return sources.run_to_table(out, "watched", progress=progress)


@entry("readings_outside_schedule", """
  SELECT batch_id, CAST(time_index AS BIGINT) AS "at", round(value, 6) AS value FROM (
    SELECT CAST(user_id AS VARCHAR) AS batch_id, CAST(epoch_us(ts) AS DOUBLE) AS time_index, value,
      min(CAST(epoch_us(ts) AS DOUBLE)) OVER w AS a, max(CAST(epoch_us(ts) AS DOUBLE)) OVER w AS b
    FROM events WINDOW w AS (PARTITION BY user_id))
  WHERE b > a AND time_index > a + (b - a) * 0.75""")
def readings_outside_schedule(spark, sf_dir):
    """What comes after the expected end, with the end set to three quarters."""
    runs = _live_runs(spark, sf_dir).withColumn("duration", F.col("duration") * 0.75)
    late = online.outside_schedule(fx.event_readings(spark, sf_dir), runs)
    return late.select("batch_id", F.col("time_index").cast("long").alias("at"), F.round("value", 6).alias("value"))


@entry("online_monitor", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, round(t2, 5) AS t2, round(spe, 4) AS spe,
    round(predicted_yield, 5) AS predicted_yield FROM steps JOIN forecast_steps USING (batch_id, time_step)""",
    "steps", "forecast_steps"))
def online_monitor(spark, sf_dir):
    """The stream gives the batch result."""
    return _steps(_watched(spark, sf_dir))


def _steps(watched):
    out = watched.where("NOT late AND NOT repeated")
    return rounded(out.select(
        "batch_id", "time_step", F.round("t2", 5).alias("t2"), F.round("spe", 4).alias("spe"), "predicted_yield"),
        5, "predicted_yield")


@entry("online_monitor_disordered", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, round(t2, 5) AS t2, round(spe, 4) AS spe,
    round(predicted_yield, 5) AS predicted_yield FROM steps JOIN forecast_steps USING (batch_id, time_step)""",
    "steps", "forecast_steps"))
def online_monitor_disordered(spark, sf_dir):
    """Repeated and disordered readings leave the result as it is."""
    return _steps(_watched(spark, sf_dir, disorder=True))


@entry("online_asides", twin("""
  SELECT batch_id, variable, CAST(step + 1 AS INTEGER) AS time_step, 1::BIGINT AS n FROM aligned
  WHERE value IS NOT NULL""", "aligned"))
def online_asides(spark, sf_dir):
    """Every second copy of a reading comes out as late or repeated, once."""
    return _watched(spark, sf_dir, disorder=True).where("late OR repeated").groupBy(
        "batch_id", "variable", "time_step").agg(F.count(F.lit(1)).alias("n"))


@entry("online_alarms", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, t2_breach_95, t2_breach_99, spe_breach_95,
    spe_breach_99, t2_sustained, spe_sustained FROM rules""", "rules"))
def online_alarms(spark, sf_dir):
    return _watched(spark, sf_dir).where("NOT late AND NOT repeated").select(
        "batch_id", "time_step", "t2_breach_95", "t2_breach_99", "spe_breach_95", "spe_breach_99",
        "t2_sustained", "spe_sustained")


@entry("upserted_batches", """
  SELECT CAST(user_id AS VARCHAR) AS batch_id, count(*) AS n, round(sum(value), 2) AS total
  FROM events GROUP BY user_id""")
def upserted_batches(spark, sf_dir):
    """Running totals per batch, newest version kept."""
    stream = _reading_files(spark, sf_dir).where("batch_id <> ''")
    totals = stream.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(sources.upsert_now(totals, "totals", ["batch_id"]), 2, "total")
