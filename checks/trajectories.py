"""Alignment, profile and conformance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import entry, twin
from trajecta.functions.numeric import rounded
from trajecta.operators import align as al
from trajecta.operators import label as lb
from trajecta.operators import profile as pf


@entry("quality_labels", twin("SELECT * FROM batches", "batches"))
def quality_labels(spark, sf_dir):
    return fx.batches(spark, sf_dir)


@entry("normalised_time", twin("""
  SELECT batch_id, CAST(time_index AS BIGINT) AS reading,
    round(CASE WHEN t1 > t0 THEN (time_index - t0) / (t1 - t0) ELSE 0 END, 6) AS progress
  FROM readings JOIN (SELECT batch_id, min(time_index) AS t0, max(time_index) AS t1
    FROM readings GROUP BY batch_id) USING (batch_id)""", "readings"))
def normalised_time(spark, sf_dir):
    timed = al.normalise_time(fx.readings(spark, sf_dir), fx.VARIABLES)
    return timed.select(
        "batch_id", F.col("time_index").cast("long").alias("reading"),
        F.round("progress", 6).alias("progress"),
    )


@entry("aligned_runs", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(value, 5) AS value FROM aligned""", "aligned"))
def aligned_runs(spark, sf_dir):
    return rounded(rounded(fx.aligned(spark, sf_dir), 5, "value"), 6, "time_norm")


fx.cte("event_aligned", ("event_cells",), fx.aligned_sql("event_cells"))


@entry("aligned_irregular", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(value, 6) AS value FROM event_aligned""", "event_aligned"))
def aligned_irregular(spark, sf_dir):
    runs = al.align(fx.event_readings(spark, sf_dir), ["value"])
    return rounded(runs, 6, "value", "time_norm")


fx.cte("sparse_aligned", ("sparse_cells",), fx.aligned_sql("sparse_cells"))


@entry("aligned_with_gaps", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(value, 6) AS value FROM sparse_aligned""", "sparse_aligned"))
def aligned_with_gaps(spark, sf_dir):
    runs = al.align(fx.sparse_readings(spark, sf_dir), fx.KINDS)
    return rounded(runs, 6, "value", "time_norm")


@entry("golden_choice", twin("SELECT * REPLACE (CAST(n_golden AS BIGINT) AS n_golden) FROM golden_choice",
                             "golden_choice"))
def golden_choice(spark, sf_dir):
    return lb.choose_golden(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))


@entry("golden_rates", twin("""
  SELECT batch_id, variable, round(rate, 6) AS rate FROM erratic_rates""", "erratic_rates"))
def golden_rates(spark, sf_dir):
    rows = pf.golden_rows(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))
    return pf.erratic_rates(rows).select("batch_id", "variable", F.round("rate", 6).alias("rate"))


PROFILE_COLUMNS = ["mean", "std", "half_width", "upper", "lower", "ci_upper", "ci_lower"]


@entry("golden_profile", twin(f"""
  SELECT variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    {", ".join(f"round({c}, 4) AS {c}" for c in PROFILE_COLUMNS)}, band_source, n_golden,
    round(t_crit, 6) AS t_crit FROM profile""", "profile", recursive=True))
def golden_profile(spark, sf_dir):
    out = rounded(fx.profile(spark, sf_dir), 4, *PROFILE_COLUMNS)
    return rounded(out, 6, "time_norm", "t_crit")


@entry("conformance", twin("""
  SELECT batch_id, round(overall, 1) AS conformance_pct, round(yield, 1) AS yield_pct,
    CASE WHEN round(overall, 1) >= 80 THEN 'good' WHEN round(overall, 1) >= 60 THEN 'watch'
      ELSE 'poor' END AS tier
  FROM conformance LEFT JOIN batches USING (batch_id)""", "conformance", recursive=True))
def conformance(spark, sf_dir):
    runs, labels = fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)
    return pf.conformance_table(labels, runs, fx.profile(spark, sf_dir))
