"""Missing values, features and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import CTES, cte, entry, twin
from trajecta.functions.numeric import rounded
from trajecta.operators import features as ft
from trajecta.operators import impute as im

cte("gap_rates", ("gappy_cells",), """
  SELECT batch_id, variable, count(*) AS n_total, count(*) - count(value) AS n_missing,
    (count(*) - count(value)) / count(*)::DOUBLE AS rate FROM gappy_cells GROUP BY ALL""")
cte("gap_summary", ("gap_rates",), """
  SELECT batch_id, max(rate) AS max_missing_rate, avg(rate) AS mean_missing_rate,
    CAST(sum(n_missing) AS BIGINT) AS n_missing_cells, CAST(sum(n_total) AS BIGINT) AS n_total_cells,
    CASE WHEN max(rate) <= 0.1 THEN 'High' WHEN max(rate) <= 0.3 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM gap_rates GROUP BY batch_id""")


@entry("missing_summary", twin("""
  SELECT * REPLACE (round(max_missing_rate, 6) AS max_missing_rate,
    round(mean_missing_rate, 6) AS mean_missing_rate) FROM gap_summary""", "gap_summary"))
def missing_summary(spark, sf_dir):
    out = im.missing_summary(fx.gappy_readings(spark, sf_dir), fx.VARIABLES)
    return rounded(out, 6, "max_missing_rate", "mean_missing_rate")


@entry("confidence_tiers", twin("""
  SELECT confidence, count(*) AS n_batches FROM gap_summary GROUP BY confidence""", "gap_summary"))
def confidence_tiers(spark, sf_dir):
    return im.confidence_counts(im.missing_summary(fx.gappy_readings(spark, sf_dir), fx.VARIABLES))


@entry("least_certain_batches", twin("""
  SELECT batch_id, round(max_missing_rate, 6) AS max_missing_rate FROM gap_summary
  WHERE confidence = 'Low' ORDER BY gap_summary.max_missing_rate DESC, batch_id LIMIT 8""", "gap_summary"))
def least_certain_batches(spark, sf_dir):
    summary = im.missing_summary(fx.gappy_readings(spark, sf_dir), fx.VARIABLES)
    return rounded(im.least_certain(summary, first=8), 6, "max_missing_rate")


@entry("global_medians", twin("""
  SELECT variable, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS median
  FROM gappy_cells GROUP BY variable""", "gappy_cells"))
def global_medians(spark, sf_dir):
    return rounded(im.global_medians(fx.gappy_readings(spark, sf_dir), fx.VARIABLES), 6, "median")


cte("sparse_methods", ("sparse_cells",), """
  SELECT batch_id, variable, n_missing, CASE
      WHEN n >= 4 THEN 'cubic' || CASE WHEN a > t0 OR b < t1 THEN '+edge-fill' ELSE '' END
      WHEN n >= 2 THEN 'linear' WHEN n = 1 THEN 'single-point-constant' ELSE 'global-median' END AS method
  FROM (SELECT batch_id, variable, count(value) AS n, count(*) - count(value) AS n_missing,
    min(time_index) AS t0, max(time_index) AS t1, min(time_index) FILTER (value IS NOT NULL) AS a,
    max(time_index) FILTER (value IS NOT NULL) AS b FROM sparse_cells GROUP BY batch_id, variable)
  WHERE n_missing > 0""")


@entry("imputation_methods", twin("SELECT * FROM sparse_methods", "sparse_methods"))
def imputation_methods(spark, sf_dir):
    return im.methods(fx.sparse_readings(spark, sf_dir), fx.KINDS)


@entry("imputation_method_counts", twin("""
  SELECT method, count(*) AS n_series FROM sparse_methods GROUP BY method""", "sparse_methods"))
def imputation_method_counts(spark, sf_dir):
    return im.method_counts(im.methods(fx.sparse_readings(spark, sf_dir), fx.KINDS))


@entry("imputed_share", twin("""
  SELECT CAST(sum(n_missing) AS BIGINT) AS imputed_cells, CAST(sum(n_total) AS BIGINT) AS total_cells,
    round(100.0::DOUBLE * sum(n_missing) / sum(n_total), 6) AS imputed_pct FROM gap_rates""", "gap_rates"))
def imputed_share(spark, sf_dir):
    return rounded(im.imputed_share(fx.gappy_readings(spark, sf_dir), fx.VARIABLES), 6, "imputed_pct")


def linear_sql(cells: str) -> str:
    """Nearest valid neighbours by position, then a straight line between them."""
    return f"""
  SELECT batch_id, time_index, variable,
    coalesce(value, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v1, v0, median) AS value
  FROM (
    SELECT *, last_value(value IGNORE NULLS) OVER back AS v0,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS p0,
      first_value(value IGNORE NULLS) OVER ahead AS v1,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS p1
    FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, variable ORDER BY time_index) AS pos FROM {cells})
    WINDOW back AS (PARTITION BY batch_id, variable ORDER BY pos ROWS UNBOUNDED PRECEDING),
      ahead AS (PARTITION BY batch_id, variable ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  JOIN (SELECT variable, coalesce(quantile_cont(value, 0.5), 0) AS median FROM {cells} GROUP BY variable)
    USING (variable)"""


cte("gappy_linear", ("gappy_cells",), linear_sql("gappy_cells"))
cte("sparse_linear", ("sparse_cells",), linear_sql("sparse_cells"))


@entry("linear_fill", twin("""
  SELECT batch_id, CAST(time_index AS BIGINT) AS time_index, variable, round(value, 8) AS value
  FROM gappy_linear""", "gappy_linear"))
def linear_fill(spark, sf_dir):
    """Scattered gaps, ends, and series without any point (global median)."""
    filled = im.impute(fx.gappy_readings(spark, sf_dir), fx.VARIABLES, cubic=False)
    return rounded(filled.unpivot(["batch_id", "time_index"], fx.VARIABLES, "variable", "value"),
                   8, "value").withColumn("time_index", F.col("time_index").cast("long"))


@entry("linear_fill_sparse", twin("""
  SELECT batch_id, CAST(time_index AS BIGINT) AS time_index, variable, round(value, 8) AS value
  FROM sparse_linear""", "sparse_linear"))
def linear_fill_sparse(spark, sf_dir):
    filled = im.impute(fx.sparse_readings(spark, sf_dir), fx.KINDS, cubic=False)
    return rounded(filled.unpivot(["batch_id", "time_index"], fx.KINDS, "variable", "value"),
                   8, "value").withColumn("time_index", F.col("time_index").cast("long"))


cte("sparse_places", ("sparse_cells",), """
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER w AS a,
    first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER v AS b,
    last_value(value IGNORE NULLS) OVER w AS va, first_value(value IGNORE NULLS) OVER v AS vb,
    count(value) OVER (PARTITION BY batch_id, variable) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, variable ORDER BY time_index) - 1 AS p FROM sparse_cells)
  WINDOW w AS (PARTITION BY batch_id, variable ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    v AS (PARTITION BY batch_id, variable ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
cte("spline_knots", ("sparse_places",), """
  SELECT batch_id, variable, k, p, n, lead(p) OVER w - p AS h, (lead(value) OVER w - value) / (lead(p) OVER w - p) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, variable ORDER BY p) - 1 AS k
    FROM sparse_places WHERE value IS NOT NULL AND n >= 4)
  WINDOW w AS (PARTITION BY batch_id, variable ORDER BY k)""")
# the not-a-knot system, one row per inner knot
cte("spline_rows", ("spline_knots",), """
  SELECT batch_id, variable, k, n, 6 * (s - sa) AS r,
    2 * (ha + h) + CASE WHEN k = 1 THEN ha * (1 + ha / h) ELSE 0 END
      + CASE WHEN k = n - 2 THEN h * (1 + h / ha) ELSE 0 END AS diag,
    ha - CASE WHEN k = n - 2 THEN h * h / ha ELSE 0 END AS low,
    CASE WHEN k = n - 2 THEN 0 ELSE h - CASE WHEN k = 1 THEN ha * ha / h ELSE 0 END END AS up
  FROM (SELECT *, (lag(h) OVER w)::DOUBLE AS ha, lag(s) OVER w AS sa FROM spline_knots
    WINDOW w AS (PARTITION BY batch_id, variable ORDER BY k))
  WHERE k BETWEEN 1 AND n - 2""")
cte("spline_forward", ("spline_rows",), """
  SELECT batch_id, variable, k, n, diag AS d, r, up FROM spline_rows WHERE k = 1
  UNION ALL
  SELECT t.batch_id, t.variable, t.k, t.n, t.diag - t.low / f.d * f.up, t.r - t.low / f.d * f.r, t.up
  FROM spline_forward f JOIN spline_rows t ON t.batch_id = f.batch_id AND t.variable = f.variable AND t.k = f.k + 1""")
cte("spline_back", ("spline_forward",), """
  SELECT batch_id, variable, k, r / d AS m FROM spline_forward WHERE k = n - 2
  UNION ALL
  SELECT t.batch_id, t.variable, t.k, (t.r - t.up * b.m) / t.d
  FROM spline_back b JOIN spline_forward t ON t.batch_id = b.batch_id AND t.variable = b.variable AND t.k = b.k - 1""")
cte("spline_bends", ("spline_back", "spline_knots"), """
  SELECT batch_id, variable, p, CASE WHEN k = 0 THEN m1 * (1 + h / h1) - m2 * h / h1
    WHEN k = n - 1 THEN l1 * (1 + g1 / g2) - l2 * g1 / g2 ELSE m END AS m
  FROM (SELECT q.*, b.m, lead(b.m) OVER w AS m1, lead(b.m, 2) OVER w AS m2, lag(b.m) OVER w AS l1,
      lag(b.m, 2) OVER w AS l2, lead(h) OVER w AS h1, lag(h) OVER w AS g1, lag(h, 2) OVER w AS g2
    FROM spline_knots q LEFT JOIN spline_back b USING (batch_id, variable, k)
    WINDOW w AS (PARTITION BY batch_id, variable ORDER BY k))""")


@entry("adaptive_fill", twin("""
  SELECT s.batch_id, s.time_index, s.variable, round(CASE
    WHEN s.value IS NOT NULL THEN s.value
    WHEN a IS NULL AND b IS NULL THEN (SELECT coalesce(quantile_cont(value, 0.5), 0) FROM sparse_cells c
      WHERE c.variable = s.variable)
    WHEN a IS NULL THEN vb WHEN b IS NULL THEN va
    WHEN n < 4 THEN va + (vb - va) * (s.p - a) / (b - a)
    ELSE va * (b - s.p) / (b - a) + vb * (s.p - a) / (b - a) + (
      (pow((b - s.p) / (b - a)::DOUBLE, 3) - (b - s.p) / (b - a)::DOUBLE) * x.m
      + (pow((s.p - a) / (b - a)::DOUBLE, 3) - (s.p - a) / (b - a)::DOUBLE) * y.m) * (b - a) * (b - a) / 6 END, 4) AS value
  FROM sparse_places s
  LEFT JOIN spline_bends x ON x.batch_id = s.batch_id AND x.variable = s.variable AND x.p = s.a
  LEFT JOIN spline_bends y ON y.batch_id = s.batch_id AND y.variable = s.variable AND y.p = s.b""",
    "spline_bends", recursive=True))
def adaptive_fill(spark, sf_dir):
    """The full treatment: cubic, linear, constant, median, edges."""
    filled = im.impute(fx.sparse_readings(spark, sf_dir), fx.KINDS)
    return rounded(filled.unpivot(["batch_id", "time_index"], fx.KINDS, "variable", "value"), 4, "value")


cte("holes", ("aligned",), """
  SELECT * REPLACE (CASE WHEN (CAST(batch_id AS BIGINT) * 31 + step) % 11 = 0
      OR (variable = 'tax' AND step = 7) THEN NULL ELSE value END AS value) FROM aligned""")


@entry("matrix_fill", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    round(coalesce(value, avg(value) OVER (PARTITION BY variable, step), 0), 5) AS value,
    value IS NULL AS was_missing FROM holes""", "holes"))
def matrix_fill(spark, sf_dir):
    hole = ((F.col("batch_id").cast("long") * 31 + F.col("step")) % 11 == 0) | (
        (F.col("variable") == "tax") & (F.col("step") == 7))
    runs = fx.aligned(spark, sf_dir).withColumn("value", F.when(~hole, F.col("value")))
    return rounded(rounded(im.fill_matrix(runs), 5, "value"), 6, "time_norm")


cte("basic", ("reading_cells",), CTES["features"][1].replace("round(value, 9) AS value", "value"))


@entry("basic_features", twin("""
  SELECT batch_id, feature, round(value, 8) AS value FROM basic""", "basic"))
def basic_features(spark, sf_dir):
    return rounded(ft.basic_features(fx.readings(spark, sf_dir), fx.VARIABLES), 8, "value")


cte("rich_wide", ("reading_cells",), """
  SELECT batch_id, variable, avg(v) AS mean,
    CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS std,
    coalesce(avg(v) FILTER (t <= 0.33), avg(v)) AS startup_mean,
    coalesce(avg(v) FILTER (t > 0.33 AND t <= 0.67), avg(v)) AS reaction_mean,
    coalesce(avg(v) FILTER (t > 0.67), avg(v)) AS harvest_mean,
    CASE WHEN count(*) >= 3 THEN regr_slope(v, t) / CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END
      ELSE 0 END AS slope,
    coalesce(sum((t - pt) * (v + pv) / 2), avg(v)) AS auc_norm
  FROM (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM (
      SELECT batch_id, variable, value AS v, (time_index - min(time_index) OVER (PARTITION BY batch_id))
        / (max(time_index) OVER (PARTITION BY batch_id) - min(time_index) OVER (PARTITION BY batch_id)) AS t
      FROM reading_cells) WINDOW w AS (PARTITION BY batch_id, variable ORDER BY t))
  GROUP BY batch_id, variable""")
cte("rich", ("rich_wide",), """
  SELECT batch_id, variable || '_' || stat AS feature, value FROM rich_wide
  UNPIVOT (value FOR stat IN (mean, std, startup_mean, reaction_mean, harvest_mean, slope, auc_norm))""")


@entry("rich_features", twin("""
  SELECT batch_id, feature, round(value, 8) AS value FROM rich""", "rich"))
def rich_features(spark, sf_dir):
    return rounded(ft.rich_features(fx.readings(spark, sf_dir), fx.VARIABLES), 8, "value")


cte("event_rich_wide", ("event_cells",), CTES["rich_wide"][1].replace("reading_cells", "event_cells"))
cte("event_rich", ("event_rich_wide",), CTES["rich"][1].replace("rich_wide", "event_rich_wide"))


@entry("yield_outliers", twin("""
  SELECT batch_id, yield, CASE WHEN yield < q1 - 2.5 * (q3 - q1) THEN 'low'
      WHEN yield > q3 + 2.5 * (q3 - q1) THEN 'high' END AS flag,
    CASE WHEN yield < q1 - 0.5 * (q3 - q1) THEN 'low'
      WHEN yield > q3 + 0.5 * (q3 - q1) THEN 'high' END AS near_flag
  FROM batches, (SELECT quantile_cont(yield, 0.25) AS q1, quantile_cont(yield, 0.75) AS q3 FROM batches)""",
    "batches"))
def yield_outliers(spark, sf_dir):
    runs = fx.batches(spark, sf_dir)
    near = ft.yield_flags(runs, 0.5).select("batch_id", F.col("flag").alias("near_flag"))
    return ft.yield_flags(runs).join(near, "batch_id")


@entry("process_outliers", twin("""
  SELECT batch_id, count(*) FILTER (z > 3) AS n_extreme, round(max(z), 6) AS worst_z, max(n) AS n_batches
  FROM (SELECT batch_id, abs(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0
      THEN stddev_pop(value) OVER w ELSE 1 END AS z, count(*) OVER w AS n
    FROM rich WINDOW w AS (PARTITION BY feature)) GROUP BY batch_id""", "rich"))
def process_outliers(spark, sf_dir):
    found = ft.rich_features(fx.readings(spark, sf_dir), fx.VARIABLES)
    return rounded(ft.process_scores(found), 6, "worst_z")


@entry("outlier_batches", twin("""
  SELECT batch_id, string_agg(why, ', ' ORDER BY why) AS reasons FROM (
    SELECT batch_id, 'process' AS why FROM (SELECT batch_id, count(*) FILTER (z > 3) AS k, max(n) AS n
      FROM (SELECT batch_id, abs(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0
          THEN stddev_pop(value) OVER w ELSE 1 END AS z, count(*) OVER w AS n
        FROM event_rich WINDOW w AS (PARTITION BY feature)) GROUP BY batch_id) WHERE k >= 3 AND n >= 5
    UNION ALL SELECT batch_id, 'yield ' || CASE WHEN yield < q1 - 2.5 * (q3 - q1) THEN 'low' ELSE 'high' END
    FROM event_batches, (SELECT quantile_cont(yield, 0.25) AS q1, quantile_cont(yield, 0.75) AS q3 FROM event_batches)
    WHERE yield < q1 - 2.5 * (q3 - q1) OR yield > q3 + 2.5 * (q3 - q1))
  GROUP BY batch_id""", "event_batches", "event_rich"))
def outlier_batches(spark, sf_dir):
    found = ft.rich_features(fx.event_readings(spark, sf_dir), ["value"])
    return ft.all_outliers(fx.event_batches(spark, sf_dir), found)


@entry("outlier_summary", twin("""
  SELECT lo AS n_low, hi AS n_high, pr AS n_process, lo + hi + pr > 0 AS any_outlier
  FROM (SELECT count(*) FILTER (yield < q1 - 2.5 * (q3 - q1)) AS lo,
      count(*) FILTER (yield > q3 + 2.5 * (q3 - q1)) AS hi
    FROM event_batches, (SELECT quantile_cont(yield, 0.25) AS q1, quantile_cont(yield, 0.75) AS q3
      FROM event_batches)),
    (SELECT count(*) AS pr FROM (SELECT batch_id, count(*) FILTER (z > 3) AS k, max(n) AS n
      FROM (SELECT batch_id, abs(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0
          THEN stddev_pop(value) OVER w ELSE 1 END AS z, count(*) OVER w AS n
        FROM event_rich WINDOW w AS (PARTITION BY feature)) GROUP BY batch_id) WHERE k >= 3 AND n >= 5)""",
    "event_batches", "event_rich"))
def outlier_summary(spark, sf_dir):
    found = ft.rich_features(fx.event_readings(spark, sf_dir), ["value"])
    return ft.outlier_counts(fx.event_batches(spark, sf_dir), found)
