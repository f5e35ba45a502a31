"""Monitoring, forecasting, warping distances and profile reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import cte, entry, twin
from trajecta.functions.numeric import pearson, rounded
from trajecta.functions.stats import correlation_p
from trajecta.operators import align as al
from trajecta.operators import compare as cp
from trajecta.operators import label as lb
from trajecta.operators import monitor as mo
from trajecta.operators import profile as pf
from trajecta.session import cut_lineage

# ── a model table free of any fit ────────────────────────────────────────────
# Loadings are cosines over the steps (orthonormal by construction), so that the
# scoring algebra is checked apart from the fits.

COMPONENTS = 3
POSITION = {v: i for i, v in enumerate(fx.VARIABLES)}


@fx.stage
def model_terms(spark, sf_dir):
    scale = fx.golden_aligned(spark, sf_dir).groupBy("variable", "step").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    k = len(fx.VARIABLES)
    place = al.variable_order(scale, fx.VARIABLES)
    angle = (F.col("step") + 0.5) / 100.0 * math.pi
    loading = [F.lit(math.sqrt(2.0 / (100 * k))) * F.cos(angle * a) for a in (1, 2, 3)]
    weight = [F.cos(angle * a) * (1 + 0.1 * place) for a in (1, 2, 3)]
    return scale.select(
        "variable", "step", "mu",
        F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(1.0)).alias("sigma"),
        F.array(*loading).alias("loadings"), F.array(*weight).alias("weights"),
        (0.01 * F.sin(F.col("step") + place)).alias("coef"),
    )


@fx.stage
def model_meta(spark, sf_dir):
    good = fx.batches(spark, sf_dir).where("is_golden").select("batch_id")
    cells = mo.scaled_cells(fx.aligned(spark, sf_dir), model_terms(spark, sf_dir)).join(
        good, "batch_id", "left_semi")
    scores = cells.groupBy("batch_id").agg(
        *[F.sum(F.col("z") * F.col("loadings")[a]).alias(f"t{a}") for a in range(COMPONENTS)],
        F.sum(F.col("z") * F.col("z")).alias("q"))
    axes = cut_lineage(scores.agg(
        F.array(*[F.var_samp(f"t{a}") for a in range(COMPONENTS)]).alias("eigenvalues")))
    stats = mo.run_statistics(
        fx.aligned(spark, sf_dir).join(good, "batch_id", "left_semi"),
        model_terms(spark, sf_dir), axes, COMPONENTS)
    intercept = fx.batches(spark, sf_dir).agg(F.avg("yield").alias("intercept"))
    return axes.crossJoin(mo.control_limits(stats)).crossJoin(intercept).withColumn(
        "q", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).withColumn(
        "tt", F.array(F.lit(40.0), F.lit(20.0), F.lit(10.0)))


cte("terms", ("aligned", "batches"), """
  SELECT variable, step, mu, CASE WHEN sigma > 0 THEN sigma ELSE 1 END AS sigma,
    sqrt(2.0::DOUBLE / 400) * cos((step + 0.5) / 100 * pi()) AS p1,
    sqrt(2.0::DOUBLE / 400) * cos((step + 0.5) / 100 * pi() * 2) AS p2,
    sqrt(2.0::DOUBLE / 400) * cos((step + 0.5) / 100 * pi() * 3) AS p3,
    cos((step + 0.5) / 100 * pi()) * (1 + 0.1 * k) AS w1,
    cos((step + 0.5) / 100 * pi() * 2) * (1 + 0.1 * k) AS w2,
    cos((step + 0.5) / 100 * pi() * 3) * (1 + 0.1 * k) AS w3,
    0.01 * sin(step + k) AS coef
  FROM (SELECT variable, step, avg(value) AS mu, stddev_pop(value) AS sigma,
      list_position(['quantity', 'price', 'discount', 'tax'], variable) - 1 AS k
    FROM aligned WHERE batch_id IN (SELECT batch_id FROM batches WHERE is_golden)
    GROUP BY variable, step)""")
cte("zcells", ("terms",), """
  SELECT a.batch_id, a.variable, a.step, (value - mu) / sigma AS z, p1, p2, p3, coef
  FROM aligned a JOIN terms USING (variable, step)""")
cte("run_scores", ("zcells",), """
  SELECT batch_id, sum(z * p1) AS t1, sum(z * p2) AS t2, sum(z * p3) AS t3, sum(z * z) AS q
  FROM zcells GROUP BY batch_id""")
cte("eigen", ("run_scores",), """
  SELECT var_samp(t1) AS l1, var_samp(t2) AS l2, var_samp(t3) AS l3 FROM run_scores
  WHERE batch_id IN (SELECT batch_id FROM batches WHERE is_golden)""")
cte("run_stats", ("eigen",), """
  SELECT batch_id, t1 * t1 / l1 + t2 * t2 / l2 + t3 * t3 / l3 AS hotelling,
    q - t1 * t1 - t2 * t2 - t3 * t3 AS spe FROM run_scores, eigen""")
cte("limits", ("run_stats",), """
  SELECT quantile_cont(hotelling, 0.95) AS t2_95, quantile_cont(hotelling, 0.99) AS t2_99,
    quantile_cont(spe, 0.95) AS spe_95, quantile_cont(spe, 0.99) AS spe_99
  FROM run_stats WHERE batch_id IN (SELECT batch_id FROM batches WHERE is_golden)""")
cte("steps", ("limits",), """
  SELECT batch_id, step + 1 AS time_step, c1 * c1 / l1 + c2 * c2 / l2 + c3 * c3 / l3 AS t2,
    q - c1 * c1 - c2 * c2 - c3 * c3 AS spe FROM (
    SELECT batch_id, step, sum(s1) OVER w AS c1, sum(s2) OVER w AS c2, sum(s3) OVER w AS c3, sum(q) OVER w AS q
    FROM (SELECT batch_id, step, sum(z * p1) AS s1, sum(z * p2) AS s2, sum(z * p3) AS s3, sum(z * z) AS q
      FROM zcells GROUP BY batch_id, step)
    WINDOW w AS (PARTITION BY batch_id ORDER BY step ROWS UNBOUNDED PRECEDING)), eigen""")
cte("breaches", ("steps",), """
  SELECT s.*, t2 > t2_95 AS t2_breach_95, t2 > t2_99 AS t2_breach_99, spe > spe_95 AS spe_breach_95,
    spe > spe_99 AS spe_breach_99 FROM steps s, limits""")


def _model(spark, sf_dir):
    return fx.aligned(spark, sf_dir), model_terms(spark, sf_dir), model_meta(spark, sf_dir)


def steps(spark, sf_dir):
    return mo.monitor_steps(*_model(spark, sf_dir), COMPONENTS)


@entry("cell_scaler", twin("""
  SELECT variable, CAST(step AS INTEGER) AS step, round(mu, 5) AS mu, round(sigma, 5) AS sigma FROM terms""", "terms"))
def cell_scaler(spark, sf_dir):
    from trajecta.operators.linear_models import scaler
    return rounded(scaler(fx.golden_aligned(spark, sf_dir), ["variable", "step"]), 5, "mu", "sigma")


@entry("run_statistics", twin("""
  SELECT batch_id, round(hotelling, 5) AS t2, round(spe, 4) AS spe FROM run_stats""", "run_stats"))
def run_statistics(spark, sf_dir):
    out = mo.run_statistics(*_model(spark, sf_dir), COMPONENTS)
    return rounded(rounded(out, 5, "t2"), 4, "spe")


@entry("control_limits", twin("""
  SELECT round(t2_95, 5) AS t2_95, round(t2_99, 5) AS t2_99, round(spe_95, 4) AS spe_95,
    round(spe_99, 4) AS spe_99 FROM limits""", "limits"))
def control_limits(spark, sf_dir):
    out = model_meta(spark, sf_dir).select("t2_95", "t2_99", "spe_95", "spe_99")
    return rounded(rounded(out, 5, "t2_95", "t2_99"), 4, "spe_95", "spe_99")


@entry("monitor_steps", twin("""
  SELECT * REPLACE (CAST(time_step AS INTEGER) AS time_step, round(t2, 5) AS t2, round(spe, 4) AS spe)
  FROM breaches""", "breaches"))
def monitor_steps(spark, sf_dir):
    return rounded(rounded(steps(spark, sf_dir), 5, "t2"), 4, "spe")


@entry("future_imputed_runs", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step,
    round(CASE WHEN step < 40 THEN value ELSE mu END, 5) AS value FROM aligned JOIN terms USING (variable, step)""",
    "terms"))
def future_imputed_runs(spark, sf_dir):
    runs, terms, _ = _model(spark, sf_dir)
    return rounded(al.impute_future(runs, terms, 40), 5, "value")


def contribution_sql(current: int) -> str:
    """Direct form: squared residual of every cell, future cells included."""
    return f"""
  SELECT batch_id, variable, round(e / sum(e) OVER b * 100, 5) AS contribution,
    CAST(row_number() OVER (PARTITION BY batch_id ORDER BY e DESC, variable) AS INTEGER) AS place
  FROM (SELECT batch_id, variable, sum(pow(z0 - c1 * p1 - c2 * p2 - c3 * p3, 2)) AS e
    FROM (SELECT *, sum(z0 * p1) OVER b AS c1, sum(z0 * p2) OVER b AS c2, sum(z0 * p3) OVER b AS c3
      FROM (SELECT *, CASE WHEN step < {current} THEN z ELSE 0 END AS z0 FROM zcells)
      WINDOW b AS (PARTITION BY batch_id)) GROUP BY batch_id, variable)
  WINDOW b AS (PARTITION BY batch_id)"""


@entry("spe_contributions", twin(contribution_sql(100), "zcells"))
def spe_contributions(spark, sf_dir):
    runs, terms, _ = _model(spark, sf_dir)
    return rounded(mo.contributions(runs, terms, COMPONENTS), 5, "contribution")


@entry("spe_contributions_midway", twin(contribution_sql(60), "zcells"))
def spe_contributions_midway(spark, sf_dir):
    runs, terms, _ = _model(spark, sf_dir)
    return rounded(mo.contributions(runs, terms, COMPONENTS, 60), 5, "contribution")


@entry("spe_contribution_steps", twin("""
  SELECT batch_id, variable, CAST(step + 1 AS INTEGER) AS time_step,
    round((q - 2 * (t1 * s1 + t2 * s2 + t3 * s3) + t1 * t1 * m11 + t2 * t2 * m22 + t3 * t3 * m33
      + 2 * (t1 * t2 * m12 + t1 * t3 * m13 + t2 * t3 * m23)) /
      sum(q - 2 * (t1 * s1 + t2 * s2 + t3 * s3) + t1 * t1 * m11 + t2 * t2 * m22 + t3 * t3 * m33
      + 2 * (t1 * t2 * m12 + t1 * t3 * m13 + t2 * t3 * m23)) OVER (PARTITION BY batch_id, step) * 100, 4) AS contribution
  FROM (SELECT *, sum(s1) OVER x AS t1, sum(s2) OVER x AS t2, sum(s3) OVER x AS t3 FROM (
      SELECT batch_id, variable, step, sum(z * z) OVER w AS q, sum(z * p1) OVER w AS s1,
        sum(z * p2) OVER w AS s2, sum(z * p3) OVER w AS s3 FROM zcells
      WINDOW w AS (PARTITION BY batch_id, variable ORDER BY step ROWS UNBOUNDED PRECEDING))
    WINDOW x AS (PARTITION BY batch_id, step))
  JOIN (SELECT variable, sum(p1 * p1) AS m11, sum(p2 * p2) AS m22, sum(p3 * p3) AS m33, sum(p1 * p2) AS m12,
    sum(p1 * p3) AS m13, sum(p2 * p3) AS m23 FROM terms GROUP BY variable) USING (variable)""", "zcells"))
def spe_contribution_steps(spark, sf_dir):
    runs, terms, _ = _model(spark, sf_dir)
    return rounded(mo.contribution_trajectory(runs, terms, COMPONENTS), 4, "contribution")


cte("rules", ("breaches",), """
  SELECT *, coalesce(sum(t2_breach_95::INT) OVER w = 3, false) AS t2_sustained,
    coalesce(sum(spe_breach_95::INT) OVER w = 3, false) AS spe_sustained FROM breaches
  WINDOW w AS (PARTITION BY batch_id ORDER BY time_step ROWS 2 PRECEDING)""")


@entry("alarm_states", twin("""
  SELECT r.batch_id, CAST(time_step AS INTEGER) AS time_step,
    CASE WHEN t2_breach_99 OR spe_breach_99 THEN 'ALARM' WHEN t2_breach_95 OR spe_breach_95 THEN 'WARNING'
      ELSE 'IN CONTROL' END AS state,
    concat_ws(' | ', CASE WHEN t2_breach_99 THEN 'T2 > 99% limit' END,
      CASE WHEN spe_breach_99 THEN 'SPE > 99% limit' END) AS message, m.t2_sustained, m.spe_sustained
  FROM rules r JOIN (SELECT batch_id, bool_or(t2_sustained) AS t2_sustained, bool_or(spe_sustained) AS spe_sustained
    FROM rules WHERE time_step <= 75 GROUP BY batch_id) m ON m.batch_id = r.batch_id
  WHERE time_step = 75""", "rules"))
def alarm_states(spark, sf_dir):
    return mo.alarm_states(steps(spark, sf_dir), 75)


@entry("run_rule", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, t2_sustained, spe_sustained FROM rules""", "rules"))
def run_rule(spark, sf_dir):
    return mo.with_run_rule(steps(spark, sf_dir)).select(
        "batch_id", "time_step", "t2_sustained", "spe_sustained")


@entry("breach_streaks", twin("""
  SELECT batch_id, coalesce(t2_streak, 0) AS t2_streak, coalesce(spe_streak, 0) AS spe_streak
  FROM (SELECT DISTINCT batch_id FROM breaches)
  LEFT JOIN (SELECT batch_id, max(k) AS t2_streak FROM (SELECT batch_id, count(*) AS k FROM (
    SELECT batch_id, time_step - row_number() OVER (PARTITION BY batch_id ORDER BY time_step) AS g
    FROM breaches WHERE t2_breach_95) GROUP BY batch_id, g) GROUP BY batch_id) USING (batch_id)
  LEFT JOIN (SELECT batch_id, max(k) AS spe_streak FROM (SELECT batch_id, count(*) AS k FROM (
    SELECT batch_id, time_step - row_number() OVER (PARTITION BY batch_id ORDER BY time_step) AS g
    FROM breaches WHERE spe_breach_95) GROUP BY batch_id, g) GROUP BY batch_id) USING (batch_id)""", "breaches"))
def breach_streaks(spark, sf_dir):
    return mo.longest_streaks(steps(spark, sf_dir))


@entry("fleet_view", twin("""
  SELECT batch_id, round(hotelling, 5) AS t2, round(spe, 4) AS spe, yield, quality,
    CASE WHEN hotelling > t2_95 AND spe > spe_95 THEN 'severe deviation'
      WHEN hotelling > t2_95 THEN 'known-direction shift' WHEN spe > spe_95 THEN 'novel pattern'
      ELSE 'normal' END AS quadrant
  FROM run_stats JOIN batches USING (batch_id), limits""", "limits"))
def fleet_view(spark, sf_dir):
    runs, terms, meta = _model(spark, sf_dir)
    stats = mo.run_statistics(runs, terms, meta, COMPONENTS)
    return rounded(rounded(mo.fleet_view(stats, meta, fx.batches(spark, sf_dir)), 5, "t2"), 4, "spe")


cte("forecast_steps", ("zcells",), """
  SELECT batch_id, step + 1 AS time_step, (SELECT avg(yield) FROM batches) + sum(f) OVER (
    PARTITION BY batch_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS predicted_yield
  FROM (SELECT batch_id, step, sum(z * coef) AS f FROM zcells GROUP BY batch_id, step)""")


@entry("forecast", twin("""
  SELECT batch_id, round(predicted_yield, 5) AS predicted_yield FROM forecast_steps WHERE time_step = 100""",
    "forecast_steps"))
def forecast(spark, sf_dir):
    return rounded(mo.forecast(*_model(spark, sf_dir)), 5, "predicted_yield")


@entry("forecast_steps", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, round(predicted_yield, 5) AS predicted_yield
  FROM forecast_steps""", "forecast_steps"))
def forecast_steps(spark, sf_dir):
    return rounded(mo.forecast_steps(*_model(spark, sf_dir)), 5, "predicted_yield")


@entry("forecast_status", twin("""
  SELECT batch_id, CAST(time_step AS INTEGER) AS time_step, round(predicted_yield, 5) AS predicted_yield,
    cut AS golden_threshold, round(predicted_yield - cut, 5) AS delta, predicted_yield >= cut AS on_track
  FROM forecast_steps, (SELECT quantile_cont(yield, 0.75) AS cut FROM batches) WHERE time_step = 60""",
    "forecast_steps"))
def forecast_status(spark, sf_dir):
    out = mo.forecast_status(mo.forecast_steps(*_model(spark, sf_dir)), fx.batches(spark, sf_dir), 60)
    return rounded(out, 5, "predicted_yield", "delta")


cte("vip", ("terms",), """
  SELECT variable, step, sqrt(n * (10.0 * pow(w1 / (n1 + 1e-10), 2) + 1.8 * pow(w2 / (n2 + 1e-10), 2)
    + 0.4 * pow(w3 / (n3 + 1e-10), 2)) / 12.2) AS vip
  FROM terms, (SELECT count(*) AS n, sqrt(sum(w1 * w1)) AS n1, sqrt(sum(w2 * w2)) AS n2,
    sqrt(sum(w3 * w3)) AS n3 FROM terms)""")


@entry("vip_cells", twin("""
  SELECT variable, CAST(step AS INTEGER) AS step, round(vip, 6) AS vip FROM vip""", "vip"))
def vip_cells(spark, sf_dir):
    _, terms, meta = _model(spark, sf_dir)
    return rounded(mo.vip_cells(terms, meta, COMPONENTS), 6, "vip")


@entry("vip_by_variable", twin("""
  SELECT variable, round(sqrt(sum(vip * vip)), 6) AS agg_vip, sqrt(sum(vip * vip)) > 1 AS important
  FROM vip GROUP BY variable""", "vip"))
def vip_by_variable(spark, sf_dir):
    _, terms, meta = _model(spark, sf_dir)
    return rounded(mo.vip_by_variable(mo.vip_cells(terms, meta, COMPONENTS)), 6, "agg_vip")


@entry("vip_by_phase", twin("""
  SELECT variable, CASE WHEN step < 33 THEN 'Startup' WHEN step < 66 THEN 'Reaction' ELSE 'Harvest' END AS phase,
    round(sqrt(sum(vip * vip)), 6) AS vip FROM vip GROUP BY ALL""", "vip"))
def vip_by_phase(spark, sf_dir):
    _, terms, meta = _model(spark, sf_dir)
    return rounded(mo.vip_by_phase(mo.vip_cells(terms, meta, COMPONENTS)), 6, "vip")


@entry("coefficient_direction", twin("""
  SELECT variable, round(sum(coef * abs(coef)) / sum(abs(coef)), 8) AS direction,
    round(avg(abs(coef)), 8) AS magnitude FROM terms GROUP BY variable""", "terms"))
def coefficient_direction(spark, sf_dir):
    return rounded(mo.coefficient_direction(model_terms(spark, sf_dir)), 8, "direction", "magnitude")


@entry("model_agreement", twin("""
  SELECT feature, round(lead, 6) AS coef, CASE WHEN lead > 0 THEN 'up' ELSE 'down' END AS model_direction,
    (lead > 0) = (delta > 0) AS model_agrees
  FROM plan JOIN (SELECT variable, sum(coef * abs(coef)) / sum(abs(coef)) AS lead FROM terms GROUP BY variable)
    ON variable = replace(replace(feature, '_mean', ''), '_std', '')""", "plan", "terms"))
def model_agreement(spark, sf_dir):
    from checks.ranking import plan
    from trajecta.operators.recommend import model_agreement as agree
    out = agree(plan(spark, sf_dir), mo.coefficient_direction(model_terms(spark, sf_dir)))
    return out.select("feature", F.round("coef", 6).alias("coef"), "model_direction", "model_agrees")


# ── fitted models ────────────────────────────────────────────────────────────


def _monitor(spark, sf_dir):
    return mo.fit_monitor(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir), fx.VARIABLES)


@entry("fitted_monitor")
def fitted_monitor(spark, sf_dir):
    """Every run against the model fitted on the good runs."""
    model = _monitor(spark, sf_dir)
    stats = mo.run_statistics(fx.aligned(spark, sf_dir), model.terms, model.meta, model.components)
    fleet = mo.fleet_view(stats, model.meta, fx.batches(spark, sf_dir))
    return rounded(fleet, 4, "t2", "spe")


# Sign-free facts every component model must meet.
@entry("fitted_monitor_facts", twin("""
  SELECT count(*) AS n_good, round(avg(t2_mean_gap), 6) AS t2_gap, 0.0::DOUBLE AS orthonormality_gap
  FROM (SELECT 0.0::DOUBLE AS t2_mean_gap FROM batches WHERE is_golden)""", "batches"))
def fitted_monitor_facts(spark, sf_dir):
    """Mean T² over the training runs is A (n - 1) / n; loadings are orthonormal."""
    model = _monitor(spark, sf_dir)
    good = mo.good_runs(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)).select("batch_id")
    cells = fx.aligned(spark, sf_dir).join(good, "batch_id", "left_semi")
    stats = mo.run_statistics(cells, model.terms, model.meta, model.components)
    a = model.components
    gaps = [
        F.abs(F.sum(F.col("loadings")[i] * F.col("loadings")[j]) - (1.0 if i == j else 0.0))
        for i in range(a) for j in range(i + 1)
    ]
    ortho = model.terms.agg(F.round(F.greatest(*gaps, F.lit(0.0)), 6).alias("orthonormality_gap"))
    n = F.count(F.lit(1))
    return stats.agg(
        n.alias("n_good"), F.round(F.abs(F.avg("t2") - a * (n - 1) / n), 6).alias("t2_gap")
    ).crossJoin(ortho)


@entry("fitted_forecast")
def fitted_forecast(spark, sf_dir):
    model = mo.fit_forecast(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir), fx.VARIABLES)
    return rounded(mo.forecast(fx.aligned(spark, sf_dir), model.terms, model.meta), 4, "predicted_yield")


# With one component the regression has a closed form: weights follow Xᵀy.
@entry("one_component_forecast", twin("""
  SELECT batch_id, round(ybar + sum(z * xy) * any_value(b), 4) AS predicted_yield
  FROM (SELECT z.batch_id, z.z, s.xy FROM sz z JOIN sxy s USING (variable, step)),
    (SELECT avg(yield) AS ybar FROM batches),
    (SELECT sum(t * (yield - (SELECT avg(yield) FROM batches))) / sum(t * t) AS b FROM (
      SELECT batch_id, sum(z * xy) AS t FROM sz JOIN sxy USING (variable, step) GROUP BY batch_id)
      JOIN batches USING (batch_id))
  GROUP BY batch_id, ybar""", "sxy"))
def one_component_forecast(spark, sf_dir):
    runs = fx.aligned(spark, sf_dir)
    model = mo.fit_forecast(runs, fx.batches(spark, sf_dir), fx.VARIABLES, components=1)
    return rounded(mo.forecast(runs, model.terms, model.meta), 4, "predicted_yield")


cte("sz", ("aligned", "batches"), """
  SELECT batch_id, variable, step, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0
    THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM aligned WINDOW w AS (PARTITION BY variable, step)""")
cte("sxy", ("sz",), """
  SELECT variable, step, sum(z * (yield - (SELECT avg(yield) FROM batches))) AS xy
  FROM sz JOIN batches USING (batch_id) GROUP BY variable, step""")


@entry("leave_one_out")
def leave_one_out(spark, sf_dir):
    runs, labels = fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)
    model = mo.fit_forecast(runs, labels, fx.VARIABLES)
    return rounded(mo.leave_one_out(runs, labels, model), 4, "predicted", "fitted")


# With one or two components the left-out prediction has a closed form, too: totals minus one run.
def left_out_cells_sql(aligned: str) -> str:
    return f"""
  SELECT batch_id AS i, j, n, y AS yi, (sy - y) / (n - 1) AS ybar, (sx - x) / (n - 1) AS m, x,
    CASE WHEN sqrt(greatest((sxx - x * x) / (n - 1) - pow((sx - x) / (n - 1), 2), 0)) > 1e-12
      THEN sqrt((sxx - x * x) / (n - 1) - pow((sx - x) / (n - 1), 2)) ELSE 1 END AS sd,
    sxy - x * y - (sx - x) * (sy - y) / (n - 1) AS s
  FROM (SELECT batch_id, j, x, y, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(x * x) OVER w AS sxx,
      sum(x * y) OVER w AS sxy, sum(y) OVER w AS sy
    FROM (SELECT batch_id, variable || step AS j, value AS x, yield AS y FROM {aligned} JOIN batches USING (batch_id)
      WHERE yield IS NOT NULL) WINDOW w AS (PARTITION BY j))"""


def one_left_out_sql(cells: str) -> str:
    return f"""
  SELECT i AS batch_id, any_value(yi) AS actual, round(any_value(ybar) + any_value(zi) * sum(t * (y - ybar)) / sum(t * t), 4) AS predicted
  FROM (SELECT w.i, b.batch_id AS k, any_value(w.ybar) AS ybar, any_value(b.yield) AS y,
      sum((a.x - w.m) / w.sd * w.w) AS t, any_value(own.zi) AS zi, any_value(yb.yield) AS yi
    FROM (SELECT *, s / sd / sqrt(sum(pow(s / sd, 2)) OVER (PARTITION BY i)) AS w FROM {cells}) w
    JOIN {cells} a ON a.j = w.j AND a.i <> w.i
    JOIN batches b ON b.batch_id = a.i
    JOIN batches yb ON yb.batch_id = w.i
    JOIN (SELECT i, sum((x - m) / sd * w) AS zi FROM (
      SELECT *, s / sd / sqrt(sum(pow(s / sd, 2)) OVER (PARTITION BY i)) AS w FROM {cells}) GROUP BY i) own ON own.i = w.i
    GROUP BY w.i, b.batch_id) GROUP BY i"""


cte("left_out_cells", ("aligned", "batches"), left_out_cells_sql("aligned"))
cte("wide_aligned", ("reading_cells",), fx.aligned_sql("reading_cells", 1100))
cte("wide_left_out", ("wide_aligned", "batches"), left_out_cells_sql("wide_aligned"))
cte("lo_z", ("left_out_cells",), """
  SELECT c.i, a.i AS k, c.j, (a.x - c.m) / c.sd AS z, a.yi - c.ybar AS y FROM left_out_cells c JOIN left_out_cells a ON a.j = c.j""")
cte("lo_w1", ("left_out_cells",), """
  SELECT i, j, s / sd AS s, s / sd / sqrt(sum(pow(s / sd, 2)) OVER (PARTITION BY i)) AS w FROM left_out_cells""")
cte("lo_t1", ("lo_z", "lo_w1"), """
  SELECT i, k, sum(z * w) AS t, any_value(y) AS y FROM lo_z JOIN lo_w1 USING (i, j) GROUP BY i, k""")
cte("lo_q1", ("lo_t1",), """
  SELECT i, sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q FROM lo_t1 WHERE k <> i GROUP BY i""")
cte("lo_p1", ("lo_z", "lo_t1", "lo_q1"), """
  SELECT i, j, sum(z * t) / any_value(tt) AS p FROM lo_z JOIN lo_t1 USING (i, k) JOIN lo_q1 USING (i) WHERE k <> i GROUP BY i, j""")
cte("lo_w2", ("lo_w1", "lo_p1", "lo_q1"), """
  SELECT i, j, w1, p, s2 / sqrt(sum(s2 * s2) OVER (PARTITION BY i)) AS w2 FROM (
    SELECT i, j, w AS w1, p, s - p * q * tt AS s2 FROM lo_w1 JOIN lo_p1 USING (i, j) JOIN lo_q1 USING (i))""")
cte("lo_t2", ("lo_z", "lo_w2"), """
  SELECT i, k, sum(z * r) AS t, any_value(y) AS y FROM lo_z JOIN (
    SELECT i, j, w2 - sum(p * w2) OVER (PARTITION BY i) * w1 AS r FROM lo_w2) USING (i, j) GROUP BY i, k""")


@entry("leave_one_out_double", twin("""
  SELECT c.i AS batch_id, c.yi AS actual, round(c.ybar + q1.q * t1.t + q2.q * t2.t, 4) AS predicted
  FROM (SELECT i, any_value(yi) AS yi, any_value(ybar) AS ybar FROM left_out_cells GROUP BY i) c
  JOIN lo_q1 q1 ON q1.i = c.i JOIN lo_t1 t1 ON t1.i = c.i AND t1.k = c.i
  JOIN (SELECT i, sum(t * y) / sum(t * t) AS q FROM lo_t2 WHERE k <> i GROUP BY i) q2 ON q2.i = c.i
  JOIN lo_t2 t2 ON t2.i = c.i AND t2.k = c.i""", "left_out_cells", "lo_q1", "lo_t1", "lo_t2"))
def leave_one_out_double(spark, sf_dir):
    runs, labels = fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)
    model = mo.fit_forecast(runs, labels, fx.VARIABLES, components=2)
    found = mo.leave_one_out(runs, labels, model, components=2)
    return rounded(found.select("batch_id", "actual", "predicted"), 4, "predicted")


@entry("leave_one_out_wide", twin(one_left_out_sql("wide_left_out"), "wide_left_out"))
def leave_one_out_wide(spark, sf_dir):
    """4,400 columns: beyond the matrix limit, by products of the rows."""
    runs = al.align(fx.readings(spark, sf_dir), fx.VARIABLES, points=1100, whole=True)  # a table of its own
    labels = fx.batches(spark, sf_dir)
    model = mo.fit_forecast(runs, labels, fx.VARIABLES, points=1100, components=1)
    found = mo.leave_one_out(runs, labels, model, points=1100, components=1)
    return rounded(found.select("batch_id", "actual", "predicted"), 4, "predicted")


@entry("leave_one_out_single", twin(one_left_out_sql("left_out_cells"), "left_out_cells"))
def leave_one_out_single(spark, sf_dir):
    runs, labels = fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)
    model = mo.fit_forecast(runs, labels, fx.VARIABLES, components=1)
    found = mo.leave_one_out(runs, labels, model, components=1)
    return rounded(found.select("batch_id", "actual", "predicted"), 4, "predicted")


@entry("cross_validation", twin("""
  SELECT n, round(r2, 3) AS r2_loocv, round(rmse, 2) AS rmse_loocv, round(r2t, 3) AS r2_train,
    CASE WHEN round(r2, 3) >= 0.7 THEN 'reliable' WHEN round(r2, 3) >= 0.4 THEN 'moderate' ELSE 'low' END AS reliability,
    round(round(r2t, 3) - round(r2, 3), 3) AS overfit_gap
  FROM (SELECT count(*) AS n, 1 - sum(pow(yield - p, 2)) / (var_pop(yield) * count(*) + 1e-9) AS r2,
      sqrt(avg(pow(yield - p, 2))) AS rmse, 1 - sum(pow(yield - f, 2)) / (var_pop(yield) * count(*) + 1e-9) AS r2t
    FROM (SELECT batch_id, max(predicted_yield) FILTER (time_step = 50) AS p,
      max(predicted_yield) FILTER (time_step = 100) AS f FROM forecast_steps GROUP BY batch_id)
    JOIN batches USING (batch_id))""", "forecast_steps"))
def cross_validation(spark, sf_dir):
    """The metrics, from pairs that SQL can give as well."""
    steps_ = mo.forecast_steps(*_model(spark, sf_dir))
    pairs = steps_.groupBy("batch_id").agg(
        F.max(F.when(F.col("time_step") == 50, F.col("predicted_yield"))).alias("predicted"),
        F.max(F.when(F.col("time_step") == 100, F.col("predicted_yield"))).alias("fitted"),
    ).join(fx.batches(spark, sf_dir).select("batch_id", F.col("yield").alias("actual")), "batch_id")
    return mo.cross_validation(pairs)


@entry("fitted_cross_validation")
def fitted_cross_validation(spark, sf_dir):
    runs, labels = fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir)
    model = mo.fit_forecast(runs, labels, fx.VARIABLES)
    return mo.cross_validation(mo.leave_one_out(runs, labels, model))


@entry("fitted_vip", twin("""
  SELECT 400::BIGINT AS n_cells, 1.0::DOUBLE AS mean_square"""))
def fitted_vip(spark, sf_dir):
    """The mean squared VIP of a fitted model is 1."""
    model = mo.fit_forecast(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir), fx.VARIABLES)
    vip = mo.vip_cells(model.terms, model.meta, model.components)
    return vip.agg(F.count(F.lit(1)).alias("n_cells"),
                   F.round(F.avg(F.col("vip") * F.col("vip")), 6).alias("mean_square"))


# ── warping, phases, profile reports ─────────────────────────────────────────

# Dynamic programme along anti-diagonals; each series carries two diagonals.
cte("dtw_series", ("aligned", "profile_core"), """
  SELECT batch_id, a.variable, list(value ORDER BY a.step) AS a, any_value(b) AS b
  FROM aligned a JOIN (SELECT variable, list(mean ORDER BY step) AS b FROM profile_core GROUP BY variable) g
    ON g.variable = a.variable GROUP BY batch_id, a.variable""")
cte("dtw_walk", ("dtw_series",), """
  SELECT batch_id, variable, a, b, 0 AS d,
    list_transform(range(0, 100), lambda i: CASE WHEN i = 0 THEN pow(a[1] - b[1], 2) ELSE 'inf'::DOUBLE END) AS last,
    list_transform(range(0, 100), lambda i: 'inf'::DOUBLE) AS before
  FROM dtw_series
  UNION ALL
  SELECT batch_id, variable, a, b, d + 1,
    list_transform(range(0, 100), lambda i: CASE WHEN d + 1 - i < 0 OR d + 1 - i > 99 THEN 'inf'::DOUBLE ELSE
      pow(a[i + 1] - b[d + 2 - i], 2) + least(last[i + 1],
        CASE WHEN i > 0 THEN last[i] ELSE 'inf'::DOUBLE END,
        CASE WHEN i > 0 THEN before[i] ELSE 'inf'::DOUBLE END) END), last
  FROM dtw_walk WHERE d < 198""")
cte("dtw", ("dtw_walk",), """
  SELECT batch_id, variable, sqrt(last[100]) AS distance FROM dtw_walk WHERE d = 198""")


@fx.stage
def warps(spark, sf_dir):
    return cp.warp_from_profile(fx.aligned(spark, sf_dir), fx.profile(spark, sf_dir))


@entry("warp_distances", twin("""
  SELECT batch_id, variable, round(distance, 4) AS distance FROM dtw""", "dtw", recursive=True))
def warp_distances(spark, sf_dir):
    return rounded(warps(spark, sf_dir), 4, "distance")


@entry("total_warp", twin("""
  SELECT batch_id, round(sum(distance), 4) AS total_distance, any_value(yield) AS yield,
    any_value(quality) AS quality FROM dtw JOIN batches USING (batch_id) GROUP BY batch_id""", "dtw", recursive=True))
def total_warp(spark, sf_dir):
    return rounded(cp.total_warp(warps(spark, sf_dir), fx.batches(spark, sf_dir)), 4, "total_distance")


@entry("warp_yield_link", twin("""
  SELECT round(r, 6) AS r, CASE WHEN r < -0.5 THEN 'strong' WHEN r < -0.2 THEN 'moderate' ELSE 'weak' END AS link
  FROM (SELECT corr(t, yield) AS r FROM (SELECT batch_id, sum(distance) AS t FROM dtw GROUP BY batch_id)
    JOIN batches USING (batch_id))""", "dtw", recursive=True))
def warp_yield_link(spark, sf_dir):
    return rounded(cp.warp_yield_link(cp.total_warp(warps(spark, sf_dir), fx.batches(spark, sf_dir))), 6, "r")


@entry("resampled_band", twin("""
  SELECT batch_id, variable, count(*) AS n_points, count(*) FILTER (value > hi OR value < lo) AS n_outside,
    round(100.0::DOUBLE * count(*) FILTER (value > hi OR value < lo) / count(*), 6) AS pct_outside
  FROM (SELECT r.batch_id, r.variable, r.value, l.upper + (h.upper - l.upper) * (u - cell) AS hi,
      l.lower + (h.lower - l.lower) * (u - cell) AS lo
    FROM (SELECT *, least(floor(u), 98) AS cell FROM (SELECT batch_id, variable, value,
        (time_index - min(time_index) OVER (PARTITION BY batch_id)) /
        (max(time_index) OVER (PARTITION BY batch_id) - min(time_index) OVER (PARTITION BY batch_id)) * 99 AS u
        FROM reading_cells)) r
    JOIN (SELECT variable, step, mean + 2 * std AS upper, mean - 2 * std AS lower FROM profile_core) l
      ON l.variable = r.variable AND l.step = cell
    JOIN (SELECT variable, step, mean + 2 * std AS upper, mean - 2 * std AS lower FROM profile_core) h
      ON h.variable = r.variable AND h.step = cell + 1)
  GROUP BY batch_id, variable""", "profile_core", "reading_cells"))
def resampled_band(spark, sf_dir):
    """Raw readings against the two-sigma band read at their own times."""
    timed = al.normalise_time(fx.readings(spark, sf_dir), fx.VARIABLES)
    samples = timed.select("batch_id", F.col("progress").alias("x"), *fx.VARIABLES).unpivot(
        ["batch_id", "x"], fx.VARIABLES, "variable", "value")
    shape = fx.profile(spark, sf_dir).withColumns({
        "upper": F.col("mean") + 2 * F.col("std"), "lower": F.col("mean") - 2 * F.col("std")})
    return rounded(al.outside_band(samples, shape), 6, "pct_outside")


@entry("unfolded_cells", twin("""
  SELECT batch_id, variable || '_t' || lpad(CAST(step + 1 AS VARCHAR), 3, '0') AS column, round(value, 5) AS value
  FROM aligned""", "aligned"))
def unfolded_cells(spark, sf_dir):
    return al.unfolded_cells(fx.aligned(spark, sf_dir)).select(
        "batch_id", "column", F.round("value", 5).alias("value"))


@entry("unfolded_rows", twin("""
  SELECT batch_id, list(CASE WHEN round(value, 5) = 0 THEN 0.0 ELSE round(value, 5) END
    ORDER BY list_position(['quantity', 'price', 'discount', 'tax'], variable), step) AS x
  FROM aligned GROUP BY batch_id""", "aligned"))
def unfolded_rows(spark, sf_dir):
    value = F.round("value", 5)  # one zero, not two
    return al.unfold(fx.aligned(spark, sf_dir).withColumn(
        "value", F.when(value == 0, F.lit(0.0)).otherwise(value)), fx.VARIABLES)


cte("phase_stats", ("aligned", "phases"), """
  SELECT batch_id, phase, variable, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS max,
    sum(value) - (min_by(value, step) + max_by(value, step)) / 2 AS auc
  FROM aligned JOIN phases ON time_norm BETWEEN lo AND hi GROUP BY ALL""")


@entry("phase_summary", twin("""
  SELECT batch_id, phase, variable, round(mean, 5) AS mean, round(std, 5) AS std, round(max, 5) AS max,
    round(auc, 4) AS auc FROM phase_stats""", "phase_stats"))
def phase_summary(spark, sf_dir):
    return rounded(rounded(al.phase_summary(fx.aligned(spark, sf_dir)), 5, "mean", "std", "max"), 4, "auc")


@entry("phase_contrast", twin("""
  SELECT phase, variable, round(g, 5) AS golden_median, round(p, 5) AS poor_median, round(abs(g - p), 5) AS gap,
    CASE WHEN g - p > 0 THEN 'higher' ELSE 'lower' END AS direction
  FROM (SELECT phase, variable, quantile_cont(mean, 0.5) FILTER (quality = 'Golden') AS g,
    quantile_cont(mean, 0.5) FILTER (quality = 'Poor') AS p
    FROM phase_stats JOIN batches USING (batch_id) GROUP BY ALL)""", "phase_stats", "batches"))
def phase_contrast(spark, sf_dir):
    out = cp.phase_contrast(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir))
    return rounded(out, 5, "golden_median", "poor_median", "gap")


@entry("phase_boxes", twin("""
  SELECT phase, variable, quality, round(min(mean), 5) AS low, round(quantile_cont(mean, 0.25), 5) AS q1,
    round(quantile_cont(mean, 0.5), 5) AS median, round(quantile_cont(mean, 0.75), 5) AS q3,
    round(max(mean), 5) AS high
  FROM phase_stats JOIN batches USING (batch_id) GROUP BY ALL""", "phase_stats", "batches"))
def phase_boxes(spark, sf_dir):
    out = cp.phase_boxes(fx.aligned(spark, sf_dir), fx.batches(spark, sf_dir))
    return rounded(out, 5, "low", "q1", "median", "q3", "high")


@entry("conformance_by_variable", twin("""
  SELECT batch_id, variable, round(score, 6) AS score FROM conformance_cpp""", "conformance_cpp", recursive=True))
def conformance_by_variable(spark, sf_dir):
    return rounded(pf.conformance_by_variable(fx.aligned(spark, sf_dir), fx.profile(spark, sf_dir)), 6, "score")


@entry("conformance_by_phase", twin("""
  SELECT batch_id, variable, phase, round(avg(CASE WHEN inside THEN 100.0::DOUBLE ELSE 0 END), 6) AS score
  FROM deviations JOIN phases ON time_norm BETWEEN lo AND hi GROUP BY ALL""", "deviations", "phases", recursive=True))
def conformance_by_phase(spark, sf_dir):
    return rounded(pf.conformance_by_phase(fx.aligned(spark, sf_dir), fx.profile(spark, sf_dir)), 6, "score")


@entry("deviation_profile", twin("""
  SELECT batch_id, variable, CAST(step AS INTEGER) AS step, inside, round(z, 5) AS z FROM deviations""",
    "deviations", recursive=True))
def deviation_profile(spark, sf_dir):
    out = pf.deviations(fx.aligned(spark, sf_dir), fx.profile(spark, sf_dir))
    return out.select("batch_id", "variable", "step", "inside", F.round("z", 5).alias("z"))


@entry("conformance_yield_link", twin("""
  SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope,
    round(regr_intercept(y, x), 5) AS intercept FROM (
      SELECT round(overall, 1) AS x, round(yield, 1) AS y FROM conformance JOIN batches USING (batch_id))""",
    "conformance", recursive=True))
def conformance_yield_link(spark, sf_dir):
    """Over the rounded columns of the conformance table, as it is shown."""
    link = lb.yield_link(_shown_scores(spark, sf_dir), "conformance_pct", "yield_pct")
    return rounded(rounded(link, 6, "r", "slope"), 5, "intercept")


def _shown_scores(spark, sf_dir):
    return pf.conformance_table(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir), fx.profile(spark, sf_dir))


P_SQL = """
  SELECT round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 4000 / 3 *
    list_sum(list_transform(range(0, 4001), lambda k:
      (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) *
      pow(1 + pow(t * k / 4000, 2) / df, -(df + 1) / 2))), 6) AS p_value
  FROM (SELECT (count(*) - 2)::DOUBLE AS df, abs(corr(x, y)) *
    sqrt((count(*) - 2) / (1 - pow(corr(x, y), 2))) AS t FROM (
      SELECT round(overall, 1) AS x, round(yield, 1) AS y FROM conformance JOIN batches USING (batch_id)))"""


@entry("conformance_yield_p", twin(P_SQL, "conformance", recursive=True))
def conformance_yield_p(spark, sf_dir):
    one = _shown_scores(spark, sf_dir).agg(pearson(F.col("conformance_pct"), F.col("yield_pct")).alias("r"),
                     F.count(F.lit(1)).cast("double").alias("n"))
    return one.select(F.round(correlation_p("r", "n"), 6).alias("p_value"))


@entry("ideal_ranges", twin("""
  SELECT variable, phase, round(avg(mean), 3) AS mean, round(min(lower), 3) AS lower,
    round(max(upper), 3) AS upper, round(avg(std), 3) AS std
  FROM (SELECT *, CASE WHEN step < 33 THEN 'Startup' WHEN step < 66 THEN 'Reaction' ELSE 'Harvest' END AS phase
    FROM profile) GROUP BY GROUPING SETS ((variable, phase), (variable))""", "profile", recursive=True))
def ideal_ranges(spark, sf_dir):
    return pf.ideal_ranges(fx.profile(spark, sf_dir))


@entry("profile_meta", twin("""
  SELECT count(*) AS n_golden, max(golden_pct_used) AS golden_pct_used, max(yield_threshold) AS yield_threshold,
    round(any_value(t_crit), 6) AS t_crit, 0.05::DOUBLE AS alpha
  FROM golden_members, t_crit WHERE batch_id NOT IN (SELECT batch_id FROM erratic)""",
    "golden_members", "t_crit", recursive=True))
def profile_meta(spark, sf_dir):
    return rounded(pf.profile_meta(pf.profile_members(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))), 6, "t_crit")


@entry("golden_members", twin("""
  SELECT batch_id, golden_pct_used, yield_threshold FROM golden_members""", "golden_members"))
def golden_members(spark, sf_dir):
    return pf.golden_members(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))


@entry("band_source", twin("""
  SELECT band_source, count(*) AS n_cells FROM profile GROUP BY band_source""", "profile", recursive=True))
def band_source(spark, sf_dir):
    return fx.profile(spark, sf_dir).groupBy("band_source").agg(F.count(F.lit(1)).alias("n_cells"))


# A planted erratic run: one golden batch shifted on half of its steps.
cte("planted", ("golden_rows",), """
  SELECT batch_id, variable, step, time_norm, CASE WHEN batch_id = (SELECT min(batch_id) FROM golden_rows)
    AND step % 2 = 0 THEN value + 1000000 ELSE value END AS value FROM golden_rows""")


@entry("inconsistent_members", twin("""
  SELECT batch_id, round(worst_rate, 6) AS worst_rate FROM (
    SELECT batch_id, worst_rate, count(*) OVER () AS n, sum((worst_rate <= 0.30)::INT) OVER () AS kept
    FROM (SELECT batch_id, max(rate) AS worst_rate FROM (
      SELECT batch_id, variable, avg(CASE WHEN abs(value - m) / (s + 1e-9) > 2.5 THEN 1.0::DOUBLE ELSE 0 END) AS rate
      FROM planted JOIN (SELECT variable, step, avg(value) AS m, stddev_pop(value) AS s FROM planted
        GROUP BY variable, step) USING (variable, step) GROUP BY batch_id, variable) GROUP BY batch_id))
  WHERE worst_rate > 0.30 AND n >= 5 AND kept >= 3""", "planted"))
def inconsistent_members(spark, sf_dir):
    rows = pf.golden_rows(fx.batches(spark, sf_dir), fx.aligned(spark, sf_dir))
    first = rows.agg(F.min("batch_id").alias("_first"))
    planted = rows.crossJoin(F.broadcast(first)).withColumn("value", F.when(
        (F.col("batch_id") == F.col("_first")) & (F.col("step") % 2 == 0), F.col("value") + 1000000
    ).otherwise(F.col("value"))).drop("_first")
    return pf.inconsistent_members(planted).select("batch_id", F.round("worst_rate", 6).alias("worst_rate"))
