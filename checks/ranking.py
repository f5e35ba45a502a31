"""Segments, association, ranking, recommendations and overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.base import cte, entry, twin
from trajecta.functions.numeric import rounded
from trajecta.operators import association as asn
from trajecta.operators import label as lb
from trajecta.operators import linear_models as lm
from trajecta.operators import profile as pf
from trajecta.operators import recommend as rc


def prepared(spark, sf_dir):
    return lb.prepare_features(fx.features(spark, sf_dir), fx.batches(spark, sf_dir))


def marked(spark, sf_dir):
    return rc.mark_target(prepared(spark, sf_dir), lb.default_target(fx.batches(spark, sf_dir)))


cte("marked", ("prepared", "target"), """
  SELECT p.*, target, yield >= target AS is_target FROM prepared p, target""")

# ── labels and segments ──────────────────────────────────────────────────────


@entry("training_choice", twin("""
  SELECT CASE WHEN n0 >= 3 THEN n0 WHEN n1 >= 3 THEN n1 WHEN n2 >= 3 THEN n2 ELSE n END::BIGINT AS n_good,
    CASE WHEN n0 >= 3 THEN c0 WHEN n1 >= 3 THEN c1 WHEN n2 >= 3 THEN c2 ELSE lo END AS threshold_used,
    CASE WHEN n0 >= 3 THEN 'p75' WHEN n1 >= 3 THEN 'p60' WHEN n2 >= 3 THEN 'p50' ELSE 'all' END AS rung
  FROM (SELECT c0, c1, c2, count(yield) AS n, min(yield) AS lo, sum((yield >= c0)::INT) AS n0,
      sum((yield >= c1)::INT) AS n1, sum((yield >= c2)::INT) AS n2
    FROM batches, (SELECT quantile_cont(yield, 0.75) AS c0, quantile_cont(yield, 0.6) AS c1,
      quantile_cont(yield, 0.5) AS c2 FROM batches) GROUP BY ALL)""", "batches"))
def training_choice(spark, sf_dir):
    return lb.choose_training(fx.batches(spark, sf_dir))


@entry("target_segments", twin("""
  SELECT batch_id, yield, quality, round(target, 4) AS target, is_target FROM segmented""", "segmented"))
def target_segments(spark, sf_dir):
    return fx.segmented(spark, sf_dir).select(
        "batch_id", "yield", "quality", F.round("target", 4).alias("target"), "is_target")


@entry("segment_summary", twin("""
  SELECT round(target, 6) AS target, n_target, n_below, n_total, round(target_avg, 6) AS target_avg,
    round(below_avg, 6) AS below_avg, round(target - coalesce(below_avg, target), 6) AS gap,
    round(target_avg - below_avg, 6) AS uplift,
    round((target_avg - below_avg) / greatest(below_avg, 1e-6) * 100, 6) AS uplift_pct,
    round(100.0::DOUBLE * n_target / n_total, 6) AS pct_at_target,
    CASE WHEN least(n_target, n_below) >= 20 THEN 'adequate' WHEN least(n_target, n_below) >= 10 THEN 'limited'
      ELSE 'very low' END AS power
  FROM (SELECT max(target) AS target, count(*) FILTER (is_target) AS n_target,
    count(*) FILTER (NOT is_target) AS n_below, count(*) AS n_total,
    avg(yield) FILTER (is_target) AS target_avg, avg(yield) FILTER (NOT is_target) AS below_avg
    FROM segmented)""", "segmented"))
def segment_summary(spark, sf_dir):
    out = rc.power_tier(lb.segment_summary(fx.segmented(spark, sf_dir)))
    return rounded(out, 6, "target", "target_avg", "below_avg", "gap", "uplift", "uplift_pct", "pct_at_target")


@entry("default_targets", twin("""
  SELECT 'p75' AS kind, target FROM target UNION ALL
  SELECT 'saved', 64.5::DOUBLE UNION ALL SELECT 'out of range', target FROM target""", "target"))
def default_targets(spark, sf_dir):
    runs = fx.batches(spark, sf_dir)
    kinds = (("p75", None), ("saved", 64.5), ("out of range", 250.0))
    parts = [lb.default_target(runs, saved).select(F.lit(k).alias("kind"), "target") for k, saved in kinds]
    return parts[0].union(parts[1]).union(parts[2])


@entry("batches_by_tier", twin("""
  SELECT * FROM batches WHERE quality IN ('Golden', 'Good') ORDER BY batch_id LIMIT 30""", "batches"))
def batches_by_tier(spark, sf_dir):
    return lb.by_quality(fx.batches(spark, sf_dir), ["Golden", "Good"], 30)


@entry("prepared_features", twin("""
  SELECT batch_id, feature, round(value, 5) AS value, yield FROM prepared""", "prepared"))
def prepared_features(spark, sf_dir):
    return rounded(prepared(spark, sf_dir), 5, "value")


cte("holey", ("features",), """
  SELECT batch_id, feature, CASE WHEN feature = 'tax_std' THEN NULL
    WHEN (CAST(batch_id AS BIGINT) + length(feature)) % 7 = 0 THEN NULL ELSE value END AS value
  FROM features WHERE CAST(batch_id AS BIGINT) % 9 <> 2""")


@entry("prepared_with_gaps", twin("""
  SELECT batch_id, feature, round(coalesce(value, m), 5) AS value, yield FROM (
    SELECT h.*, CASE WHEN CAST(batch_id AS BIGINT) % 10 = 4 THEN NULL ELSE yield END AS yield,
      avg(value) OVER (PARTITION BY feature) AS m FROM holey h JOIN batches USING (batch_id))
  WHERE m IS NOT NULL AND yield IS NOT NULL""", "holey", "batches"))
def prepared_with_gaps(spark, sf_dir):
    """All-null feature dropped, means taken before batches without yield go."""
    key = F.col("batch_id").cast("long")
    hole = (F.col("feature") == "tax_std") | ((key + F.length("feature")) % 7 == 0)
    holey = fx.features(spark, sf_dir).where(key % 9 != 2).withColumn(
        "value", F.when(~hole, F.col("value")))
    runs = fx.batches(spark, sf_dir).withColumn("yield", F.when(key % 10 != 4, F.col("yield")))
    return rounded(lb.prepare_features(holey, runs), 5, "value")


@entry("feature_source", twin("""
  SELECT 'rich' AS source, count(*) AS n_values, count(DISTINCT feature) AS n_features FROM rich
  UNION ALL SELECT 'basic', count(*), count(DISTINCT feature) FROM features""", "rich", "features"))
def feature_source(spark, sf_dir):
    from trajecta.operators.features import rich_features
    basic = fx.features(spark, sf_dir)
    rich = rich_features(fx.readings(spark, sf_dir), fx.VARIABLES)
    parts = []
    for choice in (lb.feature_source(rich=rich, basic=basic), lb.feature_source(basic=basic)):
        name, table = choice
        parts.append(table.agg(F.count(F.lit(1)).alias("n_values"),
                               F.count_distinct("feature").alias("n_features")).select(
            F.lit(name).alias("source"), "*"))
    return parts[0].union(parts[1])


@entry("reconciled_variables", twin("""
  SELECT 'matched' AS kind, variable FROM (SELECT DISTINCT variable FROM aligned)
    WHERE variable IN ('tax', 'price', 'unknown')
  UNION ALL SELECT 'fallback', variable FROM (SELECT DISTINCT variable FROM aligned)""", "aligned"))
def reconciled_variables(spark, sf_dir):
    shape = fx.profile(spark, sf_dir)
    a = lb.reconcile(["tax", "price", "unknown"], shape).select(F.lit("matched").alias("kind"), "variable")
    b = lb.reconcile(["other", "unknown"], shape).select(F.lit("fallback").alias("kind"), "variable")
    return a.union(b)


@entry("temperature_variables", twin("""
  SELECT 'events' AS source, min(event_type) AS variable FROM events
  UNION ALL SELECT 'parts', p_type FROM (SELECT DISTINCT p_type FROM part)
  WHERE regexp_matches(lower(p_type), 'temp|temperature|tmp|t_')
    OR (NOT EXISTS (SELECT 1 FROM part WHERE regexp_matches(lower(p_type), 'temp|temperature|tmp|t_'))
      AND p_type = (SELECT min(p_type) FROM part))"""))
def temperature_variables(spark, sf_dir):
    from pyspark.sql import Window
    out = []
    for name, source, column in (("events", "events", "event_type"), ("parts", "part", "p_type")):
        names = fx.table(spark, sf_dir, source).select(F.col(column).alias("variable")).distinct()
        # one row per variable name
        ordered = names.withColumn("ordinal", F.row_number().over(Window.orderBy("variable")))
        out.append(lb.temperature_like(ordered).select(F.lit(name).alias("source"), "variable"))
    return out[0].union(out[1])


@entry("build_flags", twin("""
  SELECT golden_pct_used, n_good, rung, golden_pct_used < 0.75 AS golden_degraded,
    rung <> 'p75' AS few_training_batches,
    CAST(100 - floor(golden_pct_used * 100) AS INTEGER) AS top_pct
  FROM golden_choice, (SELECT count(*) AS n_good, 'p75' AS rung FROM batches
    WHERE yield >= (SELECT quantile_cont(yield, 0.75) FROM batches))""", "golden_choice"))
def build_flags(spark, sf_dir):
    runs = fx.batches(spark, sf_dir)
    return lb.build_flags(lb.choose_golden(runs, fx.aligned(spark, sf_dir)), lb.choose_training(runs))


# Names of the standard variables for the fixture's four, to exercise the dimension.
RENAMED = {"quantity": "temperature", "price": "pH", "discount": "dissolved_o2"}


@entry("labelled_features", twin("""
  SELECT feature, label, target_value, round(avg(value), 5) AS mean FROM (
    SELECT replace(replace(replace(feature, 'quantity', 'temperature'), 'price', 'pH'),
      'discount', 'dissolved_o2') AS feature, value FROM features)
  JOIN (SELECT * FROM (VALUES ('temperature_mean', 'Temperature (°C)', 37.0::DOUBLE),
    ('temperature_std', 'Temperature (°C)', 37.0), ('pH_mean', 'pH', 7.2), ('pH_std', 'pH', 7.2),
    ('dissolved_o2_mean', 'Dissolved O₂ (%)', 40.0), ('dissolved_o2_std', 'Dissolved O₂ (%)', 40.0),
    ('tax_mean', 'tax_mean', NULL), ('tax_std', 'tax_std', NULL)) AS t(feature, label, target_value))
  USING (feature) GROUP BY ALL""", "features"))
def labelled_features(spark, sf_dir):
    name = F.col("feature")
    for old, new in RENAMED.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    means = fx.features(spark, sf_dir).groupBy(name.alias("feature")).agg(
        F.round(F.avg("value"), 5).alias("mean"))
    return lb.with_labels(means, lb.dimension(spark), "feature")


# ── association ──────────────────────────────────────────────────────────────

cte("pair_ranks", ("prepared",), """
  SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY feature ORDER BY yield)
      + (count(*) OVER (PARTITION BY feature, yield) - 1) / 2.0 AS ry FROM prepared""")
cte("correlation", ("pair_ranks",), """
  SELECT feature, n, CASE WHEN n >= 5 THEN r ELSE 0 END AS pearson,
    CASE WHEN n >= 5 THEN rho ELSE 0 END AS spearman,
    (abs(CASE WHEN n >= 5 THEN r ELSE 0 END) + abs(CASE WHEN n >= 5 THEN rho ELSE 0 END)) / 2 AS combined
  FROM (SELECT feature, count(*) AS n,
    covar_pop(value, yield) / nullif(stddev_pop(value) * stddev_pop(yield), 0) AS r,
    covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho
    FROM pair_ranks GROUP BY feature)""")
# Two-sided p of Student's t by Simpson's rule over the density.
P_OF_T = """
  1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * t / 4000 / 3 *
    list_sum(list_transform(range(0, 4001), lambda k:
      (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) *
      pow(1 + pow(t * k / 4000, 2) / df, -(df + 1) / 2)))"""
cte("correlation_p", ("correlation",), f"""
  SELECT feature, CASE WHEN n >= 5 THEN {P_OF_T} ELSE 1 END AS p_value FROM (
    SELECT feature, n, CAST(n - 2 AS DOUBLE) AS df,
      abs(pearson) * sqrt((n - 2) / (1 - pearson * pearson)) AS t FROM correlation)""")


@entry("correlations", twin("""
  SELECT feature, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman,
    round(combined, 6) AS combined, round(p_value, 6) AS p_value
  FROM correlation JOIN correlation_p USING (feature)""", "correlation_p"))
def correlations(spark, sf_dir):
    return rounded(asn.correlations(prepared(spark, sf_dir)), 6, "pearson", "spearman", "combined", "p_value")


@entry("strongest_features", twin("""
  SELECT feature, round(c.combined, 6) AS combined, CASE WHEN c.combined > 0.7 THEN 'strong'
    WHEN c.combined > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
  FROM correlation c ORDER BY c.combined DESC, feature LIMIT 3""", "correlation"))
def strongest_features(spark, sf_dir):
    top = asn.strongest(asn.correlations(prepared(spark, sf_dir), with_p=False), first=3)
    return top.select("feature", F.round("combined", 6).alias("combined"), "strength")


@entry("trend_lines", twin("""
  SELECT feature, count(*) AS n, round(corr(value, yield), 6) AS r,
    round(regr_slope(yield, value), 5) AS slope, round(regr_intercept(yield, value), 5) AS intercept,
    round(any_value(p_value), 6) AS p_value
  FROM prepared JOIN correlation_p USING (feature)
  WHERE feature IN (SELECT feature FROM correlation ORDER BY combined DESC, feature LIMIT 3)
  GROUP BY feature""", "correlation", "correlation_p"))
def trend_lines(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    top = asn.strongest(asn.correlations(rows, with_p=False), first=3)
    return rounded(rounded(asn.trend_lines(rows, top), 6, "r", "p_value"), 5, "slope", "intercept")


@entry("significant_features", twin("""
  SELECT count(p_value) AS n_features, count(*) FILTER (p_value < 0.05) AS n_significant FROM correlation_p""",
                                    "correlation_p"))
def significant_features(spark, sf_dir):
    return asn.significant(asn.correlations(prepared(spark, sf_dir)))


@entry("ranking_guard", twin("""
  SELECT count(*) AS n_batches, count(yield) AS n_with_yield,
    (SELECT count(DISTINCT feature) FROM features WHERE value IS NOT NULL) AS n_features,
    count(*) >= 5 AND count(yield) >= 5 AS enough
  FROM batches WHERE batch_id IN (SELECT batch_id FROM features)""", "features", "batches"))
def ranking_guard(spark, sf_dir):
    return lb.ranking_guard(fx.features(spark, sf_dir), fx.batches(spark, sf_dir))


@fx.stage
def forest(spark, sf_dir):
    return asn.forest_importance(lm.feature_matrix(prepared(spark, sf_dir)))


@fx.stage
def boosted(spark, sf_dir):
    return asn.boosted_importance(lm.feature_matrix(prepared(spark, sf_dir)))


@entry("forest_importance")
def forest_importance(spark, sf_dir):
    return rounded(forest(spark, sf_dir), 6, "importance")


@entry("boosted_importance")
def boosted_importance(spark, sf_dir):
    return rounded(boosted(spark, sf_dir), 6, "importance")


@entry("tree_score", twin("""
  SELECT feature, round((a / sum(a) OVER () + b / sum(b) OVER ()) / 2, 6) AS score FROM (
    SELECT feature, abs(corr(value, yield)) AS a, stddev_pop(value) / (abs(avg(value)) + 1) AS b
    FROM prepared GROUP BY feature)""", "prepared"))
def tree_score(spark, sf_dir):
    """Over importances that plain SQL can give; the fitted ones are in ``fitted_ranking``."""
    rows = prepared(spark, sf_dir).groupBy("feature")
    first, second = (rows.agg(METHODS[m]().alias("importance")) for m in ("corr", "tree"))
    return rounded(asn.tree_score(first, second), 6, "score")


@entry("component_importance")
def component_importance(spark, sf_dir):
    found = lm.component_importance(lm.feature_matrix(prepared(spark, sf_dir)))
    return rounded(found.importance, 6, "loading", "score")


cte("two_features", ("prepared",), """
  SELECT batch_id, max(value) FILTER (feature = 'quantity_mean') AS a,
    max(value) FILTER (feature = 'price_mean') AS b, any_value(yield) AS y
  FROM prepared GROUP BY batch_id""")


@entry("two_feature_components", twin("""
  SELECT round(greatest(1 + r, 1 - r) / 2, 6) AS first_share, round(sqrt(0.5), 6) AS loading,
    round(greatest(CASE WHEN kept >= 1 THEN CASE WHEN r >= 0 THEN cs ELSE cd END END,
      CASE WHEN kept >= 2 THEN CASE WHEN r >= 0 THEN cd ELSE cs END ELSE 0 END), 6) AS best_corr
  FROM (SELECT corr(za, zb) AS r, abs(corr(za + zb, y)) AS cs, abs(corr(za - zb, y)) AS cd,
      CASE WHEN (1 + abs(corr(za, zb))) / 2 >= 0.85 THEN 1 ELSE 2 END AS kept
    FROM (SELECT (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za,
      (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb, y FROM two_features))""", "two_features"))
def two_feature_components(spark, sf_dir):
    """Two standardised features have a closed form: sum and difference."""
    two = prepared(spark, sf_dir).where(F.col("feature").isin("quantity_mean", "price_mean"))
    found = lm.component_importance(lm.feature_matrix(two))
    return spark.createDataFrame(
        [(float(found.explained[0]), float(abs(found.loadings[0, 0])),
          float(abs(found.yield_corr[found.chosen])))],
        "first_share double, loading double, best_corr double",
    ).select(*[F.round(c, 6).alias(c) for c in ("first_share", "loading", "best_corr")])


@entry("sparse_regression")
def sparse_regression(spark, sf_dir):
    found = lm.sparse_regression(lm.feature_matrix(prepared(spark, sf_dir)))
    return rounded(found.table, 6, "coef", "score").withColumns({
        "alpha": F.lit(round(found.alpha, 6)), "r2": F.lit(round(found.r2, 6)),
        "place": F.array_position(F.array(*map(F.lit, found.selected or [""])), F.col("feature"))})


cte("one_feature", ("prepared",), """
  SELECT row_number() OVER (ORDER BY batch_id) - 1 AS i, count(*) OVER () AS n, (value - avg(value) OVER ())
    / stddev_pop(value) OVER () AS x, yield AS y FROM prepared WHERE feature = 'quantity_mean'""")


@entry("sparse_single_feature", twin("""
  SELECT 'quantity_mean' AS feature, round(alpha, 6) AS alpha,
    CASE WHEN abs(xy) <= alpha THEN 0.0 ELSE round(sign(xy) * (abs(xy) - alpha) / xx, 6) END AS coef FROM (
      SELECT regr_sxy(y, x) / count(*) AS xy, regr_sxx(y, x) / count(*) AS xx FROM one_feature), (
    SELECT alpha FROM (
      SELECT alpha, fold, avg(pow(y - my - w * (x - mx), 2)) AS err FROM (
        SELECT t.alpha, t.fold, mx, my, sign(xy) * greatest(abs(xy) - t.alpha, 0) / xx AS w FROM (
          SELECT g.alpha, f.fold, avg(o.x) AS mx, avg(o.y) AS my, covar_pop(o.x, o.y) AS xy, var_pop(o.x) AS xx
          FROM grid g, (SELECT DISTINCT fold FROM folded) f JOIN folded o ON o.fold <> f.fold
          GROUP BY g.alpha, f.fold) t) m JOIN folded USING (fold)
      GROUP BY alpha, fold) GROUP BY alpha ORDER BY round(avg(err), 9), alpha DESC LIMIT 1)""", "folded", "grid"))
def sparse_single_feature(spark, sf_dir):
    """One feature has a closed form: the soft-thresholded covariance."""
    one = prepared(spark, sf_dir).where("feature = 'quantity_mean'")
    found = lm.sparse_regression(lm.feature_matrix(one))
    coef = F.when(F.abs("coef") < 1e-9, 0.0).otherwise(F.col("coef")).alias("coef")
    return rounded(found.table.select("feature", F.lit(found.alpha).alias("alpha"), coef), 6, "alpha", "coef")


cte("folded", ("one_feature",), """
  SELECT *, CASE WHEN i < n % 5 * (n // 5 + 1) THEN i // (n // 5 + 1)
    ELSE n % 5 + (i - n % 5 * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM one_feature""")
cte("grid", ("one_feature",), """
  SELECT top * pow(10, -3.0::DOUBLE * k / 99) AS alpha
  FROM (SELECT abs(regr_sxy(y, x)) / count(*) AS top FROM one_feature), (SELECT unnest(range(100)) AS k)""")
# Scores of four methods that plain SQL can give as well: correlation, and
# three closed forms of the features' spread.
METHODS = {
    "corr": lambda: F.abs(F.corr("value", "yield")),
    "tree": lambda: F.stddev_pop("value") / (F.abs(F.avg("value")) + 1),
    "pca": lambda: F.abs(F.avg("value")) / (F.max("value") + 1),
    "lasso": lambda: F.abs(F.covar_pop("value", "yield")) / (F.stddev_pop("value") + 1),
}
cte("method_scores", ("prepared",), """
  SELECT feature, method, score FROM (SELECT feature, abs(corr(value, yield)) AS corr,
      stddev_pop(value) / (abs(avg(value)) + 1) AS tree, abs(avg(value)) / (max(value) + 1) AS pca,
      abs(covar_pop(value, yield)) / (stddev_pop(value) + 1) AS lasso FROM prepared GROUP BY feature)
  UNPIVOT (score FOR method IN (corr, tree, pca, lasso))
  WHERE NOT (method = 'lasso' AND feature = 'tax_mean')""")
cte("scaled_scores", ("method_scores",), """
  SELECT feature, method, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) AS score
  FROM method_scores WINDOW w AS (PARTITION BY method)""")
cte("ranking", ("scaled_scores", "batches"), """
  SELECT *, row_number() OVER (ORDER BY weighted_score DESC, feature) AS rank,
    regexp_replace(feature, '_(mean|std|startup_mean|reaction_mean|harvest_mean|slope|auc_norm)$', '') AS base_variable,
    CASE WHEN feature LIKE '%\\_std' ESCAPE '\\' THEN 'std' ELSE 'mean' END AS stat
  FROM (SELECT *, 0.25 * corr_score + 0.30 * tree_score + 0.20 * pca_score + 0.25 * lasso_score AS weighted_score,
    (corr_score >= 0.5)::INT + (tree_score >= 0.5)::INT + (pca_score >= 0.5)::INT + (lasso_score >= 0.5)::INT
      AS method_agreement
  FROM (SELECT feature, coalesce(max(score) FILTER (method = 'corr'), 0) AS corr_score,
    coalesce(max(score) FILTER (method = 'tree'), 0) AS tree_score,
    coalesce(max(score) FILTER (method = 'pca'), 0) AS pca_score,
    coalesce(max(score) FILTER (method = 'lasso'), 0) AS lasso_score FROM scaled_scores GROUP BY feature))""")


def method_scores(spark, sf_dir):
    wide = prepared(spark, sf_dir).groupBy("feature").agg(
        *[make().alias(m) for m, make in METHODS.items()])
    return wide.unpivot(["feature"], list(METHODS), "method", "score").where(
        ~((F.col("method") == "lasso") & (F.col("feature") == "tax_mean")))


def ranking(spark, sf_dir):
    # the fixture always has three batches per feature, the first weight set
    return asn.combined_ranking(method_scores(spark, sf_dir), 100, 8)


@entry("scaled_scores", twin("""
  SELECT feature, method, round(score, 6) AS score FROM scaled_scores""", "scaled_scores"))
def scaled_scores(spark, sf_dir):
    return rounded(asn.min_max(method_scores(spark, sf_dir)), 6, "score")


RANK_COLUMNS = ["corr_score", "tree_score", "pca_score", "lasso_score", "weighted_score"]


@entry("combined_ranking", twin(f"""
  SELECT feature, {", ".join(f"round({c}, 6) AS {c}" for c in RANK_COLUMNS)}, method_agreement,
    CAST(rank AS INTEGER) AS rank, base_variable, stat, 0.25::DOUBLE AS w_corr, 0.30::DOUBLE AS w_tree,
    0.20::DOUBLE AS w_pca, 0.25::DOUBLE AS w_lasso FROM ranking""", "ranking"))
def combined_ranking(spark, sf_dir):
    return rounded(ranking(spark, sf_dir), 6, *RANK_COLUMNS)


@entry("fitted_ranking")
def fitted_ranking(spark, sf_dir):
    """The ranking from the four fitted methods."""
    rows = prepared(spark, sf_dir)
    matrix = lm.feature_matrix(rows)
    scores = asn.correlations(rows, with_p=False).select(
        "feature", F.lit("corr").alias("method"), F.col("combined").alias("score"))
    fitted = {
        "tree": asn.tree_score(forest(spark, sf_dir)),
        "pca": lm.component_importance(matrix).importance,
        "lasso": lm.sparse_regression(matrix).table,
    }
    for name, table in fitted.items():
        scores = scores.unionByName(table.select("feature", F.lit(name).alias("method"), "score"))
    return rounded(asn.combined_ranking(scores, matrix.n, len(matrix.names)), 6, *RANK_COLUMNS)


cte("variable_scores", ("ranking",), """
  SELECT base_variable AS variable, max(weighted_score) AS score FROM ranking GROUP BY base_variable""")


@entry("variable_ranking", twin("""
  SELECT variable, round(v.score, 6) AS score, CAST(row_number() OVER (ORDER BY v.score DESC, variable) AS INTEGER) AS rank,
    v.score >= cut AS strong, row_number() OVER (ORDER BY v.score DESC, variable) <= 3 AS top3
  FROM variable_scores v, (SELECT quantile_cont(score, 0.75) AS cut FROM variable_scores)""", "variable_scores"))
def variable_ranking(spark, sf_dir):
    return rounded(asn.variable_ranking(ranking(spark, sf_dir)), 6, "score")


@entry("best_row_per_variable", twin("""
  SELECT base_variable AS variable, CAST(rank AS INTEGER) AS rank, round(corr_score, 6) AS corr_score,
    round(tree_score, 6) AS tree_score, round(pca_score, 6) AS pca_score,
    round(lasso_score, 6) AS lasso_score, round(weighted_score, 6) AS avg_score, method_agreement
  FROM ranking QUALIFY row_number() OVER (PARTITION BY base_variable ORDER BY ranking.rank) = 1""", "ranking"))
def best_row_per_variable(spark, sf_dir):
    out = asn.best_rows(ranking(spark, sf_dir))
    return rounded(out, 6, "corr_score", "tree_score", "pca_score", "lasso_score", "avg_score")


# ── recommendations ──────────────────────────────────────────────────────────

cte("windows", ("marked",), """
  SELECT *, target_median - current_avg AS delta, (target_median - current_avg) / sd AS delta_sigma,
    abs(target_median - current_avg) / (CASE WHEN n_below > 1 AND sb > 0 THEN sqrt((st * st + sb * sb) / 2)
      ELSE sd END + 1e-9) AS cohens_d, rec_max - rec_min AS range_width,
    CASE WHEN target_median - current_avg > 0 THEN 'increase' ELSE 'decrease' END AS direction,
    CASE WHEN feature LIKE '%\\_std' ESCAPE '\\' THEN 'variability (std)' ELSE 'mean level' END AS stat_type
  FROM (SELECT feature, avg(value) AS current_avg,
      CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS sd,
      stddev_samp(value) FILTER (is_target) AS st, stddev_samp(value) FILTER (NOT is_target) AS sb,
      count(value) FILTER (is_target) AS n_target, count(value) FILTER (NOT is_target) AS n_below,
      quantile_cont(value, 0.1) FILTER (is_target) AS rec_min,
      quantile_cont(value, 0.9) FILTER (is_target) AS rec_max,
      quantile_cont(value, 0.5) FILTER (is_target) AS target_median FROM marked GROUP BY feature)""")
WINDOW_COLUMNS = ["current_avg", "target_median", "rec_min", "rec_max", "range_width", "delta",
                  "delta_sigma", "cohens_d"]


@entry("operating_windows", twin(f"""
  SELECT feature, {", ".join(f"round({c}, 5) AS {c}" for c in WINDOW_COLUMNS)}, direction, stat_type,
    n_target, n_below FROM windows""", "windows"))
def operating_windows(spark, sf_dir):
    return rounded(rc.operating_windows(marked(spark, sf_dir)), 5, *WINDOW_COLUMNS)


# Normal tail by Simpson's rule; from five batches on both sides.
cte("u_tests", ("marked",), """
  SELECT feature, n1 AS n_target, n2 AS n_below, tie_term, CASE WHEN n1 >= 5 AND n2 >= 5 THEN u END AS u,
    CASE WHEN n1 >= 5 AND n2 >= 5 THEN least(1.0, 1 - 2 * z / 4000 / 3 / sqrt(2 * pi()) *
      list_sum(list_transform(range(0, 4001), lambda k:
        (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * k / 4000, 2) / 2))))
      END AS p_value
  FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5) /
      sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z
    FROM (SELECT feature, sum(rk) FILTER (is_target) - any_value(n1) * (any_value(n1) + 1) / 2.0::DOUBLE AS u,
        any_value(n1) AS n1, any_value(n2) AS n2, sum(t * t - 1)::DOUBLE AS tie_term
      FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
          + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk,
          count(*) OVER (PARTITION BY feature, value) AS t,
          count(*) FILTER (is_target) OVER (PARTITION BY feature) AS n1,
          count(*) FILTER (NOT is_target) OVER (PARTITION BY feature) AS n2
        FROM marked) GROUP BY feature))""")


@entry("rank_tests", twin("""
  SELECT feature, n_target, n_below, tie_term, u, round(p_value, 6) AS p_value FROM u_tests""", "u_tests"))
def rank_tests(spark, sf_dir):
    return rounded(rc.rank_tests(marked(spark, sf_dir)), 6, "p_value")


cte("boot", ("marked",), """
  SELECT feature, rep, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM (
    SELECT d.feature, d.rep, v.value FROM (
      SELECT feature, rep, CAST('0x' || substr(md5(feature || '|' || rep || '|' || draw), 1, 8) AS BIGINT) % n AS idx
      FROM (SELECT feature, n, rep, unnest(range(0, n)) AS draw FROM (
        SELECT feature, count(*) AS n, unnest(range(0, 500)) AS rep FROM marked WHERE is_target GROUP BY feature))) d
    JOIN (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value, batch_id) - 1 AS idx
      FROM marked WHERE is_target) v ON v.feature = d.feature AND v.idx = d.idx)
  GROUP BY feature, rep""")


@entry("bootstrap_limits", twin("""
  SELECT feature, round(a, 5) AS p10_low, round(b, 5) AS p10_high, round(c, 5) AS p90_low,
    round(d, 5) AS p90_high, round((b - a + d - c) / 2, 5) AS ci_uncertainty
  FROM (SELECT feature, quantile_cont(p10, 0.05) AS a, quantile_cont(p10, 0.95) AS b,
    quantile_cont(p90, 0.05) AS c, quantile_cont(p90, 0.95) AS d FROM boot GROUP BY feature)""", "boot"))
def bootstrap_limits(spark, sf_dir):
    out = rc.bootstrap_limits(marked(spark, sf_dir))
    return rounded(out, 5, *[c for c in out.columns if c != "feature"])


cte("plan", ("windows", "u_tests"), """
  SELECT *, CAST(row_number() OVER (ORDER BY priority DESC, feature) AS INTEGER) AS rank,
    CASE WHEN priority >= 0.8 THEN 'Critical' WHEN priority >= 0.5 THEN 'High'
      WHEN priority >= 0.25 THEN 'Medium' ELSE 'Low' END AS tier
  FROM (SELECT w.*, p_value, coalesce(p_value < 0.05, false) AS significant,
    round(cohens_d * CASE WHEN coalesce(p_value < 0.05, false) THEN 1.5 ELSE 1 END, 3) AS priority
    FROM windows w LEFT JOIN (SELECT feature, p_value FROM u_tests) USING (feature))""")


def plan(spark, sf_dir):
    rows = marked(spark, sf_dir)
    return rc.priorities(rc.operating_windows(rows), rc.rank_tests(rows))


@entry("priorities", twin("""
  SELECT feature, priority, rank, tier, significant FROM plan""", "plan"))
def priorities(spark, sf_dir):
    return plan(spark, sf_dir).select("feature", "priority", "rank", "tier", "significant")


@entry("yield_correlation", twin("""
  SELECT feature, round(coalesce(abs(corr(value, yield)), 0), 3) AS abs_r FROM prepared GROUP BY feature""",
    "prepared"))
def yield_correlation(spark, sf_dir):
    return rounded(rc.yield_correlation(prepared(spark, sf_dir)), 3, "abs_r")


@entry("action_plan", twin("""
  SELECT feature, rank, tier, CASE WHEN abs(round(delta_sigma, 2)) < 0.1 THEN 'hold'
      WHEN delta > 0 THEN 'raise' ELSE 'lower' END AS action,
    CASE WHEN abs(round(delta_sigma, 2)) >= 0.1 THEN printf('%s (%s): %.3f -> %.3f, window %.3f to %.3f',
      feature, stat_type, round(current_avg, 3), round(target_median, 3), round(rec_min, 3), round(rec_max, 3)) END AS change
  FROM plan""", "plan"))
def action_plan(spark, sf_dir):
    named = lb.with_labels(plan(spark, sf_dir), lb.dimension(spark), "feature")
    return rc.action_text(named).select("feature", "rank", "tier", "action", "change")


@entry("top_actions", twin("""
  SELECT 'priority' AS list, feature, rank FROM (SELECT * FROM plan WHERE tier IN ('Critical', 'High')
    ORDER BY rank LIMIT 5)
  UNION ALL SELECT 'significant', feature, rank FROM (SELECT * FROM plan WHERE significant ORDER BY rank LIMIT 5)
  UNION ALL SELECT 'shifted', feature, rank FROM plan WHERE abs(round(delta_sigma, 2)) > 0.05""", "plan"))
def top_actions(spark, sf_dir):
    items = plan(spark, sf_dir)
    lists = {"priority": rc.top_actions(items, 5), "significant": rc.top_significant(items, 5),
             "shifted": rc.shifted(items)}
    parts = [t.select(F.lit(k).alias("list"), "feature", "rank") for k, t in lists.items()]
    return parts[0].union(parts[1]).union(parts[2])


# ── target trajectories and recipe ───────────────────────────────────────────

cte("curves", ("aligned", "segmented"), """
  SELECT *, target_mean + target_std AS target_upper, target_mean - target_std AS target_lower
  FROM (SELECT variable, step, max(time_norm) AS time_norm, avg(value) FILTER (is_target) AS target_mean,
      stddev_pop(value) FILTER (is_target) AS target_std, avg(value) FILTER (NOT is_target) AS below_mean,
      count(*) FILTER (is_target) AS n_target, count(*) FILTER (NOT is_target) AS n_below
    FROM aligned JOIN segmented USING (batch_id) GROUP BY variable, step) WHERE n_target >= 2""")
cte("recipe", ("curves", "phases"), """
  SELECT variable, phase, round(avg(target_mean), 3) AS setpoint, round(avg(target_lower), 3) AS lower,
    round(avg(target_upper), 3) AS upper, round(avg(below_mean), 3) AS below_mean,
    round(avg(target_mean) - avg(below_mean), 3) AS separation
  FROM curves JOIN phases ON time_norm BETWEEN lo AND hi GROUP BY variable, phase""")
CURVE_COLUMNS = ["target_mean", "target_std", "below_mean", "target_upper", "target_lower"]


@entry("target_trajectory", twin(f"""
  SELECT variable, CAST(step AS INTEGER) AS step, round(time_norm, 6) AS time_norm,
    {", ".join(f"round({c}, 5) AS {c}" for c in CURVE_COLUMNS)}, n_target, n_below FROM curves""", "curves"))
def target_trajectory(spark, sf_dir):
    out = pf.target_trajectory(fx.aligned(spark, sf_dir), fx.segmented(spark, sf_dir))
    return rounded(rounded(out, 5, *CURVE_COLUMNS), 6, "time_norm")


@entry("phase_recipe", twin("""
  SELECT *, abs(separation) > 1 AS wide_separation,
    row_number() OVER (PARTITION BY variable ORDER BY abs(separation) DESC, phase) = 1 AS critical
  FROM recipe""", "recipe"))
def phase_recipe(spark, sf_dir):
    return pf.phase_recipe(pf.target_trajectory(fx.aligned(spark, sf_dir), fx.segmented(spark, sf_dir)))


# ── overview ─────────────────────────────────────────────────────────────────


@entry("overview", twin("""
  SELECT count(*) AS n_batches, sum(is_golden::INT)::BIGINT AS n_golden, round(avg(yield), 6) AS avg_yield,
    4 AS n_variables FROM batches""", "batches"))
def overview(spark, sf_dir):
    return rounded(rc.overview(fx.batches(spark, sf_dir), fx.VARIABLES), 6, "avg_yield")


@entry("yield_by_quality", twin("""
  SELECT quality, round(avg(yield), 6) AS mean, round(stddev_samp(yield), 6) AS std, count(yield) AS n
  FROM batches GROUP BY quality""", "batches"))
def yield_by_quality(spark, sf_dir):
    return rounded(rc.yield_by_quality(fx.batches(spark, sf_dir)), 6, "mean", "std")


@entry("duration_histogram", twin("""
  SELECT quality, bin, round(min(lo + bin * (hi - lo) / 20.0::DOUBLE), 6) AS bin_start, count(*) AS n_batches
  FROM (SELECT quality, lo, hi, CAST(least(floor((duration - lo) / ((hi - lo) / 20.0::DOUBLE)), 19) AS INTEGER) AS bin
    FROM batches, (SELECT min(duration) AS lo, max(duration) AS hi FROM batches)) GROUP BY quality, bin""", "batches"))
def duration_histogram(spark, sf_dir):
    return rounded(rc.duration_histogram(fx.batches(spark, sf_dir)), 6, "bin_start")


@entry("yield_bars", twin("""
  SELECT batch_id, yield, quality, (SELECT quantile_cont(yield, 0.75) FROM batches) AS golden_line
  FROM batches""", "batches"))
def yield_bars(spark, sf_dir):
    return rc.yield_bars(fx.batches(spark, sf_dir))
