"""Evidence that links features to the yield, and the combined ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.numeric import finite, first_rows, pearson
from trajecta.functions.stats import correlation_p
from trajecta.operators.linear_models import FeatureMatrix, vector_frame
from trajecta.operators.scale import average_ranks, lookup


def correlations(prepared: DataFrame, with_p: bool = True) -> DataFrame:
    """Pearson, Spearman, p-value and combined score per feature.

    Under five complete pairs r and rho are 0 and p is 1; a constant feature
    has NULL.
    """
    pairs = prepared.where(F.col("value").isNotNull() & F.col("yield").isNotNull())
    x_rank = average_ranks(pairs, ["feature"], "value", "rx").drop("ties")
    y_rank = average_ranks(pairs, ["feature"], "yield", "ry").drop("ties")
    ranked = lookup(lookup(pairs, x_rank, ["feature", "value"]), y_rank, ["feature", "yield"])
    out = ranked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("value"), F.col("yield")).alias("_r"),
        pearson(F.col("rx"), F.col("ry")).alias("_rho"),
    )
    enough = F.col("n") >= 5
    out = out.select(
        "feature", "n",
        F.when(enough, F.col("_r")).otherwise(F.lit(0.0)).alias("pearson"),
        F.when(enough, F.col("_rho")).otherwise(F.lit(0.0)).alias("spearman"),
    )
    out = out.withColumn("combined", (F.abs("pearson") + F.abs("spearman")) / 2)
    if with_p:
        p = correlation_p(F.col("pearson"), F.col("n").cast("double"))
        out = out.withColumn("p_value", F.when(F.col("n") >= 5, p).otherwise(F.lit(1.0)))
    return out


def strength(score: Column) -> Column:
    return F.when(score > 0.7, "strong").when(score > 0.4, "moderate").otherwise("weak")


def strongest(scores: DataFrame, first: int | None = None) -> DataFrame:
    """The features by combined score, or the ``first`` of them."""
    return first_rows(scores.orderBy(F.desc_nulls_last("combined"), "feature"), first).withColumn(
        "strength", strength(F.col("combined"))
    )


def trend_lines(prepared: DataFrame, top: DataFrame) -> DataFrame:
    """Least-squares line, r and its p-value of every top feature."""
    x, y = F.col("value"), F.col("yield")
    lines = lookup(prepared, top.select("feature"), ["feature"], "left_semi").groupBy(
        "feature"
    ).agg(
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
        pearson(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )
    return lines.withColumn("p_value", correlation_p(F.col("r"), F.col("n").cast("double")))


def significant(scores: DataFrame, level: float = 0.05) -> DataFrame:
    """One row: features tested, and those with a p-value under ``level``."""
    return scores.agg(F.count("p_value").alias("n_features"),
                      F.count(F.when(F.col("p_value") < level, 1)).alias("n_significant"))


TREE_PARTS = 8
TREE_ROWS = 50_000  # batches of a part


@dataclass(frozen=True)
class TreeSizes:
    """Model sizes that fit the number of batches and features."""

    forest_depth: int
    boosted_depth: int
    trees: int
    warning: str | None


def tree_sizes(n: int, p: int) -> TreeSizes:
    # Depth and size per batches-to-features ratio.
    if n >= 3 * p:
        return TreeSizes(6, 4, 300, None)
    if n >= 2 * p:
        return TreeSizes(3, 2, 200, f"moderate overfitting risk ({n} batches, {p} features)")
    return TreeSizes(2, 1, 100, f"high overfitting risk ({n} batches, {p} features)")


def _importances(matrix: FeatureMatrix, estimator) -> DataFrame:
    # sampling draws by part, so the parts follow from the batches alone: their number from
    # the count, their rows from the ids, in order; cores, input splits and settings don't matter
    parts = max(TREE_PARTS, -(-matrix.n // TREE_ROWS))
    data = matrix.rows.select("batch_id", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    data = data.repartition(parts, "batch_id").sortWithinPartitions("batch_id").drop("batch_id").persist()
    found = estimator.fit(data).featureImportances.toArray()
    data.unpersist()
    return vector_frame(matrix.rows.sparkSession, matrix.names, importance=found)


def forest_importance(matrix: FeatureMatrix, trees: int | None = None, seed: int = 42) -> DataFrame:
    """Random-forest importances, all features tried at every split."""
    size = tree_sizes(matrix.n, len(matrix.names))
    return _importances(matrix, RandomForestRegressor(
        numTrees=trees or size.trees, maxDepth=size.forest_depth,
        minInstancesPerNode=max(2, matrix.n // 10), featureSubsetStrategy="all",
        subsamplingRate=1.0, seed=seed,
    ))


def boosted_importance(matrix: FeatureMatrix, trees: int | None = None, seed: int = 42) -> DataFrame:
    """Gradient-boosted importances; columns are drawn per node."""
    size = tree_sizes(matrix.n, len(matrix.names))
    n = matrix.n
    return _importances(matrix, GBTRegressor(
        maxIter=trees or size.trees, maxDepth=size.boosted_depth, stepSize=0.05,
        subsamplingRate=min(0.8, max(0.5, n / (n + 10))), featureSubsetStrategy="0.8", seed=seed,
    ))


def tree_score(forest: DataFrame, boosted: DataFrame | None = None) -> DataFrame:
    """Mean of the importances, each normalised to sum 1 (one row per feature)."""
    both = forest.withColumn("m", F.lit(0))
    if boosted is not None:
        both = both.unionByName(boosted.withColumn("m", F.lit(1)))
    total = F.sum("importance").over(Window.partitionBy("m"))
    return both.withColumn("share", F.try_divide(F.col("importance"), total)).groupBy("feature").agg(
        F.avg(F.coalesce("share", F.lit(0.0))).alias("score")
    )


def min_max(scores: DataFrame, by: str = "method") -> DataFrame:
    """Scale ``score`` to [0, 1] per method."""
    # methods x features rows
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", (F.col("score") - low) / (high - low + F.lit(1e-9)))


# Method weights per batches-to-features ratio.
WEIGHTS = {
    "large": {"corr": 0.25, "tree": 0.30, "pca": 0.20, "lasso": 0.25},
    "medium": {"corr": 0.30, "tree": 0.20, "pca": 0.15, "lasso": 0.35},
    "small": {"corr": 0.35, "tree": 0.10, "pca": 0.10, "lasso": 0.45},
}


def method_weights(n: int, p: int) -> dict[str, float]:
    ratio = n / max(p, 1)
    return WEIGHTS["large" if ratio >= 3 else "medium" if ratio >= 2 else "small"]


def base_variable(feature: Column) -> Column:
    # The statistic suffixes.
    return F.regexp_replace(
        feature, "_(mean|std|startup_mean|reaction_mean|harvest_mean|slope|auc_norm)$", ""
    )


def stat_label(feature: Column) -> Column:
    # The statistic names.
    return (
        F.when(feature.contains("_startup_mean"), "startup mean")
        .when(feature.contains("_reaction_mean"), "reaction mean")
        .when(feature.contains("_harvest_mean"), "harvest mean")
        .when(feature.contains("_slope"), "slope")
        .when(feature.contains("_auc_norm"), "AUC")
        .when(feature.endswith("_std"), "std")
        .otherwise("mean")
    )


def combined_ranking(scores: DataFrame, n: int, p: int) -> DataFrame:
    """Weighted ranking from ``(method, feature, score)`` of the four methods.

    Missing scores count as 0; ties go to the smaller feature name.
    """
    weights = method_weights(n, p)
    wide = min_max(scores).groupBy("feature").pivot("method", list(weights)).agg(F.first("score"))
    wide = wide.select("feature", *[
        F.coalesce(m, F.lit(0.0)).alias(f"{m}_score") for m in weights
    ])
    total = sum((F.col(f"{m}_score") * w for m, w in weights.items()), F.lit(0.0))
    votes = sum(((F.col(f"{m}_score") >= 0.5).cast("int") for m in weights), F.lit(0))
    out = wide.withColumn("weighted_score", total).withColumn("method_agreement", votes)
    # one row per feature: a single ordered window is small
    place = F.row_number().over(Window.orderBy(F.desc("weighted_score"), "feature"))
    return out.select(
        "*", place.alias("rank"),
        base_variable(F.col("feature")).alias("base_variable"),
        stat_label(F.col("feature")).alias("stat"),
        *[F.lit(w).alias(f"w_{m}") for m, w in weights.items()],
    )


def variable_ranking(ranking: DataFrame) -> DataFrame:
    """Best score per variable, with the p75 cut and the top-3 mark."""
    best = ranking.groupBy("base_variable").agg(F.max("weighted_score").alias("score"))
    cut = best.agg(F.percentile("score", F.lit(0.75)).alias("strong_cut"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "base_variable"))
    return best.crossJoin(F.broadcast(cut)).select(
        F.col("base_variable").alias("variable"), "score", place.alias("rank"),
        (F.col("score") >= F.col("strong_cut")).alias("strong"), (place <= 3).alias("top3"),
    )


def best_rows(ranking: DataFrame) -> DataFrame:
    """The best-ranked row per variable, ready for saving."""
    w = Window.partitionBy("base_variable").orderBy("rank")
    return ranking.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(
        F.col("base_variable").alias("variable"), "rank",
        *[finite(F.col(c)).alias(c) for c in ("corr_score", "tree_score", "pca_score", "lasso_score")],
        finite(F.col("weighted_score")).alias("avg_score"), "method_agreement",
    )
