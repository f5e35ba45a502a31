"""Quality labels, reference-set ladders, segments and small filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta import config
from trajecta.functions.numeric import first_rows, pearson
from trajecta.operators.scale import lookup, quantiles
from trajecta.session import cut_lineage

__all__ = [
    "label_quality", "choose_golden", "choose_training", "split_by_target", "default_target",
    "segment_summary", "by_quality", "prepare_features", "feature_source", "reconcile",
    "temperature_like", "build_flags", "dimension", "with_labels", "yield_link",
]


def yield_cuts(batches: DataFrame, probs: Sequence[float], name: str = "_cuts") -> DataFrame:
    """Quantiles of the batch yields."""
    return quantiles(batches, [], "yield", probs, name)


def label_quality(batches: DataFrame) -> DataFrame:
    """Add ``quality`` and ``is_golden`` from the yield quartiles.

    Labels need every yield and at least four batches.
    """
    cuts = yield_cuts(batches, [config.GOLDEN_PERCENTILE, config.GOOD_PERCENTILE])
    totals = batches.agg(
        F.count(F.lit(1)).alias("_n"), F.count("yield").alias("_known")
    )
    # one row on both sides; no cuts when no yield is known
    facts = totals.join(F.broadcast(cuts), F.lit(True), "left")
    usable = (F.col("_n") == F.col("_known")) & (F.col("_n") >= 4)
    golden = F.coalesce(usable & (F.col("yield") >= F.col("_cuts")[0]), F.lit(False))
    quality = (
        F.when(~usable, "Unknown")
        .when(F.col("yield") >= F.col("_cuts")[0], "Golden")
        .when(F.col("yield") >= F.col("_cuts")[1], "Good")
        .otherwise("Poor")
    )
    return (
        batches.crossJoin(F.broadcast(facts))
        .withColumn("quality", quality)
        .withColumn("is_golden", golden)
        .drop("_n", "_known", "_cuts")
    )


def _rungs(batches: DataFrame, probs: Sequence[float], eligible: Column) -> DataFrame:
    """One row: the cut and the number of eligible batches of every rung."""
    cuts = yield_cuts(batches, probs)
    counts = [
        F.count(F.when(eligible & (F.col("yield") >= F.col("_cuts")[i]), 1)).alias(f"n{i}")
        for i in range(len(probs))
    ]
    return batches.crossJoin(F.broadcast(cuts)).groupBy("_cuts").agg(*counts)


def mark_aligned(batches: DataFrame, aligned_ids: DataFrame) -> DataFrame:
    """Batches flagged ``_in`` when they have an aligned trajectory; written
    out, because the ladder reads it several times (one row per batch)."""
    ids = aligned_ids.select("batch_id").distinct().withColumn("_in", F.lit(True))
    marked = batches.select("batch_id", "yield").join(ids, "batch_id", "left")
    return cut_lineage(marked.withColumn("_in", F.coalesce("_in", F.lit(False))), "marked")


def choose_golden(
    batches: DataFrame, aligned_ids: DataFrame | None = None
) -> DataFrame:
    """One row ``(golden_pct_used, yield_threshold, n_golden)``: the first rung
    of the percentile ladder that leaves at least three aligned batches.

    A rung's cut uses every batch; its count only the aligned ones.  All
    columns are NULL when no rung qualifies.
    """
    if aligned_ids is None:
        return ladder(batches.withColumn("_in", F.lit(True)))
    return ladder(mark_aligned(batches, aligned_ids))


def ladder(marked: DataFrame) -> DataFrame:
    """The golden ladder over batches flagged by :func:`mark_aligned`."""
    probs = config.GOLDEN_LADDER
    rungs = _rungs(marked, probs, F.col("_in"))
    pct, cut, n = F, F, F
    for i, p in enumerate(probs):
        enough = F.col(f"n{i}") >= 3
        pct = pct.when(enough, F.lit(p))
        cut = cut.when(enough, F.col("_cuts")[i])
        n = n.when(enough, F.col(f"n{i}"))
    return rungs.select(
        pct.alias("golden_pct_used"), cut.alias("yield_threshold"), n.alias("n_golden")
    )


def choose_training(batches: DataFrame, target: float | None = None) -> DataFrame:
    """One row ``(n_good, threshold_used, rung)`` for the monitor fit; ``rung`` is
    ``target``, the ladder's code, or ``all``."""
    probs = [p for p, _ in config.TRAINING_LADDER]
    rungs = _rungs(batches.select("yield"), probs, F.lit(True))
    low = batches.agg(F.min("yield").alias("_min"), F.count("yield").alias("_all"),
                      F.count(F.when(F.col("yield") >= F.lit(target), 1)).alias("_user"))
    row = rungs.crossJoin(F.broadcast(low))
    n, cut, label = F, F, F
    if target is not None:
        enough = F.col("_user") >= 3
        n = n.when(enough, F.col("_user"))
        cut = cut.when(enough, F.lit(float(target)))
        label = label.when(enough, F.lit("target"))
    for i, (_, text) in enumerate(config.TRAINING_LADDER):
        enough = F.col(f"n{i}") >= 3
        n = n.when(enough, F.col(f"n{i}"))
        cut = cut.when(enough, F.col("_cuts")[i])
        label = label.when(enough, F.lit(text))
    return row.select(
        n.otherwise(F.col("_all")).alias("n_good"),
        cut.otherwise(F.col("_min")).alias("threshold_used"),
        label.otherwise(F.lit("all")).alias("rung"),
    )


def default_target(batches: DataFrame, saved: float | None = None) -> DataFrame:
    """One row ``target``: the saved value when in range, else p75, clamped to [1, 100]."""
    cut = yield_cuts(batches, [config.GOLDEN_PERCENTILE], "_cut")
    usable = saved is not None and 1.0 <= saved <= 100.0
    base = F.lit(float(saved)) if usable else F.col("_cut")[0]
    return cut.select(F.greatest(F.lit(1.0), F.least(F.lit(100.0), base)).alias("target"))


def split_by_target(batches: DataFrame, target: DataFrame) -> DataFrame:
    """Batches with a yield, flagged ``is_target``; ``target`` is one row."""
    return (
        batches.where(F.col("yield").isNotNull())
        .crossJoin(F.broadcast(target))
        .withColumn("is_target", F.col("yield") >= F.col("target"))
    )


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Counts, means, gap and uplift of the target and below-target groups."""
    hit = F.col("is_target")
    out = segmented.agg(
        F.max("target").alias("target"),
        F.count(F.when(hit, 1)).alias("n_target"),
        F.count(F.when(~hit, 1)).alias("n_below"),
        F.count(F.lit(1)).alias("n_total"),
        F.avg(F.when(hit, F.col("yield"))).alias("target_avg"),
        F.avg(F.when(~hit, F.col("yield"))).alias("below_avg"),
    )
    uplift = F.col("target_avg") - F.col("below_avg")
    return (
        out.withColumn("gap", F.col("target") - F.coalesce(F.col("below_avg"), F.col("target")))
        .withColumn("uplift", uplift)
        .withColumn("uplift_pct", uplift / F.greatest(F.col("below_avg"), F.lit(1e-6)) * 100)
        .withColumn("pct_at_target", F.lit(100.0) * F.col("n_target") / F.col("n_total"))
    )


def by_quality(batches: DataFrame, tiers: Sequence[str], first: int | None = None) -> DataFrame:
    """The batches of the wanted tiers by id, or the first of them."""
    return first_rows(batches.where(F.col("quality").isin(list(tiers))).orderBy("batch_id"), first)


def ranking_guard(features: DataFrame, batches: DataFrame, least: int = 5) -> DataFrame:
    """One row: shared batches, features with a value, batches left with a yield,
    and whether a ranking makes sense: ``least`` batches and one feature, before
    and after batches without a yield go."""
    shared = features.join(batches.select("batch_id", "yield"), "batch_id")
    known = F.col("yield").isNotNull()
    per_batch = shared.groupBy("batch_id").agg(F.max(known).alias("_known")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.count(F.when(F.col("_known"), 1)).alias("n_with_yield"))
    usable = shared.where("value IS NOT NULL").select("feature").distinct().agg(F.count(F.lit(1)).alias("n_features"))
    return per_batch.crossJoin(usable).withColumn(
        "enough", (F.col("n_batches") >= least) & (F.col("n_with_yield") >= least) & (F.col("n_features") >= 1))


def prepare_features(features: DataFrame, batches: DataFrame) -> DataFrame:
    """``(batch_id, feature, value, yield)`` ready for the rankings.

    Keeps batches present on both sides, drops all-NULL features, fills gaps
    with the feature mean (taken before batches without a yield go).
    """
    shared = features.join(batches.select("batch_id", "yield"), "batch_id")
    # one row per feature
    means = shared.groupBy("feature").agg(F.avg("value").alias("_mean")).where("_mean IS NOT NULL")
    return (
        lookup(shared, means, ["feature"])
        .where(F.col("yield").isNotNull())
        .select("batch_id", "feature", F.coalesce("value", "_mean").alias("value"), "yield")
    )


def feature_source(
    uploaded: DataFrame | None = None, summary: DataFrame | None = None,
    rich: DataFrame | None = None, basic: DataFrame | None = None,
) -> tuple[str, DataFrame]:
    """The best feature table at hand, with its name."""
    choices = (("uploaded", uploaded), ("summary", summary), ("rich", rich), ("basic", basic))
    for name, table in choices:
        if table is not None:
            return name, table
    raise ValueError("no feature table given")


def reconcile(selected: Sequence[str], profile: DataFrame) -> DataFrame:
    """Selected variables the profile has; every profile variable if none match."""
    spark = profile.sparkSession
    known = profile.select("variable").distinct()
    if len(set(selected)) < 2:
        raise ValueError("select at least two variables")
    wanted = spark.createDataFrame([(v,) for v in selected], "variable string")
    matched = known.join(wanted, "variable", "left_semi")
    any_match = matched.agg((F.count(F.lit(1)) > 0).alias("_any"))
    return (
        known.crossJoin(F.broadcast(any_match))
        .join(matched.withColumn("_hit", F.lit(True)), "variable", "left")
        .where(F.col("_hit") | ~F.col("_any"))
        .select("variable")
    )


def temperature_like(variables: DataFrame) -> DataFrame:
    """Variables named like a temperature, else the first one by ``ordinal``."""
    # The name fragments that mark a temperature.
    named = F.lower("variable").rlike("temp|temperature|tmp|t_")
    flagged = variables.withColumn("_named", named)
    seen = flagged.agg(F.max("_named").alias("_any"), F.min("ordinal").alias("_first"))
    return (
        flagged.crossJoin(F.broadcast(seen))
        .where(F.col("_named") | (~F.col("_any") & (F.col("ordinal") == F.col("_first"))))
        .select("variable")
    )


def build_flags(golden: DataFrame, training: DataFrame) -> DataFrame:
    """One row that tells whether the reference and the monitor set are degraded."""
    strong = F.col("rung").isin("target", config.TRAINING_LADDER[0][1])
    return golden.crossJoin(F.broadcast(training)).select(
        "golden_pct_used", "n_good", "rung",
        (F.col("golden_pct_used") < config.GOLDEN_PERCENTILE).alias("golden_degraded"),
        (~strong).alias("few_training_batches"),
        (F.lit(100) - F.floor(F.col("golden_pct_used") * 100)).cast("int").alias("top_pct"),
    )


def dimension(spark: SparkSession) -> DataFrame:
    """Label, target and unit of the standard variables."""
    rows = [(v, config.LABELS[v], config.TARGETS[v]) for v in config.VARIABLES]
    return spark.createDataFrame(rows, "variable string, label string, target_value double")


def with_labels(df: DataFrame, dim: DataFrame, column: str = "variable") -> DataFrame:
    """Add ``label`` and ``target_value``; unknown names keep their raw name.

    A trailing ``_mean`` or ``_std`` is not part of the variable's name.
    """
    base = F.regexp_replace(F.regexp_replace(F.col(column), "_mean", ""), "_std", "")
    names = dim.withColumnRenamed("variable", "_base")
    return (
        df.withColumn("_base", base)
        .join(names, "_base", "left")
        .withColumn("label", F.coalesce("label", column))
        .drop("_base")
    )


def yield_link(df: DataFrame, x: str, y: str = "yield") -> DataFrame:
    """Pearson r and least-squares line of ``y`` on ``x``; NULL under five pairs."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.agg(
        n.alias("n"),
        pearson(F.col(x), F.col(y)).alias("r"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    ).select(
        "n",
        *[F.when(F.col("n") >= 5, F.col(c)).alias(c) for c in ("r", "slope", "intercept")],
    )
