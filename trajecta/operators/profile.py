"""Reference trajectory ("golden profile") with bands, and conformance to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta import config
from trajecta.functions.numeric import tier
from trajecta.functions.stats import t_quantile
from trajecta.operators.align import index_phase, with_phases
from trajecta.operators.label import ladder, mark_aligned
from trajecta.session import cut_lineage


def golden_members(batches: DataFrame, aligned: DataFrame) -> DataFrame:
    """Golden batch ids by the percentile ladder; empty when no rung holds."""
    marked = mark_aligned(batches, aligned)
    chosen = ladder(marked)
    return (
        marked.where("_in")
        .crossJoin(F.broadcast(chosen))
        .where(F.col("yield") >= F.col("yield_threshold"))
        .select("batch_id", "golden_pct_used", "yield_threshold")
    )


def golden_rows(batches: DataFrame, aligned: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Aligned rows of the golden members."""
    members = golden_members(batches, aligned) if members is None else members
    return aligned.join(members.select("batch_id"), "batch_id", "left_semi")


def erratic_rates(rows: DataFrame) -> DataFrame:
    """Share of steps beyond 2.5 population sigmas per batch and variable."""
    # one row per variable and step
    centre = rows.groupBy("variable", "step").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
    )
    z = F.abs(F.col("value") - F.col("_m")) / (F.col("_s") + 1e-9)
    return (
        rows.join(centre, ["variable", "step"])
        .groupBy("batch_id", "variable")
        .agg(F.avg(F.when(z > 2.5, 1.0).otherwise(0.0)).alias("rate"))
    )


def inconsistent_members(rows: DataFrame) -> DataFrame:
    """Golden batches to leave out: for some variable more than 30 % of the
    steps are beyond 2.5 sigmas.

    Nothing is left out under five members, or when fewer than three would stay.
    """
    per_batch = erratic_rates(rows).groupBy("batch_id").agg(
        F.max("rate").alias("worst_rate"),
        F.sort_array(F.collect_set(F.when(F.col("rate") > 0.30, F.col("variable")))).alias("causes"),
    )
    counts = per_batch.agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("worst_rate") <= 0.30, 1)).alias("_kept")
    )
    return (
        per_batch.crossJoin(F.broadcast(counts))
        .where((F.col("worst_rate") > 0.30) & (F.col("_n") >= 5) & (F.col("_kept") >= 3))
        .select("batch_id", "worst_rate", "causes")
    )


def band(rows: DataFrame, k_sigma: float = config.K_SIGMA) -> DataFrame:
    """The profile: mean, spread, interval and band per variable and step."""
    spread = rows.groupBy("variable", "step").agg(
        F.max("time_norm").alias("time_norm"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("n_golden"),
    )
    # the critical value is computed once per sample size
    sizes = spread.select("n_golden").distinct().withColumn(
        "t_crit",
        F.when(F.col("n_golden") >= 3,
               t_quantile(F.lit(1 - config.BAND_ALPHA / 2), (F.col("n_golden") - 1).cast("double")))
        .otherwise(F.lit(float(k_sigma))),
    )
    ci = F.col("t_crit") * F.col("std") / F.sqrt("n_golden")
    sigma = F.lit(float(k_sigma)) * F.col("std")
    half = F.greatest(ci, sigma)
    return spread.join(sizes, "n_golden").select(
        "variable", "step", "time_norm", "mean", "std",
        half.alias("half_width"),
        (F.col("mean") + half).alias("upper"),
        (F.col("mean") - half).alias("lower"),
        (F.col("mean") + ci).alias("ci_upper"),
        (F.col("mean") - ci).alias("ci_lower"),
        F.when(ci > sigma, "ci").otherwise("sigma").alias("band_source"),
        "n_golden", "t_crit",
    )


def build_profile(
    batches: DataFrame, aligned: DataFrame, consistent: bool = True, members: DataFrame | None = None
) -> DataFrame:
    """Profile of the golden set (see :func:`band` for the columns); ``members``
    are its batches when :func:`profile_members` has run already."""
    if members is None:
        members = (profile_members if consistent else golden_members)(batches, aligned)
        members = cut_lineage(members, "members")  # one row per golden batch
    return band(golden_rows(batches, aligned, members))


def profile_members(batches: DataFrame, aligned: DataFrame) -> DataFrame:
    """The batches behind the profile, one row each, with their ladder rung."""
    members = cut_lineage(golden_members(batches, aligned), "golden")  # one row per golden batch
    dropped = inconsistent_members(golden_rows(batches, aligned, members))
    return members.join(dropped, "batch_id", "left_anti")


def profile_meta(members: DataFrame) -> DataFrame:
    """One row: size, critical value, ladder rung and threshold.  The members
    themselves grow with the data and stay a table."""
    return members.agg(
        F.count(F.lit(1)).alias("n_golden"),
        F.max("golden_pct_used").alias("golden_pct_used"),
        F.max("yield_threshold").alias("yield_threshold"),
    ).withColumn(
        "t_crit", t_quantile(F.lit(1 - config.BAND_ALPHA / 2), (F.col("n_golden") - 1).cast("double"))
    ).withColumn("alpha", F.lit(config.BAND_ALPHA))


def require_profile(profile: DataFrame) -> DataFrame:
    """Raise when no rung of the ladder left three golden batches."""
    if profile.limit(1).count() == 0:
        raise ValueError("not enough batches with a yield to build a golden profile")
    return profile


def deviations(aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """Per cell: inside the band or not, and the signed z-score.

    The profile has variables x steps rows, so it is broadcast.
    """
    small = profile.select("variable", "step", "mean", "std", "half_width")
    x, mean, half = F.col("value"), F.col("mean"), F.col("half_width")
    inside = (x >= mean - half) & (x <= mean + half)
    return aligned.join(small, ["variable", "step"]).select(
        "batch_id", "variable", "step", "time_norm", "value",
        inside.alias("inside"),
        ((x - mean) / F.greatest(F.col("std"), F.lit(1e-9))).alias("z"),
    )


def conformance_by_variable(aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """Percent of steps inside the band per batch and variable."""
    hit = F.when(F.col("inside"), 100.0).otherwise(0.0)
    return deviations(aligned, profile).groupBy("batch_id", "variable").agg(
        F.avg(hit).alias("score")
    )


def conformance_by_phase(aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """Percent of steps inside the band per batch, variable and phase."""
    hit = F.when(F.col("inside"), 100.0).otherwise(0.0)
    return with_phases(deviations(aligned, profile)).groupBy("batch_id", "variable", "phase").agg(
        F.avg(hit).alias("score")
    )


def conformance(aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """Overall score: the plain mean of the variables' scores."""
    return conformance_by_variable(aligned, profile).groupBy("batch_id").agg(
        F.avg("score").alias("overall")
    )


def conformance_table(batches: DataFrame, aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """Scores with yield and tier, best first."""
    scores = conformance(aligned, profile).join(
        batches.select("batch_id", "yield"), "batch_id", "left"
    )
    return scores.select(
        "batch_id",
        F.round("overall", 1).alias("conformance_pct"),
        F.round("yield", 1).alias("yield_pct"),
        tier(F.round("overall", 1), [(80, "good"), (60, "watch")], "poor").alias("tier"),
    ).orderBy(F.desc("conformance_pct"), "batch_id")


def ideal_ranges(profile: DataFrame, points: int = config.GRID_POINTS) -> DataFrame:
    """Per variable and index-third phase, plus the whole run (phase NULL)."""
    return profile.withColumn("phase", index_phase(points)).groupBy("variable", "phase").agg(
        F.sum("mean").alias("_mean"), F.sum("std").alias("_std"), F.count(F.lit(1)).alias("_n"),
        F.min("lower").alias("_lower"), F.max("upper").alias("_upper"),
    ).rollup("variable", "phase").agg(
        F.round(F.sum("_mean") / F.sum("_n"), 3).alias("mean"),
        F.round(F.min("_lower"), 3).alias("lower"),
        F.round(F.max("_upper"), 3).alias("upper"),
        F.round(F.sum("_std") / F.sum("_n"), 3).alias("std"),
    ).where(F.col("variable").isNotNull())


def target_trajectory(aligned: DataFrame, segmented: DataFrame) -> DataFrame:
    """Target and below-target mean curves with a one-sigma band."""
    flags = segmented.select("batch_id", "is_target")
    hit, v = F.col("is_target"), F.col("value")
    out = aligned.join(flags, "batch_id").groupBy("variable", "step").agg(
        F.max("time_norm").alias("time_norm"),
        F.avg(F.when(hit, v)).alias("target_mean"),
        F.stddev_pop(F.when(hit, v)).alias("target_std"),
        F.avg(F.when(~hit, v)).alias("below_mean"),
        F.count(F.when(hit, 1)).alias("n_target"),
        F.count(F.when(~hit, 1)).alias("n_below"),
    ).where(F.col("n_target") >= 2)
    return out.withColumn("target_upper", F.col("target_mean") + F.col("target_std")).withColumn(
        "target_lower", F.col("target_mean") - F.col("target_std")
    )


def phase_recipe(trajectory: DataFrame) -> DataFrame:
    """Setpoint, bounds and separation per phase; marks the critical phase."""
    out = with_phases(trajectory).groupBy("variable", "phase").agg(
        F.avg("target_mean").alias("setpoint"),
        F.avg(F.col("target_mean") - F.col("target_std")).alias("lower"),
        F.avg(F.col("target_mean") + F.col("target_std")).alias("upper"),
        F.avg("below_mean").alias("below_mean"),
    ).withColumn("separation", F.round(F.col("setpoint") - F.col("below_mean"), 3))
    by_size = Window.partitionBy("variable").orderBy(
        F.abs("separation").desc_nulls_last(), "phase"
    )
    return out.select(
        "variable", "phase",
        *[F.round(c, 3).alias(c) for c in ("setpoint", "lower", "upper", "below_mean")],
        "separation",
        (F.abs("separation") > 1).alias("wide_separation"),
        ((F.row_number().over(by_size) == 1) & F.col("separation").isNotNull()).alias("critical"),
    )


def recipe_export(trajectory: DataFrame, variable: str) -> DataFrame:
    """The setpoint file of one variable, in time order."""
    return trajectory.where(F.col("variable") == variable).select(
        F.round(F.col("time_norm") * 100, 1).alias("time_pct"),
        F.round("target_mean", 4).alias(f"{variable}_setpoint"),
        F.round("target_lower", 4).alias(f"{variable}_lower_1sigma"),
        F.round("target_upper", 4).alias(f"{variable}_upper_1sigma"),
    ).orderBy("time_pct")
