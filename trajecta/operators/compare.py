"""Runs against the profile by warping distance, and phase contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions.numeric import pearson
from trajecta.functions.warp import warp_distance
from trajecta.operators.align import phase_summary
from trajecta.operators.scale import quantiles


def _series(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    # grid points per series
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", F.col(value).alias("v")))),
                    lambda c: c["v"]).alias(name)
    )


def warp_from_profile(aligned: DataFrame, profile: DataFrame) -> DataFrame:
    """DTW distance of every run to the profile mean, per variable."""
    runs = _series(aligned, ["batch_id", "variable"], "value", "a")
    golden = _series(profile, ["variable"], "mean", "b")  # one row per variable
    return runs.join(golden, "variable").select(
        "batch_id", "variable", warp_distance("a", "b").alias("distance")
    )


def total_warp(distances: DataFrame, batches: DataFrame) -> DataFrame:
    """Sum over the variables, with yield and quality, nearest first."""
    return distances.groupBy("batch_id").agg(F.sum("distance").alias("total_distance")).join(
        batches.select("batch_id", "yield", "quality"), "batch_id", "left"
    ).orderBy("total_distance", "batch_id")


def warp_yield_link(totals: DataFrame) -> DataFrame:
    """One row: correlation of the total distance with the yield, and its tier."""
    out = totals.agg(pearson(F.col("total_distance"), F.col("yield")).alias("r"))
    label = F.when(F.col("r") < -0.5, "strong").when(F.col("r") < -0.2, "moderate").otherwise("weak")
    return out.withColumn("link", label)


def phase_contrast(aligned: DataFrame, batches: DataFrame) -> DataFrame:
    """Median phase mean of Golden and Poor runs, their gap and its direction."""
    labelled = phase_summary(aligned).join(batches.select("batch_id", "quality"), "batch_id")
    med = quantiles(labelled.where(F.col("quality").isin("Golden", "Poor")),
                    ["phase", "variable", "quality"], "mean", [0.5], "m")
    wide = med.groupBy("phase", "variable").agg(
        F.max(F.when(F.col("quality") == "Golden", F.col("m")[0])).alias("golden_median"),
        F.max(F.when(F.col("quality") == "Poor", F.col("m")[0])).alias("poor_median"),
    ).where("golden_median IS NOT NULL AND poor_median IS NOT NULL")
    gap = F.col("golden_median") - F.col("poor_median")
    return wide.select(
        "phase", "variable", "golden_median", "poor_median", F.abs(gap).alias("gap"),
        F.when(gap > 0, "higher").otherwise("lower").alias("direction"),
    )


def phase_boxes(aligned: DataFrame, batches: DataFrame) -> DataFrame:
    """Five-number summary of the phase means per quality tier."""
    labelled = phase_summary(aligned).join(batches.select("batch_id", "quality"), "batch_id")
    q = quantiles(labelled, ["phase", "variable", "quality"], "mean", [0, 0.25, 0.5, 0.75, 1], "q")
    names = ["low", "q1", "median", "q3", "high"]
    return q.select("phase", "variable", "quality", *[F.col("q")[i].alias(c) for i, c in enumerate(names)])
