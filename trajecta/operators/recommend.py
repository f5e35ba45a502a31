"""Operating windows, tests, bootstrap intervals and the action plan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta import config
from trajecta.functions.numeric import first_rows, pearson, tier
from trajecta.functions.stats import mann_whitney_p
from trajecta.operators.label import yield_cuts
from trajecta.operators.scale import average_ranks, lookup, plain, positions, quantiles
from trajecta.session import cut_lineage


def mark_target(prepared: DataFrame, target: DataFrame) -> DataFrame:
    """``(batch_id, feature, value, yield, is_target)``; ``target`` is one row."""
    return prepared.crossJoin(F.broadcast(target)).withColumn(
        "is_target", F.col("yield") >= F.col("target")
    )


def power_tier(segments: DataFrame) -> DataFrame:
    """How much the group sizes let a test see."""
    least = F.when(F.col("n_below") > 0, F.least("n_target", "n_below")).otherwise(F.col("n_target"))
    return segments.withColumn("power", tier(least, [(20, "adequate"), (10, "limited")], "very low"))


def operating_windows(marked: DataFrame) -> DataFrame:
    """Per feature: P10/P90/median of the target group against all batches,
    shift, effect size and direction."""
    hit, v = F.col("is_target"), F.col("value")
    cuts = quantiles(marked.where(hit), ["feature"], "value", [0.10, 0.90, 0.50], "_q")
    stats = marked.groupBy("feature").agg(
        F.avg(v).alias("current_avg"), F.stddev_samp(v).alias("_sd"),
        F.stddev_samp(F.when(hit, v)).alias("_st"), F.stddev_samp(F.when(~hit, v)).alias("_sb"),
        F.count(F.when(hit, v)).alias("n_target"), F.count(F.when(~hit, v)).alias("n_below"),
    )
    std = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    delta = F.col("target_median") - F.col("current_avg")
    pooled = F.when(
        (F.col("n_below") > 1) & (F.col("_sb") > 0),
        F.sqrt((F.col("_st") * F.col("_st") + F.col("_sb") * F.col("_sb")) / 2),
    ).otherwise(std)
    # one row per feature
    return stats.join(cuts, "feature").withColumns({
        "rec_min": F.col("_q")[0], "rec_max": F.col("_q")[1], "target_median": F.col("_q")[2],
    }).select(
        "feature", "current_avg", "target_median", "rec_min", "rec_max",
        (F.col("rec_max") - F.col("rec_min")).alias("range_width"),
        delta.alias("delta"), (delta / std).alias("delta_sigma"),
        F.when(delta > 0, "increase").otherwise("decrease").alias("direction"),
        (F.abs(delta) / (pooled + 1e-9)).alias("cohens_d"),
        F.when(F.col("feature").endswith("_std"), "variability (std)").otherwise("mean level").alias("stat_type"),
        "n_target", "n_below",
    )


def rank_tests(marked: DataFrame, with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of target against below per feature.

    Rank sums come from counted distinct values, so no feature's values meet
    in one task.  U and p are NULL under five batches on a side.
    """
    ranks = average_ranks(marked, ["feature"], "value", "rank")
    hits = marked.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.when(F.col("is_target"), 1)).alias("_hits"))
    sums = ranks.join(hits, ["feature", "value"]).groupBy("feature").agg(
        F.sum(F.col("rank") * F.col("_hits")).alias("_r1"),
        F.sum("_hits").alias("n_target"),
        F.sum(F.col("ties") - F.col("_hits")).alias("n_below"),
        F.sum((F.col("ties").cast("double") * F.col("ties") * F.col("ties")) - F.col("ties")).alias("tie_term"),
    )
    n1, n2 = F.col("n_target"), F.col("n_below")
    enough = (n1 >= 5) & (n2 >= 5)
    out = sums.select(
        "feature", "n_target", "n_below", "tie_term",
        F.when(enough, F.col("_r1") - n1 * (n1 + 1) / 2).alias("u"),
    )
    if with_p:
        out = out.withColumn("p_value", mann_whitney_p(
            "u", n1.cast("double"), n2.cast("double"), "tie_term"))
    return out


TAILS = (0.10, 0.90)
_COUNTED = "feature string, rep int, _n long, _w long, bin long, _c long, _start long"


def _draw(feature: str, rep: int, n: int, begin: int, end: int) -> np.ndarray:
    """Positions of the draws ``begin`` to ``end`` of a repetition.

    Draw ``d`` is the number in the first eight hex digits of the MD5 of
    ``feature|rep|d``, modulo the size, so it is the same however the ranges are cut.
    """
    head = hashlib.md5(f"{feature}|{rep}|".encode(), usedforsecurity=False)
    words = bytearray()
    for d in range(begin, end):
        one = head.copy()
        one.update(b"%d" % d)
        words += one.digest()[:4]
    return np.frombuffer(words, ">u4").astype(np.int64) % n


def _counts(feature: str, rep: int, n: int, width: int, place, count, start) -> pa.RecordBatch:
    k = len(place)
    return pa.RecordBatch.from_arrays([
        pa.array([feature] * k, pa.string()), pa.array(np.full(k, rep, np.int32)), pa.array(np.full(k, n)),
        pa.array(np.full(k, width)), pa.array(place, pa.int64()), pa.array(count, pa.int64()),
        pa.array(start, pa.int64())], names=["feature", "rep", "_n", "_w", "bin", "_c", "_start"])


def _counted_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws of every (feature, repetition, range), only counted.

    A range that is a whole repetition gives the positions its percentiles lie between, with the
    draws below them; a part of one gives counts per bin of positions.
    """
    for batch in batches:
        for feature, rep, n, width, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            place = _draw(feature, rep, n, begin, end)
            if end - begin == n:
                place.sort()
                at = np.unique([place[int(edge((n - 1) * p))] for p in TAILS for edge in (np.floor, np.ceil)])
                low, high = place.searchsorted(at, "left"), place.searchsorted(at, "right")
                yield _counts(feature, rep, n, 1, at, high - low, low)
            else:
                found, count = np.unique(place // width, return_counts=True)
                yield _counts(feature, rep, n, width, found, count, [None] * len(found))


def _draws_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws of every range that lie in the wanted bins, counted per position; ``_start`` is the bin's."""
    for batch in batches:
        for feature, rep, n, width, begin, end, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            place = _draw(feature, rep, n, begin, end)
            bins = place // width
            for held in wanted:
                found, count = np.unique(place[bins == held["bin"]], return_counts=True)
                yield _counts(feature, rep, n, held["bin"], found, count, np.full(len(found), held["_start"]))


def bootstrap_limits(marked: DataFrame, reps: int = config.BOOTSTRAP_REPS) -> DataFrame:
    """90 % bootstrap intervals of P10 and P90 of the target group per feature.

    Draws are hashes of (feature, repetition, draw), so that every run of the
    job gives the same interval.  They never are rows: a task makes a whole
    repetition of up to ``BOOTSTRAP_RANGE`` draws and keeps the positions its
    percentiles lie between.  Larger ones are generated in split ranges and only
    counted: per bin of sorted positions first, then, where a bin holds more
    than one position, inside the bins that a percentile falls in.
    """
    target = marked.where(F.col("is_target") & F.col("value").isNotNull())
    placed, _ = positions(
        target, ["feature"], [F.col("value"), F.col("batch_id")], F.col("value"), "idx"
    )
    placed = plain(placed).select("feature", "idx", "value")
    sizes = cut_lineage(target.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    biggest, drawn_rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    biggest = biggest or 0
    # a task per so many draws: by number, as few small rows would else be put together into one task
    tasks = max(1, min(-(-(drawn_rows or 0) * reps // config.BOOTSTRAP_TASK), config.BOOTSTRAP_BINS))
    n = F.col("_n")

    def ranged(repeated: DataFrame) -> DataFrame:
        """A row per range of draws of every repetition, dealt over the tasks."""
        return repeated.withColumn(
            "_from", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(config.BOOTSTRAP_RANGE).cast("long")))
        ).withColumn("_to", F.least(F.col("_from") + config.BOOTSTRAP_RANGE, n)).repartition(
            tasks, "feature", "rep", "_from")

    ranks = F.array(*[
        F.struct(F.lit(tail).alias("tail"), edge((n - 1) * F.lit(p)).cast("long").alias("r"),
                 (share if side else 1 - share).alias("weight"))
        for tail, p in enumerate(TAILS)
        for share in [(n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p))]
        for side, edge in enumerate((F.floor, F.ceil))])

    def started(counted: DataFrame, within: list[str], at: str, base: Column) -> DataFrame:
        run = Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumn("_start", base + F.coalesce(F.sum("_c").over(run), F.lit(0)))

    def holding(counted: DataFrame) -> DataFrame:
        """A row per wanted rank, where it lies."""
        return counted.withColumn("t", F.explode(ranks)).select("*", "t.*").where(
            (F.col("r") >= F.col("_start")) & (F.col("r") < F.col("_start") + F.col("_c")))

    turns = sizes.where("_n >= 3").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn(
        "_w", F.ceil(n / config.BOOTSTRAP_BINS))
    columns = ["feature", "rep", "_n", "_w", "_from", "_to"]
    whole = ranged(turns.where(n <= config.BOOTSTRAP_RANGE)).select(*columns).mapInArrow(_counted_draws, _COUNTED)
    want = ["feature", "rep", "tail", "weight", F.col("bin").alias("idx")]
    drawn = holding(whole).select(*want)
    if biggest > config.BOOTSTRAP_RANGE:
        split = ranged(turns.where(n > config.BOOTSTRAP_RANGE)).select(*columns).mapInArrow(_counted_draws, _COUNTED)
        bins = split.groupBy("feature", "rep", "_n", "_w", "bin").agg(F.sum("_c").alias("_c"))
        found = cut_lineage(holding(started(bins, ["feature", "rep"], "bin", F.lit(0))), "bootstrap-bins")
        drawn = drawn.unionByName(found.where("_w = 1").select(*want))  # a bin is one position
        inside = ranged(found.where("_w > 1").groupBy("feature", "rep", "_n", "_w").agg(
            F.collect_set(F.struct("bin", "_start")).alias("_wanted")))
        within = ["feature", "rep", "_n", "_w", "_start"]  # _w is the wanted bin here, as bin is the position
        counted = inside.select(*columns, "_wanted").mapInArrow(_draws_inside, _COUNTED).groupBy(
            *within, "bin").agg(F.sum("_c").alias("_c"))
        drawn = drawn.unionByName(holding(started(counted, within, "bin", F.col("_start"))).select(*want))
    share = F.col("value") * F.col("weight")
    # four rows per feature and repetition meet all values of the target group: neither is broadcast
    tails = drawn.join(placed.hint("merge"), ["feature", "idx"]).groupBy("feature", "rep").agg(
        F.sum(F.when(F.col("tail") == 0, share)).alias("p10"), F.sum(F.when(F.col("tail") == 1, share)).alias("p90"))
    ci = F.array(F.lit(0.05), F.lit(0.95))
    out = tails.groupBy("feature").agg(
        F.percentile("p10", ci).alias("a"), F.percentile("p90", ci).alias("b"))
    # groups of one or two keep their point values
    few = quantiles(
        lookup(target, sizes.where("_n < 3").select("feature"), ["feature"], "left_semi"),
        ["feature"], "value", [0.10, 0.90], "q",
    ).select("feature", F.array(F.col("q")[0], F.col("q")[0]).alias("a"),
             F.array(F.col("q")[1], F.col("q")[1]).alias("b"))
    both = out.unionByName(few)
    return both.select(
        "feature", F.col("a")[0].alias("p10_low"), F.col("a")[1].alias("p10_high"),
        F.col("b")[0].alias("p90_low"), F.col("b")[1].alias("p90_high"),
    ).withColumn(
        "ci_uncertainty",
        (F.col("p10_high") - F.col("p10_low") + F.col("p90_high") - F.col("p90_low")) / 2,
    )


def priorities(windows: DataFrame, tests: DataFrame) -> DataFrame:
    """Effect size, raised by half when significant; rank and tier."""
    significant = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    scored = windows.join(
        tests.select("feature", "p_value"), "feature", "left"
    ).withColumn("significant", significant).withColumn(
        "priority", F.round(F.col("cohens_d") * F.when(significant, 1.5).otherwise(1.0), 3)
    )
    # one row per feature: a single ordered window is small
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "feature"))
    return scored.withColumn("rank", place).withColumn("tier", tier(
        F.col("priority"), [(0.8, "Critical"), (0.5, "High"), (0.25, "Medium")], "Low"))


def yield_correlation(prepared: DataFrame) -> DataFrame:
    """|r| of every feature with the yield, 0 where undefined."""
    return prepared.groupBy("feature").agg(
        F.coalesce(F.abs(pearson(F.col("value"), F.col("yield"))), F.lit(0.0)).alias("abs_r"))


def model_agreement(plan: DataFrame, direction: DataFrame) -> DataFrame:
    """Whether the forecast model moves a variable the way the data does."""
    base = F.regexp_replace(F.regexp_replace("feature", "_mean", ""), "_std", "")
    signs = direction.select(F.col("variable").alias("_base"), F.col("direction").alias("coef"))
    agrees = (F.col("coef") > 0) == (F.col("delta") > 0)
    return plan.withColumn("_base", base).join(signs, "_base", "left").drop(
        "_base").withColumn(
        "model_direction", F.when(F.col("coef") > 0, "up").when(F.col("coef").isNotNull(), "down")
    ).withColumn("model_agrees", F.when(F.col("coef").isNotNull(), agrees))


def action_text(plan: DataFrame) -> DataFrame:
    """What to do per feature: a code (``hold``, ``raise``, ``lower``) and, for
    ``label``, the move and the window it should end in."""
    hold = F.abs(F.round("delta_sigma", 2)) < 0.1
    code = F.when(hold, "hold").when(F.col("delta") > 0, "raise").otherwise("lower")
    digits = [F.round(c, 3) for c in ("current_avg", "target_median", "rec_min", "rec_max")]
    move = F.format_string("%s (%s): %.3f -> %.3f, window %.3f to %.3f", "label", "stat_type", *digits)
    return plan.withColumn("action", code).withColumn(
        "change", F.when(hold, F.lit(None).cast("string")).otherwise(move))


def top_actions(plan: DataFrame, first: int | None = None) -> DataFrame:
    """The Critical and High items by rank, or the ``first`` of them."""
    return first_rows(plan.where(F.col("tier").isin("Critical", "High")).orderBy("rank"), first)


def top_significant(plan: DataFrame, first: int | None = None) -> DataFrame:
    return first_rows(plan.where("significant").orderBy("rank"), first)


def shifted(plan: DataFrame, least: float = 0.05) -> DataFrame:
    """Features whose target median is off the current mean."""
    return plan.where(F.abs(F.round("delta_sigma", 2)) > least)


# ── overview ─────────────────────────────────────────────────────────────────


def overview(batches: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Headline numbers of a data set."""
    out = batches.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum(F.col("is_golden").cast("long")).alias("n_golden"),
        F.avg("yield").alias("_y"), F.count("yield").alias("_k"),
    )
    return out.select(
        "n_batches", "n_golden",
        F.when(F.col("_k") == F.col("n_batches"), F.col("_y")).alias("avg_yield"),
        F.lit(len(list(variables))).alias("n_variables"),
    )


def yield_by_quality(batches: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("Golden", "Good", "Poor"))), F.col("quality"))
    return batches.where(F.col("quality").isin("Golden", "Good", "Poor")).groupBy("quality").agg(
        F.avg("yield").alias("mean"), F.stddev_samp("yield").alias("std"),
        F.count("yield").alias("n"),
    ).orderBy(order)


def duration_histogram(batches: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width duration bins per quality tier."""
    span = batches.agg(F.min("duration").alias("_lo"), F.max("duration").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.least(F.floor(F.try_divide(F.col("duration") - F.col("_lo"), width)), F.lit(bins - 1))
    return batches.crossJoin(F.broadcast(span)).withColumn(
        "bin", F.coalesce(at, F.lit(0)).cast("int")
    ).groupBy("quality", "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        F.count(F.lit(1)).alias("n_batches"),
    )


def yield_bars(batches: DataFrame) -> DataFrame:
    """Batches by yield, best first, with the golden line."""
    cut = yield_cuts(batches, [config.GOLDEN_PERCENTILE], "_cut").select(
        F.col("_cut")[0].alias("golden_line"))
    return batches.crossJoin(F.broadcast(cut)).select(
        "batch_id", "yield", "quality", "golden_line").orderBy(F.desc("yield"), "batch_id")
