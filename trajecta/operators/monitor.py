"""Multivariate monitoring (T², SPE) and outcome forecasting.

Future cells of an unfinished run are set to the training mean, which is zero
after scaling.  Scores are then running sums over the steps, so every step of
every run costs one pass instead of one projection per step.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta import config
from trajecta.functions.numeric import tier
from trajecta.operators.align import AlignedRuns, index_phase
from trajecta.operators.label import choose_training, yield_cuts
from trajecta.operators.linear_models import (
    RowProducts, RunRows, cell_table, cross_products, kernel_pls, principal_axes, run_scaler, scaled_matrix,
    scaled_rows, scaler, stacked, term_arrays,
)
from trajecta.operators.scale import quantiles
from trajecta.session import cut_lineage

# ── scoring against a model table ────────────────────────────────────────────


def scaled_cells(aligned: DataFrame, terms: DataFrame) -> DataFrame:
    """Cells with ``z`` and the model's per-cell terms (variables x steps rows)."""
    return aligned.join(terms, ["variable", "step"]).withColumn(
        "z", (F.col("value") - F.col("mu")) / F.col("sigma")
    )


def _score_sums(components: int, column: str = "loadings") -> list[Column]:
    return [
        F.sum(F.col("z") * F.col(column)[a]).alias(f"_s{a}") for a in range(components)
    ]


def _t2_spe(components: int) -> tuple[Column, Column]:
    t2 = sum((F.col(f"_s{a}") * F.col(f"_s{a}") / F.col("eigenvalues")[a] for a in range(components)), F.lit(0.0))
    inside = sum((F.col(f"_s{a}") * F.col(f"_s{a}") for a in range(components)), F.lit(0.0))
    return t2, F.col("_q") - inside


def run_statistics(aligned: DataFrame, terms: DataFrame, meta: DataFrame, components: int) -> DataFrame:
    """T² and SPE of every complete run."""
    sums = scaled_cells(aligned, terms).groupBy("batch_id").agg(
        F.sum(F.col("z") * F.col("z")).alias("_q"), *_score_sums(components)
    )
    t2, spe = _t2_spe(components)
    return sums.crossJoin(F.broadcast(meta.select("eigenvalues"))).select(
        "batch_id", t2.alias("t2"), spe.alias("spe")
    )


def control_limits(stats: DataFrame) -> DataFrame:
    """One row: the 95 % and 99 % empirical limits of T² and SPE."""
    probs = [p / 100 for p in config.LIMIT_PERCENTILES]
    t2 = quantiles(stats, [], "t2", probs, "a")
    spe = quantiles(stats, [], "spe", probs, "b")
    return t2.crossJoin(spe).select(
        F.col("a")[0].alias("t2_95"), F.col("a")[1].alias("t2_99"),
        F.col("b")[0].alias("spe_95"), F.col("b")[1].alias("spe_99"),
    )


def monitor_steps(aligned: DataFrame, terms: DataFrame, meta: DataFrame, components: int) -> DataFrame:
    """T², SPE and breaches of every run at every step, future cells at the mean."""
    per_step = scaled_cells(aligned, terms).groupBy("batch_id", "step").agg(
        F.sum(F.col("z") * F.col("z")).alias("_q"), *_score_sums(components)
    )
    # one row per step and run
    so_far = Window.partitionBy("batch_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = per_step.select(
        "batch_id", (F.col("step") + 1).alias("time_step"),
        *[F.sum(c).over(so_far).alias(c) for c in ["_q", *[f"_s{a}" for a in range(components)]]],
    )
    t2, spe = _t2_spe(components)
    return running.crossJoin(F.broadcast(meta)).select(
        "batch_id", "time_step", t2.alias("t2"), spe.alias("spe"),
        (t2 > F.col("t2_95")).alias("t2_breach_95"), (t2 > F.col("t2_99")).alias("t2_breach_99"),
        (spe > F.col("spe_95")).alias("spe_breach_95"), (spe > F.col("spe_99")).alias("spe_breach_99"),
    )


def shown_step(progress_pct: int, points: int = config.GRID_POINTS) -> int:
    return max(1, int(progress_pct * points / 100))


def contributions(
    aligned: DataFrame, terms: DataFrame, components: int, current: int = config.GRID_POINTS
) -> DataFrame:
    """Share of the SPE per variable at step ``current`` (1-based), largest first.

    The residual of a cell is z minus its reconstruction; its square summed
    over a variable needs only three small sums per batch and variable.
    """
    n = range(components)
    seen = scaled_cells(aligned, terms).where(F.col("step") < current).groupBy(
        "batch_id", "variable"
    ).agg(F.sum(F.col("z") * F.col("z")).alias("_q"), *_score_sums(components))
    # one row per variable: products of the loadings over all steps
    products = terms.groupBy("variable").agg(*[
        F.sum(F.col("loadings")[a] * F.col("loadings")[b]).alias(f"_m{a}_{b}")
        for a in n for b in n
    ])
    whole = Window.partitionBy("batch_id")
    totals = seen.withColumns({f"_t{a}": F.sum(f"_s{a}").over(whole) for a in n})
    cross = sum((F.col(f"_t{a}") * F.col(f"_s{a}") for a in n), F.lit(0.0))
    square = sum(
        (F.col(f"_t{a}") * F.col(f"_t{b}") * F.col(f"_m{a}_{b}") for a in n for b in n), F.lit(0.0)
    )
    parts = totals.join(products, "variable").withColumn(
        "_e", F.col("_q") - 2 * cross + square
    )
    total = F.sum("_e").over(whole)
    share = F.when(total == 0, F.col("_e")).otherwise(F.col("_e") / total * 100)
    place = F.row_number().over(whole.orderBy(F.desc("contribution"), "variable"))
    return parts.withColumn("contribution", share).select(
        "batch_id", "variable", "contribution", place.alias("place")
    )


def contribution_trajectory(aligned: DataFrame, terms: DataFrame, components: int) -> DataFrame:
    """SPE share per variable at every step of every run."""
    n = range(components)
    so_far = Window.partitionBy("batch_id", "variable").orderBy("step").rowsBetween(
        Window.unboundedPreceding, 0)
    z = F.col("z")
    cells = scaled_cells(aligned, terms).select(
        "batch_id", "variable", "step", F.sum(z * z).over(so_far).alias("_q"),
        *[F.sum(z * F.col("loadings")[a]).over(so_far).alias(f"_s{a}") for a in n],
    )
    products = terms.groupBy("variable").agg(*[
        F.sum(F.col("loadings")[a] * F.col("loadings")[b]).alias(f"_m{a}_{b}")
        for a in n for b in n
    ])
    at = Window.partitionBy("batch_id", "step")
    totals = cells.withColumns({f"_t{a}": F.sum(f"_s{a}").over(at) for a in n})
    cross = sum((F.col(f"_t{a}") * F.col(f"_s{a}") for a in n), F.lit(0.0))
    square = sum(
        (F.col(f"_t{a}") * F.col(f"_t{b}") * F.col(f"_m{a}_{b}") for a in n for b in n), F.lit(0.0)
    )
    parts = totals.join(products, "variable").withColumn(
        "_e", F.col("_q") - 2 * cross + square
    )
    total = F.sum("_e").over(at)
    share = F.when(total == 0, F.col("_e")).otherwise(F.col("_e") / total * 100)
    return parts.select(
        "batch_id", "variable", (F.col("step") + 1).alias("time_step"), share.alias("contribution")
    )


def alarm_states(steps: DataFrame, progress_pct: int) -> DataFrame:
    """State and message of every run at a progress, with the run rule up to it."""
    current = shown_step(progress_pct)
    visible = with_run_rule(steps.where(F.col("time_step") <= current))
    high = F.concat_ws(
        " | ", F.when(F.col("t2_breach_99"), "T2 > 99% limit"),
        F.when(F.col("spe_breach_99"), "SPE > 99% limit"),
    )
    state = (
        F.when(F.col("t2_breach_99") | F.col("spe_breach_99"), "ALARM")
        .when(F.col("t2_breach_95") | F.col("spe_breach_95"), "WARNING")
        .otherwise("IN CONTROL")
    )
    sustained = visible.groupBy("batch_id").agg(
        F.max("t2_sustained").alias("t2_sustained"), F.max("spe_sustained").alias("spe_sustained")
    )
    return visible.where(F.col("time_step") == current).select(
        "batch_id", "time_step", state.alias("state"), high.alias("message"),
    ).join(sustained, "batch_id")


def with_run_rule(steps: DataFrame, run: int = 3) -> DataFrame:
    """Mark steps that end ``run`` consecutive 95 % breaches of one statistic."""
    w = Window.partitionBy("batch_id").orderBy("time_step").rowsBetween(-(run - 1), 0)

    def rule(column: str) -> Column:
        return F.sum(F.col(column).cast("int")).over(w) == run

    return steps.withColumn("t2_sustained", rule("t2_breach_95")).withColumn(
        "spe_sustained", rule("spe_breach_95")
    )


def longest_streaks(steps: DataFrame) -> DataFrame:
    """Longest run of 95 % breaches per batch and statistic."""
    out = []
    for name in ("t2", "spe"):
        w = Window.partitionBy("batch_id").orderBy("time_step")
        islands = steps.where(F.col(f"{name}_breach_95")).select(
            "batch_id", (F.col("time_step") - F.row_number().over(w)).alias("g")
        )
        out.append(islands.groupBy("batch_id", "g").agg(F.count(F.lit(1)).alias("k")).groupBy(
            "batch_id").agg(F.max("k").alias(f"{name}_streak")))
    ids = steps.select("batch_id").distinct()
    joined = ids.join(out[0], "batch_id", "left").join(out[1], "batch_id", "left")
    return joined.na.fill(0, ["t2_streak", "spe_streak"])


def quadrant(t2: Column, spe: Column, t2_limit: Column, spe_limit: Column) -> Column:
    """Meaning of a (T², SPE) pair against its limits."""
    return (
        F.when((t2 > t2_limit) & (spe > spe_limit), "severe deviation")
        .when(t2 > t2_limit, "known-direction shift")
        .when(spe > spe_limit, "novel pattern")
        .otherwise("normal")
    )


def fleet_view(stats: DataFrame, meta: DataFrame, batches: DataFrame) -> DataFrame:
    """Every run's T² and SPE with yield, quality and quadrant."""
    limits = meta.select("t2_95", "spe_95")
    return stats.join(batches.select("batch_id", "yield", "quality"), "batch_id", "left").crossJoin(
        F.broadcast(limits)
    ).select(
        "batch_id", "t2", "spe", "yield", F.coalesce("quality", F.lit("Unknown")).alias("quality"),
        quadrant(F.col("t2"), F.col("spe"), F.col("t2_95"), F.col("spe_95")).alias("quadrant"),
    )


def forecast(aligned: DataFrame | AlignedRuns, terms: DataFrame, meta: DataFrame) -> DataFrame:
    """Predicted yield of every complete run."""
    if isinstance(aligned, AlignedRuns):
        matrix, (coef,) = scaled_matrix(aligned, terms), term_arrays(terms, aligned.variables, "coef")
        start = meta.first()["intercept"]

        def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                found = [matrix(pdf.iloc[i:i + 64]) @ coef for i in range(0, len(pdf), 64)]
                yield pd.DataFrame({"batch_id": pdf["batch_id"], "predicted_yield": start + np.concatenate([[], *found])})

        kind = aligned.table.schema["batch_id"].dataType.simpleString()
        found = aligned.table.mapInPandas(predict, f"batch_id {kind}, predicted_yield double")
        return cut_lineage(found, "forecast", wide=True)  # one row per run
    return scaled_cells(aligned, terms).groupBy("batch_id").agg(
        F.sum(F.col("z") * F.col("coef")).alias("_f")
    ).crossJoin(F.broadcast(meta.select("intercept"))).select(
        "batch_id", (F.col("intercept") + F.col("_f")).alias("predicted_yield")
    )


def forecast_steps(aligned: DataFrame, terms: DataFrame, meta: DataFrame) -> DataFrame:
    """Predicted yield at every step, future cells at the mean."""
    per_step = scaled_cells(aligned, terms).groupBy("batch_id", "step").agg(
        F.sum(F.col("z") * F.col("coef")).alias("_f")
    )
    so_far = Window.partitionBy("batch_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return per_step.withColumn("_f", F.sum("_f").over(so_far)).crossJoin(
        F.broadcast(meta.select("intercept"))
    ).select(
        "batch_id", (F.col("step") + 1).alias("time_step"),
        (F.col("intercept") + F.col("_f")).alias("predicted_yield"),
    )


def forecast_status(steps: DataFrame, batches: DataFrame, progress_pct: int) -> DataFrame:
    """Forecast at a progress against the golden threshold."""
    cut = yield_cuts(batches, [config.GOLDEN_PERCENTILE], "_cut").select(
        F.col("_cut")[0].alias("golden_threshold"))
    delta = F.col("predicted_yield") - F.col("golden_threshold")
    return steps.where(F.col("time_step") == shown_step(progress_pct)).crossJoin(
        F.broadcast(cut)
    ).select(
        "batch_id", "time_step", "predicted_yield", "golden_threshold", delta.alias("delta"),
        (delta >= 0).alias("on_track"),
    )


def vip_cells(terms: DataFrame, meta: DataFrame, components: int) -> DataFrame:
    """Variable importance in projection of every cell.

    ``terms`` has ``weights``, ``meta`` one row with ``q`` and ``tt``.
    """
    n = range(components)
    norms = terms.agg(
        F.count(F.lit(1)).alias("_p"),
        *[F.sqrt(F.sum(F.col("weights")[a] * F.col("weights")[a])).alias(f"_n{a}") for a in n],
    )
    part = [F.col("tt")[a] * F.col("q")[a] * F.col("q")[a] for a in n]
    total = sum(part, F.lit(0.0))
    mass = F.lit(0.0)
    for a in n:
        unit = F.col("weights")[a] / (F.col(f"_n{a}") + 1e-10)
        mass = mass + part[a] * unit * unit
    vip = F.when(total > 0, F.sqrt(F.col("_p") * mass / total)).otherwise(F.lit(0.0))
    return terms.crossJoin(F.broadcast(norms)).crossJoin(F.broadcast(meta.select("q", "tt"))).select(
        "variable", "step", vip.alias("vip")
    )


def vip_by_variable(vip: DataFrame) -> DataFrame:
    agg = F.sqrt(F.sum(F.col("vip") * F.col("vip")))
    return vip.groupBy("variable").agg(agg.alias("agg_vip")).withColumn(
        "important", F.col("agg_vip") > 1.0
    ).orderBy(F.desc("agg_vip"), "variable")


def vip_by_phase(vip: DataFrame) -> DataFrame:
    return vip.withColumn("phase", index_phase()).groupBy("variable", "phase").agg(
        F.sqrt(F.sum(F.col("vip") * F.col("vip"))).alias("vip")
    )


def coefficient_direction(terms: DataFrame) -> DataFrame:
    """Leverage-weighted mean coefficient (direction) and mean size per variable."""
    c = F.col("coef")
    return terms.groupBy("variable").agg(
        F.coalesce(F.try_divide(F.sum(c * F.abs(c)), F.sum(F.abs(c))), F.lit(0.0)).alias("direction"),
        F.avg(F.abs(c)).alias("magnitude"),
    )


# ── fitting ──────────────────────────────────────────────────────────────────


@dataclass
class Model:
    """A fitted model as two tables: per cell and one row."""

    terms: DataFrame
    meta: DataFrame
    components: int
    variables: list[str]
    info: dict


def good_runs(aligned: DataFrame, batches: DataFrame, target: float | None = None) -> DataFrame:
    """Batches that train the monitor, with the rung that chose them."""
    known = batches.where(F.col("yield").isNotNull()).join(
        aligned.select("batch_id").distinct(), "batch_id", "left_semi")
    chosen = choose_training(known, target)
    return cut_lineage(
        known.crossJoin(F.broadcast(chosen)).where(F.col("yield") >= F.col("threshold_used")).select(
            "batch_id", "yield", "n_good", "threshold_used", "rung"), "training")


def fit_monitor(
    aligned: DataFrame, batches: DataFrame, variables: Sequence[str],
    points: int = config.GRID_POINTS, target: float | None = None,
) -> Model:
    """Component model of the good runs, with empirical limits."""
    variables = list(variables)
    spark = aligned.sparkSession
    good = good_runs(aligned, batches, target)
    cells = aligned.join(good.select("batch_id"), "batch_id", "left_semi")
    scale = cut_lineage(scaler(cells, ["variable", "step"]), "scaler")
    cross, total = cross_products(scaled_rows(cells, scale, variables), len(variables) * points)
    if isinstance(cross, RowProducts):
        values, loadings, reached = cross.axes(config.MONITOR_COMPONENTS, config.MONITOR_VARIANCE)
    else:
        values, loadings, reached = principal_axes(
            cross / max(total.n - 1, 1), total.n, config.MONITOR_COMPONENTS, config.MONITOR_VARIANCE)
    kept = len(values)
    terms = cut_lineage(cell_table(spark, variables, points, scale, loadings=loadings), "terms")
    axes = spark.createDataFrame(
        [([float(v) for v in values], kept, float(reached[-1]))],
        "eigenvalues array<double>, n_components int, variance_reached double",
    )
    limits = control_limits(cut_lineage(run_statistics(cells, terms, axes, kept), "training-stats"))
    rung = good.select("n_good", "threshold_used", "rung").limit(1)
    meta = cut_lineage(axes.crossJoin(limits).crossJoin(rung), "meta")
    return Model(terms, meta, kept, variables, {"variance_reached": float(reached[-1])})


def fit_forecast(
    aligned: DataFrame | AlignedRuns, batches: DataFrame, variables: Sequence[str],
    points: int = config.GRID_POINTS, components: int = config.FORECAST_COMPONENTS,
) -> Model:
    """One-response PLS of the yield on the unfolded runs."""
    variables = list(variables)
    spark = batches.sparkSession
    known = batches.where(F.col("yield").isNotNull())
    if isinstance(aligned, AlignedRuns):
        cells, scale = aligned, run_scaler(aligned, known)
    else:
        cells = aligned.join(known.select("batch_id"), "batch_id", "left_semi")
        scale = scaler(cells, ["variable", "step"])
    scale = cut_lineage(scale, "scaler")
    xx, total = cross_products(scaled_rows(cells, scale, variables, known), len(variables) * points)
    xy = xx.xy if isinstance(xx, RowProducts) else total.centred()[1]
    fit = kernel_pls(xx, xy, min(components, int(total.n) - 1, len(xy)))
    terms = cell_table(spark, variables, points, scale, weights=fit["w"], coefs=fit["coef"])
    terms = cut_lineage(terms.withColumn("coef", F.col("coefs")[0]).drop("coefs"), "terms")
    kept = len(fit["q"])
    meta = spark.createDataFrame(
        [(float(total.y_mean), [float(v) for v in fit["q"]], [float(v) for v in fit["tt"]], kept)],
        "intercept double, q array<double>, tt array<double>, n_components int",
    )
    return Model(terms, meta, kept, variables, {"moments": total})


@dataclass
class Totals:
    """Sums of ``[x, y]`` over all runs; ``times`` gives ``XᵀX`` times vectors in rows."""

    n: float
    sx: np.ndarray
    sy: float
    xy: np.ndarray
    squares: np.ndarray
    times: Callable[[np.ndarray], np.ndarray]

    @classmethod
    def of_matrix(cls, cross: np.ndarray) -> Totals:
        xx = cross[:-2, :-2]
        return cls(cross[-1, -1], cross[:-2, -1], cross[-2, -1], cross[:-2, -2], np.diag(xx), lambda u: u @ xx)

    @classmethod
    def of_rows(cls, rows: RowProducts) -> Totals:
        """Every product is a pass over the rows."""
        n, mean = rows.n, rows.x_mean
        return cls(n, n * mean, n * rows.y_mean, rows.xy + n * mean * rows.y_mean, rows.spread + n * mean ** 2,
                   lambda u: rows.raw(u.T).T)


def _fold_predictions(x: np.ndarray, y: np.ndarray, totals: Totals, components: int) -> np.ndarray:
    """Prediction of every run by a model fitted without it.

    The training statistics of a fold are the totals minus one run; PLS needs
    them only through products with a few vectors, done for the block at once.
    """
    n, sx, sy, xy = totals.n, totals.sx, totals.sy, totals.xy
    m = n - 1
    mean = (sx - x) / m
    y_mean = (sy - y) / m
    var = (totals.squares - x * x) / m - mean * mean
    std = np.sqrt(np.maximum(var, 0.0))
    std = np.where(std > 1e-12, std, 1.0)
    s = (xy - x * y[:, None] - m * mean * y_mean[:, None]) / std

    def product(r: np.ndarray) -> np.ndarray:
        u = r / std
        inner = totals.times(u) - x * (u * x).sum(1)[:, None] - m * mean * (u * mean).sum(1)[:, None]
        return inner / std

    scale = np.linalg.norm(s, axis=1)
    z = (x - mean) / std
    out = y_mean.copy()
    loads: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    alive = scale > 0
    for _ in range(components):
        size = np.linalg.norm(s, axis=1)
        alive = alive & (size > 1e-12 * np.maximum(scale, 1e-300))
        w = s / np.where(alive, size, 1.0)[:, None]
        r = w.copy()
        for p, old in zip(loads, roots):
            r -= (p * w).sum(1)[:, None] * old
        sr = product(r)
        tt = (r * sr).sum(1)
        alive = alive & (tt > 0)
        tt = np.where(alive, tt, 1.0)
        p = sr / tt[:, None]
        q = np.where(alive, (r * s).sum(1) / tt, 0.0)
        s = s - p * (q * tt)[:, None]
        out += q * (z * r).sum(1)
        loads.append(p)
        roots.append(r)
    return out


def leave_one_out(
    aligned: DataFrame | AlignedRuns, batches: DataFrame, model: Model,
    points: int = config.GRID_POINTS, components: int = config.FORECAST_COMPONENTS,
) -> DataFrame:
    """``(batch_id, actual, predicted, fitted)``: each run predicted without it;
    ``predicted`` is NULL under four runs.

    Up to the matrix limit the totals are one matrix and the runs are spread over
    the cluster.  So they are beyond it (``WIDE_MATRIX`` columns at most) where the runs outnumber
    the columns: the matrix is made in panels, each summed in a pass and sent to the tasks, so the work
    grows with the runs and not with their square.  Else wider runs are left out in blocks of
    ``FOLD_VALUES`` numbers: a pass over the rows gives the next direction of every run of a
    block, and only the block's vectors are on the driver.
    """
    total = model.info["moments"]
    n = int(total.n)
    known = batches.where(F.col("yield").isNotNull())
    fitted = forecast(aligned, model.terms, model.meta).withColumnRenamed("predicted_yield", "fitted")
    if n < 4:  # too few runs to leave one out
        return known.select("batch_id", F.col("yield").alias("actual"), F.lit(None).cast("double").alias(
            "predicted")).join(fitted, "batch_id")
    width = len(model.variables) * points
    rows = scaled_rows(aligned, model.terms, model.variables, known)
    kept = max(1, min(components, n - 2, width))
    schema = "batch_id string, actual double, predicted double"
    context = batches.sparkSession.sparkContext
    matrix = rows.matrix if isinstance(rows, RunRows) else stacked
    panels = []
    if isinstance(total, RowProducts) and width < n and width <= config.WIDE_MATRIX:
        panels = [context.broadcast(p) for p in total.panels()]  # one at a time on the driver
        ends = dataclasses.replace(Totals.of_rows(total), times=None)
    elif isinstance(total, RowProducts):
        totals, block = Totals.of_rows(total), max(1, config.FOLD_VALUES // width)
        dense = rows.dense() if isinstance(rows, RunRows) else rows
        runs = cut_lineage(dense.select("batch_id", "x", "y"), "left-out").toLocalIterator()
        found = []
        while part := list(itertools.islice(runs, block)):
            y = np.array([r["y"] for r in part])
            guess = _fold_predictions(np.array([r["x"] for r in part]), y, totals, kept)
            found += zip([r["batch_id"] for r in part], y.tolist(), guess.tolist())
        return batches.sparkSession.createDataFrame(found, schema).join(fitted, "batch_id")
    shared = context.broadcast(ends if panels else total.cross)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if panels:
            totals = dataclasses.replace(
                shared.value, times=lambda u: np.concatenate([u @ p.value for p in panels], axis=1))
        else:
            totals = Totals.of_matrix(shared.value)
        for pdf in parts:
            y = pdf["y"].to_numpy(dtype=float)
            guesses = [
                _fold_predictions(matrix(pdf.iloc[i:i + 64]), y[i:i + 64], totals, kept)
                for i in range(0, len(y), 64)
            ]
            yield pd.DataFrame({
                "batch_id": pdf["batch_id"], "actual": y, "predicted": np.concatenate([[], *guesses])})

    if isinstance(rows, RunRows):
        left_out = cut_lineage(rows.table.mapInPandas(predict, schema), "left-out", wide=True)  # one row per run
    else:
        left_out = rows.mapInPandas(predict, schema)
    return left_out.join(fitted, "batch_id")


def cross_validation(pairs: DataFrame) -> DataFrame:
    """One row: R² and RMSE left out, training R², reliability, overfit gap."""
    y = F.col("actual")
    err, fit = y - F.col("predicted"), y - F.col("fitted")
    total = F.var_pop("actual") * F.count("actual") + 1e-9
    out = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(1 - F.sum(err * err) / total, 3).alias("r2_loocv"),
        F.round(F.sqrt(F.avg(err * err)), 2).alias("rmse_loocv"),
        F.round(1 - F.sum(fit * fit) / total, 3).alias("r2_train"),
    )
    for c in ("r2_loocv", "rmse_loocv", "r2_train"):
        out = out.withColumn(c, F.when(F.col("n") >= 4, F.col(c)))
    return out.withColumn(
        "reliability", F.when(F.col("r2_loocv").isNotNull(), tier(
            F.col("r2_loocv"), [(0.70, "reliable"), (0.40, "moderate")], "low"))
    ).withColumn("overfit_gap", F.round(F.col("r2_train") - F.col("r2_loocv"), 3))
