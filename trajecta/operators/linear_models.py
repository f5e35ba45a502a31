"""Sufficient statistics on the cluster, small solves on the driver.

Every linear fit reads the data once: each partition adds up its own
cross-product matrix, Spark sums the matrices row by row, and only a matrix
whose side is the number of columns comes back.  Data wider than the matrix
limit is fitted by products of its rows with a few vectors instead: a pass over
the rows per step, and only vectors as long as the columns come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta import config
from trajecta.operators.align import AlignedRuns, unfold
from trajecta.operators.scale import lookup
from trajecta.session import cut_lineage, freeing_shuffles


@dataclass
class Moments:
    """Cross products of ``[x, y, 1]`` rows."""

    cross: np.ndarray

    @property
    def n(self) -> float:
        return self.cross[-1, -1]

    @property
    def xx(self) -> np.ndarray:
        return self.cross[:-2, :-2]

    @property
    def xy(self) -> np.ndarray:
        return self.cross[:-2, -2]

    @property
    def x_mean(self) -> np.ndarray:
        return self.cross[:-2, -1] / self.n

    @property
    def y_mean(self) -> float:
        return self.cross[-2, -1] / self.n

    def minus(self, other: Moments) -> Moments:
        return Moments(self.cross - other.cross)

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """``XᵀX``, ``Xᵀy`` and ``yᵀy`` about the means."""
        m, my = self.x_mean, self.y_mean
        return (
            self.xx - self.n * np.outer(m, m),
            self.xy - self.n * m * my,
            self.cross[-2, -2] - self.n * my * my,
        )


def check_width(columns: int) -> None:
    if columns > config.MATRIX_LIMIT:
        raise ValueError(
            f"{columns} columns exceed the matrix limit of {config.MATRIX_LIMIT}, "
            "and this fit needs the whole matrix; use fewer variables or grid points"
        )


PIECE = 1024
ROWS = 256
MERGE_SHARES = 16
NEAR = 0.8


def stacked(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["x"].to_numpy())


@dataclass
class RunRows:
    """Rows that are made where they are read: ``matrix`` gives those of a part of ``table``, which has ``y``."""

    table: DataFrame
    matrix: Callable[[pd.DataFrame], np.ndarray]

    def dense(self) -> DataFrame:
        """``(batch_id, x, y)``."""
        matrix, kind = self.matrix, self.table.schema["batch_id"].dataType.simpleString()

        def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for at in range(0, len(pdf), 64):
                    part = pdf.iloc[at:at + 64]
                    yield pd.DataFrame({"batch_id": part["batch_id"], "x": [*matrix(part)], "y": part["y"]})

        return self.table.mapInPandas(made, f"batch_id {kind}, x array<double>, y double")


def summed(rows: DataFrame, matrix, fn, size: int, key: str | None = None) -> np.ndarray:
    """Sum of ``fn(x, y)`` over ``rows``, a vector, where ``matrix`` gives the ``x`` of a part."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((-(-size // PIECE), PIECE))
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at:at + ROWS]
                more = () if key is None else (part[key].to_numpy(),)
                total.reshape(-1)[:size] += fn(matrix(part), part["y"].to_numpy(dtype=float), *more)
        for at in range(0, len(total), 256):
            yield pd.DataFrame({"i": range(at, min(at + 256, len(total))), "piece": [*total[at:at + 256]]})

    with freeing_shuffles(rows.sparkSession, wide=True):
        parts = rows.mapInPandas(partial, "i int, piece array<double>")
        found = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("piece")).alias("v")).select(
            "i", vector_to_array("v").alias("v")).toArrow()  # size / PIECE rows
    out = np.zeros((-(-size // PIECE), PIECE))
    for batch in found.to_batches():
        out[batch.column("i").to_numpy()] = batch.column("v").flatten().to_numpy().reshape(-1, PIECE)
    return out.ravel()[:size]


class RowProducts:
    """``XᵀX`` of rows ``x ARRAY<DOUBLE>``, ``y DOUBLE`` as an operator on vectors."""

    matrix = staticmethod(stacked)

    def __init__(self, rows: DataFrame | RunRows, columns: int):
        self.columns = columns
        if isinstance(rows, RunRows):
            self.rows, self.matrix = rows.table, rows.matrix
        else:
            self.rows = cut_lineage(rows.select("x", "y"), "wide-rows")

        def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            flat = np.concatenate([x.sum(0), (x * x).sum(0), y @ x, [len(y), y.sum(), y @ y]])
            return flat

        flat = self._summed(sums, 3 * columns + 3)
        self.n, self._y, self._yy = flat[-3:]
        self.x_mean, self.y_mean = flat[:columns] / self.n, self._y / self.n
        self.spread = flat[columns:2 * columns] - self.n * self.x_mean ** 2
        self.xy = flat[2 * columns:3 * columns] - self.n * self.x_mean * self.y_mean
        self.yy = self._yy - self.n * self.y_mean ** 2

    def _summed(self, fn, size: int, key: str | None = None, tasks: int | None = None) -> np.ndarray:
        """Sum over the rows of ``fn(x, y)`` (with a key, ``fn(x, y, key)``), a vector; parts are
        added piece by piece.  ``tasks``: at most so many of them send a vector."""
        return summed(self.rows if tasks is None else self.rows.coalesce(tasks), self.matrix, fn, size, key)

    def __matmul__(self, vectors: np.ndarray) -> np.ndarray:
        """Centred ``XᵀX`` times one or a few vectors."""
        v = vectors.reshape(self.columns, -1)
        shared = self.rows.sparkSession.sparkContext.broadcast(v)  # columns x a few
        raw = self._summed(lambda x, y: (x.T @ (x @ shared.value)).ravel(), v.size).reshape(v.shape)
        raw -= self.n * np.outer(self.x_mean, self.x_mean @ v)
        return raw.reshape(vectors.shape)

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        """``XᵀX`` about the origin times one or a few vectors."""
        return self @ vectors + self.n * np.multiply.outer(self.x_mean, self.x_mean @ vectors)

    def panels(self) -> Iterator[np.ndarray]:
        """``XᵀX`` about the origin in panels of columns, ``FOLD_VALUES`` numbers and a pass each.

        Every task sends a panel, so they follow the cores and not the rows.
        """
        wide = max(1, config.FOLD_VALUES // self.columns)
        tasks = max(MERGE_SHARES, self.rows.sparkSession.sparkContext.defaultParallelism)
        for lo in range(0, self.columns, wide):
            hi = min(lo + wide, self.columns)
            yield self._summed(lambda x, y: (x.T @ x[:, lo:hi]).ravel(), self.columns * (hi - lo), tasks=tasks).reshape(
                self.columns, hi - lo)

    def axes(self, limit: int, share: float, rounds: int = 200, tol: float = 1e-10):
        """As :func:`principal_axes`, by orthogonal iteration on a few vectors."""
        most = max(1, min(limit, int(self.n) - 1, self.columns))
        wide = min(self.columns, most + 5)
        basis = np.linalg.qr(np.random.default_rng(0).normal(size=(self.columns, wide)))[0]
        before = np.zeros(most)
        for _ in range(rounds):
            image = self @ basis
            inner, turn = np.linalg.eigh(basis.T @ image)
            now = inner[::-1][:most]
            done = np.abs(now - before).max() <= tol * max(now[0], 1e-300)
            before, vectors = now, (basis @ turn)[:, ::-1][:, :most]
            if done:
                break
            basis = np.linalg.qr(image)[0]
        return _kept_axes(before / max(self.n - 1, 1), vectors, self.spread.sum() / max(self.n - 1, 1), share)


def partial_products(rows: DataFrame, columns: int, key: str | None = None) -> DataFrame:
    """``(k, i, share, row)``: the rows of every scan task's half matrix of cross products.

    As many tasks as the scan has splits; row ``i`` begins at its diagonal entry.
    """
    check_width(columns)
    side = columns + 2
    upper = np.triu_indices(side)
    ends = np.append(0, np.cumsum(np.arange(side, 0, -1))).astype(np.int32)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, columns)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            a = np.column_stack([x, y, np.ones(len(y))])
            keys = batch.column("k").to_numpy()
            for k in np.unique(keys):
                part = a[keys == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        share = TaskContext.get().partitionId() % MERGE_SHARES
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(side, k, np.int32)), pa.array(np.arange(side, dtype=np.int32)),
                pa.array(np.full(side, share, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[upper])),
            ], names=["k", "i", "share", "row"])

    k = F.lit(0) if key is None else F.col(key)
    return rows.select("x", F.col("y").cast("double").alias("y"), k.cast("int").alias("k")).mapInArrow(
        partial, "k int, i int, share int, row array<double>")


def moments(rows: DataFrame, columns: int, key: str | None = None) -> dict[object, Moments]:
    """Cross products of ``x ARRAY<DOUBLE>`` and ``y DOUBLE``, per ``key`` value.

    The tasks' half matrices are merged as a tree: by (row, share) first, so that
    many tasks' rows are added up in parallel, then by row.
    """
    side = columns + 2
    merged = partial_products(rows, columns, key).select("k", "i", "share", array_to_vector("row").alias("row"))
    for keys in (["k", "i", "share"], ["k", "i"]):
        merged = merged.groupBy(*keys).agg(Summarizer.sum(F.col("row")).alias("row"))
    out: dict[object, np.ndarray] = {}
    for r in merged.select("k", "i", vector_to_array("row").alias("row")).collect():  # (columns + 2) rows per key
        cross = out.setdefault(r["k"], np.zeros((side, side)))
        cross[r["i"], r["i"]:] = r["row"]
        cross[r["i"]:, r["i"]] = r["row"]
    return {name: Moments(cross) for name, cross in out.items()}


def run_scaler(runs: AlignedRuns, batches: DataFrame) -> DataFrame:
    """:func:`scaler` of the cells of the runs in ``batches``, ``(variable, step, mu, sigma)``."""
    rows = lookup(runs.table, batches.select("batch_id").distinct(), ["batch_id"], "left_semi").withColumn("y", F.lit(0.0))
    matrix, columns = runs.matrix(), len(runs.variables) * runs.points
    one = rows.limit(1).toArrow().to_pandas()
    about = matrix(one)[0] if len(one) else np.zeros(columns)  # squares about a run, so that no digits are lost

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x - about
        return np.concatenate([d.sum(0), (d * d).sum(0), [len(d)]])

    flat = summed(rows, matrix, sums, 2 * columns + 1)
    n, shift = max(flat[-1], 1.0), flat[:columns] / max(flat[-1], 1.0)
    sigma = np.sqrt(np.maximum(flat[columns:-1] / n - shift * shift, 0.0))
    sigma = np.where(sigma > 0, sigma, 1.0)
    found = [(v, s, float(about[k * runs.points + s] + shift[k * runs.points + s]), float(sigma[k * runs.points + s]))
             for k, v in enumerate(runs.variables) for s in range(runs.points)] if flat[-1] else []
    return runs.table.sparkSession.createDataFrame(found, "variable string, step int, mu double, sigma double")


def scaler(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population std per column; a zero std becomes 1."""
    out = cells.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))
    return out.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(1.0)))


# ── component models ─────────────────────────────────────────────────────────


def principal_axes(
    cov: np.ndarray, n: float, limit: int, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(eigenvalues, loadings, cumulative share)`` of the fewest components
    that reach the wanted share of the total variance."""
    most = max(1, min(limit, int(n) - 1, cov.shape[0]))
    values, vectors = np.linalg.eigh(cov)
    return _kept_axes(values[::-1][:most], vectors[:, ::-1][:, :most], np.trace(cov), share)


def _kept_axes(values: np.ndarray, vectors: np.ndarray, total: float, share: float):
    reached = np.cumsum(values) / total
    keep = max(1, min(int(np.searchsorted(reached, share) + 1), len(values)))
    vectors = vectors[:, :keep]
    # sign rule: the largest entry of every loading is positive
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(keep)])
    return values[:keep], vectors * np.where(signs == 0, 1.0, signs), reached[:keep]


def cross_products(
    rows: DataFrame | RunRows, columns: int
) -> tuple[np.ndarray | RowProducts, Moments | RowProducts]:
    """Centred ``XᵀX`` as a matrix, or beyond the limit as an operator, and the totals."""
    if columns > config.MATRIX_LIMIT:
        wide = RowProducts(rows, columns)
        return wide, wide
    total = moments(rows.dense() if isinstance(rows, RunRows) else rows, columns)[0]
    return total.centred()[0], total


def kernel_pls(xx: np.ndarray | RowProducts, xy: np.ndarray, components: int) -> dict[str, np.ndarray]:
    """One-response PLS from cross products only."""
    xy = xy.copy()
    w_all, r_all, p_all, q_all, t_all = [], [], [], [], []
    scale = np.linalg.norm(xy)
    for _ in range(components):
        size = np.linalg.norm(xy)
        if size <= 1e-12 * max(scale, 1e-300):
            break
        w = xy / size
        r = w.copy()
        for p, old in zip(p_all, r_all):
            r -= (p @ w) * old
        s = xx @ r
        tt = float(r @ s)
        if tt <= 0:
            break
        p = s / tt
        q = float(r @ xy) / tt
        xy -= p * (q * tt)
        for box, item in zip((w_all, r_all, p_all, q_all, t_all), (w, r, p, q, tt)):
            box.append(item)
    if not w_all:
        zero = np.zeros((len(xy), 1))
        return {"w": zero, "q": np.zeros(1), "tt": np.zeros(1), "coef": zero[:, 0]}
    w, r = np.array(w_all).T, np.array(r_all).T
    q, tt = np.array(q_all), np.array(t_all)
    return {"w": w, "q": q, "tt": tt, "coef": r @ q}


def feature_sign(g: np.ndarray, b: np.ndarray, penalty: float, w: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Minimum of ``w'gw / 2 - b'w + penalty |w|`` by active signs: with the signs given it is
    a linear system, and a step stops where a coefficient would change its sign."""
    w = w.copy()
    if not len(b):
        return w
    sign = np.sign(w)
    scale = max(np.abs(b).max(initial=0.0), penalty, 1e-300)

    def cost(v: np.ndarray, at: np.ndarray) -> float:
        return float(v @ (g[np.ix_(at, at)] @ v) / 2 - b[at] @ v + penalty * np.abs(v).sum())

    for _ in range(50 * len(b) + 100):
        slope = g @ w - b
        held = sign != 0
        settled = not held.any() or np.abs(slope[held] + penalty * sign[held]).max() <= tol * scale
        if settled:
            free = np.where(held, 0.0, np.abs(slope))
            j = int(np.argmax(free))
            if free[j] <= penalty + tol * scale:
                break
            sign[j] = -np.sign(slope[j])
        at = np.flatnonzero(sign)
        system, right = g[np.ix_(at, at)], b[at] - penalty * sign[at]
        try:
            goal = np.linalg.solve(system, right)
        except np.linalg.LinAlgError:
            goal = np.linalg.lstsq(system, right, rcond=None)[0]
        now = w[at]
        step = goal - now
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = np.where(now * goal < 0, -now / step, 1.0)
        points = [now + t * step for t in np.unique(np.append(cross, 1.0))]
        for p, t in zip(points, np.unique(np.append(cross, 1.0))):
            p[np.isclose(cross, t, rtol=1e-12, atol=0) & (now * goal < 0)] = 0.0
        costs = [cost(p, at) for p in points]
        best = points[int(np.argmin(costs))]
        held_cost = cost(now, at)
        if not min(costs) < held_cost - 1e-15 * abs(held_cost):  # down to rounding
            break
        w[at] = best
        sign = np.sign(w)
    return w


def lasso_path(xx: np.ndarray, xy: np.ndarray, n: float, alphas: Sequence[float]) -> list[np.ndarray]:
    """L1 fits on centred cross products, warm-started along the path."""
    w, out = np.zeros(len(xy)), []
    for alpha in alphas:
        w = feature_sign(xx, xy, n * alpha, w)
        out.append(w)
    return out


# ── feature matrices ─────────────────────────────────────────────────────────


@dataclass
class FeatureMatrix:
    """Standardised features, one row per batch."""

    names: list[str]
    mean: np.ndarray
    std: np.ndarray
    rows: DataFrame  # batch_id, x ARRAY<DOUBLE>, y
    n: int


def feature_matrix(prepared: DataFrame) -> FeatureMatrix:
    """From ``(batch_id, feature, value, yield)``; features sorted by name."""
    prepared = cut_lineage(prepared, "prepared")
    scale = cut_lineage(scaler(prepared, ["feature"]), "feature-scaler")
    # names, means and deviations of the columns: one row per feature
    stats = sorted(scale.collect(), key=lambda r: r["feature"])
    names = [r["feature"] for r in stats]
    cell = F.struct("feature", ((F.col("value") - F.col("mu")) / F.col("sigma")).alias("z"))
    rows = lookup(prepared, scale, ["feature"], rows=len(names)).groupBy("batch_id").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["z"]).alias("x"),
        F.max("yield").alias("y"),
    )
    rows = cut_lineage(rows, "matrix")
    return FeatureMatrix(
        names, np.array([r["mu"] for r in stats]), np.array([r["sigma"] for r in stats]),
        rows, rows.count(),
    )


def vector_frame(spark: SparkSession, names: Sequence[str], **columns) -> DataFrame:
    """A small table with one row per feature."""
    heads = ", ".join(f"{c} double" for c in columns)
    rows = [
        (name, *[float(values[i]) for values in columns.values()]) for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, f"feature string, {heads}")


@dataclass
class ComponentAnalysis:
    """Principal components of the features and their link to the yield."""

    explained: np.ndarray
    loadings: np.ndarray
    yield_corr: np.ndarray
    chosen: int
    importance: DataFrame = field(repr=False)


def component_importance(matrix: FeatureMatrix) -> ComponentAnalysis:
    """Absolute loadings of the component that follows the yield most."""
    xx, total = cross_products(matrix.rows, len(matrix.names))
    if isinstance(xx, RowProducts):
        values, loadings, _ = xx.axes(config.RANKING_COMPONENTS, config.RANKING_VARIANCE)
        xy, yy, trace = xx.xy, xx.yy, xx.spread.sum()
    else:
        _, xy, yy = total.centred()
        trace = np.trace(xx)
        values, loadings, _ = principal_axes(
            xx / (total.n - 1), total.n, config.RANKING_COMPONENTS, config.RANKING_VARIANCE)
    # score variances and covariances follow from the cross products
    spread = np.sqrt((loadings * (xx @ loadings)).sum(axis=0) * yy)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.where(spread > 0, loadings.T @ xy / spread, 0.0)
    chosen = int(np.argmax(np.abs(corr)))
    table = vector_frame(
        matrix.rows.sparkSession, matrix.names,
        loading=loadings[:, chosen], score=np.abs(loadings[:, chosen]),
    )
    return ComponentAnalysis(values / (trace / (total.n - 1)), loadings, corr, chosen, table)


def with_fold(rows: DataFrame, n: int, folds: int) -> DataFrame:
    """Contiguous folds over the batches in id order; the first ones are
    one larger when the count does not divide."""
    # ids in ranges of the text itself, each sorted; a place is the range's offset and the row in it
    ranges = max(1, -(-2 * n // config.HOT_ROWS))
    at = F.monotonically_increasing_id()
    ids = cut_lineage(rows.select("batch_id").repartitionByRange(ranges, "batch_id").sortWithinPartitions(
        "batch_id").select("batch_id", F.shiftright(at, 33).alias("_range"),
                           at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "fold-ids")
    offsets = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # ranges rows
    index = ids.join(offsets, "_range").select("batch_id", (F.col("_before") + F.col("_place")).alias("_at"))
    size, extra = divmod(n, folds)
    edge = extra * (size + 1)
    fold = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (size + 1))).otherwise(
        extra + F.floor((F.col("_at") - edge) / max(size, 1))
    )
    return rows.join(index, "batch_id").withColumn("fold", fold.cast("int")).drop("_at")


@dataclass
class SparseRegression:
    """The penalty, the fit's R², the coefficients, and the selected ones by size."""

    alpha: float
    coef: np.ndarray
    r2: float
    selected: list[str]
    table: DataFrame = field(repr=False)


class FoldProducts:
    """Cross products of standardised rows by fold, asked for only where the L1 path needs them.

    A problem leaves one fold out; the last one leaves out none.  A pass gives every
    problem's ``XᵀXw`` for a few ``w``, or the folds' products among chosen columns;
    the driver holds vectors as long as the columns, and a matrix of the chosen ones.
    """

    def __init__(self, rows: DataFrame, columns: int, folds: int):
        self.columns, self.folds = columns, folds
        self.products = RowProducts.__new__(RowProducts)
        self.products.rows = cut_lineage(rows.select("x", "y", "fold"), "fold-rows")
        self.products.columns = columns

        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            out = np.zeros((folds, 3 * columns + 3))
            for f in np.unique(fold):
                a, b = x[fold == f], y[fold == f]
                out[f] = np.concatenate([a.sum(0), (a * a).sum(0), b @ a, [len(b), b.sum(), b @ b]])
            return out.ravel()

        flat = self.products._summed(sums, folds * (3 * columns + 3), "fold").reshape(folds, -1)
        self.part = flat
        train = np.vstack([flat.sum(0) - flat, flat.sum(0)])
        self.n, self.y_sum, self.yy = train[:, -3], train[:, -2], train[:, -1]
        self.mean = train[:, :columns] / self.n[:, None]
        self.y_mean = self.y_sum / self.n
        self.xy = train[:, 2 * columns:3 * columns] - self.n[:, None] * self.mean * self.y_mean[:, None]

    def times(self, chosen: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Centred ``XᵀX`` of every problem times vectors that are zero outside the chosen columns:
        ``(problems, chosen, k)`` in, ``(problems, columns, k)`` out."""
        problems, _, k = vectors.shape
        flat = np.ascontiguousarray(vectors.transpose(1, 0, 2)).reshape(len(chosen), problems * k)
        shared = self.products.rows.sparkSession.sparkContext.broadcast(flat)

        def one(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            score = (x[:, chosen] @ shared.value).reshape(len(x), problems, k)
            score[np.arange(len(fold)), fold] = 0.0  # a fold is not among its problem's rows
            return (score.reshape(len(x), -1).T @ x).ravel()

        shape = (problems, k, self.columns)
        raw = self.products._summed(one, int(np.prod(shape)), "fold").reshape(shape).transpose(0, 2, 1)
        inner = np.einsum("fp,fpk->fk", self.mean[:, chosen], vectors)
        return raw - self.n[:, None, None] * self.mean[:, :, None] * inner[:, None, :]

    def among(self, chosen: np.ndarray) -> np.ndarray:
        """Centred products of the chosen columns, ``(problems, chosen, chosen)``."""
        size, folds = len(chosen), self.folds

        def one(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            out, a = np.zeros((folds, size, size)), x[:, chosen]
            for f in np.unique(fold):
                out[f] = a[fold == f].T @ a[fold == f]
            return out.ravel()

        part = self.products._summed(one, folds * size * size, "fold").reshape(folds, size, size)
        raw = np.concatenate([part.sum(0) - part, part.sum(0)[None]])
        m = self.mean[:, chosen]
        return raw - self.n[:, None, None] * m[:, :, None] * m[:, None, :]

    def left_out_error(self, problem: int, w: np.ndarray, product: np.ndarray) -> float:
        """Mean squared error of a problem's fit on the fold it leaves out; ``product`` is
        the centred ``XᵀXw`` of that fold's rows."""
        x_sum, xy, (n, y_sum, yy) = (self.part[problem, :self.columns],
                                     self.part[problem, 2 * self.columns:3 * self.columns], self.part[problem, -3:])
        mean, y_mean = x_sum / n, y_sum / n
        spread = yy - n * y_mean ** 2 - 2 * w @ (xy - n * mean * y_mean) + w @ product
        off = y_mean - self.y_mean[problem] - (mean - self.mean[problem]) @ w
        return float(spread / n + off ** 2)


def screened_paths(found: FoldProducts, grid: np.ndarray, together: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Every problem's coefficients along ``grid`` (problems, penalties, columns) of the chosen columns, and those.

    ``together`` penalties are solved at a time among the columns held, then one pass
    checks the optimality conditions of all columns.  Penalties before the first one
    that fails are done; there the columns enter that fail or come within ``NEAR`` of
    it, and the path goes on from there.
    """
    problems = len(found.xy)
    chosen, grams = np.zeros(0, np.int64), np.zeros((problems, 0, 0))
    paths = np.zeros((problems, len(grid), 0))
    begin = 0
    while begin < len(grid):
        alphas = grid[begin:begin + together]
        for f in range(problems):
            w = paths[f, begin - 1] if begin else np.zeros(len(chosen))
            for k, alpha in enumerate(alphas):
                w = feature_sign(grams[f], found.xy[f, chosen], found.n[f] * alpha, w)
                paths[f, begin + k] = w
        w = paths[:, begin:begin + len(alphas)].transpose(0, 2, 1)
        slope = np.abs(found.xy[:, :, None] - (found.times(chosen, w) if len(chosen) else 0.0))
        slope = slope / (found.n[:, None, None] * np.maximum(alphas, 1e-300))
        slope[:, chosen, :] = 0.0
        failed = (slope > 1 + 1e-7).any(axis=(0, 1))
        if not failed.any():
            begin += len(alphas)
            continue
        k = int(np.argmax(failed))
        begin += k
        fresh = np.flatnonzero((slope[:, :, k] > NEAR).any(axis=0))
        chosen = np.append(chosen, fresh)
        grams = found.among(chosen)
        paths = np.pad(paths, ((0, 0), (0, 0), (0, len(fresh))))
    return paths, chosen


def _products_fit(matrix: FeatureMatrix, folds: int, alphas: int):
    """(penalty, coefficients, R²) by passes over the rows, for any number of columns."""
    columns = len(matrix.names)
    found = FoldProducts(with_fold(matrix.rows, matrix.n, folds), columns, folds)
    top = np.abs(found.xy[-1]).max() / found.n[-1]
    grid = np.geomspace(top, top * 1e-3, alphas) if top > 0 else np.zeros(1)
    paths, chosen = screened_paths(found, grid)
    errors = np.zeros((folds, len(grid)))
    full = found.among(chosen) if len(chosen) else np.zeros((folds + 1, 0, 0))
    raw_mean = found.mean[:, chosen]
    n_part, mean_part = found.part[:, -3], found.part[:, :columns][:, chosen] / found.part[:, -3:-2]
    totals = full + found.n[:, None, None] * raw_mean[:, :, None] * raw_mean[:, None, :]
    for f in range(folds):
        own = totals[-1] - totals[f] - n_part[f] * np.outer(mean_part[f], mean_part[f])
        for k in range(len(grid)):
            w, product = np.zeros(columns), np.zeros(columns)
            w[chosen], product[chosen] = paths[f, k], own @ paths[f, k]
            errors[f, k] = found.left_out_error(f, w, product)
    best = int(np.argmin(errors.mean(axis=0)))
    coef = np.zeros(columns)
    coef[chosen] = paths[-1, best]
    yy = found.yy[-1] - found.n[-1] * found.y_mean[-1] ** 2
    residual = yy - 2 * coef @ found.xy[-1] + paths[-1, best] @ full[-1] @ paths[-1, best]
    return float(grid[best]), coef, float(1.0 - residual / yy if yy > 0 else 0.0)


def _matrix_fit(matrix: FeatureMatrix, folds: int, alphas: int):
    """(penalty, coefficients, R²) from one matrix per fold, where few columns make it small."""
    parts = moments(with_fold(matrix.rows, matrix.n, folds), len(matrix.names), "fold")
    total = Moments(sum(m.cross for m in parts.values()))
    xx, xy, yy = total.centred()
    top = np.abs(xy).max() / total.n
    grid = np.geomspace(top, top * 1e-3, alphas) if top > 0 else np.zeros(1)
    errors = np.zeros((len(parts), len(grid)))
    for i, part in enumerate(parts.values()):
        train = total.minus(part)
        txx, txy, _ = train.centred()
        for j, w in enumerate(lasso_path(txx, txy, train.n, grid)):
            v = np.concatenate([-w, [1.0, -(train.y_mean - train.x_mean @ w)]])
            errors[i, j] = v @ part.cross @ v / part.n
    best = int(np.argmin(errors.mean(axis=0)))
    coef = lasso_path(xx, xy, total.n, grid[: best + 1])[-1]
    residual = yy - 2 * coef @ xy + coef @ xx @ coef
    return float(grid[best]), coef, float(1.0 - residual / yy if yy > 0 else 0.0)


def sparse_regression(matrix: FeatureMatrix, folds: int = 5, alphas: int = 100) -> SparseRegression:
    """L1 regression with the penalty chosen by cross-validation; any number of columns."""
    folds = min(folds, matrix.n)
    fit = _products_fit if len(matrix.names) > config.SPARSE_LIMIT else _matrix_fit
    alpha, coef, r2 = fit(matrix, folds, alphas)
    table = vector_frame(matrix.rows.sparkSession, matrix.names, coef=coef, score=np.abs(coef)).withColumn(
        "direction", F.when(F.col("coef") > 0, "increases").when(F.col("coef") < 0, "decreases"))
    selected = [matrix.names[i] for i in np.argsort(-np.abs(coef), kind="stable") if coef[i] != 0]
    return SparseRegression(alpha, coef, r2, selected, table)


# ── trajectory models ────────────────────────────────────────────────────────


def term_arrays(terms: DataFrame, variables: Sequence[str], *names: str) -> list[np.ndarray]:
    """Columns of a cell table as arrays over the unfolded cells."""
    place = {v: k for k, v in enumerate(variables)}
    rows = sorted((place[r["variable"]], r["step"], *[r[c] for c in names])  # variables x points rows
                  for r in terms.select("variable", "step", *names).collect())
    return [np.array([r[2 + i] for r in rows]) for i in range(len(names))]


def scaled_matrix(runs: AlignedRuns, terms: DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    mu, sigma = term_arrays(terms, runs.variables, "mu", "sigma")
    matrix = runs.matrix()

    def scaled(part: pd.DataFrame) -> np.ndarray:
        x = matrix(part)
        x -= mu
        x /= sigma
        return x

    return scaled


def scaled_rows(
    aligned: DataFrame | AlignedRuns, terms: DataFrame, variables: Sequence[str], batches: DataFrame | None = None
) -> DataFrame | RunRows:
    """``(batch_id, x, y)`` of standardised unfolded runs."""
    if isinstance(aligned, AlignedRuns):
        table = aligned.table.withColumn("y", F.lit(0.0)) if batches is None else lookup(
            aligned.table, batches.select("batch_id", F.col("yield").alias("y")), ["batch_id"]).where("y IS NOT NULL")
        return RunRows(table, scaled_matrix(aligned, terms))
    z = aligned.join(terms.select("variable", "step", "mu", "sigma"),
                     ["variable", "step"]).withColumn(
        "z", (F.col("value") - F.col("mu")) / F.col("sigma"))
    rows = unfold(z, variables, "z")
    if batches is None:
        return rows.withColumn("y", F.lit(0.0))
    return rows.join(batches.select("batch_id", F.col("yield").alias("y")), "batch_id").where(
        F.col("y").isNotNull()
    )


def cell_table(
    spark: SparkSession, variables: Sequence[str], points: int, terms: DataFrame, **arrays
) -> DataFrame:
    """Scaler rows joined with per-cell model arrays (variables x points rows)."""
    names = list(arrays)
    rows = [
        (v, s, *[[float(c) for c in np.atleast_1d(arrays[a][k * points + s])] for a in names])
        for k, v in enumerate(variables) for s in range(points)
    ]
    schema = "variable string, step int, " + ", ".join(f"{a} array<double>" for a in names)
    return terms.join(spark.createDataFrame(rows, schema), ["variable", "step"])
