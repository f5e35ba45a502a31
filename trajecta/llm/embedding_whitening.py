"""Whitening of embeddings by Jacobi-Davidson with distributed products.

The entries of a vector become integers x = floor(256 c); every distinct x vector
is fitted once.  Those are a stage table of blocks (one packed matrix a row), so a
product of the covariance with a few vectors is one pass over blocks in numpy:
rows are centred, multiplied, and only a (dimensions x vectors) sum leaves a task.
The covariance itself is never formed.

Jacobi-Davidson for its leading eigenpairs: Rayleigh-Ritz in a search space of at
most ``MOST_SPACE`` vectors; for every wanted Ritz pair that has not converged the
correction equation (I - QQ')(V - theta I)(I - QQ') t = -r is solved roughly by
MINRES, all pairs in step so that a pass serves them all (Q: locked vectors and
the Ritz vector); the corrections extend the space.  A pair is locked when its
residual is ``TOLERANCE`` of the largest eigenvalue or less; the run ends when all
wanted ones are.  The driver holds only vectors of the embedding's dimension.

Defined cases: rows whose vector is NULL, empty, or holds NULL or non-finite
entries are dropped, and so are those of another length than most (the longer one
in a tie) and those with an entry of 2^54 or more; repeated rows are fitted once
and returned each; directions without variance have no whitened value and are left
out, so one distinct vector or an empty table give no rows; a deviation beyond 64
bits is NULL; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import stage

SCALE = 256
COMPONENTS = 4
BLOCK_VALUES = 1 << 19
MOST_SPACE = 56
KEPT_SPACE = 24
START = 16
GUARD = 8  # Ritz pairs beyond the wanted ones that are corrected along: near eigenvalues part faster
INNER_STEPS = 3
OUTER_STEPS = 200
TOLERANCE = 2.0 ** -46  # of the largest eigenvalue: some 60 units of the last place
NO_VARIANCE = 2.0 ** -40  # of the trace
DIRECT_PARTS = 512


def quantised(rows: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows whose vector is whole, as longs."""
    limit = F.lit(float(2 ** 62))  # NULL and non-finite entries fail the comparison or the NaN test
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < limit))
    good = rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{column}`").alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0)).where(sound)
    return good.select("vec_id", F.transform("c", lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))


@dataclass
class FitList:
    """The distinct vectors as packed blocks, their number, sums and mean."""

    blocks: DataFrame
    n: int
    width: int
    sums: list[int]
    largest: int
    parts: int  # scan tasks of a pass

    @property
    def mean(self) -> np.ndarray:
        # the quotient of whole numbers is rounded once, also beyond 2^53
        return np.array([s / self.n for s in self.sums])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_list(found: DataFrame) -> FitList | None:
    """Stage the distinct vectors of (vec_id, x) as blocks; None if there is none."""
    widths = found.groupBy(F.size("x").alias("width")).count().orderBy(
        F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return None
    width = widths[0]["width"]

    def pack(batches):
        for batch in batches:
            rows = _matrix(batch, width)
            step = max(1, BLOCK_VALUES // width)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                kind = next(k for k in (np.int16, np.int32, np.int64)
                            if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                sums = [sum(map(int, c)) if kind is np.int64 else int(c.sum(dtype=np.int64)) for c in part.T]
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(part)], pa.int64()), pa.array([kind().itemsize], pa.int32()),
                    pa.array([np.ascontiguousarray(part, kind).tobytes()], pa.binary()),
                    pa.array([[str(s) for s in sums]], pa.list_(pa.string())),
                    pa.array([max(abs(int(part.min())), abs(int(part.max())))], pa.int64()),
                ], names=["rows", "item", "data", "sums", "largest"])

    distinct = found.where(F.size("x") == width).select("x").distinct()
    blocks = stage(distinct.mapInArrow(
        pack, "rows long, item int, data binary, sums array<string>, largest long"), "whitening-blocks")
    total = blocks.agg(F.sum("rows").alias("n"), F.max("largest").alias("largest")).first()
    per_place = blocks.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    sums = [0] * width
    for r in per_place:
        sums[r["place"]] = int(r["s"])
    return FitList(blocks, total["n"], width, sums, total["largest"], blocks.rdd.getNumPartitions())


def block_sums(fit: FitList, of_block, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``of_block(centred rows)`` over all blocks.  Tasks sum their blocks; many
    tasks' sums are added up by place in a shuffle, so that few numbers reach the driver."""
    width, mean = fit.width, fit.mean
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("data").to_pylist()):
                rows = np.frombuffer(data, f"<i{item}").reshape(-1, width)
                total += of_block(rows - mean).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = fit.blocks.select("item", "data").mapInArrow(run, "part array<double>")
    if fit.parts <= DIRECT_PARTS:
        found = [r["part"] for r in parts.collect()]
        return np.array([math.fsum(p) for p in zip(*found)]).reshape(shape)
    by_place = parts.select(F.posexplode("part").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in by_place.collect():
        out[r["place"]] = r["v"]
    return out.reshape(shape)


def covariance_times(fit: FitList, vectors: np.ndarray) -> np.ndarray:
    """V @ vectors, one pass over the blocks."""
    return block_sums(fit, lambda rows: rows.T @ (rows @ vectors), vectors.shape) / fit.n


def orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``vectors`` add to the orthonormal ``against``."""
    kept = against
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        rest = np.linalg.norm(v)
        if rest > 1e-8:
            v = v / rest
            v = v - kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept[:, against.shape[1]:]


def minres(times, right: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of symmetric systems A x = b, a column each, in step.

    ``times`` maps a matrix of one vector per system to A times each.  Lanczos
    vectors are built per system; the least-squares problem of each is solved by
    Givens rotations as usual.
    """
    n, m = right.shape
    x = np.zeros((n, m))
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    old, new = np.zeros((n, m)), np.where(live, right / np.where(live, beta, 1), 0)
    d_old, d_older = np.zeros((n, m)), np.zeros((n, m))
    c_old, c_older, s_old, s_older = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    eta, last = beta.copy(), np.zeros(m)
    for _ in range(steps):
        product = times(new)
        alpha = (new * product).sum(axis=0)
        follow = product - alpha * new - last * old
        norm = np.linalg.norm(follow, axis=0)
        # the new column of the tridiagonal matrix under the two rotations before it
        delta = c_old * alpha - c_older * s_old * last
        rho = np.hypot(delta, norm)
        rho_2 = s_old * alpha + c_older * c_old * last
        rho_3 = s_older * last
        live &= rho > 0
        safe = np.where(live, rho, 1)
        c, s = np.where(live, delta / safe, 1), np.where(live, norm / safe, 0)
        d = np.where(live, (new - rho_3 * d_older - rho_2 * d_old) / safe, 0)
        x += np.where(live, c * eta, 0) * d
        eta = np.where(live, -s * eta, 0)
        d_older, d_old = d_old, d
        c_older, c_old, s_older, s_old = c_old, c, s_old, s
        live &= norm > 1e-14 * beta
        old, new, last = new, np.where(live, follow / np.where(live, norm, 1), 0), np.where(live, norm, 0)
        if not live.any():
            break
    return x


def eigenpairs(times, width: int, wanted: int = COMPONENTS, tolerance: float = TOLERANCE,
               inner: int = INNER_STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues, their vectors and the passes taken.

    ``times`` maps a (width, k) matrix to its product with the symmetric matrix.
    """
    wanted = min(wanted, width)
    passes = 0

    def product(v: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(v)

    rng = np.random.default_rng(seed)
    space = orthonormal(rng.standard_normal((width, min(START, width))), np.zeros((width, 0)))
    image = product(space)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    for _ in range(OUTER_STEPS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        top = max(values[0] if len(values) else 0.0, theta[0] if len(theta) else 0.0, 0.0)
        lock = 0
        open_pairs = wanted - len(values)
        residual = ritz_image - ritz * theta
        sizes = np.linalg.norm(residual, axis=0)
        while lock < min(open_pairs, len(theta)) and sizes[lock] <= tolerance * top:
            lock += 1
        if lock:  # locked pairs leave the space, which stays orthogonal to them
            locked = np.column_stack([locked, ritz[:, :lock]])
            values = np.append(values, theta[:lock])
            if len(values) >= wanted:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order], passes
        keep = ritz.shape[1] if ritz.shape[1] + wanted + GUARD <= MOST_SPACE else KEPT_SPACE
        space, image = ritz[:, lock:keep], ritz_image[:, lock:keep]
        open_pairs = min(wanted - len(values) + GUARD, space.shape[1])
        u, r, shift = ritz[:, lock:lock + open_pairs], residual[:, lock:lock + open_pairs], theta[lock:lock + open_pairs]
        u, r, shift = (a[..., sizes[lock:lock + open_pairs] > tolerance * top] for a in (u, r, shift))

        def project(v: np.ndarray, u=u) -> np.ndarray:
            for _ in range(2):
                v = v - locked @ (locked.T @ v)
                v = v - u * (u * v).sum(axis=0)
            return v

        t = minres(lambda v: project(product(v) - v * shift), -project(r), inner)
        new = orthonormal(project(t), np.column_stack([locked, space]))
        if not new.shape[1]:  # nothing to add by the equations: the residuals themselves, else a new direction
            new = orthonormal(r, np.column_stack([locked, space]))
        if not new.shape[1] and locked.shape[1] + space.shape[1] < width:
            new = orthonormal(rng.standard_normal((width, 1)), np.column_stack([locked, space]))
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
        else:  # the whole space is spanned: fresh products take rounding out of the image
            space = orthonormal(space, locked)
            image = product(space)
    raise RuntimeError(f"eigenpairs have not settled in {OUTER_STEPS} steps")


@dataclass
class Whitening:
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int
    largest: int


def fit(found: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of (vec_id, x); None where nothing varies."""
    listed = fit_list(found)
    if listed is None:
        return None
    trace = float(block_sums(listed, lambda rows: np.square(rows).sum(axis=0), (listed.width,)).sum()) / listed.n
    if not trace > 0:
        return None
    values, vectors, passes = eigenpairs(lambda v: covariance_times(listed, v), listed.width, components)
    varied = values > NO_VARIANCE * trace
    values, vectors = values[varied], vectors[:, varied]
    base = vectors / np.sqrt(values)
    m = len(values)
    means = block_sums(listed, lambda rows: (rows @ base).sum(axis=0), (m,)) / listed.n

    def spread(rows: np.ndarray) -> np.ndarray:
        z = rows @ base - means
        return z.T @ z

    cov = block_sums(listed, spread, (m, m)) / listed.n
    return Whitening(listed.n, listed.sums, listed.mean, values, vectors, trace,
                     float(np.abs(cov - np.eye(m)).max()), passes + 3, listed.largest)


def whiten(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of
    every remaining row and component."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    found = quantised(rows, column, key)
    model = fit(found, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, mean, m = model.n, model.sums, model.mean, len(model.values)
    width = len(mean)
    base = model.vectors / np.sqrt(model.values)
    explained, error = model.values / model.trace, model.identity_error
    fits = width * (n * model.largest + max(map(abs, sums))) ** 2 < 2 ** 63

    def deviations(x: np.ndarray) -> list:
        if fits:
            return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
        exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
        return [d if d < 2 ** 63 else None for d in exact]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            z = (x - mean) @ base
            times = np.repeat(np.arange(len(x)), m)
            count = len(times)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(times)), pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                pa.array(np.full(count, n), pa.int64()), pa.array(deviations(x), pa.int64()).take(pa.array(times)),
                pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(count, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.where(F.size("x") == width).select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(
        run, schema)
