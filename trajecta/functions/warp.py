"""Dynamic time warping over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def warp_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise DTW distance of two stacks of series (squared cost, no band).

    The table is filled along anti-diagonals, all rows of the stack at once.
    """
    rows, n = a.shape
    m = b.shape[1]
    before = np.full((rows, n), np.inf)  # diagonal d - 2, by index into a
    last = np.full((rows, n), np.inf)    # diagonal d - 1
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(lo, hi + 1)
        cost = (a[:, i] - b[:, d - i]) ** 2
        best = last[:, i].copy()                         # from (i, j - 1)
        up = i > 0
        best[:, up] = np.minimum(best[:, up], last[:, i[up] - 1])     # from (i - 1, j)
        best[:, up] = np.minimum(best[:, up], before[:, i[up] - 1])   # from (i - 1, j - 1)
        if d == 0:
            best[:] = 0.0
        now = np.full((rows, n), np.inf)
        now[:, i] = cost + best
        before, last = last, now
    return np.sqrt(last[:, n - 1])


@F.pandas_udf(T.DoubleType())
def warp_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """DTW distance of two arrays per row; series of one length are stacked."""
    out = np.full(len(a), np.nan)
    sizes = pd.Series([
        None if x is None or y is None else (len(x), len(y)) for x, y in zip(a, b)
    ], dtype=object)
    for size in sizes.dropna().unique():
        at = np.flatnonzero([s == size for s in sizes])
        if min(size) == 0:
            continue
        out[at] = warp_distances(
            np.stack([np.asarray(a.iloc[i], dtype=float) for i in at]),
            np.stack([np.asarray(b.iloc[i], dtype=float) for i in at]),
        )
    return pd.Series(out).where(~np.isnan(out), None)
