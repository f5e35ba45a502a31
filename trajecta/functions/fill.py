"""Gap filling for many whole runs at once, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def many_second_derivatives(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of not-a-knot splines through many series.

    ``x`` and ``y`` hold the series (four knots or more each) in a row.  Series
    of like length are solved side by side by one tridiagonal sweep.
    """
    out = np.empty(len(x))
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # up to twice the shortest length side by side
        top = np.searchsorted(sizes[order], max(2 * sizes[order[at]], 64), side="right")
        group = order[at:top]
        length = sizes[group]
        cells = first[group] + np.arange(length.max())[:, None]  # knots x series
        real = np.arange(length.max())[:, None] < length
        cells = np.where(real, cells, 0)
        out[cells[real]] = _sweep(x[cells], y[cells], real, length)[real]
        at = top
    return out


def _sweep(x: np.ndarray, y: np.ndarray, real: np.ndarray, length: np.ndarray) -> np.ndarray:
    cols = np.arange(x.shape[1])
    h = np.where(real[1:], np.diff(x, axis=0), 1.0)
    slope = np.where(real[1:], np.diff(y, axis=0), 0.0) / h
    diag, low, up = 2.0 * (h[:-1] + h[1:]), h[:-1].copy(), h[1:].copy()
    rhs = 6.0 * np.diff(slope, axis=0)
    inner = real[2:]
    diag, low, up, rhs = (np.where(inner, a, fill) for a, fill in ((diag, 1.0), (low, 0.0), (up, 0.0), (rhs, 0.0)))
    # the end values follow from their neighbours; fold them into the rows
    end = length - 3
    ha, hb, hy, hz = h[0], h[1], h[length - 3, cols], h[length - 2, cols]
    diag[0] += ha * (1.0 + ha / hb)
    up[0] -= ha * ha / hb
    diag[end, cols] += hz * (1.0 + hz / hy)
    low[end, cols] -= hz * hz / hy
    up[end, cols] = 0.0
    for i in range(1, len(diag)):
        f = low[i] / diag[i - 1]
        diag[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.zeros(x.shape)
    m[-2] = rhs[-1] / diag[-1]
    for i in range(len(diag) - 2, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / diag[i]
    m[0] = m[1] * (1.0 + ha / hb) - m[2] * ha / hb
    m[length - 1, cols] = m[length - 2, cols] * (1.0 + hz / hy) - m[length - 3, cols] * hz / hy
    return m


def fill_runs(
    starts: np.ndarray, columns: Sequence[np.ndarray], medians: Sequence[float], cubic: bool = True
) -> list[np.ndarray]:
    """The columns without NaN: cubic from four valid points of a run on (if wanted), linear
    from two, constant from one, the median without any; ends take the nearest."""
    n = len(columns[0])
    run = np.zeros(n, np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    begin, stop = starts[run], np.append(starts[1:], n)[run]
    place = np.arange(n)
    out = []
    for v, median in zip(columns, medians):
        valid = ~np.isnan(v)
        if valid.all():
            out.append(v)
            continue
        before = np.maximum.accumulate(np.where(valid, place, -1))
        after = np.minimum.accumulate(np.where(valid, place, n)[::-1])[::-1]
        gap = np.flatnonzero(~valid)
        p, q = before[gap], after[gap]
        has_p, has_q = p >= begin[gap], q < stop[gap]
        p, q = np.where(has_p, p, 0), np.where(has_q, q, 0)
        both = has_p & has_q
        h = np.where(both, q - p, 1)
        b = (gap - p) / h
        filled = np.where(both, v[p] + (v[q] - v[p]) * b, np.where(has_q, v[q], np.where(has_p, v[p], median)))
        counts = np.add.reduceat(valid.astype(np.int64), starts)
        inside = np.zeros(len(starts), bool)
        inside[run[gap[both]]] = True
        curved = inside & (counts >= 4) & cubic
        if curved.any():
            knots = np.flatnonzero(valid & curved[run])
            m = np.zeros(n)
            m[knots] = many_second_derivatives(knots.astype(float), v[knots], counts[curved])
            use = both & curved[run[gap]]
            a = 1.0 - b
            curve = a * v[p] + b * v[q] + ((a ** 3 - a) * m[p] + (b ** 3 - b) * m[q]) * h * h / 6.0
            filled = np.where(use, curve, filled)
        done = v.copy()
        done[gap] = filled
        out.append(done)
    return out
