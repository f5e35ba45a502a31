"""Distribution functions Spark lacks, applied to group-level rows in Arrow batches."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            total *= change
        if abs(change - 1.0) < 1e-16:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > t) for Student's t."""
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the tail."""
    if df <= 0 or not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    tail = 2 * (1 - p)
    while t_two_sided(hi, df) > tail:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def pearson_p(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson correlation."""
    df = n - 2
    if df <= 0 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(abs(r) * math.sqrt(df / (1 - r * r)), df)


@functools.cache
def _part_counts(k: int) -> tuple[int, list[int]]:
    """(L, N): partitions into parts 1, 1, 2, ..., k have the series N(q) / (1 - q^L)^(k+1)."""
    period = math.lcm(*range(1, k + 1))
    series = [1]
    for part in (1, *range(1, k + 1)):
        # times 1 + q^part + q^(2 part) + ... below q^period: running sums with a stride
        grown = series + [0] * (period - part)
        for i in range(part, len(grown)):
            grown[i] += grown[i - part]
        for i in range(len(grown) - 1, period - 1, -1):
            grown[i] -= grown[i - period]
        series = grown
    return period, series


def _partitions_up_to(m: int, k: int) -> int:
    """Partitions of at most ``m`` into parts of at most ``k``."""
    period, series = _part_counts(k)
    return sum(series[t] * math.comb((m - t) // period + k, k)
               for t in range(m % period, min(m, len(series) - 1) + 1, period))


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided exact Mann-Whitney p for samples without ties.

    U counts partitions into at most n1 parts of at most n2 each.  Their series
    is that of partitions with parts up to n1 times the product of
    (1 - q^(n2+i)), so the lower tail is a sum over the subsets of 1..n1 in
    whole numbers: its cost grows with 2^n1 (n1 is 8 at most), not with n2.
    """
    n1, n2 = int(min(n1, n2)), int(max(n1, n2))
    low = int(math.floor(min(u, n1 * n2 - u)))
    signed = {0: 1}  # the product of (1 - q^(n2+i)) up to q^low
    for i in range(1, n1 + 1):
        for at, sign in list(signed.items()):
            if at + n2 + i <= low:
                signed[at + n2 + i] = signed.get(at + n2 + i, 0) - sign
    count = sum(sign * _partitions_up_to(low - at, n1) for at, sign in signed.items() if sign)
    return float(min(1.0, 2 * count / math.comb(n1 + n2, n1)))


def normal_u_tail(u: float, n1: float, n2: float, tie_term: float) -> float:
    """Two-sided p by the normal law with tie and continuity correction."""
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    top = max(u, n1 * n2 - u)
    z = (top - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return float(min(1.0, math.erfc(z / math.sqrt(2.0))))


def mann_whitney(u: float, n1: float, n2: float, tie_term: float) -> float:
    """Exact without ties when one side is at most 8, normal otherwise; NaN under
    five values on a side."""
    if n1 < 5 or n2 < 5 or any(map(math.isnan, (u, tie_term))):
        return math.nan
    if tie_term == 0 and min(n1, n2) <= 8:
        return exact_u_tail(u, int(n1), int(n2))
    return normal_u_tail(u, n1, n2, tie_term)


def _series(fn, *columns: pd.Series) -> pd.Series:
    out = [fn(*map(float, row)) if not any(pd.isna(v) for v in row) else None
           for row in zip(*columns)]
    return pd.Series([None if v is None or math.isnan(v) else v for v in out], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_ppf, p, df)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _series(pearson_p, r, n)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return _series(mann_whitney, u, n1, n2, ties)
