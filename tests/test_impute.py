"""Missing values against brute force, and the split path against the plain one."""

import numpy as np
import pytest

from trajecta import config
from trajecta.functions.spline import second_derivatives
from trajecta.operators import impute as im

SCHEMA = "batch_id string, time_index double, v double"


def frame(spark, series):
    rows = [(b, float(t), None if v is None else float(v)) for b, vs in series.items()
            for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["batch_id"], r["time_index"])):
        out.setdefault(r["batch_id"], []).append(r["v"])
    return out


def spline_by_dense_solve(x, y, at):
    """Piecewise cubics from one dense system: values, smoothness, not-a-knot."""
    n = len(x) - 1
    rows, rhs = [], []

    def row(i, coefs, target):
        r = np.zeros(4 * n)
        r[4 * i:4 * i + 4] = coefs
        return r, target

    for i in range(n):
        h = x[i + 1] - x[i]
        for coefs, t in (([1, 0, 0, 0], y[i]), ([1, h, h * h, h ** 3], y[i + 1])):
            r, t = row(i, coefs, t)
            rows.append(r), rhs.append(t)
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        for a, b in (([0, 1, 2 * h, 3 * h * h], [0, 1, 0, 0]), ([0, 0, 2, 6 * h], [0, 0, 2, 0])):
            r = np.zeros(4 * n)
            r[4 * i:4 * i + 4] = a
            r[4 * i + 4:4 * i + 8] = [-c for c in b]
            rows.append(r), rhs.append(0.0)
    for i in (0, n - 2):
        r = np.zeros(4 * n)
        r[4 * i + 3], r[4 * i + 7] = 1, -1
        rows.append(r), rhs.append(0.0)
    c = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0].reshape(n, 4)
    out = []
    for t in at:
        i = min(max(np.searchsorted(x, t) - 1, 0), n - 1)
        d = t - x[i]
        out.append(c[i] @ [1, d, d * d, d ** 3])
    return out


def test_methods_by_number_of_points(spark):
    got = values(im.impute(frame(spark, {
        "none": [None, None, None], "one": [None, 5, None], "two": [None, 2, None, 4, None],
        "cubic": [None, 0, 1, None, 27, 64, None, 216, None],
    }), ["v"]))
    median = float(np.median([5, 2, 4, 0, 1, 27, 64, 216]))
    assert got["none"] == [median] * 3
    assert got["one"] == [5, 5, 5]
    assert got["two"] == [2, 2, 3, 4, 4]
    # cubes of 0..6 at positions 1..7: the spline reproduces a cubic, ends are filled flat
    assert got["cubic"] == pytest.approx([0, 0, 1, 8, 27, 64, 125, 216, 216])


def test_spline_equals_dense_solve(spark):
    rng = np.random.default_rng(3)
    series = {}
    for b in range(4):
        v = list(rng.normal(size=40))
        for i in rng.choice(np.arange(1, 39), 14, replace=False):
            v[i] = None
        series[f"b{b}"] = v
    got = values(im.impute(frame(spark, series), ["v"]))
    for b, v in series.items():
        x = np.array([i for i, w in enumerate(v) if w is not None], dtype=float)
        y = np.array([w for w in v if w is not None])
        gaps = [i for i, w in enumerate(v) if w is None]
        assert [got[b][i] for i in gaps] == pytest.approx(spline_by_dense_solve(x, y, gaps), abs=1e-7)


def test_long_spline_matches_short_solver():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.integers(1, 4, 300)).astype(float)
    y = rng.normal(size=300)
    m = second_derivatives(x, y)
    near = second_derivatives(x[100:230], y[100:230])
    # a halo of 64 knots leaves no difference in the middle
    assert near[64:66] == pytest.approx(m[164:166], abs=1e-12)


def test_split_runs_and_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    series = {}
    for b, n in (("hot", 900), ("small", 30)):
        v = list(np.cumsum(rng.normal(size=n)))
        for i in rng.choice(n, n // 3, replace=False):
            v[i] = None
        series[b] = v
    plain = values(im.impute(frame(spark, series), ["v"]))
    linear = values(im.impute(frame(spark, series), ["v"], cubic=False))
    monkeypatch.setattr(config, "HOT_ROWS", 50)
    monkeypatch.setattr(config, "SPLINE_BLOCK", 150)
    split = values(im.impute(frame(spark, series), ["v"]))
    split_linear = values(im.impute(frame(spark, series), ["v"], cubic=False))
    for b in series:
        assert split[b] == pytest.approx(plain[b], abs=1e-9)
        assert split_linear[b] == pytest.approx(linear[b], abs=1e-9)


def test_blocks_with_gaps_of_many_decades(spark, monkeypatch):
    """Blocks and halo against the whole solve where spacings differ a thousandfold."""
    rng = np.random.default_rng(13)
    v = []
    for _ in range(260):
        v += [float(rng.normal())] + [None] * int(10 ** rng.uniform(0, 3) - 1)
    df = frame(spark, {"hot": [*v, 1.0], "small": [1, None, 2, 3, None, 4]})
    plain = values(im.impute(df, ["v"]))
    monkeypatch.setattr(config, "HOT_ROWS", 5000)
    monkeypatch.setattr(config, "SPLINE_BLOCK", 150)
    split = values(im.impute(df, ["v"]))
    scale = np.abs(plain["hot"]).max()
    assert np.abs(np.array(split["hot"]) - plain["hot"]).max() <= 1e-9 * scale
    assert split["small"] == pytest.approx(plain["small"])
