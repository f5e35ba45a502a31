"""Hand-made edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import stats, warp
from trajecta.operators import align as al
from trajecta.operators import association as asn
from trajecta.operators import label as lb
from trajecta.operators import linear_models as lm
from trajecta.operators import monitor as mo
from trajecta.operators import profile as pf
from trajecta.sources import detect, ingest
from trajecta.sources.store import ResultStore, RunHeader


def batches(spark, yields):
    rows = [(f"b{i}", None if y is None else float(y), 10) for i, y in enumerate(yields)]
    return spark.createDataFrame(rows, "batch_id string, yield double, duration int")


def aligned(spark, series, variable="v"):
    rows = [(b, variable, s, s / 99.0, float(v)) for b, vs in series.items() for s, v in enumerate(vs)]
    return spark.createDataFrame(
        rows, "batch_id string, variable string, step int, time_norm double, value double")


def test_labels_need_every_yield_and_four_batches(spark):
    for ys in ([1, 2, 3], [1, 2, 3, None, 5]):
        rows = lb.label_quality(batches(spark, ys)).collect()
        assert {(r["quality"], r["is_golden"]) for r in rows} == {("Unknown", False)}
    rows = lb.label_quality(batches(spark, [1, 2, 3, 4])).collect()
    assert [r["quality"] for r in sorted(rows, key=lambda r: r["yield"])] == ["Poor", "Poor", "Good", "Golden"]


def test_golden_ladder(spark):
    def pick(ys):
        return lb.choose_golden(batches(spark, ys)).first()

    assert pick(range(12))["golden_pct_used"] == 0.75
    assert pick(range(8))["golden_pct_used"] == 0.67
    assert pick(range(6))["golden_pct_used"] == 0.60
    assert pick(range(5))["golden_pct_used"] == 0.50
    assert pick(range(4))["golden_pct_used"] is None
    got = lb.choose_training(batches(spark, range(12)), target=10.5).first()
    assert (got["n_good"], got["rung"]) == (3, "p75")
    got = lb.choose_training(batches(spark, range(12)), target=5).first()
    assert got["rung"] == "target"


def test_alignment_edges(spark):
    rows = [("one", 3.0, 7.0, None), ("same", 1.0, 1.0, 5.0), ("same", 1.0, 3.0, None),
            ("two", 0.0, 0.0, 1.0), ("two", 10.0, 99.0, None)]
    df = spark.createDataFrame(rows, "batch_id string, time_index double, v double, w double")
    out = {}
    for r in al.align(df, ["v", "w"], tie="v").collect():
        out.setdefault((r["batch_id"], r["variable"]), {})[r["step"]] = r["value"]
    assert all(len(v) == 100 for v in out.values())
    assert set(out["one", "v"].values()) == {7.0}
    assert set(out["one", "w"].values()) == {0.0}          # absent variable
    assert out["same", "v"][0] == 1.0 and out["same", "v"][99] == pytest.approx(3.0)
    assert set(out["same", "w"].values()) == {5.0}         # filled with the run's mean
    assert [out["two", "v"][s] for s in (0, 50, 99)] == pytest.approx([0.0, 50.0, 99.0])


def test_alignment_equals_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 50, 237))
    v = rng.normal(size=237)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, v)],
                               "batch_id string, time_index double, v double")
    got = [r["value"] for r in al.align(df, ["v"]).orderBy("step").collect()]
    want = np.interp(np.linspace(0, 1, 100), (t - t[0]) / (t[-1] - t[0]), v)
    assert got == pytest.approx(list(want), abs=1e-10)


def test_band_source_and_consistency(spark):
    three = {f"b{i}": np.full(100, float(i)) for i in range(3)}
    assert {r["band_source"] for r in pf.band(aligned(spark, three)).collect()} == {"ci"}
    four = {f"b{i}": np.full(100, float(i)) for i in range(4)}
    assert {r["band_source"] for r in pf.band(aligned(spark, four)).collect()} == {"sigma"}
    for n, dropped in ((7, 0), (8, 1)):
        runs = {f"b{i}": np.full(100, 0.01 * i) for i in range(n - 1)}
        runs["bad"] = np.full(100, 1000.0)
        assert pf.inconsistent_members(aligned(spark, runs)).count() == dropped


def test_phase_definitions_differ_at_step_66(spark):
    runs = aligned(spark, {"a": range(100)})
    rows = al.with_phases(runs).where("step = 66").collect()
    assert [r["phase"] for r in rows] == ["Reaction"]
    assert runs.where("step = 66").select(al.index_phase().alias("p")).first()["p"] == "Harvest"
    sizes = {r["phase"]: r["n"] for r in al.with_phases(runs).groupBy("phase").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == {"Startup": 33, "Reaction": 34, "Harvest": 33}


def test_constant_and_small_correlations(spark):
    rows = [(f"b{i}", f, v, float(i)) for i in range(8) for f, v in (("flat", 2.0), ("line", 3.0 * i))]
    rows += [(f"b{i}", "few", float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "batch_id string, feature string, value double, yield double")
    got = {r["feature"]: r for r in asn.correlations(df).collect()}
    assert got["flat"]["pearson"] is None
    assert got["line"]["pearson"] == pytest.approx(1.0) and got["line"]["p_value"] == pytest.approx(0.0, abs=1e-12)
    assert (got["few"]["pearson"], got["few"]["spearman"], got["few"]["p_value"]) == (0.0, 0.0, 1.0)


def test_distribution_functions():
    # textbook quantiles of Student's t
    for df, want in ((2, 4.302653), (10, 2.228139), (24, 2.063899), (200, 1.971896)):
        assert stats.t_ppf(0.975, df) == pytest.approx(want, abs=2e-6)
    assert stats.pearson_p(0.5, 20) == pytest.approx(0.0247690, abs=1e-6)
    # exact U of two samples without overlap: 2 / C(10, 5)
    assert stats.mann_whitney(25, 5, 5, 0) == pytest.approx(2 / math.comb(10, 5))
    assert math.isnan(stats.mann_whitney(10, 4, 9, 0))
    # brute force over all splits
    from itertools import combinations
    n1, n2, u = 5, 6, 24
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    want = min(1.0, 2 * np.mean([x >= max(u, n1 * n2 - u) for x in us]))
    assert stats.exact_u_tail(u, n1, n2) == pytest.approx(want)


def test_exact_u_law_by_counting_partitions():
    def plain(low, n1, n2):  # coefficients of the Gaussian binomial, one array entry per U
        counts = [1] + [0] * low
        for i in range(1, n1 + 1):
            counts = [c - (counts[k - n2 - i] if k >= n2 + i else 0) for k, c in enumerate(counts)]
            for k in range(i, low + 1):
                counts[k] += counts[k - i]
        return min(1.0, 2 * sum(counts) / math.comb(n1 + n2, n1))

    for n1, n2 in ((1, 1), (1, 9), (2, 2), (3, 7), (5, 5), (5, 40), (7, 23), (8, 8), (8, 150)):
        for u in {0, 1, n1, n2, n1 * n2 // 3, n1 * n2 / 2, n1 * n2}:
            assert stats.exact_u_tail(u, n1, n2) == plain(int(min(u, n1 * n2 - u)), n1, n2)
    # both tails meet at the centre; near it the normal law of so large a sample agrees
    n2 = 10**8
    assert stats.exact_u_tail(4 * n2, 8, n2) == pytest.approx(1.0, abs=1e-6)
    assert 0 < stats.exact_u_tail(8 * n2 * 0.1, 8, n2) < 1e-3
    assert stats.exact_u_tail(8 * n2 * 0.4, 8, n2) == pytest.approx(
        stats.normal_u_tail(8 * n2 * 0.4, 8, n2, 0), rel=0.05)


def test_warping_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(3, 17)), rng.normal(size=(3, 23))
    for x, y, got in zip(a, b, warp.warp_distances(a, b)):
        d = np.full((18, 24), np.inf)
        d[0, 0] = 0
        for i in range(1, 18):
            for j in range(1, 24):
                d[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert got == pytest.approx(math.sqrt(d[17, 23]))


def test_sparse_regression_meets_the_optimality_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x -= x.mean(0)
    y = 3 * x[:, 0] - 2 * x[:, 3] + rng.normal(size=60)
    y -= y.mean()
    for alpha in (0.05, 0.5, 1.5):
        w = lm.lasso_path(x.T @ x, x.T @ y, 60, [alpha])[0]
        slope = x.T @ (y - x @ w) / 60
        assert np.all(np.abs(slope) <= alpha + 1e-6)
        live = w != 0
        assert slope[live] == pytest.approx(alpha * np.sign(w[live]), abs=1e-6)


def nipals(x, y, components):
    """Textbook PLS with deflation of the data."""
    x, y = x.copy(), y.copy()
    ws, ps, qs = [], [], []
    for _ in range(components):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x, y = x - np.outer(t, p), y - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.solve(p.T @ w, np.array(qs))


def test_kernel_pls_and_leave_one_out_equal_refits():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 12))
    y = x @ rng.normal(size=12) + rng.normal(size=20) + 50
    z = (x - x.mean(0)) / x.std(0)
    yc = y - y.mean()
    assert lm.kernel_pls(z.T @ z, z.T @ yc, 4)["coef"] == pytest.approx(nipals(z, yc, 4))
    a = np.column_stack([z, y, np.ones(20)])
    got = mo._fold_predictions(z, y, mo.Totals.of_matrix(a.T @ a), 4)
    for i in range(20):
        keep = np.arange(20) != i
        mean, std = z[keep].mean(0), z[keep].std(0)
        coef = nipals((z[keep] - mean) / std, y[keep] - y[keep].mean(), 4)
        assert got[i] == pytest.approx(y[keep].mean() + (z[i] - mean) / std @ coef)


def test_monitor_equals_direct_projection(spark):
    rng = np.random.default_rng(12)
    runs = {f"b{i:02d}": rng.normal(size=20) for i in range(15)}
    rows = [(b, "v", s, s / 19.0, float(v)) for b, vs in runs.items() for s, v in enumerate(vs)]
    df = spark.createDataFrame(
        rows, "batch_id string, variable string, step int, time_norm double, value double")
    model = mo.fit_monitor(df, batches(spark, []).union(spark.createDataFrame(
        [(b, float(i), 1) for i, b in enumerate(runs)], "batch_id string, yield double, duration int")),
        ["v"], points=20, target=0.0)
    x = np.array([runs[b] for b in sorted(runs)])
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / 14)
    top, load = values[::-1][:model.components], vectors[:, ::-1][:, :model.components]
    got = {(r["batch_id"], r["time_step"]): r for r in mo.monitor_steps(
        df, model.terms, model.meta, model.components).collect()}
    for i, b in enumerate(sorted(runs)):
        for t in (1, 7, 20):
            seen = np.where(np.arange(20) < t, z[i], 0.0)
            score = seen @ load
            assert got[b, t]["t2"] == pytest.approx((score ** 2 / top).sum())
            assert got[b, t]["spe"] == pytest.approx(((seen - load @ score) ** 2).sum())


def test_detection_order_and_fallbacks(spark):
    df = spark.createDataFrame([("x", 1, 2.0, 3.0)], "Lot string, Step int, a double, Batch_Yield double")
    r = detect.detect_long(df)
    assert (r.batch_col, r.time_col, r.yield_col, r.cpp_cols) == ("Lot", "Step", "Batch_Yield", ["a"])
    both = spark.createDataFrame([("x", "y", 1)], "lot string, batch string, t int")
    assert detect.detect_long(both).batch_col == "batch"
    numeric = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert detect.detect_pivot(numeric).warnings and detect.detect_wide(numeric).warnings


def test_position_match_and_duplicate_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "t int, c1 double, c2 double")
    assert ingest.rename_by_position(df, ["c1", "c2"], ["A", "B"]).columns == ["t", "A", "B"]
    with pytest.raises(ValueError):
        ingest.rename_by_position(df, ["c1", "c2"], ["A"])
    with pytest.raises(ValueError):
        ingest.assert_unique(["x", "y", "x"])


def test_pivot_files_merge_on_the_union(spark):
    a = spark.createDataFrame([("08-03-2026 00:05", 2.0, 20.0), ("08-03-2026 00:00", 1.0, 10.0)],
                              "Timestamp string, B1 double, B2 double")
    b = spark.createDataFrame([("08-03-2026 00:00", 5.0)], "Timestamp string, B3 double")
    parsed = [ingest.parse_pivot(a, "Timestamp", ["B1", "B2"], "x"), ingest.parse_pivot(b, "Timestamp", ["B3"], "y")]
    runs, readings = ingest.merge_pivots(parsed, ["x", "y"])
    rows = sorted(tuple(r) for r in readings.select("batch_id", "time_index", "x").collect())
    assert rows == [("B1", 0, 1.0), ("B1", 1, 2.0), ("B2", 0, 10.0), ("B2", 1, 20.0), ("B3", 0, None)]
    assert {r["quality"] for r in runs.collect()} == {"Unknown"}


def test_fingerprint_sees_changed_readings(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 2.0), (3, 4.0)], "k int, v double")
    same = spark.createDataFrame([(3, 4.0), (1, 2.0), (1, 2.0)], "k int, v double")
    other = spark.createDataFrame([(3, 4.0), (3, 4.0), (3, 4.0)], "k int, v double")
    print_of = lambda df: tuple(ingest.fingerprint({"t": df}).first())
    assert print_of(a) == print_of(same) != print_of(other)


def test_store_cleans_and_replaces(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    rows = lb.label_quality(batches(spark, [1, 2, 3, None]))
    first, second = (store.save_run(RunHeader(f, "long", 4, 1)) for f in "ab")
    assert (first, second) == (1, 2)
    for run in (1, 2, 2):
        store.save_batches(rows, run)
    assert store.batches(2).count() == 4
    assert store.batches(2).where("yield_value IS NULL").count() == 1
    assert store.delete_run(1) and not store.delete_run(1)
    assert store.batches(1).count() == 0 and store.batches(2).count() == 4
    assert store.audit_log().where("run_id IS NULL").count() == 3  # built, saved, deleted
    store.save_batches(rows.limit(0), 2)
    assert store.batches(2).count() == 0
    store.save_batches(rows, 1)
    assert store.batches(1).count() == 4
    assert store.save_run(RunHeader("c", "long", 4, 1), run_id=0) == 0 and store.delete_run(0)
    assert [r["run_id"] for r in store.runs().collect()] == [2]


def test_cells_are_thinned_before_one_shuffle(spark):
    rng = np.random.default_rng(4)
    rows = [(f"b{i % 5}", float(u), int(u), float(rng.integers(5)), float(rng.integers(5)))
            for i, u in enumerate(rng.integers(0, 40, 600) / 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        cells = al.edge_cells(spark.createDataFrame(rows, "batch_id string, _u double, _cell int, _v0 double, _v1 double"), 2)
        got = {(r["batch_id"], r["_cell"]): tuple(r)[2:] for r in cells.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for b, u, c, *v in rows:
        groups.setdefault((b, c), []).append((u, v))
    assert got == {k: (min(u for u, _ in g), max(u for u, _ in g), *[min((u, v[i]) for u, v in g)[1] for i in (0, 1)],
                       *[max((u, v[i]) for u, v in g)[1] for i in (0, 1)]) for k, g in groups.items()}
    readings = spark.createDataFrame([(f"b{i % 3}", float(i), float(i)) for i in range(90)], "batch_id string, time_index double, v double")
    plan = al.align(readings, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(batch_id") == 1 and "_cell#" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)
