"""Fits by products of rows equal the fits by a matrix."""

import numpy as np
import pytest

from trajecta import config
from trajecta.operators import linear_models as lm


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 30)) + 0.1 * rng.normal(size=(40, 30))
    y = x[:, :3].sum(axis=1) + rng.normal(size=40)
    return spark.createDataFrame([(f"b{i}", x[i].tolist(), float(y[i])) for i in range(40)],
                                 "batch_id string, x array<double>, y double").cache()


def test_wide_fits_equal_matrix_fits(rows, monkeypatch):
    total = lm.moments(rows, 30)[0]
    xx, xy, yy = total.centred()
    values, loadings, reached = lm.principal_axes(xx / (total.n - 1), total.n, 4, 0.99)
    pls = lm.kernel_pls(xx, xy, 3)
    monkeypatch.setattr(config, "MATRIX_LIMIT", 10)
    monkeypatch.setattr(lm, "PIECE", 7)
    wide, _ = lm.cross_products(rows, 30)
    assert isinstance(wide, lm.RowProducts)
    assert wide.xy == pytest.approx(xy) and wide.yy == pytest.approx(yy)
    assert wide @ np.eye(30)[:, :2] == pytest.approx(xx[:, :2])
    v, p, r = wide.axes(4, 0.99)
    assert v == pytest.approx(values) and r == pytest.approx(reached)
    assert p == pytest.approx(loadings, abs=1e-5)
    assert lm.kernel_pls(wide, wide.xy, 3)["coef"] == pytest.approx(pls["coef"], abs=1e-8)


def test_component_importance_beyond_the_limit(spark, rows, monkeypatch):
    cells = rows.selectExpr("batch_id", "posexplode(x) AS (k, value)", "y AS yield").selectExpr(
        "batch_id", "format_string('f%02d', k) AS feature", "value", "yield")
    narrow = lm.component_importance(lm.feature_matrix(cells))
    monkeypatch.setattr(config, "MATRIX_LIMIT", 10)
    wide = lm.component_importance(lm.feature_matrix(cells))
    assert wide.explained == pytest.approx(narrow.explained) and wide.chosen == narrow.chosen
    assert wide.yield_corr == pytest.approx(narrow.yield_corr, abs=1e-5)


def test_moments_use_every_split_of_the_scan(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(500, 9)), rng.normal(size=500)
    a = np.column_stack([x, y, np.ones(500)])
    for parts in (1, 40):
        rows = spark.createDataFrame([(v.tolist(), float(w), i % 3) for i, (v, w) in enumerate(zip(x, y))],
                                     "x array<double>, y double, k int").repartition(parts)
        assert lm.partial_products(rows, 9).rdd.getNumPartitions() == parts
        assert np.allclose(lm.moments(rows, 9)[0].cross, a.T @ a, rtol=1e-12, atol=1e-12)
        by_key = lm.moments(rows, 9, "k")
        for k in range(3):
            assert np.allclose(by_key[k].cross, a[k::3].T @ a[k::3], rtol=1e-12, atol=1e-12)


def matrix_of(spark, x, y):
    rows = spark.createDataFrame([(f"BATCH-{i:06d}", v.tolist(), float(w)) for i, (v, w) in enumerate(zip(x, y))],
                                 "batch_id string, x array<double>, y double").repartition(4).cache()
    p = x.shape[1]
    return lm.FeatureMatrix([f"f{k:05d}" for k in range(p)], np.zeros(p), np.ones(p), rows, len(y))


def test_sparse_path_by_products_equals_the_matrix_path(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 40))
    x[:, 7] = x[:, 3] + 0.01 * rng.normal(size=50)
    y = 2 * x[:, 3] - x[:, 11] + rng.normal(size=50) + 60
    matrix = matrix_of(spark, (x - x.mean(0)) / x.std(0), y)
    narrow = lm.sparse_regression(matrix, alphas=30)
    monkeypatch.setattr(config, "SPARSE_LIMIT", 10)
    wide = lm.sparse_regression(matrix, alphas=30)
    assert wide.alpha == pytest.approx(narrow.alpha) and wide.r2 == pytest.approx(narrow.r2, abs=1e-7)
    assert wide.coef == pytest.approx(narrow.coef, abs=1e-5) and wide.selected == narrow.selected


def test_sparse_regression_of_five_thousand_columns_is_optimal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5000))
    x = (x - x.mean(0)) / x.std(0)
    y = 3 * x[:, 17] - 2 * x[:, 4000] + 0.5 * rng.normal(size=60) + 70
    found = lm.sparse_regression(matrix_of(spark, x, y), alphas=8)
    slope = x.T @ ((y - y.mean()) - x @ found.coef) / 60
    assert np.abs(slope).max() <= found.alpha * (1 + 1e-6)
    live = found.coef != 0
    assert slope[live] == pytest.approx(found.alpha * np.sign(found.coef[live]), rel=1e-6)
    assert found.selected[:2] == ["f00017", "f04000"] and found.r2 > 0.9
    assert lm.sparse_regression(matrix_of(spark, np.zeros((12, 600)), np.arange(12.0)), alphas=5).selected == []


def test_leave_one_out_beyond_the_limit(spark, monkeypatch):
    from trajecta.operators import monitor as mo

    rng = np.random.default_rng(2)
    base = rng.normal(size=(14, 3)) @ rng.normal(size=(3, 20)) + 0.1 * rng.normal(size=(14, 20))
    cells = [(f"b{i:02d}", v, s, s / 9.0, float(base[i, k * 10 + s])) for i in range(14)
             for k, v in enumerate("pq") for s in range(10)]
    runs = spark.createDataFrame(cells, "batch_id string, variable string, step int, time_norm double, value double")
    labels = spark.createDataFrame([(f"b{i:02d}", float(base[i, 0] + 50), 1) for i in range(14)],
                                   "batch_id string, yield double, duration int")

    def predictions(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(config, name, value)
        model = mo.fit_forecast(runs, labels, ["p", "q"], points=10, components=3)
        return {r["batch_id"]: r["predicted"] for r in
                mo.leave_one_out(runs, labels, model, points=10, components=3).collect()}

    narrow = predictions()
    assert predictions(MATRIX_LIMIT=5, FOLD_VALUES=100) == pytest.approx(narrow, abs=1e-9)  # blocks of five runs


def test_leave_one_out_of_more_runs_than_columns(spark, monkeypatch):
    """By panels of the matrix: no run comes to the driver, and the predictions are those of the matrix."""
    from trajecta.operators import monitor as mo

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 20)) + 0.1 * rng.normal(size=(30, 20))
    cells = [(f"b{i:02d}", v, s, s / 9.0, float(base[i, k * 10 + s])) for i in range(30)
             for k, v in enumerate("pq") for s in range(10)]
    runs = spark.createDataFrame(cells, "batch_id string, variable string, step int, time_norm double, value double")
    labels = spark.createDataFrame([(f"b{i:02d}", float(base[i, 0] + 50), 1) for i in range(30)],
                                   "batch_id string, yield double, duration int")

    def predictions():
        model = mo.fit_forecast(runs, labels, ["p", "q"], points=10, components=3)
        found = mo.leave_one_out(runs, labels, model, points=10, components=3)
        return {r["batch_id"]: r["predicted"] for r in found.collect()}

    narrow = predictions()
    monkeypatch.setattr(config, "MATRIX_LIMIT", 5)
    monkeypatch.setattr(config, "FOLD_VALUES", 100)  # panels of five columns
    monkeypatch.setattr(type(runs), "toLocalIterator", None)
    assert predictions() == pytest.approx(narrow, abs=1e-9)


def test_whole_runs_equal_cells(spark, monkeypatch):
    """Samples of one instant, a run at one instant, one reading, gaps, and runs over many Arrow batches."""
    from trajecta.operators import align as al, monitor as mo

    rng = np.random.default_rng(6)
    rows = [(f"r{i:02d}", float(rng.integers(0, 40)), float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal()))
            for i in range(24) for _ in range(rng.integers(2, 60))]
    rows += [("flat", 3.0, float(v), float(-v)) for v in range(7)] + [("one", 5.0, 1.5, None), ("one", None, 9.0, 9.0)]
    rows += [("short", 0.0, 2.0, 1.0), ("short", 0.0, 1.0, 4.0), ("short", 9.0, 8.0, 3.0), ("short", 9.0, 7.0, 5.0)]
    readings = spark.createDataFrame(rows, "batch_id string, time_index double, p double, q double").repartition(5)
    names = sorted({r[0] for r in rows})
    labels = spark.createDataFrame(
        [(b, float(rng.normal() + 50) if b != "r03" else None) for b in names], "batch_id string, yield double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cells, runs = (al.align(readings, ["p", "q"], points=10, whole=w) for w in (False, True))
        found = {r["batch_id"]: r["x"] for r in lm.RunRows(
            lm.scaled_rows(runs, scale_of(spark, 2, 10), ["p", "q"]).table, runs.matrix()).dense().collect()}
        assert found == {r["batch_id"]: r["x"] for r in al.unfold(cells, ["p", "q"]).collect()}

        def predictions(aligned):
            model = mo.fit_forecast(aligned, labels, ["p", "q"], points=10, components=2)
            out = mo.leave_one_out(aligned, labels, model, points=10, components=2)
            return {r["batch_id"]: (r["actual"], r["predicted"], r["fitted"]) for r in out.collect()}

        want = predictions(cells)
        assert len(want) == len(names) - 1
        for limits in ({}, {"MATRIX_LIMIT": 5, "FOLD_VALUES": 100}, {"WIDE_MATRIX": 10}):  # matrix, panels, blocks
            for name, value in limits.items():
                monkeypatch.setattr(config, name, value)
            got = predictions(runs)
            assert got.keys() == want.keys()
            assert [*got.values()] == [pytest.approx(want[b], abs=1e-8) for b in got]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def scale_of(spark, variables, points):
    return spark.createDataFrame([("pq"[k], s, 0.0, 1.0) for k in range(variables) for s in range(points)],
                                 "variable string, step int, mu double, sigma double")


def test_panels_are_sent_by_few_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(config, "MATRIX_LIMIT", 10)
    wide, _ = lm.cross_products(rows.repartition(40), 30)
    wide.rows, sent, add = wide.rows.repartition(60), [], lm.summed
    monkeypatch.setattr(lm, "summed", lambda of, *more: sent.append(of.rdd.getNumPartitions()) or add(of, *more))
    x = np.array([r["x"] for r in rows.collect()])
    assert np.column_stack([*wide.panels()]) == pytest.approx(x.T @ x)
    assert max(sent) <= max(lm.MERGE_SHARES, spark.sparkContext.defaultParallelism)


def test_shuffle_files_go_with_the_stage_table(spark):
    import time

    from trajecta.session import cut_lineage

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while held.hasNext():
            names.add(held.next().getName())
        return {x for x in names if x.startswith("shuffle_")}

    before = files()
    kept = cut_lineage(spark.range(1000).repartition(5, "id"), "freed")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and kept.count() == 1000
