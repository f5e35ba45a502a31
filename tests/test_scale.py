"""The balanced plans give the results of the simple ones."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta import config
from trajecta.operators import association as asn
from trajecta.operators import features as ft
from trajecta.operators import linear_models as lm
from trajecta.operators import recommend as rc
from trajecta.operators import scale as sc
from trajecta.operators.align import align
from trajecta.sources.ingest import file_positions


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(t), float(rng.integers(0, 5))) for t in range(700)]
    rows += [(f"b{i}", float(t) * 1.5, float(rng.normal())) for i in range(9) for t in range(40)]
    return spark.createDataFrame(rows, "batch_id string, time_index double, v double")


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_split(spark, skewed, monkeypatch):
    order = [F.col("time_index")]
    plain, cell = sc.positions(skewed, ["batch_id"], order, F.col("time_index"))
    assert cell == ["batch_id"]
    monkeypatch.setattr(config, "HOT_ROWS", 60)
    split, cell = sc.positions(skewed, ["batch_id"], order, F.col("time_index"))
    assert cell == ["batch_id", "_chunk"]
    assert split.where("batch_id = 'hot'").select("_chunk").distinct().count() > 5
    assert collected(sc.plain(split).select(plain.columns)) == collected(plain)


def test_lookup_paths(spark, skewed, monkeypatch):
    dim = skewed.groupBy("batch_id").agg(F.max("v").alias("top"))
    small = collected(sc.lookup(skewed, dim, ["batch_id"]))
    monkeypatch.setattr(config, "BROADCAST_BYTES", 1)
    assert collected(sc.lookup(skewed, dim, ["batch_id"], heaviest=10)) == small
    salted = sc.lookup(skewed, dim, ["batch_id"])
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert collected(salted) == small


@pytest.mark.parametrize("keys", [[], ["batch_id"]])
def test_quantiles_inside_brackets(skewed, keys, monkeypatch):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    plain = sc.quantiles(skewed, keys, "v", probs).collect()
    monkeypatch.setattr(config, "QUANTILE_ROWS", 3)
    split = sc.quantiles(skewed, keys, "v", probs).collect()
    by = lambda rows: {tuple(r[k] for k in keys): r["q"] for r in rows}
    a, b = by(plain), by(split)
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-12)


def test_average_ranks_split(skewed, monkeypatch):
    plain = collected(sc.average_ranks(skewed, ["batch_id"], "v"))
    monkeypatch.setattr(config, "HOT_ROWS", 3)
    assert collected(sc.average_ranks(skewed, ["batch_id"], "v").select(
        "batch_id", "v", "ties", "rank")) == plain


def test_trapezoid_and_features_split(skewed, monkeypatch):
    plain = {(r["batch_id"], r["feature"]): r["value"] for r in ft.rich_features(skewed, ["v"]).collect()}
    monkeypatch.setattr(config, "HOT_ROWS", 60)
    split = {(r["batch_id"], r["feature"]): r["value"] for r in ft.rich_features(skewed, ["v"]).collect()}
    assert plain.keys() == split.keys()
    for k in plain:
        assert split[k] == pytest.approx(plain[k], abs=1e-9)


def test_alignment_without_broadcast(skewed, monkeypatch):
    plain = collected(align(skewed, ["v"]))
    monkeypatch.setattr(config, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(config, "HOT_ROWS", 60)
    assert collected(align(skewed, ["v"])) == plain


@pytest.fixture
def uneven(spark):
    """One outlier of 1e15, and half of the rows at one value."""
    rng = np.random.default_rng(3)
    values = [1e15, *[7.0] * 4000, *rng.normal(size=4000)]
    return spark.createDataFrame([("b", float(v), float(i)) for i, v in enumerate(values)],
                                 "batch_id string, v double, other double")


def test_chunks_of_uneven_values_stay_small(uneven, monkeypatch):
    tie = F.xxhash64("other")
    order = [F.col("v"), tie, F.col("other")]
    plain, _ = sc.positions(uneven, ["batch_id"], order, F.col("v"), tie=tie)
    want = collected(plain)
    monkeypatch.setattr(config, "HOT_ROWS", 500)
    split, cell = sc.positions(uneven, ["batch_id"], order, F.col("v"), tie=tie)
    assert max(r["count"] for r in split.groupBy(*cell).count().collect()) <= 500
    assert collected(sc.plain(split).select(plain.columns)) == want


def test_quantiles_and_ranks_of_uneven_values(uneven, monkeypatch):
    probs = [0.0, 0.05, 0.5, 0.999, 1.0]
    quantiles = sc.quantiles(uneven, [], "v", probs).first()["q"]
    ranks = collected(sc.average_ranks(uneven, ["batch_id"], "v"))
    monkeypatch.setattr(config, "QUANTILE_ROWS", 500)
    monkeypatch.setattr(config, "HOT_ROWS", 500)
    assert sc.quantiles(uneven, [], "v", probs).first()["q"] == pytest.approx(quantiles)
    assert collected(sc.average_ranks(uneven, ["batch_id"], "v").select("batch_id", "v", "ties", "rank")) == ranks


def bootstrap_input(spark, n):
    rng = np.random.default_rng(8)
    rows = [(f"b{i}", "f", float(v), 1.0, True) for i, v in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(
        rows, "batch_id string, feature string, value double, yield double, is_target boolean")


def test_bootstrap_has_one_law(spark, monkeypatch):
    marked = bootstrap_input(spark, 400)
    plain = rc.bootstrap_limits(marked).first()
    monkeypatch.setattr(config, "BOOTSTRAP_BINS", 16)
    monkeypatch.setattr(config, "BOOTSTRAP_RANGE", 37)
    assert rc.bootstrap_limits(marked).first() == plain


def test_bootstrap_draws_are_spread(spark, monkeypatch, tmp_path):
    """Small rows that make many draws are not put together into one task."""
    drawn, seen = rc._counted_draws, str(tmp_path)

    def watched(batches):
        from pyspark import TaskContext
        for batch in batches:
            open(f"{seen}/{TaskContext.get().partitionId()}", "w").close()
            yield from drawn(iter([batch]))

    marked = bootstrap_input(spark, 400)
    plain = rc.bootstrap_limits(marked).first()
    monkeypatch.setattr(rc, "_counted_draws", watched)
    monkeypatch.setattr(config, "BOOTSTRAP_TASK", 20_000, raising=False)
    assert rc.bootstrap_limits(marked).first() == plain
    assert len(list(tmp_path.iterdir())) > 5


def test_bootstrap_draws_are_never_rows(spark, monkeypatch):
    """Whole and split repetitions side by side; no plan makes rows of draws, which Spark would send to the driver."""
    marked = bootstrap_input(spark, 400).unionByName(
        bootstrap_input(spark, 90).withColumn("feature", F.lit("g"))).unionByName(
        bootstrap_input(spark, 2).withColumn("feature", F.lit("h")))
    want = collected(rc.bootstrap_limits(marked, reps=60))
    monkeypatch.setattr(config, "BOOTSTRAP_BINS", 16)
    monkeypatch.setattr(config, "BOOTSTRAP_RANGE", 100)
    out = rc.bootstrap_limits(marked, reps=60)
    assert collected(out) == want and len(want) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "strategy=merge" in plan


def test_bootstrap_is_resampling(spark):
    values = sorted(r["value"] for r in bootstrap_input(spark, 50).collect())
    n, p10, p90 = len(values), [], []
    for rep in range(40):
        words = [int(hashlib.md5(f"f|{rep}|{d}".encode()).hexdigest()[:8], 16) for d in range(n)]
        sample = [values[w % n] for w in words]
        p10.append(np.percentile(sample, 10))
        p90.append(np.percentile(sample, 90))
    got = rc.bootstrap_limits(bootstrap_input(spark, 50), reps=40).first()
    want = [*np.percentile(p10, [5, 95]), *np.percentile(p90, [5, 95])]
    assert [got[c] for c in ("p10_low", "p10_high", "p90_low", "p90_high")] == pytest.approx(want)


def test_bootstrap_of_tiny_groups_keeps_the_point(spark):
    rows = [("a", "f", 1.0, 1.0, True), ("b", "f", 2.0, 1.0, True)]
    marked = spark.createDataFrame(
        rows, "batch_id string, feature string, value double, yield double, is_target boolean")
    got = rc.bootstrap_limits(marked).first()
    assert got["p10_low"] == got["p10_high"] == pytest.approx(1.1)
    assert got["ci_uncertainty"] == 0


def test_file_positions_follow_the_file(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).coalesce(1).write.parquet(path)
    got = file_positions(spark.read.parquet(path).select("id", "_metadata"))
    assert got.where("id <> pos").count() == 0
    assert got.count() == 5000


def test_tree_draws_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 4))
    y = x[:, 0] * 2 + x[:, 1] * x[:, 2] + rng.normal(size=240)
    cells = spark.createDataFrame(
        [(f"b{i:03d}", f"f{k}", float(x[i, k]), float(y[i])) for i in range(240) for k in range(4)],
        "batch_id string, feature string, value double, yield double")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in (4, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        matrix = lm.feature_matrix(cells.repartition(parts))
        got = [{r.feature: r.importance for r in fit(matrix, trees=6).collect()}
               for fit in (asn.forest_importance, asn.boosted_importance)]
        found.append(got)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    for other in found[1:]:
        for a, b in zip(found[0], other):
            assert b == pytest.approx(a, abs=1e-12)
    assert max(found[0][0], key=found[0][0].get) == "f0"
    with_more = asn.forest_importance  # more parts beyond the rows of one
    old, asn.TREE_ROWS = asn.TREE_ROWS, 20
    try:
        assert sum(r.importance for r in with_more(matrix, trees=6).collect()) == pytest.approx(1.0)
    finally:
        asn.TREE_ROWS = old


def test_folds_of_ids_with_a_common_prefix(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("format_string('BATCH-%05d', (id * 7919) % 20000) AS batch_id")
    monkeypatch.setattr(config, "HOT_ROWS", 1_000)
    got = lm.with_fold(rows, 20_000, 3).orderBy("batch_id").collect()
    assert [r.fold for r in got] == [0] * 6_667 + [1] * 6_667 + [2] * 6_666
