"""Results that must not depend on row order, on repeats or on size limits."""

import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta import config
from trajecta.functions import stats
from trajecta.operators import align as al
from trajecta.sources import ingest


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_alignment_ignores_the_order_of_equal_instants(spark):
    rows = [("a", 0.0, 1.0), ("a", 0.0, 9.0), ("a", 1.0, 2.0), ("a", 2.0, 5.0), ("a", 2.0, 3.0)]
    schema = "batch_id string, time_index double, v double"
    results = [rows_of(al.align(spark.createDataFrame(order, schema).coalesce(1), ["v"], points=5))
               for order in (rows, rows[::-1], rows[2:] + rows[:2])]
    assert results[0] == results[1] == results[2]
    by_tie = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", line int")
    values = [r["value"] for r in sorted(al.align(by_tie, ["v"], points=5, tie="line").collect(), key=lambda r: r["step"])]
    assert values == pytest.approx([1, 5.5, 2, 3.5, 5])


def test_untimed_readings_are_counted(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", None, 2.0), ("b", 1.0, 1.0)],
                               "batch_id string, time_index double, v double")
    assert rows_of(al.untimed(df)) == [("a", 1, 2)]


def test_large_pivot_files_parse(spark, monkeypatch):
    rng = np.random.default_rng(1)
    times = rng.permutation(300).tolist()
    rows = [(float(t), float(t) * 2, None if t % 7 == 0 else -float(t)) for t in times]
    df = spark.createDataFrame(rows, "t double, B1 double, B2 double")
    plain = rows_of(ingest.parse_pivot(df, "t", ["B1", "B2"], "v"))
    monkeypatch.setattr(config, "HOT_ROWS", 60)
    assert rows_of(ingest.parse_pivot(df, "t", ["B1", "B2"], "v")) == plain
    assert len(plain) == 600 and plain[5][1] == 5


@pytest.mark.parametrize("n1,n2", [(5, 5), (5, 7), (6, 6)])
def test_exact_u_against_enumeration(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(ranks, n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
        assert stats.mann_whitney(u, n1, n2, 0.0) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n2", [40, 500, 501, 5000])
def test_exact_u_has_no_size_switch(n2):
    """U <= 10 with five values: partitions of 0..10 into at most five parts."""
    def partitions(n, parts, largest):
        if n == 0:
            return 1
        return sum(partitions(n - k, parts - 1, k) for k in range(1, min(n, largest) + 1)) if parts else 0

    want = 2 * sum(partitions(k, 5, n2) for k in range(11)) / math.comb(n2 + 5, 5)
    assert stats.mann_whitney(10, 5, n2, 0.0) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_trapezoid_with_a_burst_at_one_instant(spark, monkeypatch, limit):
    from trajecta.operators.align import trapezoid_pairs
    rows = [("a", 5.0, 2.0)] * 200 + [("a", float(t), 1.0) for t in range(5)] + [("a", 6.0 + t, 3.0) for t in range(5)]
    df = spark.createDataFrame(rows, "batch_id string, t double, v double")
    monkeypatch.setattr(config, "HOT_ROWS", limit)
    area = trapezoid_pairs(df, F.col("t"), ["v"]).first()["_area0"]
    assert area == pytest.approx(4 * 1 + 1.5 + 2.5 + 4 * 3)


def test_pivot_files_take_the_variable_of_the_file(spark, tmp_path):
    for name, shift in (("Temp_run.csv", 0), ("pH_run.csv", 10)):
        (tmp_path / name).write_text("t,B1\n1,%d\n2,%d\n" % (shift, shift + 1))
    paths = [str(tmp_path / n) for n in ("Temp_run.csv", "pH_run.csv")]
    found = ingest.read_pivot_files(spark, dict(zip(paths, ("temperature", "pH"))))
    assert [name for name, _ in found] == ["temperature", "pH"]
    assert [t.count() for _, t in found] == [2, 2]


def test_unfolded_names():
    assert al.unfolded_names(["a", "b"], 2) == ["a_t001", "a_t002", "b_t001", "b_t002"]


def test_rate_source_gives_readings(spark):
    from trajecta.streaming.sources import rate_stream
    stream = rate_stream(spark, rows_per_second=50, batches=2)
    query = stream.writeStream.format("memory").queryName("rate_rows").trigger(processingTime="1 second").start()
    try:
        for _ in range(20):
            time.sleep(1)
            if spark.table("rate_rows").count():
                break
    finally:
        query.stop()
    assert {r["batch_id"] for r in spark.table("rate_rows").collect()} <= {"B0", "B1"}


def test_the_model_of_the_golden_runs_aligns_no_others(spark, tmp_path):
    from checks import fixtures as fx
    from checks import monitoring

    rng = np.random.default_rng(7)
    runs = [k for k in [*range(14), None] for _ in range(int(rng.integers(3, 40)))]
    rows = [(k, i // 3, int(rng.integers(9)), i % 3, float(rng.integers(50)), float(rng.integers(900)),
             None if i % 9 == 0 else float(rng.random()), float(rng.random()), str(rng.choice(["R", "A", "N"])),
             f"1995-01-{1 + i % 20:02d}") for i, k in enumerate(runs)]
    spark.createDataFrame(rows + rows[:60], """l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
        day string""").withColumn("l_shipdate", F.to_timestamp("day")).repartition(3).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    sf_dir = str(tmp_path)
    agreement = rows_of(monitoring.model_agreement(spark, sf_dir))
    assert len(agreement) == 8 and all(r[1] is not None for r in agreement)
    assert not {"readings", "aligned"} & {name for _, where, name in fx._STAGES if where == sf_dir}
    golden = {r[0] for r in fx.batches(spark, sf_dir).where("is_golden").collect()} - {None}
    assert 3 <= len(golden) < 14
    assert {r[0] for r in fx.golden_readings(spark, sf_dir).collect()} == golden
    few = rows_of(fx.golden_aligned(spark, sf_dir))
    whole = [r for r in rows_of(fx.aligned(spark, sf_dir)) if r[0] in golden]
    assert few == whole and len(whole) == 400 * len(golden)
    assert rows_of(fx.golden_aligned(spark, sf_dir)) == whole  # now taken from all runs
    by_run = fx.basic_features(fx.readings(spark, sf_dir), fx.VARIABLES)
    value = {(b, f): v for b, f, v in by_run.collect()}
    found = {(b, f): v for b, f, v in fx.features(spark, sf_dir).collect()}
    assert found == pytest.approx(value, abs=1e-8) and len(found) == 8 * 15
