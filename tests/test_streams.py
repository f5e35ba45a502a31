"""Streams whose state ends, and a sink that survives a crash at any point."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import monitoring as mon
from checks import streams
from trajecta import config
from trajecta.session import scratch_path
from trajecta.streaming import online, sources


def state_rows(progress):
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["stateOperators"]]


def test_no_state_is_left(spark, sf_dir):
    for run in (streams._sessions, streams._live_steps, lambda *a, progress: streams._watched(*a, progress=progress)):
        progress: list = []
        assert run(spark, sf_dir, progress=progress).count() > 0
        rows = state_rows(progress)
        assert max(rows) > 0 and rows[-1] == 0



def test_runs_share_states(spark, sf_dir, monkeypatch):
    """As many states as shares, and the same steps and asides."""
    monkeypatch.setattr(config, "STREAM_BUCKETS", 2)
    progress: list = []
    out = streams._watched(spark, sf_dir, disorder=True, progress=progress)
    aligned = fx.aligned(spark, sf_dir)
    runs = aligned.select("batch_id").distinct().count()
    assert runs > 2 >= max(state_rows(progress))
    assert out.where("NOT late AND NOT repeated").count() == 100 * runs
    asides = out.where("late OR repeated").select("batch_id", "variable", (F.col("time_step") - 1).alias("step"), "value")
    assert asides.exceptAll(aligned.select(asides.columns)).count() == 0 and asides.count() == aligned.count()


def test_closed_steps_by_hand():
    import numpy as np

    held = (np.zeros(0),) * 5
    cells = online.merged_cells(np.array([0.0, 0.4, 2.5, 5.0]), np.array([1.0, 2.0, 4.0, 9.0]), held)
    cells = online.merged_cells(np.array([2.2, 0.4]), np.array([3.0, 1.5]), cells)  # late, and a tie of one instant
    assert [c.tolist() for c in cells] == [[0, 2, 5], [0.0, 2.2, 5.0], [1.0, 3.0, 9.0], [0.4, 2.5, 5.0], [2.0, 4.0, 9.0]]
    step, value = online.closed_steps(cells, True, 1, False)
    assert step.tolist() == [0, 1, 2] and value[0] == 1.0 and value[1] == pytest.approx(2 + 0.6 / 1.8)
    step, value = online.closed_steps(tuple(c[1:] for c in cells), False, 1, True)
    assert step.tolist() == [3, 4, 5] and value[-1] == 9.0
    assert online.closed_steps(tuple(c[:1] for c in cells), True, 0, True)[0].tolist() == [0]


def rows_of(spark, path):
    return sorted((r["run"], r["k"], r["v"]) for r in spark.read.parquet(path).collect())


def test_a_replayed_epoch_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "crash")
    part = F.col("run")
    frame = lambda rows: spark.createDataFrame(rows, "run string, k int, v int")
    sources.upsert_rows(frame([(r, k, 0) for r in "abc" for k in range(3)]), 0, path, ["run", "k"], part)
    fresh = frame([("a", 0, 1), ("b", 5, 1)])
    want = sorted([(r, k, 0) for r in "abc" for k in range(3) if (r, k) != ("a", 0)] + [("a", 0, 1), ("b", 5, 1)])
    kept = {f: os.stat(f"{path}/_part=c/{f}").st_mtime_ns for f in os.listdir(f"{path}/_part=c")}

    def crash(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(sources, "roll_forward", crash)  # merged aside, nothing in place
        with pytest.raises(RuntimeError):
            sources.upsert_rows(fresh, 1, path, ["run", "k"], part)
    assert len(rows_of(spark, path)) == 9  # the old table is whole
    aside = f"{path}.aside-1"
    os.rename(f"{path}/_part=a", f"{path}-gone")  # killed between the delete and the rename of a partition
    sources.upsert_rows(fresh, 1, path, ["run", "k"], part)
    assert rows_of(spark, path) == want and not os.path.exists(aside)
    sources.upsert_rows(fresh, 1, path, ["run", "k"], part)  # replayed as a whole
    assert rows_of(spark, path) == want
    assert {f: os.stat(f"{path}/_part=c/{f}").st_mtime_ns for f in os.listdir(f"{path}/_part=c")} == kept


def test_folders_do_not_grow_with_the_runs(spark):
    path = scratch_path(spark, "many-runs")
    rows = spark.range(300).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("run"), "id")
    rows.write.parquet(path)
    table = sources.upsert_now(sources.reading_stream(spark, path, rows.schema), "shares", ["run"])
    assert sorted(map(tuple, table.collect()), key=lambda r: r[1]) == [(str(i) if i else None, i) for i in range(300)]
    folder = os.path.dirname(os.path.dirname(table.inputFiles()[0].removeprefix("file://")))
    assert len([f for f in os.listdir(folder) if f.startswith(sources.PART)]) <= sources.BUCKETS


def test_monitor_model_is_fixed(spark, sf_dir):
    """The event time changes nothing: the stream without it gives the same steps."""
    runs = fx.aligned(spark, sf_dir)
    path = scratch_path(spark, "untimed")
    runs.repartitionByRange(3, "step").write.parquet(path)
    out = online.monitor_stream(
        sources.reading_stream(spark, path, runs.schema), mon.model_terms(spark, sf_dir), mon.model_meta(spark, sf_dir),
        fx.VARIABLES, mon.COMPONENTS)
    untimed = sources.run_to_table(out, "untimed-steps").select("batch_id", "time_step", F.round("t2", 6).alias("t2"))
    timed = streams._watched(spark, sf_dir).select("batch_id", "time_step", F.round("t2", 6).alias("t2"))
    assert untimed.exceptAll(timed).count() == timed.exceptAll(untimed).count() == 0
