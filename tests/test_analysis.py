"""The whole analysis on the smallest tables."""

import json

import pytest

from checks import fixtures as fx
from trajecta.operators import monitor as mo
from trajecta.plans import analysis
from trajecta.sources.store import ResultStore


def test_analysis_end_to_end(spark, sf_dir, tmp_path):
    batches, readings = fx.batches(spark, sf_dir), fx.gappy_readings(spark, sf_dir)
    found = analysis.analyse(batches, readings, fx.VARIABLES)
    n = batches.count()
    assert found.aligned.count() == n * len(fx.VARIABLES) * 100
    assert found.aligned.where("value IS NULL").count() == 0
    assert found.profile.count() == len(fx.VARIABLES) * 100
    assert found.rich.count() == n * len(fx.VARIABLES) * 7
    steps = mo.monitor_steps(
        found.aligned, found.monitor.terms, found.monitor.meta, found.monitor.components)
    assert steps.count() == n * 100
    ranking = analysis.rank_parameters(found.basic, batches, boosted=False)
    assert sorted(r["rank"] for r in ranking.collect()) == list(range(1, 9))
    store = ResultStore(spark, str(tmp_path / "results"))
    run_id = analysis.save(store, found, ranking, filename="x.csv", data_format="long")
    facts = json.loads(store.run(run_id).first()["pipeline_meta"])
    assert sum(facts["imputation_methods"].values()) > 0 and facts["training_rung"] == "p75"
    assert {r["action"] for r in store.audit_log(run_id).collect()} == {
        "pipeline_built", "batches_saved", "golden_profile_saved", "cpp_rankings_saved"}
    assert store.batches(run_id).count() == n
    assert store.rankings(run_id).count() == len(fx.VARIABLES)
    assert store.profile(run_id).first()["n_golden"] >= 3


def test_unchanged_input_is_not_built_again(spark, sf_dir, tmp_path, monkeypatch):
    from trajecta.session import stage_count
    batches, readings = fx.batches(spark, sf_dir), fx.gappy_readings(spark, sf_dir)
    monkeypatch.setattr(analysis, "rank_parameters", lambda *a: None)  # the fit is tested above
    store = ResultStore(spark, str(tmp_path / "results"))
    before = stage_count(spark)
    first = analysis.run_once(store, batches, readings, fx.VARIABLES, filename="x", data_format="long")
    assert stage_count(spark) == before and store.batches(first).count() == batches.count()
    monkeypatch.setattr(analysis, "analyse", None)
    again = analysis.run_once(store, batches, readings.orderBy("price"), fx.VARIABLES, filename="x", data_format="long")
    assert again == first


def test_a_run_that_died_half_way_is_built_again(spark, sf_dir, tmp_path, monkeypatch):
    batches, readings = fx.batches(spark, sf_dir), fx.gappy_readings(spark, sf_dir)
    monkeypatch.setattr(analysis, "rank_parameters", lambda *a: None)
    store = ResultStore(spark, str(tmp_path / "results"))

    def die(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "save_profile", die)  # after the batches, before the rest
        with pytest.raises(RuntimeError):
            analysis.run_once(store, batches, readings, fx.VARIABLES, filename="x", data_format="long")
    assert store.runs().count() == 0
    found = analysis.run_once(store, batches, readings, fx.VARIABLES, filename="x", data_format="long")
    assert store.batches(found).count() == batches.count() and store.profile(found).count() > 0
    meta = json.loads(store.run(found).first()["pipeline_meta"])
    assert meta["tree_warning"].startswith("high overfitting risk")
