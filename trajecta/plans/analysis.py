"""The whole analysis: readings and batches in, result tables out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta import config
from trajecta.operators import association as asn
from trajecta.operators import features as ft
from trajecta.operators import impute as im
from trajecta.operators import label as lb
from trajecta.operators import linear_models as lm
from trajecta.operators import monitor as mo
from trajecta.operators import profile as pf
from trajecta.operators.align import align
from trajecta.session import cut_lineage, drop_stages, stage_count
from trajecta.sources.ingest import fingerprint_text
from trajecta.sources.store import ResultStore, RunHeader


@dataclass
class Analysis:
    """Every table later steps read; each is written once."""

    variables: list[str]
    points: int
    methods: DataFrame
    imputed: DataFrame
    golden: DataFrame
    training: DataFrame
    batches: DataFrame
    readings: DataFrame
    aligned: DataFrame
    profile: DataFrame
    members: DataFrame
    profile_meta: DataFrame
    basic: DataFrame
    rich: DataFrame
    missing: DataFrame
    outliers: DataFrame
    monitor: mo.Model
    forecast: mo.Model


def analyse(
    batches: DataFrame, readings: DataFrame, variables: Sequence[str],
    points: int = config.GRID_POINTS,
) -> Analysis:
    """Impute, align, learn the profile, extract features and fit the models.

    Imputed readings feed alignment and both feature sets, so they are
    written once.
    """
    variables = list(variables)
    batches = cut_lineage(batches, "batches")  # one row per batch, read by every step
    missing = im.missing_summary(readings, variables)
    filled = cut_lineage(im.impute(readings, variables), "readings")
    runs = cut_lineage(align(filled, variables, points), "aligned")
    members = cut_lineage(pf.profile_members(batches, runs), "members")
    profile = pf.require_profile(cut_lineage(pf.build_profile(batches, runs, members=members), "profile"))
    basic = cut_lineage(ft.basic_features(filled, variables), "basic")
    return Analysis(
        variables=variables,
        points=points,
        methods=im.method_counts(im.methods(readings, variables)),
        imputed=im.imputed_share(readings, variables),
        golden=lb.choose_golden(batches, runs),
        training=lb.choose_training(batches),
        batches=batches,
        readings=filled,
        aligned=runs,
        profile=profile,
        members=members,
        profile_meta=pf.profile_meta(members),
        basic=basic,
        rich=cut_lineage(ft.rich_features(filled, variables), "rich"),
        missing=missing,
        outliers=ft.all_outliers(batches, basic),
        monitor=mo.fit_monitor(runs, batches, variables, points),
        forecast=mo.fit_forecast(runs, batches, variables, points),
    )


def rank_parameters(features: DataFrame, batches: DataFrame, boosted: bool = True) -> DataFrame:
    """The combined ranking from the four kinds of evidence."""
    prepared = cut_lineage(lb.prepare_features(features, batches), "prepared")
    matrix = lm.feature_matrix(prepared)
    trees = asn.tree_score(
        asn.forest_importance(matrix), asn.boosted_importance(matrix) if boosted else None)
    evidence = {
        "corr": asn.correlations(prepared, with_p=False).withColumn("score", F.col("combined")),
        "tree": trees,
        "pca": lm.component_importance(matrix).importance,
        "lasso": lm.sparse_regression(matrix).table,
    }
    scores = None
    for method, table in evidence.items():
        part = table.select("feature", F.lit(method).alias("method"), "score")
        scores = part if scores is None else scores.unionByName(part)
    return asn.combined_ranking(scores, matrix.n, len(matrix.names))


def facts(found: Analysis) -> dict:
    """What a saved run remembers of its building: imputation, missingness, rungs, outliers."""
    def table(df: DataFrame, key: str, value: str) -> dict:
        return {r[key]: r[value] for r in df.collect()}  # a handful of rows

    share = found.imputed.first()
    golden, training = found.golden.first(), found.training.first()
    return {
        "imputation_methods": table(found.methods, "method", "n_series"),
        "confidence": table(im.confidence_counts(found.missing), "confidence", "n_batches"),
        "imputed_pct": share["imputed_pct"], "imputed_cells": share["imputed_cells"],
        "golden_pct_used": golden["golden_pct_used"], "training_batches": training["n_good"],
        "training_rung": training["rung"],
        "outliers": table(found.outliers.groupBy("reasons").agg(F.count(F.lit(1)).alias("n")), "reasons", "n"),
    }


def save(
    store: ResultStore, found: Analysis, ranking: DataFrame | None, *, filename: str,
    data_format: str, run_name: str | None = None, fingerprint: str | None = None,
) -> int:
    """Write the analysis to the result tables; returns the run id.

    The header with the fingerprint comes last and makes the run known: what a run
    that died before has written belongs to an id that no header names.
    """
    known = facts(found) | ({"fingerprint": fingerprint} if fingerprint else {})
    totals = found.batches.agg(F.count(F.lit(1)), F.count("yield")).first()
    columns = found.basic.select("feature").distinct().count()
    known["tree_warning"] = asn.tree_sizes(totals[1], columns).warning
    run_id = store.take_run_id()
    store.save_batches(found.batches, run_id)
    store.save_profile(found.profile, found.profile_meta, run_id, found.members)
    if ranking is not None:
        store.save_rankings(asn.best_rows(ranking), run_id)
    return store.save_run(RunHeader(
        filename=filename, data_format=data_format, n_batches=totals[0], n_cpps=len(found.variables),
        n_time_steps=found.points, has_yield=totals[1] > 0, golden_pct_used=known["golden_pct_used"],
        cpp_vars=found.variables, run_name=run_name, facts=known), run_id)


def run_once(
    store: ResultStore, batches: DataFrame, readings: DataFrame, variables: Sequence[str], *,
    filename: str, data_format: str, points: int = config.GRID_POINTS, run_name: str | None = None,
) -> int:
    """Analyse and save, unless a saved run was built from the same input; the run id either way."""
    mark = fingerprint_text({"batches": batches, "readings": readings}) + f";{points};{','.join(variables)}"
    known = store.run_of(mark)
    if known is not None:
        return known
    spark, before = batches.sparkSession, stage_count(batches.sparkSession)
    found = analyse(batches, readings, variables, points)
    ranking = rank_parameters(found.basic, batches)
    run_id = save(
        store, found, ranking, filename=filename, data_format=data_format, run_name=run_name, fingerprint=mark)
    drop_stages(spark, before)  # the results are in the store
    return run_id
