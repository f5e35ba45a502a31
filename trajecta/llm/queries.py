"""Queries of the operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import (
    best_fit_packing, decontamination, embedding_whitening, html_extraction, language_id, lexical_search,
    license_scan, line_frequency, line_spread, ppm_score, simhash_golay, token_counts, toxicity, twins,
)
from trajecta.llm.common import table

ENTRIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(fn):
        ENTRIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


@entry("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@entry("op2_line_frequency", twins.QUALITY)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(table(spark, sf_dir, "documents"))


@entry("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@entry("op4_ppm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.score(table(spark, sf_dir, "documents"))


@entry("op5_decontamination", twins.DECONTAMINATION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@entry("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@entry("op7_simhash_golay")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.digest(simhash_golay.near_duplicates(table(spark, sf_dir, "documents")))


@entry("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


@entry("op9_line_spread", twins.LINE_SPREAD)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_chars", "n_removed")


@entry("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@entry("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@entry("op12_lexical_search", twins.LEXICAL_SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@entry("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))
