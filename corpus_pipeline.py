"""A training-corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import best_fit_packing, decontamination, language_id, line_spread, simhash_golay
from trajecta.llm.common import stage, table

ORACLE_SQL = None  # n-gram hashes, XXH64 and token ids are beyond SQL; tests compare with brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return language_id.keep_identified(docs)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share leave the texts, also short ones; every document stays."""
    return line_spread.remove_spread_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component stays, rows without id being members too."""
    return simhash_golay.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of packed sequences."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_spread", remove_boilerplate),
    ("simhash_golay", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        out = apply(spark, docs, sf_dir)
        docs = stage(out, f"pipeline-{name}") if name != STAGES[-1][0] else out
    return docs
