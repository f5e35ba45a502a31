"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every ASCII character that is no letter becomes a space,
and the character 1-, 2- and 3-grams are hashed to ``2**bits`` buckets.  Training
counts buckets per language on a bounded sample of labelled rows (about ``sample_rows``,
and ``LEAST_ROWS`` of every language, those of smallest hash of id and text); the log-probability matrix, buckets x languages,
is broadcast.  Scoring is numpy on Arrow slices of whole texts.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0;
rows without a language or in the held-out fold teach nothing; ties go to the
first language in order; with no training row at all everything is ``und``.
Repeated rows count as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import fold, map_slices, slices, text_key

BITS = 16
SAMPLE_ROWS = 12_000
LEAST_ROWS = 300  # of every language
SLICE = 1 << 18  # bytes of text at a time: some dozens of bytes are held per character
EVIDENCE = 40.0  # n-grams to which the evidence of a longer text is tempered


@dataclass
class Languages:
    names: list[str]
    log_prob: np.ndarray  # float32, buckets x languages
    prior: np.ndarray


def gram_buckets(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row: buckets, the row of each, characters per row."""
    text = pc.utf8_lower(pc.fill_null(text.cast(pa.string()), ""))
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    shift = np.uint32(32 - bits)
    one = codes * np.uint32(2654435761)
    buckets, owners = [one >> shift], [rows]
    if len(codes) > 1:
        two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(2246822519)
        same = rows[:-1] == rows[1:]
        buckets.append(((two ^ (two >> np.uint32(15))) * np.uint32(3266489917) >> shift)[same])
        owners.append(rows[1:][same])
    if len(codes) > 2:
        three = two[:-1] * np.uint32(31) + codes[2:] * np.uint32(668265263)
        same = rows[:-2] == rows[2:]
        buckets.append(((three ^ (three >> np.uint32(15))) * np.uint32(374761393) >> shift)[same])
        owners.append(rows[2:][same])
    return np.concatenate(buckets), np.concatenate(owners), sizes


def train(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS,
          bits: int = BITS, smoothing: float = 0.5) -> Languages:
    """Bucket counts per language of the sample; sums are merged by Spark.

    A language gives its share of ``sample_rows``, but ``LEAST_ROWS`` rows at least (all, if it
    has fewer), so that rare ones are learnt too; the prior is that of all training rows.
    The driver holds a row per language, as the model holds a column.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        (fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Languages([], np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    n = sum(sizes.values())
    shares = F.create_map(*[F.lit(v) for lang, size in sizes.items()
                            for v in (lang, max(sample_rows / n, LEAST_ROWS / size))])
    draw = F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(draw < shares[F.col("lang")]).select("lang", "text")

    def count(batch: pa.RecordBatch) -> dict:
        langs = batch.column("lang").to_pylist()
        buckets, owners, _ = gram_buckets(batch.column("text"), bits)
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)
        pairs, seen = np.unique(code[owners] << bits | buckets, return_counts=True)
        mask = (1 << bits) - 1
        return {"lang": [*names, *np.array(names, object)[pairs >> bits]],
                "bucket": np.concatenate([np.full(len(names), -1), pairs & mask]),  # -1: the rows
                "n": np.concatenate([np.bincount(code, minlength=len(names)), seen])}

    types = {"lang": pa.string(), "bucket": pa.int64(), "n": pa.int64()}
    got = map_slices(sample, count, types, SLICE).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))  # at most 2**bits + 1 rows for each
    if not names:
        return Languages([], np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    table = np.zeros(((1 << bits) + 1, len(names)))
    at = np.array([names.index(x) for x in got.column("lang").to_pylist()])
    table[got.column("bucket").to_numpy(), at] = got.column("n").to_numpy()
    seen, counts = np.array([sizes[x] for x in names], float), table[:-1] + smoothing
    return Languages(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(seen / seen.sum()))


def posteriors(text: pa.Array, model: Languages, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior per row and language, and the number of n-grams of each row.

    The mean log-likelihood counts as that of ``EVIDENCE`` n-grams at most, as
    neighbouring n-grams are far from independent.
    """
    buckets, owners, sizes = gram_buckets(text, bits)
    n = np.bincount(owners, minlength=len(sizes)).astype(float)
    logs = np.stack([np.bincount(owners, weights=model.log_prob[:, k][buckets], minlength=len(sizes))
                     for k in range(len(model.names))], axis=1)
    logs = logs * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None] + model.prior
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), n


def has_letter(text: pa.Array) -> np.ndarray:
    found = pc.match_substring_regex(pc.fill_null(text.cast(pa.string()), ""), r"\p{L}")
    return found.to_numpy(zero_copy_only=False)


def decide(text: pa.Array, model: Languages) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    if not model.names:
        return ["und"] * len(text), np.zeros(len(text))
    p, _ = posteriors(text, model)
    letters, best = has_letter(text), p.argmax(axis=1)
    return [model.names[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = decide(batch.column("text"), shared.value)
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    return map_slices(docs.select("doc_id", "text"), run,
                      {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}, SLICE)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt on the other folds, scored on all."""
    model = train(docs, folds, held, **options)
    return predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified with ``least_score`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                names, scores = decide(part.column("text"), shared.value)
                yield part.filter(pa.array((np.array(names) != "und") & (scores >= least_score)))

    return docs.mapInArrow(run, docs.schema)
