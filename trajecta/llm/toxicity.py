"""Toxicity: a factorization machine over hashed terms.

score(x) = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

Terms are the lower-cased words and, so that inflected forms meet, their first
four characters; a document has the set of them, hashed to ``2**bits`` features.
A feature is live if it occurs in ``LEAST_DF`` sampled documents, whatever its own
share of toxic ones: the pairwise term sees two words that mean little or nothing
apart (an insult and a group mention).  A linear weight is learnt only where that
share is ``LEAST_Z`` standard errors off the mean; others are noise of the sample.
The machine is fitted by AdaGrad on a bounded sample of labelled rows of the
training folds (about ``sample_rows``, as many of each class as far as there are,
drawn by a hash of the id) and broadcast; scoring is numpy on Arrow slices of whole texts.

Defined cases: NULL and empty texts have no feature and get the score of the
bias; labels without a document, documents without a label and NULL labels
teach nothing; a doc_id labelled twice counts as its largest label; with one
class only the score is the smoothed share of that class.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import fold, map_slices, text_key, texts_of

BITS = 20
LEAST_DF, LEAST_Z = 3, 2.5
FACTORS = 4
SAMPLE_ROWS = 16_000
THRESHOLD = 0.3


@dataclass
class Machine:
    bias: float
    value: np.ndarray    # float32, weight of a feature's presence
    linear: np.ndarray   # float32
    factors: np.ndarray  # float32, features x FACTORS


def term_sets(texts: list[bytes], bits: int = BITS,
              live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (live) features of each text, in a row, and how many each text has."""
    sets = [set(t.lower().split()) for t in texts]
    words = pa.array(itertools.chain.from_iterable(sets), pa.binary()).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    mask = (1 << bits) - 1
    strip = b".,;:!?()[]\"'*#$%&-_"
    features = np.empty((len(distinct), 2), np.int64)
    for i, w in enumerate(distinct):
        w = w.strip(strip)
        stem = w.decode("utf-8", "ignore")[:4].encode()
        features[i] = (zlib.crc32(w) & mask, zlib.crc32(b"^" + stem) & mask) if w else -1
    if live is not None:
        features[~live[features]] = -1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    index = words.indices.to_numpy(zero_copy_only=False)
    index, owner = index[some := (features >= 0).any(axis=1)[index]], owner[some]
    found = features[index].ravel()
    pairs = np.unique(((np.repeat(owner, 2) << bits) + found)[found >= 0])
    return pairs & mask, np.bincount(pairs >> bits, minlength=len(sets))


def raw_scores(features: np.ndarray, sizes: np.ndarray, m: Machine) -> np.ndarray:
    """The machine's value per text: linear and pairwise part."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    x = m.value[features].astype(float)
    total = m.bias + np.bincount(owner, m.linear[features] * x, minlength=len(sizes))
    for k in range(m.factors.shape[1]):
        vx = m.factors[:, k][features] * x
        s = np.bincount(owner, vx, minlength=len(sizes))
        total += 0.5 * (s * s - np.bincount(owner, vx * vx, minlength=len(sizes)))
    return total


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: int = BITS,
        factors: int = FACTORS, epochs: int = 8, rate: float = 0.15, ridge: float = 2e-4,
        batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad on mini-batches of the logistic loss."""
    rng = np.random.default_rng(seed)
    dims, n = 1 << bits, len(sizes)
    owners = np.repeat(np.arange(n), sizes)
    df = np.bincount(features, minlength=dims)
    df_one = np.bincount(features, weights=labels[owners], minlength=dims)
    share = labels.mean() if n else 0.0
    spread = np.sqrt(np.maximum(df * share * (1 - share) * (1 - df / max(n, 1)), 1e-9))
    signed = np.abs((df_one - df * share) / spread) >= LEAST_Z
    value = (df >= LEAST_DF).astype(np.float32)
    share = (labels.sum() + 0.5) / (n + 1.0)
    m = Machine(float(np.log(share / (1 - share))), value, np.zeros(dims, np.float32),
                (rng.normal(size=(dims, factors)) * 0.01).astype(np.float32))
    if n == 0 or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    g_lin, g_fac, g_bias = np.full(dims, 1e-6), np.full((dims, factors), 1e-6), 1e-6
    ends = np.cumsum(sizes)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at:at + batch]
            idx = np.concatenate([features[ends[d] - sizes[d]:ends[d]] for d in docs])
            idx_sizes = sizes[docs]
            live = value[idx] > 0
            owner = np.repeat(np.arange(len(docs)), idx_sizes)[live]
            idx = idx[live]
            x = value[idx]
            sums = np.stack([np.bincount(owner, m.factors[idx, k] * x, minlength=len(docs))
                             for k in range(factors)], axis=1)
            vx = m.factors[idx] * x[:, None]
            squares = np.bincount(owner, (vx * vx).sum(axis=1), minlength=len(docs))
            raw = (m.bias + np.bincount(owner, m.linear[idx] * x, minlength=len(docs))
                   + 0.5 * ((sums * sums).sum(axis=1) - squares))
            error = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[docs]
            e = error[owner] * x
            uniq, where = np.unique(idx, return_inverse=True)
            d_lin = (np.bincount(where, e) / len(docs) + ridge * m.linear[uniq]) * signed[uniq]
            pair = e[:, None] * (sums[owner] - vx)
            d_fac = np.stack([np.bincount(where, pair[:, k]) for k in range(factors)], axis=1) / len(docs)
            d_fac += ridge * m.factors[uniq]
            g_lin[uniq] += d_lin ** 2
            g_fac[uniq] += d_fac ** 2
            m.linear[uniq] -= rate * d_lin / np.sqrt(g_lin[uniq])
            m.factors[uniq] -= 0.1 * rate * d_fac / np.sqrt(g_fac[uniq])
            g_bias += error.mean() ** 2
            m.bias -= rate * error.mean() / np.sqrt(g_bias)
    return m


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2,
          sample_rows: int = SAMPLE_ROWS, **options) -> Machine:
    """Fit on about ``sample_rows`` labelled documents outside the held-out fold.

    The texts of the sample become feature sets on the executors; the driver
    gets only those sets.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.max("toxic").alias("label"))
    marked = marked.where(fold(F.col("doc_id"), folds) != held)
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # one row per class
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = marked.where(F.col("label").isin(0, 1) & (draw < F.when(
        F.col("label") == 1, sample_rows / 2 / max(sizes.get(1, 0), 1)).otherwise(
        sample_rows / 2 / max(sizes.get(0, 0), 1))))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sets(batch: pa.RecordBatch) -> dict:
        features, sizes = term_sets(texts_of(batch))
        ends = np.cumsum(sizes)
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label").cast(pa.int64()),
                "features": [features[e - s:e].astype("<u4").tobytes() for s, e in zip(sizes, ends)]}

    types = {"doc_id": pa.int64(), "label": pa.int64(), "features": pa.binary()}
    rows = map_slices(sample, sets, types).toArrow()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in types)))
    packed = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in got]
    return fit(np.concatenate(packed) if packed else np.zeros(0, np.int64),
               np.array([len(p) for p in packed], np.int64), np.array([r[1] for r in got], float), **options)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scores(batch: pa.RecordBatch) -> dict:
        features, sizes = term_sets(texts_of(batch), live=shared.value.value > 0)
        raw = raw_scores(features, sizes, shared.value)
        return {"doc_id": batch.column("doc_id"), "score": 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))}

    return map_slices(docs.select("doc_id", "text"), scores, {"doc_id": pa.int64(), "score": pa.float64()})


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2,
             threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    found = score(docs, train(docs, labels, folds, held, **options))
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
