"""Token counts, ranked search and whitening against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import frame
from trajecta.llm import embedding_whitening, lexical_search, token_counts

PIECES = ["word ", "x", "'ll", "'", "é", "é", "̧́", "中", "文", "，", "<|startoftext|>",
          "<|endoftext|>", "<|", "  \n", "İ", "123", "한", "ᄀ", "ᅡ", "😀", ".", ",!?", "ß", " "]


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False)


def test_chunks_resynchronise(encode):
    rng = random.Random(3)
    for _ in range(150):
        some = rng.sample(PIECES, rng.randrange(1, len(PIECES)))
        text = "".join(rng.choice(some) * rng.choice([1, 1, 5]) for _ in range(rng.randrange(1, 900)))
        for chunk, overlap in ((100, 40), (257, 64), (64, 33)):
            assert token_counts.count_long(text, encode, chunk, overlap) == len(encode(text)), (some, chunk)


def test_chunks_widen_without_boundaries(encode):
    sizes = []

    def watched(text):
        sizes.append(len(text))
        return encode(text)

    text = "x" * 5000
    assert token_counts.count_long(text, watched, 256, 64) == len(encode(text)) and max(sizes) == 5000
    sizes.clear()
    text = "one, two " * 2000
    assert token_counts.count_long(text, watched, 256, 64) == len(encode(text)) and max(sizes) == 256


def test_short_texts_by_words(encode):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert token_counts.counter(token_counts.tokenizer_path())(texts) == [len(encode(t)) for t in texts]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        sizes = token_counts.counter(token_counts.tokenizer_path(name), 64, 40)(texts)
        assert name.endswith(".model") or sizes == [
            len(e) for e in Tokenizer.from_file(token_counts.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, odd_rows, encode):
    got = token_counts.count_tokens(frame(spark, odd_rows)).collect()
    want = [(i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 2048) for i, t, *_ in odd_rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(frame(spark, odd_rows).limit(0)).count() == 0


def ranking(docs, items, top=10):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := lexical_search.terms_of((t or "").encode()))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        asked = Counter(lexical_search.terms_of((text or "").encode()))
        weight = {t: n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t, n in asked.items() if df[t]}
        scores = []
        for doc_id, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t])
            if score:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


def test_ranked_search(spark, odd_rows, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "É", "x9"]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(303)], k=rng.choice([3, 40, 200, 900]))))
            for i in range(400)]
    docs += [(1000 + i, "w1 w2 w2 w3 copied text") for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2")]
    docs += [(r[0], r[1]) for r in odd_rows]
    items = [(1, "w1, W2 w2! w250"), (2, "Ünï w299 w1"), (3, None), (4, "..."), (5, "nowhere"), (1, "w1, W2 w2! w250"),
             (6, "copied TEXT"), (7, docs[3][1]), (8, "alpha repeated row text")]
    found = frame(spark, docs).repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    want = ranking(docs, items)
    assert sorted(str(tuple(r)) for r in lexical_search.search(found, asked).collect()) == want
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 3)
    monkeypatch.setattr(lexical_search, "MOST_KEYS", 100)  # long texts without a signature
    monkeypatch.setattr(lexical_search.item_blocks, "__defaults__", (3,))
    assert sorted(str(tuple(r)) for r in lexical_search.search(found, asked).collect()) == want
    assert lexical_search.search(found.limit(0), asked).count() == 0
    assert lexical_search.search(found, asked.limit(0)).count() == 0


def test_bounds_hold_and_exclude(spark):
    """No bound is under the score; most documents without a query term have bound 0."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in range(2000)], k=60))) for i in range(500)]
    held = [(i, Counter(lexical_search.terms_of(t.encode()))) for i, t in docs]
    df = Counter(t.decode() for _, c in held for t in c)
    terms = [f"w{k}" for k in range(40)]
    query = lexical_search.Query([[(t, 1)] for t in terms], {t: 1000 for t in terms if df[t]}, 500, 30000)
    rows = lexical_search.index(frame(spark, docs).coalesce(1)).where(f"kind = {lexical_search.BLOCK}").collect()
    texts, spare = dict(docs), 0
    for r in rows:
        bounds = query.bounds(r["width"], r["m_docs"], r["sizes"], bytes(r["data"]))
        for c, ids in enumerate(r["ids"]):
            exact = query.exact(texts[ids[0]].encode(), list(range(len(terms))))
            assert (bounds[:, c] >= exact).all()
            spare += sum(1 for b, e in zip(bounds[:, c], exact) if b and not e)
    assert spare < 0.02 * 500 * len(terms)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "z") for i, v in rows],
                                 "vec_id long, embedding array<float>, n int, whitened string")


def test_whitening(spark):
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((400, 12)) * np.linspace(2, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900 + i, data[7].tolist()) for i in range(50)]
    bad = [(None, None), (1, None), (2, []), (3, [float("nan")] * 12), (4, [None] * 12), (5, [float("inf")] * 12),
           (6, [1.0] * 3)]
    got = embedding_whitening.whiten(vectors(spark, rows + bad)).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(int)
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(axis=0)
    centred = unique - sums / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    z = (x - sums / n) @ q / np.sqrt(e)
    z = z[np.argsort([i for i, _ in rows], kind="stable")]
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(-1, 4)) - np.abs(z)).max() < 1e-10
    assert np.allclose(got["explained"].to_numpy()[:4], e / np.trace(cov), rtol=1e-12)
    assert got["identity_error"].max() < 1e-12
    assert got["deviation"].to_numpy()[::4].tolist() == ((n * x - sums) ** 2).sum(axis=1)[np.argsort([i for i, _ in rows])].tolist()


def test_whitening_odd_tables(spark):
    assert embedding_whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert embedding_whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = embedding_whitening.whiten(vectors(spark, [(None, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["component"], r["n"], round(abs(r["whitened"]), 12)) for r in line) == [(1, 2, 1.0)] * 3
    large = embedding_whitening.whiten(vectors(spark, [(1, [1e10, 0.0]), (2, [-1e10, 1.0])])).collect()
    assert {r["deviation"] for r in large} == {None} and max(r["identity_error"] for r in large) < 1e-6


def test_eigenpairs_reach_double_precision():
    rng = np.random.default_rng(0)
    for size, values in ((64, np.ones(64) + np.linspace(0.1, 0, 64)), (300, np.exp(-0.02 * np.arange(300))), (20, np.ones(20)),
                         (3, [3.0, 2.0, 1.0]), (16, [5, 5, 5, 5, 1, *[0] * 11]), (1, [2.0])):
        q, _ = np.linalg.qr(rng.standard_normal((size, size)))
        matrix = q * np.array(values) @ q.T
        got, basis, _ = embedding_whitening.eigenpairs(lambda v: matrix @ v, size)
        want = np.sort(np.array(values, float))[::-1][:4]
        assert np.abs(got - want).max() < 1e-13 * want[0]
        assert np.linalg.norm(matrix @ basis - basis * got, axis=0).max() < 3e-14 * want[0]
        assert np.abs(basis.T @ basis - np.eye(len(want))).max() < 1e-12
