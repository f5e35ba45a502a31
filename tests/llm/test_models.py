"""Learned operators: brute force on small inputs, held-out accuracy on given tables."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from trajecta.llm import language_id, ppm_score, toxicity
from trajecta.llm.common import table


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_gram_buckets_are_those_of_single_texts():
    texts = ["", "ab", "Été, à Paris!", None, "x"]
    buckets, owners, sizes = language_id.gram_buckets(pa.array(texts))
    for i, t in enumerate(texts):
        one, _, _ = language_id.gram_buckets(pa.array([t], pa.string()))
        assert sorted(buckets[owners == i]) == sorted(one)
        n = len(t or "")
        assert len(one) == sum(max(n - k, 0) for k in range(3)) and sizes[i] == n


def test_naive_bayes_posteriors_by_hand():
    rng = np.random.default_rng(0)
    model = language_id.Languages(["a", "b"], np.log(rng.dirichlet(np.ones(1 << 16), 2).T).astype(np.float32),
                                  np.log([0.3, 0.7]))
    text = "hello world"
    got, n = language_id.posteriors(pa.array([text, "hi"]), model)
    buckets, _, _ = language_id.gram_buckets(pa.array([text]))
    logs = model.log_prob[buckets].astype(float).sum(axis=0) * min(len(buckets), 40) / len(buckets) + model.prior
    want = np.exp(logs - logs.max())
    assert got[0] == pytest.approx(want / want.sum(), rel=1e-4) and n[0] == len(buckets)


def test_language_accuracy_and_rejections(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(docs).collect()]
    assert len(got) == len(lang) and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert language_id.keep_identified(docs).count() >= 0.99 * len(lang)


def test_language_of_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows + [(100 + i, "the cat and the dog of the house", "en") for i in range(20)]
                 + [(200 + i, "der hund und die katze von dem haus", "de") for i in range(20)])
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und >= {1, 2, 3, 8} and not und & {4, 5, 6, 7, 9, 10}
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3, 8)").count() == 0
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_counts_by_brute_force_and_rare_languages(spark):
    said = {"en": "the cat and the dog %d", "de": "der hund und die katze %d", "fr": "le chat et le chien %d"}
    rows = [(i, said["en" if i % 2 else "de"] % i, "en" if i % 2 else "de") for i in range(3000)]
    rows += [(5000 + i, said["fr"] % i, "fr") for i in range(16)]
    docs = frame(spark, rows)
    kept = [r for r in rows if fold(r[0], 4) != 2]
    whole = language_id.train(docs, sample_rows=10**6)
    assert whole.names == ["de", "en", "fr"]
    for k, name in enumerate(whole.names):
        mine = [t for _, t, lang in kept if lang == name]
        buckets, _, _ = language_id.gram_buckets(pa.array(mine))
        counts = np.bincount(buckets, minlength=1 << 16) + 0.5
        assert np.allclose(whole.log_prob[:, k], np.log(counts / counts.sum()), atol=1e-5)
        assert whole.prior[k] == pytest.approx(np.log(len(mine) / len(kept)))
    few = language_id.train(docs, sample_rows=50)  # a sixtieth of the rows, and still every one of "fr"
    assert few.names == whole.names and np.allclose(few.log_prob[:, 2], whole.log_prob[:, 2])
    assert np.allclose(few.prior, whole.prior)


def test_machine_scores_by_hand():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.where(rng.random(64) < 0.7, 1, 0).astype(np.float32),
                         rng.normal(size=64).astype(np.float32), rng.normal(size=(64, 4)).astype(np.float32))
    sets = [sorted(rng.choice(64, n, replace=False)) for n in (0, 1, 5, 20)]
    got = toxicity.raw_scores(np.concatenate(sets).astype(int), np.array([len(s) for s in sets]), m)
    for s, value in zip(sets, got):
        want = m.bias + sum(m.linear[i] * m.value[i] for i in s) + sum(
            float(m.factors[i] @ m.factors[j]) * m.value[i] * m.value[j] for i in s for j in s if i < j)
        assert value == pytest.approx(want, rel=1e-5)


def test_machine_learns_a_pair():
    """Two words that mean nothing alone and something together."""
    rng = random.Random(4)
    texts, labels = [], []
    for _ in range(1500):
        words = [f"w{rng.randrange(30)}" for _ in range(6)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(words + ["insult"] * a + ["group"] * b).encode())
        labels.append(float(a and b))
    features, sizes = toxicity.term_sets(texts)
    m = toxicity.fit(features, sizes, np.array(labels), epochs=30)
    new = [b"w1 w2 insult", b"w1 w2 group", b"w1 w2 insult group", b"w1 w2"]
    p = 1 / (1 + np.exp(-toxicity.raw_scores(*toxicity.term_sets(new), m)))
    assert p[2] > 0.7 and max(p[0], p[1], p[3]) < 0.3


def test_toxicity_of_a_pair_whose_words_carry_no_sign_alone():
    """As many toxic documents with either word as without; toxic are both together and neither."""
    rng = np.random.default_rng(1)
    def made(n):
        sets, labels = [], []
        for i in range(n):
            cell = i % 4
            some = set(rng.integers(10, 60, 5).tolist()) | ({1} if cell & 1 else set()) | ({2} if cell & 2 else set())
            sets.append(np.array(sorted(some), np.int64))
            labels.append(float(cell in (0, 3)))
        return np.concatenate(sets), np.array([len(x) for x in sets]), np.array(labels)

    features, sizes, labels = made(4000)
    machine = toxicity.fit(features, sizes, labels, bits=6)
    features, sizes, labels = made(800)
    scores = toxicity.raw_scores(features, sizes, machine)
    assert ((scores > 0) == (labels > 0)).mean() > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    held = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([np.mean([p > n for n in neg]) for p in pos])
    assert auc > 0.95 and np.mean([s >= 0.3 for s in neg]) < 0.01


def test_toxicity_of_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len(toxicity.classify(docs, labels.limit(0)).collect()) == len(odd_rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def ppm(train, order, contexts, text):
    """Byte by byte, with dictionaries."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    symbols = 0
    for t in train:
        s = bytes([255]) * order + t + b"\xff"
        for i in range(order, len(s)):
            symbols += 1
            for j in range(order + 1):
                counts[j][s[i - j:i]][s[i]] += 1
    kept = [{c for c, v in level.items() if sum(v.values()) * contexts >= symbols} for level in counts]
    s, total = bytes([255]) * order + text + b"\xff", 0.0
    for i in range(order, len(s)):
        ruled_out, found = set(), False
        for j in range(order, -1, -1):
            c = s[i - j:i]
            if c not in kept[j]:
                continue
            here = {a: n for a, n in counts[j][c].items() if a not in ruled_out}
            room = sum(here.values()) + len(here)
            if s[i] in here:
                total += math.log10(here[s[i]] / room)
                found = True
                break
            total += math.log10(len(here) / room) if room else 0.0
            ruled_out |= set(counts[j][c])
        if not found:
            total -= math.log10(256 - len(counts[0][b""]))
    return total


@pytest.mark.parametrize("contexts,words", [(1 << 18, 1 << 20), (40, 8)])
def test_ppm_and_base_by_brute_force(spark, odd_rows, contexts, words):
    rng = random.Random(3)
    rows = [(1000 + i, "".join(rng.choice("abcd \n") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(2000, "The cat. The CAT sat; zzz"), (2001, "é ñ the cat"), (2002, "\x00\x1c a b")]
    rows += [r for r in odd_rows if len(r[1] or "") < 100]
    got = ppm_score.score(frame(spark, rows), contexts=contexts, words=words).collect()
    train = [(t or "") for i, t, *_ in rows if i is None or fold(i, 5) != 1]
    counts = collections.Counter(w for t in train for w in [*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        want[(i, i is not None and fold(i, 5) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n,
              round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6),
              round(ppm([x.encode() for x in train], ppm_score.ORDER, contexts, (t or "").encode()), 3))] += 1
    assert collections.Counter((
        r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
        round(r["score"], 3)) for r in got) == want


def test_ppm_splits_hot_endings(spark):
    """A bucket with a third of all questions is dealt over shares that all hold its counts."""
    rows = [(b, 1, 0, bytes([b, k]), 10 if b else 300) for b in range(61) for k in range(30 if b else 90)]
    asked = spark.createDataFrame(rows, "bucket int, kind int, row long, rows binary, questions long")
    split = ppm_score.split_buckets(asked.select("bucket", "questions"), 8)
    shares = {r["bucket"]: r["shares"] for r in split.collect()}
    total = sum(r[-1] for r in rows)
    assert shares == {0: math.ceil(90 * 300 * ppm_score.PIECES * 8 / total)} and shares[0] > 8
    counts = spark.createDataFrame([(b, 0, 0, b"", 0) for b in range(61)], asked.schema)
    got = ppm_score.shared_out(asked.union(counts), split).groupBy("bucket", "share").agg(
        F.sum(1 - F.col("kind")).alias("counts"), F.sum("kind").alias("asked"), F.sum("questions").alias("n")).collect()
    assert all(r["counts"] == 1 for r in got)  # the counts once in every share
    assert sum(r["asked"] for r in got) == len(rows) and sum(r["n"] for r in got) == total
    hot = [r["n"] for r in got if r["bucket"] == 0]
    assert len(hot) == shares[0] and max(hot) < total / 8


@pytest.mark.parametrize("parts, pieces", [(1, 4), (7, 4), (7, 64)])
def test_ppm_of_contexts_outside_the_fast_path(spark, monkeypatch, parts, pieces):
    """The score is that of the whole model however few contexts are broadcast and
    however finely the buckets are split."""
    monkeypatch.setattr(ppm_score, "PIECES", pieces)
    monkeypatch.setattr(ppm_score, "HELD_SUMS", 64)
    monkeypatch.setattr(ppm_score, "FAST_CONTEXTS", 20)
    monkeypatch.setattr(ppm_score, "FLUSH_GRAMS", 300)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcd \n") for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(500 + i, f"a rare word {'zzyzx é' * (i % 3)}") for i in range(12)] + [(None, None), (7, rows[7][1])]
    train = [(t or "").encode() for i, t in rows if i is None or fold(i, 5) != 1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ppm_score.score(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = collections.Counter((i, round(ppm(train, ppm_score.ORDER, 1 << 40, (t or "").encode()), 3)) for i, t in rows)
    assert collections.Counter((r["doc_id"], round(r["score"], 3)) for r in got) == want


def test_ppm_without_rows(spark):
    docs = frame(spark, [(1, "abc")])
    assert ppm_score.score(docs.limit(0)).count() == 0
    held = next(i for i in range(99) if fold(i, 5) == 1)
    row = ppm_score.score(frame(spark, [(held, "ab")])).first()
    assert row["score"] == pytest.approx(-3 * math.log10(256)) and row["n_known"] == row["train_tokens"] == 0


def test_ppm_beats_the_base_on_held_out_texts(spark):
    got = ppm_score.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 1.1
