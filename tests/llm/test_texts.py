"""Extraction, licences, fingerprints, packing and the pipeline against brute force."""

import collections
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import frame
from trajecta.llm import best_fit_packing, html_extraction, license_scan, simhash_golay
from trajecta.llm.common import table

PAGE = """<html><head><title>T, t.</title><script>var x = "<p>no, no.</p>";</script></head>
<body class="has-sidebar"><header>Site, name.</header><div id="topNav"><a href=/>Home</a> <a href=/b>News</a></div>
<div class="cookie-notice">We use cookies, you know.</div><div class=content><h1>Title &eacute;&#233; &amp; more</h1>
<p>One, two.
   three<br>four<div>inner, text.</div><p>Second para, with <a href=x>a link</a> inside.<!-- <p>gone</p> -->
<ul><li>item a<li>item b</ul><form><p>Search here, please.</form><style>p {}</style>
<table><tr><td>cell, one<td>cell two.</table></div><aside>Side, text, here.</aside>
<section id="comments"><p>Nice, one! Really, really nice.</p></section><footer>&copy; all, of it.</footer></body>"""


def test_page_by_hand():
    assert html_extraction.main_text(PAGE) == (
        "Title éé & more\nOne, two. three four\ninner, text.\nSecond para, with a link inside.\n"
        "item a\nitem b\ncell, one\ncell two.")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("no tags", "no tags"), ("a < b &lt; c", "a < b < c"), ("<p>x", "x"),
    ("<script>only, code.", ""), ("<div hidden>x, y.</div><p>z, w.", "z, w."), ("<p>a</p></div></div><p>b", "a\nb")])
def test_small_pages(page, text):
    assert html_extraction.main_text(page) == text


def paragraphs(n):
    return "".join(f"<p>Sentence {i} has words, and more of them. Another one follows.</p>" for i in range(n))


def test_every_article_and_every_lede_stays():
    two = html_extraction.main_text(f"<body><article>{paragraphs(11)}</article><article>{paragraphs(9)}</article>")
    assert len(two.split("\n")) == 20
    for n in (3, 10, 30, 60):
        page = f"<div id=x><div class=lede>The lede, a sentence of its own.</div><div class=t>{paragraphs(n)}</div></div>"
        assert len(html_extraction.main_text(page).split("\n")) == n + 1


@pytest.mark.parametrize("wrapper", [
    "form", "div class=layout-sidebar-left", "div class=search-result", "div class=page-share",
    "div class=blog-post-widget", "div class=header-image", "section", "div"])
def test_wrappers_of_everything_are_no_boilerplate(wrapper):
    page = f"<body><{wrapper}><div>{paragraphs(5)}</div><div class=comments>{paragraphs(9)}</div></{wrapper.split()[0]}>"
    assert html_extraction.main_text(page).count("\n") == 4


def test_unmarked_notices_go_and_headings_stay():
    page = f"<div><h2>Heading</h2>{paragraphs(4)}<div>Subscribe now for more</div><h2>Next part</h2>{paragraphs(2)}</div>"
    lines = html_extraction.main_text(page).split("\n")
    assert lines[0] == "Heading" and "Next part" in lines and len(lines) == 8


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + "x, y.", "a <b'x " * 150_000, "<i>" * 50_000 + "</b>" * 50_000, "<a '>' " * 100_000 + "x",
    "<p><div>" + "<blockquote>" * 50_000, "</div>" * 100_000, "<b " * 300_000, "<!--" * 200_000])
def test_hostile_pages_take_seconds(page):
    import time

    start = time.time()
    html_extraction.main_text(page)
    assert time.time() - start < 20


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a, b.</p>", "t", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extraction.extract(pages).collect()] == [(1, "u", "a, b.", 5)]


def test_pages_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[row["page_id"]]["text"] == "\n".join(filter(None, blocks))
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>a, b.</p>"), (1, None, None)],
                                "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_extraction.extract(odd).collect()) == [0, 0, 5]
    assert html_extraction.extract(odd.limit(0)).count() == 0


def test_automaton_statistics():
    known = license_scan.Scanner([x for x in license_scan.TEMPLATES if len(x[1]) < 400])
    automaton, vocabulary, sequences = known.automaton, known.vocabulary, known.sequences
    places = collections.defaultdict(set)
    for s, words in enumerate(sequences):
        for i in range(len(words)):
            for j in range(i, len(words)):
                places[tuple(words[i:j + 1])].add((s, j))
    rng, words = random.Random(1), []
    while len(words) < 3000:
        s = rng.choice(sequences)
        i = rng.randrange(len(s))
        words += s[i:i + rng.randrange(1, 12)] if rng.random() < 0.6 else [rng.choice([*sorted(vocabulary), b"zz"])]
    for i, (state, length) in enumerate(automaton.statistics(words)):
        want = next((n for n in range(min(60, i + 1), 0, -1) if tuple(words[i + 1 - n:i + 1]) in places), 0)
        assert length == want and (not want or automaton.ends[state] == places[tuple(words[i + 1 - want:i + 1])])


def test_matches_are_all_that_grow_to_neither_side():
    """Brute force: every run of a template in the text, also inside a longer match of another."""
    rng = random.Random(3)
    templates = [("a", "one two three four"), ("b", "zero one two three four five"), ("c", "two three four two three four six"),
                 ("a", " ".join(rng.choice("one two three six".split()) for _ in range(20)))]
    known = license_scan.Scanner(templates)
    for _ in range(200):
        words = [rng.choice(b"zero one two three four five six xx".split()) for _ in range(rng.randrange(40))]
        if rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(known.sequences)
        want = set()
        for t, s in enumerate(known.sequences):
            for i in range(len(words)):
                for p in range(len(s)):
                    if words[i] == s[p] and not (i and p and words[i - 1] == s[p - 1]):
                        n = 0
                        while i + n < len(words) and p + n < len(s) and words[i + n] == s[p + n]:
                            n += 1
                        if n >= 3:
                            want.add((t, i, p, n))
        got = known.matches(words, 3)
        assert len(got) == len(set(got)) and set(got) == want
    assert {t for t, *_ in known.matches(b"zero one two three four five".split(), 4)} == {0, 1}


@pytest.mark.parametrize("text", [
    "Songs released under the Apache License", "the dam was released under the bridge",
    "released under the Freedom of Information Act", "all rights are reserved", "this work is licensed under a new name",
    "Permission to use this software is hereby granted with the above notice"])
def test_shared_words_give_no_label(text):
    words = license_scan.words_of(text.encode())
    assert license_scan.spans(words) == []


def test_whole_licences_give_their_label():
    for label, text in license_scan.TEMPLATES:
        words = license_scan.words_of(("intro " + text + " outro").encode())
        assert label in {s[0] for s in license_scan.spans(words)}
    for label in ("mit", "isc", "bsd", "zlib"):
        text = next(t for name, t in license_scan.TEMPLATES if name == label)
        assert {s[0] for s in license_scan.spans(license_scan.words_of(text.encode()))} == {label}


def test_licences(spark, odd_rows):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) < 600 and t.startswith("Permission"))
    rows = [(1, "the MIT License, mit-license!"), (2, mit.replace("modify, merge,", "modify or join,")),
            (3, "General  Public\nLicense xMIT license"), (4, "permission is hereby"), (5, "apache license mit license"),
            (6, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (2, 1, 3, "mit")
    assert got[2]["base_labels"] == "" and got[2]["labels"] == "mit" and 0.9 < got[2]["score"] < 1
    assert (got[3]["n_words"], got[3]["base_labels"]) == (5, "gpl") and got[4]["labels"] == ""
    assert got[5]["base_labels"] == "apache,mit" and got[6]["labels"] == "cc-by-nc"
    assert license_scan.scan(frame(spark, odd_rows)).count() == len(odd_rows)
    assert license_scan.scan(frame(spark, odd_rows).limit(0)).count() == 0
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "Ünï Ab9,é_x".encode().lower())
    assert license_scan.words_of("Ünï Ab9,é_x".encode()) == words


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code():
    words = (np.arange(1, 1 << 12) << 11) | simhash_golay.PARITY[1:]
    assert np.bitwise_count(words).min() == 7 and len(np.unique(simhash_golay.ERROR_OF)) == 1 << 11


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 120, dtype=np.int64).view(np.uint64)
    prints = [base]
    for _ in range(6):
        y = base.copy()
        for _ in range(3):
            y ^= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        prints.append(y)
    x = np.unique(np.concatenate([*prints, [np.uint64(0), np.uint64(7)]]))
    want = {(int(x.view(np.int64)[i]), int(x.view(np.int64)[j])) for i in range(len(x))
            for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 3) if i != j}
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = [(r["a"], r["b"]) for r in simhash_golay.links(nodes).collect()]
    assert len(got) == len(want) / 2 and {p for a, b in got for p in ((a, b), (b, a))} == want


def test_near_duplicates_of_texts(spark, odd_rows):
    rng = random.Random(9)
    rows = list(odd_rows)
    for g in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))]
        for k in range(rng.randrange(1, 8)):
            copy = list(words)
            if k % 2:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 * (g + 1) + k, " ".join(copy)))
    found = simhash_golay.digest(simhash_golay.near_duplicates(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    prints = sorted({fingerprint(t) for _, t, *_ in rows})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, t, *_ in rows:
        r = root(fingerprint(t))
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    want = collections.Counter((i, f"{fingerprint(t):016x}", least[root(fingerprint(t))]) for i, t, *_ in rows)
    assert collections.Counter(tuple(r) for r in found) == want
    kept = [r["doc_id"] for r in simhash_golay.keep_one(frame(spark, rows)).collect()]
    # one row per component, also where no row of it has an id
    assert len(kept) == len({root(fingerprint(t)) for _, t, *_ in rows})
    assert sorted(k for k in kept if k is not None) == sorted({v for v in least.values() if v is not None})
    assert simhash_golay.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_keep_one_goes_by_row(spark):
    """One id with two texts keeps both; copies without an id go."""
    far = " ".join(f"q{i}" for i in range(40))
    rows = [(1, "a first text of seven words here"), (None, "a first text of seven words here"), (2, far),
            (2, "quite another text with its own words"), (2, far), (None, "a first text of seven words here")]
    docs = frame(spark, rows)
    got = simhash_golay.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [
        (1, rows[0][1]), (2, far), (2, rows[3][1])]
    nameless = frame(spark, [(None, far), (None, far)])
    assert [r["text"] for r in simhash_golay.keep_one(nameless).collect()] == [far]
    assert simhash_golay.keep_one(docs.limit(0)).count() == 0


ODD_TEXTS = ["á ́x é́ İSTANBUL ΣΑΣ \x85x y <|endoftext|>z a<|startoftext|>b \x1c\x1d", "it's don't'll 123 ½x₂ 日本語 한글",
             "x." * 3000 + " I.E. A.B., it's. <|ENDOFTEXT|>, Don't!! a.. É. b.;\n " + "é" * 900, "", "  ", "a\x00b  c"]


def test_tokens_are_those_of_whole_texts(spark):
    texts = ODD_TEXTS + [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    whole = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    got = best_fit_packing.WordTokenizer(best_fit_packing.tokenizer_path())(pa.array(texts))
    for t, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_repeated_rows_are_dealt_apart(spark):
    """Five thousand equal rows fill no group beyond twice the wanted size."""
    rows = [(1, 0, 0, 10, 7)] * 5000 + [(k, 0, 0, 10 + k % 90, k) for k in range(2, 5002)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = best_fit_packing.pack(pieces, group_pieces=500).selectExpr("sequence_id >> 32 AS g", "length", "sequence_id", "offset")
    found = packed.collect()
    assert len(found) == 10_000 and max(collections.Counter(r["g"] for r in found).values()) < 1000
    held = collections.Counter()
    for r in found:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048 and len(held) <= sum(held.values()) / 2048 + 21


@pytest.mark.parametrize("rule,weights", [("norm", (1, 0, 0)), ("dot", (1, 0.5, 0.5)), ("norm", (1, 0.2, 0.2))])
def test_best_fit_keeps_every_capacity(rule, weights):
    rng = np.random.default_rng(2)
    demands = np.sort(rng.random((800, 3)) * [0.6, 0.2, 0.4], axis=0)[::-1]
    bins, _ = best_fit_packing.best_fit(demands, np.array(weights, float), rule)
    for k in range(3):
        assert np.bincount(bins, demands[:, k]).max() <= 1 + 1e-9
    assert bins.max() + 1 <= 1.15 * demands[:, 0].sum() + 1 or rule == "dot"
    assert set(bins) == set(range(bins.max() + 1))


def check_packing(rows, texts, capacity=2048):
    """Every id of every text once and in order; sequences gapless and within the capacity."""
    whole = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    want = collections.Counter()
    for doc_id, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[(doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_round_trip(spark, odd_rows):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = best_fit_packing.pack_documents(docs).collect()
    assert check_packing(rows, texts) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    odd = frame(spark, odd_rows)
    check_packing(best_fit_packing.pack_documents(odd, group_pieces=4).collect(), [(r[0], r[1]) for r in odd_rows])
    few = best_fit_packing.pack_documents(odd, max_docs=2).collect()
    assert max(collections.Counter(r["sequence_id"] for r in few).values()) <= 2
    assert best_fit_packing.pack_documents(odd.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage's decision takes effect, and clean documents stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "er", "in", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, menu = text(14), text(9) + " menu"
    rows = [(i, f"{menu}\n{text(60)}" if i < 8 else text(60), "en", f"s{i}") for i in range(30)]
    long = text(600)
    rows += [(50, rows[10][1], "en", "s1"), (51, long + " extra", "en", "s2"), (52, long, "en", "s2"), (60, "123 456", "en", "s3"),
             (61, None, "en", "s3"), (70, f"{text(30)} {item} {text(30)}", "en", "s4"), (71, text(1500), "en", "s5")]
    docs = frame(spark, rows).drop("words", "tk", "start")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = [docs]
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").distinct().collect()) for d in seen]
    everyone = sorted(r[0] for r in rows)
    assert ids[1] == ids[2] == [i for i in everyone if i not in (60, 61)]
    assert seen[2].where(f"text like '%{menu}%'").count() == 0
    assert ids[3] == [i for i in ids[2] if i not in (50, 52)] and ids[4] == [i for i in ids[3] if i != 70]
    check_packing(seen[5].collect(), [(r["doc_id"], r["text"]) for r in seen[4].collect()])
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert direct.count() == seen[5].count()
