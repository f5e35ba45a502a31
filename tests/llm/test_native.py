"""The operators of DataFrame functions: SQL twins on odd rows, and the rules by hand."""

import random

import duckdb
import pytest

from tests.llm.conftest import frame
from tools.check import rows_alike, rows_of
from trajecta.llm import decontamination, line_frequency, line_spread, twins


def letters(n):
    """A word for every number; digits would be folded by the line rules."""
    return "".join("abcdefghij"[int(c)] for c in str(n))


def same_as_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert have[0] == names and len(have[1]) == len(want)
    assert not [(a, b) for a, b in zip(have[1], want) if not rows_alike(a, b)][:3]


def pages(n=400, seed=1):
    """Texts of random lines with some lines in many texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    common = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 6))]
        for k, line in enumerate(common):
            if rng.random() < 0.25:
                lines.insert(rng.randrange(len(lines) + 1), line.upper() + "  " if k % 2 else line)
        if rng.random() < 0.2:
            lines += [lines[0], "one two three one two three", "#$%&|<>*", ""]
        rows.append((i, "\n".join(lines), "en", f"s{rng.randrange(7)}" if i % 3 else "s0"))
    rows += rows[:40]  # repeated rows
    rows += [(1000 + i, rows[i % 4][1], "en", f"s{i % 9}") for i in range(60)]  # copies on many sites
    return rows


@pytest.fixture(scope="module")
def documents(spark, odd_rows):
    return frame(spark, pages() + odd_rows).cache()


def test_quality_equals_sql(documents):
    same_as_sql(line_frequency.quality(documents), twins.QUALITY, documents=documents)


def test_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(80))
    shared = " ".join(f"menu{letters(k)}" for k in range(300))
    rows = [(i, f"{own(i)}\n{shared}" if i < 30 else own(i), "en", "h") for i in range(60)]
    got = {r["doc_id"]: r for r in line_frequency.quality(frame(spark, rows)).collect()}
    assert all(got[i]["words_left"] == 80 and got[i]["n_frequent_lines"] == 1 for i in range(30))
    assert [got[i]["kept"] for i in (0, 30)] == [False, True]  # 80 of 380 words are left


def test_frequent_lines_of_a_host_above_ten_thousand_documents(spark):
    """The limit does not rise with the host, in the query and in its twin."""
    own = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(4))
    rows = [(i, f"{own(i)}\nshared line" if i < 22 else f"{own(i)}\nrare line" if i < 42 else own(i), "en", "hot")
            for i in range(11_500)]
    docs = frame(spark, rows).cache()
    got = line_frequency.quality(docs)
    assert {r["doc_id"]: r["n_frequent_lines"] for r in got.collect()} == {i: int(i < 22) for i in range(11_500)}
    same_as_sql(got, twins.QUALITY, documents=docs)
    texts = {r["doc_id"]: (r["text"], r["n_chars"], r["words"]) for r in line_frequency.remove_frequent_lines(docs).collect()}
    want = {r[0]: own(r[0]) if r[0] < 22 else r[1] for r in rows}
    assert texts == {i: (t, len(t), "x") for i, t in want.items()}


def test_removal_of_frequent_lines_on_odd_rows(spark, odd_rows):
    shared = [(100 + i, f" Menu  {i}\n\nown {letters(i)}", "en", None) for i in range(25)]
    docs = frame(spark, shared + odd_rows + shared[:1])
    got = [(r["doc_id"], r["text"]) for r in line_frequency.remove_frequent_lines(docs).collect()]
    want = [(i, f"\nown {letters(i - 100)}") for i, *_ in shared + shared[:1]] + [(r[0], r[1]) for r in odd_rows]
    assert sorted(map(str, got)) == sorted(map(str, want))  # digits fold, so every menu line is one line


def test_line_spread_equals_sql(documents):
    got = line_spread.remove_spread_lines(documents).select("doc_id", "text", "n_chars", "n_removed")
    same_as_sql(got, twins.LINE_SPREAD, documents=documents)


@pytest.mark.parametrize("band", [0.0, 0.6])
def test_line_spread_is_exact_near_the_limit(spark, band):
    own = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(30))
    rows = [(i, f"on four sites\n{own(i)}" if i < 4 else f"on five sites\n{own(i)}", "en", f"s{i}") for i in range(9)]
    got = {r["doc_id"]: r["n_removed"] for r in line_spread.remove_spread_lines(frame(spark, rows), band=band).collect()}
    assert [got[i] for i in range(9)] == [0] * 4 + [1] * 5


def test_short_pages_lose_what_sites_share(spark):
    """No share of words that must stay: eight short pages on eight sites with one line each."""
    rows = [(i, f"all rights reserved by the owner of this site\nown {letters(i)}", "en", f"s{i}") for i in range(8)]
    got = line_spread.remove_spread_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == {i: (f"own {letters(i)}", 1) for i in range(8)}


def test_copies_on_many_sites_stay_whole(spark):
    text = "\n".join(f"line {k} of the article that others carry" for k in "abcdef")
    got = line_spread.remove_spread_lines(frame(spark, [(i, text, "en", f"s{i}") for i in range(12)])).collect()
    assert {r["text"] for r in got} == {text}
    assert {c for c in got[0].asDict()} >= {"words", "tk", "start"}  # other columns pass through


def test_the_pipeline_removes_short_pages_boilerplate(spark, tmp_path):
    """Short text of its own beside spread lines; copies of a whole text stay."""
    import corpus_pipeline

    text = "\n".join(f"line {k} of the article that others carry" for k in "abcdef")
    menu = "all rights reserved by the owner"
    rows = [(i, f"own{letters(i)}.\n{menu}", "en", f"s{i % 8}") for i in range(16)]
    rows += [(50 + i, text, "en", f"s{i % 5}") for i in range(10)] + [(70, f"{menu}\nline a of the article that others carry", "en", "s1")]
    rows += [(80 + i, f"{menu}\nline b of the article that others carry", "en", "s2") for i in range(6)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_boilerplate(spark, docs, str(tmp_path)).collect()}
    assert got == {r[0]: f"own{letters(r[0])}." if r[0] < 16 else text if r[0] < 70 else "" for r in rows}


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_decontamination_equals_sql(spark, odd_rows):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "the", "of"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    bench = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 9, 10, 11, 25, 40, 40)] + [None, "", "...", "a a a"]
    bench += [bench[6]]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            item = rng.choice([b for b in bench if b]).split()
            words[5:5] = item[rng.randrange(3):][:rng.randrange(8, 30)]
        rows.append((i, ", ".join(words).title()))
    docs, benchmark = frame(spark, rows + odd_rows + rows[:5]), items(spark, bench)
    got = decontamination.digest(decontamination.contamination(docs, benchmark))
    same_as_sql(got, twins.DECONTAMINATION, documents=docs, benchmark=benchmark)


def test_decontamination_without_broadcast_and_empty_tables(spark, monkeypatch):
    phrase = " ".join(f"k{i}" for i in range(12))
    docs = frame(spark, [(1, f"intro {phrase} outro"), (2, phrase[:-3]), (3, "clean text")])
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    kept = decontamination.keep_clean(docs, items(spark, [phrase])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [3]  # document 2 holds the first window
    none = docs.limit(0)
    assert decontamination.contamination(none, items(spark, [phrase])).count() == 0
    assert decontamination.contamination(docs, items(spark, [])).where("n_hit > 0").count() == 0
    assert line_spread.remove_spread_lines(none).count() == line_frequency.quality(none).count() == 0
