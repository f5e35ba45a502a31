"""Small hand-made documents shared by the tests."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, tk string, start int"


def frame(spark, rows):
    """documents from (doc_id, text[, lang[, source]]), with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
             None if r[1] is None else len(r[1]), "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long_text = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\t"), (None, "no id here"), (None, None), (4, "repeated row"),
            (4, "repeated row"), (5, "same id"), (5, "other text"), (6, long_text), (7, "Ünïcode ÉÈ 日本語 ß"),
            (8, "12 34 ..."), (9, "a", None, None), (10, "x" * 50_000)]
