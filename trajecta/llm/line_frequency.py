"""Quality rule: cross-document line frequency per host.

Lines are normalised (lower case, white space folded, digits as one mark) and
hashed; per host the distinct documents of every line are counted.  A line in
more than ``most_docs`` documents of its host is boilerplate there, however many
documents the host has; ``remove_frequent_lines`` takes such lines out of the texts.
A document is depleted, and rejected, if what
is left without such lines is under ``least_words`` words or under
``least_share`` of its word characters.

DataFrame functions only.  The lines are a stage table.  The counts are partial sums per map task, so a line
in a third of all documents costs one row per task; frequent lines are joined
back salted, as there are few of them but many documents may hold one.

Defined cases: NULL and empty texts have no word and fail the base rule; a NULL
host is a host of its own; repeated rows are one document and get the same
verdict, in as many rows; lines without a word never count; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import ascii_lower, space_words, stage, text_key

MOST_DOCS = 20
LEAST_WORDS = 50
LEAST_SHARE = 0.3
SALTS = 16
BLANK = "^[ \\t-\\r]*$"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(BLANK))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(ascii_lower(line), "[ \\t-\\r]+", " ")), "[0-9]+", "0")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, host and text (NULL as empty)."""
    return docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.col("source").alias("host"),
                       F.coalesce("text", F.lit("")).alias("text"))


def base_features(rows: DataFrame) -> DataFrame:
    """Words, characters, symbols, repeated lines and repeated 3-word windows."""
    split = rows.select(
        "doc_id", "tk", "host", space_words(F.col("text")).alias("words"),
        lines_with_words(F.col("text")).alias("lines"), word_chars(F.col("text")).alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    counted = split.select(
        "doc_id", "tk", "host", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(
            F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(
                F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])
                               .alias("h"), i.alias("i")))).alias("grams"))
    # neighbours in hash order that are equal: windows found twice or more
    starts = counted.withColumn("starts", F.sort_array(F.transform(
        F.filter("grams", lambda g, k: (
            (k > 0) & (F.col("grams")[F.greatest(k - 1, F.lit(0))]["h"] == g["h"])) | (
            (k < F.size("grams") - 1) & (F.col("grams")[F.least(k + 1, F.size("grams") - 1)]["h"] == g["h"]))),
        lambda g: g["i"]))).drop("grams")
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(
            F.lit(3), F.when(k < F.size("starts") - 1,
                             F.col("starts")[F.least(k + 1, F.size("starts") - 1)] - s).otherwise(3))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return starts.select("doc_id", "tk", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         covered.alias("n_repeat_words"))


def host_lines(rows: DataFrame) -> DataFrame:
    """One row per document and distinct line: hash, words and characters of all its occurrences."""
    lines = rows.select("doc_id", "tk", "host", F.explode(lines_with_words(F.col("text"))).alias("line"))
    return lines.select(
        "doc_id", "tk", "host", F.xxhash64(normalised(F.col("line"))).alias("line"),
        F.size(space_words(F.col("line"))).cast("long").alias("words"), word_chars(F.col("line")).alias("chars"),
    ).groupBy("doc_id", "tk", "host", "line").agg(F.sum("words").alias("words"), F.sum("chars").alias("chars"),
                                                  F.count("*").alias("times"))


def frequent_lines(lines: DataFrame, most_docs: int) -> DataFrame:
    """(host, line) in more than ``most_docs`` documents of the host."""
    return lines.groupBy("host", "line").agg(F.count("*").alias("line_docs")).where(
        F.col("line_docs") > most_docs).select("host", "line")


def lines_that_go(lines: DataFrame, most_docs: int, salts: int) -> DataFrame:
    """The rows of ``host_lines`` whose line is frequent on its host."""
    often = frequent_lines(lines, most_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(salts)).cast("int"))
    return salted.alias("a").join(
        often.alias("b"), F.expr("a.host <=> b.host AND a.line = b.line AND a.salt = b.salt"), "left_semi")


def remove_frequent_lines(docs: DataFrame, most_docs: int = MOST_DOCS, salts: int = SALTS) -> DataFrame:
    """``docs`` without the lines that are frequent on their host; other columns as they
    are, but for ``n_chars``, which follows a changed text."""
    lines = stage(host_lines(rows_of(docs)), "host-lines")
    gone = lines_that_go(lines, most_docs, salts).groupBy("doc_id", "tk", "host").agg(
        F.collect_set("line").alias("gone")).alias("g")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       text_key(F.col("text")).alias("tk")).alias("d")
    found = rows.join(gone, F.expr("d.row.doc_id <=> g.doc_id AND d.tk = g.tk AND d.row.source <=> g.host"), "left")
    text = F.col("d.row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANK) | ~F.array_contains(
        F.col("g.gone"), F.xxhash64(normalised(x)))), "\n")
    changed = F.col("g.gone").isNotNull()
    out = found.select("d.row", F.when(changed, kept).otherwise(text).alias("text"), changed.alias("changed"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars")).cast("long")
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality(docs: DataFrame, most_docs: int = MOST_DOCS,
            least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, salts: int = SALTS) -> DataFrame:
    """Base counts, what boilerplate lines take away, and the verdict, per row."""
    rows = rows_of(docs)
    lines = stage(host_lines(rows), "host-lines")
    gone = lines_that_go(lines, most_docs, salts).groupBy("doc_id", "tk", "host").agg(
        F.sum("words").alias("gone_words"), F.sum("chars").alias("gone_chars"),
        F.sum("times").alias("gone_lines"))
    # repeated rows are one document here: their lines were counted together
    base = base_features(rows)
    documents = base.groupBy("doc_id", "tk", "host").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in base.columns[3:]])
    same = "f.doc_id <=> g.doc_id AND f.tk = g.tk AND f.host <=> g.host"
    found = documents.alias("f").join(gone.alias("g"), F.expr(same), "left").select(
        "f.*", *[F.coalesce(F.expr(f"{c} div copies"), F.lit(0).cast("long")).alias(c)
                 for c in ("gone_words", "gone_chars", "gone_lines")])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("gone_lines").alias("n_frequent_lines"),
        (F.col("n_words") - F.col("gone_words")).alias("words_left"),
        (~failed & (F.col("n_words") - F.col("gone_words") >= least_words)
         & (F.col("word_chars") - F.col("gone_chars") >= F.lit(least_share) * F.col("word_chars"))).alias("kept"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return verdict.drop("copy")
