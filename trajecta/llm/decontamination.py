"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` words (a shorter item is one
window).  A window is a set of placed 3-word shingles; exact containment needs
all of them, so one shingle, the rarest over all documents, is the prefix that
has to join.  Steps:

1. one pass over the documents keeps the places of every shingle that some window
   has, and one sentinel row per document with its number of words (a stage table);
2. shingle counts over that table order the shingles by rarity; a window with a
   shingle that occurs nowhere is out;
3. the places of the windows' rarest shingles give candidate starts, bounded by
   the document's ends (length) and the shingle's place in the window (position);
4. candidates are verified word by word against the texts of those documents only.

DataFrame functions only.  What the benchmark gives is broadcast only if it is
counted and under ``BROADCAST_ROWS`` rows, else joined by shuffles; so are the
verified candidates.

Defined cases: NULL and word-free items have no window; NULL and empty texts have
no words; items with a NULL id mark words but are not listed; repeated items
count once, repeated documents each; empty tables give no contamination; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import ascii_lower, plain_words, stage, text_key

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000
SENTINEL = -(1 << 62)  # stands for a document itself, at place -1


def item_words(text: Column) -> Column:
    return plain_words(ascii_lower(F.coalesce(text, F.lit(""))))


def shingle_hashes(words: str, size: Column | int) -> Column:
    """Hash of the ``size`` words from each place on; as many as there are places."""
    size = F.lit(size) if isinstance(size, int) else size
    w = F.col(words)
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.when(size == 3, F.xxhash64(w[i], w[i + 1], w[i + 2]))
                       .when(size == 2, F.xxhash64(w[i], w[i + 1])).otherwise(F.xxhash64(w[i])))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table with the broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase, n): the distinct windows of every item."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    runs = items.select("item_id", "words", F.explode(starts).alias("at"))
    return runs.select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("run")).select(
        "item_id", F.array_join("run", " ").alias("phrase"), F.size("run").alias("n")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(phrase, n, size, place, hash) of every shingle of every distinct window."""
    runs = windows.select("phrase", "n", F.split("phrase", " ").alias("run"),
                          F.least(F.col("n"), F.lit(SHINGLE)).alias("size")).distinct()
    return runs.select("phrase", "n", "size", F.posexplode(shingle_hashes("run", F.col("size"))).alias("place", "hash"))


def places(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, tk, n_words, size, place, hash): where the documents have one of the
    shingles, and a sentinel row with place -1 for each document."""
    wanted = stage(shingles.select("size", "hash").distinct(), "shingles")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # at most SHINGLE values
    words = docs.select("doc_id", text_key(F.col("text")).alias("tk"), item_words(F.col("text")).alias("words"))
    parts = []
    for size in sizes or [SHINGLE]:
        sentinel = F.array(F.lit(SENTINEL)) if not parts else F.array().cast("array<long>")
        spread = words.select("doc_id", "tk", F.size("words").cast("long").alias("n_words"),
                              F.posexplode(F.concat(sentinel, shingle_hashes("words", size))).alias("place", "hash"))
        # a shingle that happens to hash to the sentinel only comes along for nothing
        known = wanted.where(F.col("size") == size).select(F.col("hash").alias("h")).union(
            docs.sparkSession.range(1).select(F.lit(SENTINEL))).distinct()
        joined = spread.join(small(stage(known, "known")), F.col("hash") == F.col("h"))
        parts.append(joined.select("doc_id", "tk", "n_words", F.lit(size).alias("size"),
                                   (F.col("place") - (1 if not parts else 0)).alias("place"), "hash"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return stage(found, "places")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tk, n_words, n_hit, items (sorted texts of ids) of every row of ``docs``."""
    windows = stage(item_windows(benchmark, window), "windows")
    shingles = stage(window_shingles(windows), "window-shingles")
    seen = places(docs, shingles)
    # rarity over all documents; a window needs all its shingles
    often = seen.where("place >= 0").groupBy("size", "hash").agg(F.count("*").alias("often"))
    ranked = shingles.join(often, ["size", "hash"], "left").groupBy("phrase", "n", "size").agg(
        F.min(F.coalesce("often", F.lit(0).cast("long"))).alias("least"),
        F.min_by(F.struct("hash", "place"), F.struct(F.coalesce("often", F.lit(0).cast("long")), "place")).alias("rarest"))
    prefix = stage(ranked.where("least > 0").select(
        "phrase", F.col("n").alias("m"), F.col("size").alias("s"), F.col("rarest.hash").alias("h"),
        F.col("rarest.place").alias("at")), "prefix")
    start = F.col("place") - F.col("at")
    starts = seen.where("place >= 0").join(
        small(prefix), (F.col("hash") == F.col("h")) & (F.col("size") == F.col("s")) & (start >= 0)
        & (start + F.col("m") <= F.col("n_words")))
    starts = stage(starts.select("doc_id", "tk", start.alias("start"), "m", "phrase").distinct(), "starts")
    # verify in the texts of the candidate documents
    per_doc = starts.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "m", "phrase")).alias("found"))
    few = starts.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text").alias("d")
    candidates = (F.broadcast(per_doc) if few else per_doc).alias("c")
    words = texts.join(candidates, F.expr("d.doc_id <=> c.doc_id AND d.tk = c.tk")).select(
        "d.doc_id", "d.tk", "c.found", item_words(F.col("d.text")).alias("words"))
    checked = words.select("doc_id", "tk", F.filter("found", lambda f: F.array_join(
        F.slice(F.col("words"), f["start"] + 1, F.least(f["m"], F.size("words"))), " ") == f["phrase"]).alias("hits"))
    hits = stage(checked.where(F.size("hits") > 0).dropDuplicates(["doc_id", "tk"]), "hits")
    # words inside any hit: each span counts what it adds beyond the spans before it
    spans = F.array_sort(F.transform("hits", lambda f: F.struct(f["start"].alias("a"), (f["start"] + f["m"]).alias("b"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda t, s: F.struct(F.greatest(t["end"], s["b"]).alias("end"),
                              (t["n"] + F.greatest(s["b"] - F.greatest(s["a"], t["end"]), F.lit(0))).cast("long").alias("n")),
        lambda t: t["n"])
    counted = hits.select("doc_id", "tk", covered.alias("n_hit"))
    listed = hits.select("doc_id", "tk", F.explode(F.array_distinct(F.transform(
        "hits", lambda f: f["phrase"]))).alias("phrase")).join(windows, "phrase").groupBy("doc_id", "tk").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    marked = counted.alias("a").join(listed.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.tk = b.tk"), "left").select(
        "a.doc_id", "a.tk", "a.n_hit", "b.items")
    everyone = seen.where("place < 0").select("doc_id", "tk", "n_words")
    return everyone.alias("d").join(marked.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.tk = m.tk"), "left").select(
        "d.doc_id", "d.tk", "d.n_words", F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("m.items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The item list as its length and the SHA-256 of its comma-joined text."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    bad = contamination(docs, benchmark, **options).where("n_hit > 0").select(
        F.col("doc_id").alias("bad_id"), F.col("tk").alias("bad_tk")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (text_key(docs["text"]) == bad["bad_tk"])
    return docs.join(bad, same, "left_anti")
