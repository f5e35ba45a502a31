"""Line dedup: lines that many distinct sites share are boilerplate.

Lines are normalised as in the quality rule and hashed.  Per line a HyperLogLog
sketch of its sites is aggregated (partial sketches per task, merged).  A line
whose estimate is clearly above ``min_sites`` is spread; estimates within
``band`` of the limit are settled by an exact distinct count over those lines
only.  Every spread line is removed.  Only documents whose whole text
stands on ``min_sites`` distinct sites stay whole: they are copies of a text, not
pages with boilerplate around their own, and the near-duplicate step decides on them.

DataFrame functions only.  Lines are a stage table without their texts; the
spread lines are joined back salted, as a line may be in a third of all documents.

Defined cases: NULL texts stay NULL and have no line; lines without a word stay
and never count; a NULL site is a site of its own; repeated rows change alike;
empty tables give no rows; other columns pass through ``remove_spread_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import stage, text_key
from trajecta.llm.line_frequency import BLANK, normalised

MIN_SITES = 5
BAND = 0.25
SALTS = 16
LG_K = 11


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, place, line, site) of every line with a word."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tk"),
                       F.coalesce(F.col("source"), F.lit("\u0000")).alias("site"),
                       F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rows.where(~F.col("line").rlike(BLANK)).select(
        "doc_id", "tk", "place", "site", F.xxhash64(normalised(F.col("line"))).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Hashes of the lines on ``min_sites`` distinct sites or more."""
    sketched = lines.groupBy("line").agg(
        F.count("*").alias("rows"), F.hll_sketch_agg("site", LG_K).alias("sketch")
    ).where(F.col("rows") >= min_sites).select(
        "line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band))
    sketched = stage(sketched, "line-sites")
    clear = sketched.where(F.col("sites") > min_sites * (1 + band)).select("line")
    near = sketched.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line", "site").agg(
        F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return clear.union(exact.select("line"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, salts: int = SALTS) -> DataFrame:
    """(doc_id, tk, places) of the lines to remove, for documents that change."""
    lines = stage(line_table(docs), "lines")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    spread = spread_lines(lines, min_sites, band).withColumn("salt", every)
    marked = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(salts)).cast("int")).join(
        spread, ["line", "salt"], "left_semi")
    per_doc = marked.groupBy("doc_id", "tk").agg(F.collect_set("place").alias("places"))
    copies = lines.groupBy("tk", "site").agg(F.lit(1).alias("one")).groupBy("tk").agg(
        F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("tk", every.alias("salt"))
    return per_doc.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(
        copies, ["tk", "salt"], "left_anti").select("doc_id", "tk", "places")


def remove_spread_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with spread lines removed from ``text``, ``n_chars`` brought in line
    where lines went, and n_removed, the number of lines that went."""
    gone = removals(docs, **options).alias("g")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       text_key(F.col("text")).alias("tk")).alias("d")
    found = rows.join(gone, F.expr("d.row.doc_id <=> g.doc_id AND d.tk = g.tk"), "left")
    kept = F.array_join(F.filter(
        F.split(F.col("d.row.text"), "\n"), lambda x, i: ~F.array_contains(F.col("g.places"), i)), "\n")
    changed = F.col("g.places").isNotNull()
    out = found.select("d.row", F.when(changed, kept).otherwise(F.col("d.row.text")).alias("text"),
                       F.when(changed, F.size("g.places")).otherwise(0).cast("long").alias("n_removed"))
    before = F.col("row.n_chars") if "n_chars" in docs.columns else F.length("text")
    own = {"text": F.col("text"), "n_removed": F.col("n_removed"),
           "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(before).cast("long")}
    columns = [*docs.columns, *[c for c in ("n_chars", "n_removed") if c not in docs.columns]]
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in columns])
