"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is its component's smallest node.

    Each round points every node's larger neighbours, then its smaller ones, to
    its smallest neighbour; depth falls geometrically.  A round is a stage table,
    and only its row count and checksum reach the driver.  Minima are partial
    sums per task, and the joins back are plain equi-joins that adaptive
    execution splits at a hot node.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        larger = both.where("v > u").join(least, "u").select(
            F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
        root = larger.groupBy("a").agg(F.min("b").alias("m"))
        edges = stage(
            larger.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(root).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
