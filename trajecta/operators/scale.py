"""Building blocks that keep a plan balanced when one key holds most rows.

Each helper measures first and then picks a plan: a broadcast for a side whose
counted size fits, a plain shuffle join or window when every key group is
small, and a salted or chunked form when some group is not.  Results are the
same on every path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta import config
from trajecta.session import cut_lineage


def row_width(schema: T.StructType) -> int:
    """Rough bytes per row, with room for strings and short arrays."""
    width = 16
    for field in schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            width += 8 * config.GRID_POINTS
        elif isinstance(field.dataType, (T.StringType, T.StructType)):
            width += 48
        else:
            width += 8
    return width


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    return rows * row_width(df.schema) <= config.BROADCAST_BYTES


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows: int | None = None,
    heaviest: int | None = None,
) -> DataFrame:
    """Join a large table to a table that is unique on ``keys``.

    ``rows`` is the counted size of ``dim`` (counted here when not given) and
    ``heaviest`` the largest number of fact rows per key, when known.
    """
    keys = list(keys)
    if not keys:  # unique on nothing: one row at most
        return facts.join(F.broadcast(dim), F.lit(True), how)
    if rows is None:
        dim = cut_lineage(dim, "lookup")
        rows = dim.count()
    if fits_broadcast(dim, rows):
        return facts.join(F.broadcast(dim), keys, how)
    if heaviest is not None and heaviest <= config.HOT_ROWS:
        return facts.join(dim, keys, how)
    others = [F.col(f"`{c}`") for c in facts.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.lit(config.SALT_BUCKETS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(config.SALT_BUCKETS - 1)))
    return (
        facts.withColumn("_salt", salt)
        .join(dim.withColumn("_salt", copies), [*keys, "_salt"], how)
        .drop("_salt")
    )


def bucket_of(edges: Column, x: Column) -> Column:
    """How many of the (few, sorted) edges lie below ``x``."""
    return F.aggregate(edges, F.lit(0).cast("long"), lambda n, e: n + (e < x).cast("long"))


def edge_shares(pieces: int) -> Column:
    return F.array(*[F.lit((i + 1) / pieces) for i in range(pieces - 1)])


def split_hot(
    df: DataFrame, part: Sequence[str], along: Column, tie: Column | None = None
) -> tuple[DataFrame, list[str]]:
    """Cut oversized key groups into chunks that follow the order of ``along``.

    Chunks end at approximate quantiles, so outliers and uneven spacing do not
    matter.  Rows that share one value of ``along`` stay together unless
    ``tie``, a hash that is the next order column, is given: a value that spans
    several chunks is then cut along the hash.

    Returns the table and the columns to window by: ``part`` itself when no
    group is above the limit, else ``part`` plus ``_chunk``.
    """
    part = list(part)
    x = along.cast("double")
    heaviest = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if heaviest <= config.HOT_ROWS:
        return df, part
    pieces = 4 * -(-heaviest // config.HOT_ROWS)
    sizes = cut_lineage(
        df.groupBy(*part).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx(x, edge_shares(pieces), config.QUANTILE_ACCURACY).alias("_edges"),
        ).where(F.col("_n") > config.HOT_ROWS), "hot-groups")
    # no more groups than rows / HOT_ROWS
    low = bucket_of(F.col("_edges"), x)
    chunk = low
    if tie is not None:
        same = F.aggregate(F.col("_edges"), F.lit(0).cast("long"), lambda n, e: n + (e == x).cast("long"))
        unit = tie.cast("double") / float(1 << 64) + F.lit(0.5)  # in [0, 1], in the hash's order
        chunk = low + F.least(F.floor(unit * (same + 1)), same)
    out = lookup(df, sizes, part, "left").withColumn(
        "_chunk", F.coalesce(chunk, F.lit(0)).cast("long")
    ).withColumn("_split", F.col("_n").isNotNull()).drop("_n", "_edges")
    return out, [*part, "_chunk"]


def chunk_table(df: DataFrame, cell: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One summary row per chunk of the split groups only."""
    return df.where("_split").groupBy(*cell).agg(*aggs)


def positions(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], along: Column, name: str = "pos",
    tie: Column | None = None,
) -> tuple[DataFrame, list[str]]:
    """0-based position of each row inside its group, plus the window columns.

    ``along`` must be the leading order column, and ``tie``, if given, a hash
    that is the second one, so that chunks keep the order.
    """
    part = list(part)
    df, cell = split_hot(df, part, along, tie)
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1
    if cell == part:
        return df.withColumn(name, inside.cast("long")), cell
    before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk_table(df, cell, [F.count(F.lit(1)).alias("_c")]).select(
        *cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    out = lookup(df.withColumn("_in", inside), offsets, cell, "left")
    return (
        out.withColumn(name, (F.col("_in") + F.coalesce(F.col("_off"), F.lit(0))).cast("long"))
        .drop("_in", "_off"),
        cell,
    )


def plain(df: DataFrame) -> DataFrame:
    """Drop the chunk bookkeeping."""
    return df.drop("_chunk", "_split")


def _measure(base: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> tuple[DataFrame | None, int]:
    """Sizes of the groups if one is above the limit, else None; and the number of groups."""
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups, biggest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if (biggest or 0) <= config.QUANTILE_ROWS:
        return None, groups
    return cut_lineage(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs), "groups"), groups


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q",
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, as one array column.

    Small groups use ``percentile``.  In larger ones an approximate quantile of
    known rank error brackets every wanted rank; only the values inside the
    brackets, some thousandths of a group however they are spread, are counted
    and ordered.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    direct = base.groupBy(*keys).agg(
        F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias(name)
    )
    slack = 4.0 / config.QUANTILE_ACCURACY
    shares = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-slack, slack)]
    near = F.percentile_approx("_v", F.array(*map(F.lit, shares)), config.QUANTILE_ACCURACY)
    ends = F.array(*[e for _ in probs for e in (F.min("_v"), F.max("_v"))])
    edges = F.when(F.count(F.lit(1)) > config.QUANTILE_ACCURACY, near).otherwise(ends).alias("_edges")
    sizes, groups = _measure(base, keys, [edges])
    if sizes is None:
        return direct
    faced = lookup(base, sizes, keys, rows=groups)
    low = [F.col("_edges")[2 * i] for i in range(len(probs))]
    high = [F.col("_edges")[2 * i + 1] for i in range(len(probs))]
    below = faced.groupBy(*keys).agg(F.max("_n").alias("_n"), F.array(*[
        F.count(F.when(F.col("_v") < a, 1)) for a in low]).alias("_below"))
    inside = F.array_compact(F.array(*[
        F.when((F.col("_v") >= a) & (F.col("_v") <= b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high))]))
    counted = faced.select(*keys, "_v", F.explode(inside).alias("i")).groupBy(*keys, "i", "_v").agg(
        F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = lookup(counted, below, keys, rows=groups).withColumn(
        "_at", F.col("_below")[F.col("i")] + F.coalesce(F.sum("_m").over(run), F.lit(0)))
    share = F.array(*[F.lit(float(p)) for p in probs])[F.col("i")]
    at = (F.col("_n") - 1) * share
    holds = lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_m"))
    pair = placed.groupBy(*keys, "i").agg(
        F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("a"),
        F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("b"),
        F.max(at - F.floor(at)).alias("w"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))
    q = F.when(F.col("a").isNull() | F.col("b").isNull(), missed.cast("double")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    return pair.withColumn("q", q).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(name)
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """``(keys, value, ties, rank)``: 1-based ranks with ties averaged.

    Works on counted distinct values, so repeated values never pile up.  Large
    groups are cut at approximate quantiles of their distinct values.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("ties")
    )
    placed, cell = split_hot(counted, keys, F.col(value))
    inner = Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ties").over(inner), F.lit(0))
    if cell == keys:
        return counted.withColumn(name, start + (F.col("ties") + 1) / 2)
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk_table(placed, cell, [F.sum("ties").alias("_c")]).select(
        *cell, F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_off"))
    ranked = lookup(placed.withColumn("_start", start), offsets, cell, "left")
    return plain(ranked.withColumn(
        name, F.col("_start") + F.coalesce("_off", F.lit(0)) + (F.col("ties") + 1) / 2)).drop("_start", "_off")
