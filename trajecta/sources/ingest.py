"""Parsers from the supported layouts to readings, batches and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.functions.numeric import as_number, to_long
from trajecta.operators.label import label_quality
from trajecta.operators.scale import lookup, plain, positions


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header.  Give a schema on large inputs: inferring one reads
    the data twice."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def coerce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers where the text parses, NULL elsewhere."""
    return df.withColumns({c: as_number(F.col(f"`{c}`")) for c in columns})


def parse_long(
    df: DataFrame, batch_col: str, time_col: str, cpp_cols: Sequence[str],
    yield_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(batches, readings)`` of a table with one row per step and batch."""
    rows = df.where(F.col(f"`{batch_col}`").isNotNull()).withColumn(
        "batch_id", F.col(f"`{batch_col}`").cast("string")
    )
    readings = rows.select(
        "batch_id", as_number(F.col(f"`{time_col}`")).alias("time_index"),
        *[as_number(F.col(f"`{c}`")).alias(c) for c in cpp_cols],
    )
    y = as_number(F.col(f"`{yield_col}`")) if yield_col else F.lit(None).cast("double")
    batches = rows.groupBy("batch_id").agg(
        F.round(F.avg(y), 2).alias("yield"), F.count(F.lit(1)).cast("int").alias("duration")
    )
    return label_quality(batches), readings


def parse_wide(
    df: DataFrame, batch_col: str, cpp_cols: Sequence[str], yield_col: str | None = None,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(batches, features)`` of a table with one row per batch.

    ``order`` tells which of several rows of one batch is the last: its values
    become the features; every row stays a record of ``batches``.
    """
    y = as_number(F.col(f"`{yield_col}`")) if yield_col else F.lit(None).cast("double")
    rows = df.withColumn("batch_id", F.col(f"`{batch_col}`").cast("string"))
    batches = label_quality(rows.select(
        "batch_id", F.round(y, 2).alias("yield"), F.lit(1).alias("duration")
    ))
    if not cpp_cols:
        return batches, rows.select("batch_id").distinct()
    rank = order if order is not None else F.monotonically_increasing_id()
    values = F.struct(*[as_number(F.col(f"`{c}`")).alias(c) for c in cpp_cols])
    features = rows.withColumn("_rank", rank).groupBy("batch_id").agg(
        F.max_by(values, "_rank").alias("v")
    ).select("batch_id", *[F.col(f"v.`{c}`").alias(c) for c in cpp_cols])
    return batches, features


def parse_pivot(
    df: DataFrame, time_col: str, batch_cols: Sequence[str], variable: str,
    time_format: str = "dd-MM-yyyy HH:mm",
) -> DataFrame:
    """``(batch_id, time_index, variable, value)`` of one parameter's file.

    The time only orders the rows; the position replaces it.
    """
    text = F.col(f"`{time_col}`")
    if isinstance(df.schema[time_col].dataType, T.StringType):
        moment = F.unix_micros(F.try_to_timestamp(text, F.lit(time_format))).cast("double")
        along = F.coalesce(moment, text.try_cast("double"))
    elif isinstance(df.schema[time_col].dataType, T.NumericType):
        along = text.cast("double")
    else:
        along = F.unix_micros(text.cast("timestamp")).cast("double")
    timed = df.withColumn("_along", along)
    placed, _ = positions(timed, [], [F.col("_along"), text], F.col("_along"), "time_index")
    cells = plain(placed).select(
        F.col("time_index"), *[as_number(F.col(f"`{b}`")).alias(b) for b in batch_cols]
    )
    return to_long(cells, ["time_index"], batch_cols, "batch_id", "value").select(
        "batch_id", "time_index", F.lit(variable).alias("variable"), "value"
    )


def merge_pivots(
    parsed: Sequence[DataFrame], variables: Sequence[str], yields: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(batches, readings)`` from the parameters' files: a full outer merge
    on batch and position, over the union of the batches."""
    if len(set(variables)) != len(list(variables)):
        raise ValueError("each file needs its own parameter name")
    cells = reduce(DataFrame.unionByName, parsed)
    readings = cells.groupBy("batch_id", "time_index").pivot("variable", list(variables)).agg(
        F.first("value")
    )
    sizes = readings.groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("duration"))
    if yields is None:
        batches = sizes.withColumn("yield", F.lit(None).cast("double"))
    else:
        batches = sizes.join(yields.select("batch_id", "yield"), "batch_id", "left")
    batches = batches.select("batch_id", F.round("yield", 2).alias("yield"), "duration")
    return label_quality(batches), readings


def rename_by_position(df: DataFrame, batch_cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Give the batch columns of a pivot file the ids of a summary, in order."""
    if len(batch_cols) != len(ids):
        raise ValueError(
            f"the summary has {len(ids)} batches, the time series {len(batch_cols)} columns"
        )
    return df.withColumnsRenamed(dict(zip(batch_cols, ids)))


def file_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """0-based row number over a file source, in file order, without a shuffle.

    Rows get their place inside a file block from the scan; the number of rows
    in earlier blocks is added from a table with one row per block.
    """
    tagged = df.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = tagged.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off")
    )
    return lookup(tagged, offsets, ["_file", "_start"]).withColumn(
        name, F.col("_off") + F.col("_id") - F.col("_first")
    ).drop("_file", "_start", "_id", "_first", "_off")


def parse_stacked(
    df: DataFrame, pos: str, cpp_cols: Sequence[str], batch_ids: DataFrame
) -> DataFrame:
    """Readings of runs stacked in the order of ``batch_ids(ordinal, batch_id)``.

    All runs have the same number of steps; rows past the last whole run are
    left over by the layout itself.
    """
    sizes = df.agg(F.count(F.lit(1)).alias("_rows")).crossJoin(
        batch_ids.agg(F.count(F.lit(1)).alias("_runs"))
    ).select(F.floor(F.col("_rows") / F.col("_runs")).alias("_steps"))
    cut = df.crossJoin(F.broadcast(sizes)).where("_steps > 0").select(
        F.floor(F.col(pos) / F.col("_steps")).cast("long").alias("ordinal"),
        F.pmod(F.col(pos), F.col("_steps")).cast("double").alias("time_index"),
        *[as_number(F.col(f"`{c}`")).alias(c) for c in cpp_cols],
    )
    ids = batch_ids.select(F.col("ordinal").cast("long").alias("ordinal"), "batch_id")
    return lookup(cut, ids, ["ordinal"]).select("batch_id", "time_index", *cpp_cols)


def parse_transposed(
    df: DataFrame, name_col: str, batch_cols: Sequence[str], yield_row: str | None = "yield"
) -> tuple[DataFrame, DataFrame]:
    """``(features, yields)`` of a table whose rows are parameters and whose
    columns are batches; one row may hold the yields."""
    cells = to_long(
        df.select(F.col(f"`{name_col}`").cast("string").alias("feature"),
                  *[as_number(F.col(f"`{b}`")).alias(b) for b in batch_cols]),
        ["feature"], batch_cols, "batch_id", "value",
    )
    is_yield = F.lower(F.trim("feature")) == F.lit((yield_row or "").strip().lower())
    features = cells.where(~is_yield).select("batch_id", "feature", "value")
    yields = cells.where(is_yield).select("batch_id", F.col("value").alias("yield"))
    return features, yields


def widen(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per feature."""
    return features.groupBy("batch_id").pivot("feature", list(names)).agg(F.first("value"))


def parse_trajectory(
    df: DataFrame, time_col: str, value_col: str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(points, stats)`` of uploaded trajectories: progress in percent of
    the time span, and count, mean, sample std, min, max."""
    keys = list(keys)
    rows = df.select(
        *keys, as_number(F.col(f"`{time_col}`")).alias("_t"),
        as_number(F.col(f"`{value_col}`")).alias("value"),
    )
    stats = rows.groupBy(*keys).agg(
        F.count("value").alias("n_points"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.min("_t").alias("t_min"), F.max("_t").alias("t_max"),
    )
    span = stats.select(*keys, "t_min", "t_max")
    joined = lookup(rows, span, keys) if keys else rows.crossJoin(F.broadcast(span))
    pct = F.try_divide(F.col("_t") - F.col("t_min"), F.col("t_max") - F.col("t_min")) * 100
    points = joined.select(*keys, F.coalesce(pct, F.lit(0.0)).alias("time_pct"), "value")
    return points, stats.drop("t_min", "t_max")


def parse_yield_lines(df: DataFrame, text: str) -> DataFrame:
    """``(batch_id, yield)`` from ``id: value`` lines; other lines are skipped.
    The last line of an id wins."""
    lines = df.select(F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "entry")).where(
        F.col("entry").contains(":")
    )
    parts = F.split("entry", ":", 2)
    return lines.select(
        "line", F.trim(parts[0]).alias("batch_id"), as_number(F.trim(parts[1])).alias("yield")
    ).where("yield IS NOT NULL").groupBy("batch_id").agg(F.max_by("yield", "line").alias("yield"))


def variable_of_file() -> Column:
    """Default parameter name: the file's name without its extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def assert_unique(names: Sequence[str]) -> None:
    """Refuse two files with the same parameter name."""
    doubled = sorted({n for n in names if list(names).count(n) > 1})
    if doubled:
        raise ValueError(f"duplicate parameter names: {', '.join(doubled)}")


def read_pivot_files(spark: SparkSession, paths: Mapping[str, str] | Sequence[str]) -> list[tuple[str, DataFrame]]:
    """``(parameter, table)`` per file; a mapping overrides the default names."""
    out = []
    for path in paths:
        table = read_csv(spark, path)
        name = paths[path] if isinstance(paths, Mapping) else table.select(
            variable_of_file().alias("n")
        ).first()["n"]
        out.append((name, table))
    assert_unique([n for n, _ in out])
    return out


def fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: count, sum and xor of row hashes, in any row order.

    A rebuild can be skipped when all three agree with the stored ones.
    """
    parts = []
    for name, df in tables.items():
        columns = sorted(df.columns)
        row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
        parts.append(df.select(row.alias("_h")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"),
            F.bit_xor("_h").alias("hash_xor"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("columns"), "*"))
    return reduce(DataFrame.unionByName, parts)


def fingerprint_text(tables: Mapping[str, DataFrame]) -> str:
    """The fingerprint of some tables as one text, for :meth:`ResultStore.run_of`."""
    rows = fingerprint(tables).collect()  # one row per table
    return ";".join(":".join(map(str, r)) for r in sorted(rows))
