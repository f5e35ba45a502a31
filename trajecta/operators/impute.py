"""Missing-value treatment of raw readings.

The method per (batch, variable) follows the number of valid points: cubic
spline (four or more), linear (two or three), constant (one), global median
(none).  Interpolation runs over row positions, not over time.  Neighbouring
valid points come from windows; runs above the row limit are windowed chunk by
chunk, with the last and first valid point carried across chunks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta import config
from trajecta.functions.numeric import as_number, first_rows, to_long
from trajecta.functions.fill import fill_runs
from trajecta.functions.spline import second_derivatives
from trajecta.operators.scale import chunk_table, lookup, plain, positions, quantiles
from trajecta.session import cut_lineage


def missing_cells(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``(batch_id, variable, n_total, n_missing, rate)``, one pass over the rows."""
    counts = readings.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count(as_number(F.col(f"`{v}`"))).alias(v) for v in variables],
    )
    return to_long(counts, ["batch_id", "n_total"], variables, "variable", "n_valid").select(
        "batch_id", "variable", "n_total",
        (F.col("n_total") - F.col("n_valid")).alias("n_missing"),
        ((F.col("n_total") - F.col("n_valid")) / F.col("n_total")).alias("rate"),
    )


def missing_summary(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per batch: rates, cell counts and the confidence tier."""
    out = missing_cells(readings, variables).groupBy("batch_id").agg(
        F.max("rate").alias("max_missing_rate"),
        F.avg("rate").alias("mean_missing_rate"),
        F.sum("n_missing").alias("n_missing_cells"),
        F.sum("n_total").alias("n_total_cells"),
    )
    tier = (
        F.when(F.col("max_missing_rate") <= 0.10, "High")
        .when(F.col("max_missing_rate") <= 0.30, "Medium")
        .otherwise("Low")
    )
    return out.withColumn("confidence", tier)


def confidence_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_batches"))


def least_certain(summary: DataFrame, first: int | None = None) -> DataFrame:
    """The Low-confidence batches, those with the most gaps first."""
    return first_rows(
        summary.where(F.col("confidence") == "Low")
        .orderBy(F.desc("max_missing_rate"), "batch_id").select("batch_id", "max_missing_rate"), first
    )


def global_medians(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``(variable, median)`` over all readings; 0 for a variable without any."""
    cells = to_long(
        readings.select(*[as_number(F.col(f"`{v}`")).alias(v) for v in variables]), [], variables
    )
    found = quantiles(cells, ["variable"], "value", [0.5], "_q")
    names = readings.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    return names.join(found, "variable", "left").select(
        "variable", F.coalesce(F.col("_q")[0], F.lit(0.0)).alias("median")
    )


def method_name(n_valid: Column, edge: Column) -> Column:
    """Name of the treatment; ``edge`` tells whether an end is open."""
    return (
        F.when(n_valid >= 4, F.concat(F.lit("cubic"), F.when(edge, "+edge-fill").otherwise("")))
        .when(n_valid >= 2, "linear")
        .when(n_valid == 1, "single-point-constant")
        .otherwise("global-median")
    )


def methods(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``(batch_id, variable, method, n_missing)`` of every series with gaps.

    An end is open when the first or the last row, in the order that the
    filling uses, has no value.
    """
    place = F.struct("time_index", F.xxhash64(*[F.col(f"`{v}`") for v in variables]))
    stats = readings.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.struct(
            F.count(x).alias("n"), F.min_by(x.isNull(), place).alias("a"), F.max_by(x.isNull(), place).alias("b"),
        ).alias(v) for v in variables for x in [as_number(F.col(f"`{v}`"))]],
    )
    cells = to_long(stats, ["batch_id", "n_total"], variables, "variable", "s")
    n = F.col("s.n")
    edge = F.col("s.a") | F.col("s.b")
    return cells.where(n < F.col("n_total")).select(
        "batch_id", "variable", method_name(n, edge).alias("method"),
        (F.col("n_total") - n).alias("n_missing"),
    )


def method_counts(found: DataFrame, first: int | None = None) -> DataFrame:
    """Series per method, most frequent first."""
    return first_rows(
        found.groupBy("method").agg(F.count(F.lit(1)).alias("n_series"))
        .orderBy(F.desc("n_series"), "method"), first
    )


def imputed_share(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row: filled cells, all cells and the percentage."""
    return missing_cells(readings, variables).agg(
        F.sum("n_missing").alias("imputed_cells"), F.sum("n_total").alias("total_cells"),
    ).withColumn("imputed_pct", F.lit(100.0) * F.col("imputed_cells") / F.col("total_cells"))


def neighbours(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Readings with ``pos`` and, per variable ``i``, the ordinal, position and
    value of the valid points at or before (``_r, _p, _v``) and at or after
    (``_q, _w``) each row."""
    placed, cell = positions(
        readings, ["batch_id"],
        [F.col("time_index"), F.xxhash64(*[F.col(f"`{v}`") for v in variables])],
        F.col("time_index"), "pos",
    )
    n = range(len(variables))
    back = Window.partitionBy(*cell).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # the same frame read from the other end: a running frame stays linear
    ahead = Window.partitionBy(*cell).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    x = [F.col(f"_x{i}") for i in n]
    rows = placed.withColumns({f"_x{i}": as_number(F.col(f"`{v}`")) for i, v in enumerate(variables)})
    at = [F.when(c.isNotNull(), F.col("pos")) for c in x]
    rows = rows.withColumns({
        **{f"_r{i}": F.count(x[i]).over(back) for i in n},
        **{f"_p{i}": F.max(at[i]).over(back) for i in n},
        **{f"_v{i}": F.last(x[i], ignorenulls=True).over(back) for i in n},
        **{f"_q{i}": F.min(at[i]).over(ahead) for i in n},
        **{f"_w{i}": F.last(x[i], ignorenulls=True).over(ahead) for i in n},
    })
    if cell == ["batch_id"]:
        return rows
    ends = chunk_table(rows, cell, [
        c for i in n for c in (
            F.count(x[i]).alias(f"_cn{i}"),
            F.max(at[i]).alias(f"_cp{i}"), F.max_by(x[i], at[i]).alias(f"_cv{i}"),
            F.min(at[i]).alias(f"_cq{i}"), F.min_by(x[i], at[i]).alias(f"_cw{i}"),
        )
    ])
    earlier = Window.partitionBy("batch_id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    later = Window.partitionBy("batch_id").orderBy(F.desc("_chunk")).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = ends.select(
        *cell,
        *[c for i in n for c in (
            F.coalesce(F.sum(f"_cn{i}").over(earlier), F.lit(0)).alias(f"_kn{i}"),
            F.last(f"_cp{i}", ignorenulls=True).over(earlier).alias(f"_kp{i}"),
            F.last(f"_cv{i}", ignorenulls=True).over(earlier).alias(f"_kv{i}"),
            F.last(f"_cq{i}", ignorenulls=True).over(later).alias(f"_kq{i}"),
            F.last(f"_cw{i}", ignorenulls=True).over(later).alias(f"_kw{i}"),
        )],
    )
    joined = lookup(rows, carry, cell, "left")
    filled = {}
    for i in n:
        filled[f"_r{i}"] = F.col(f"_r{i}") + F.coalesce(F.col(f"_kn{i}"), F.lit(0))
        for a, b in (("_p", "_kp"), ("_v", "_kv"), ("_q", "_kq"), ("_w", "_kw")):
            filled[f"{a}{i}"] = F.coalesce(F.col(f"{a}{i}"), F.col(f"{b}{i}"))
    drop = [f"{k}{i}" for i in n for k in ("_kn", "_kp", "_kv", "_kq", "_kw")]
    return plain(joined.withColumns(filled).drop(*drop))


KNOT_KEYS = ["batch_id", "variable", "block"]
INTERVALS = "batch_id string, variable string, pos long, m0 double, m1 double"


def _spline_block(pdf: pd.DataFrame) -> tuple[np.ndarray, ...] | None:
    """Second derivatives at both ends of the intervals that hold gaps."""
    home = pdf["home"].to_numpy(dtype=bool)
    x = pdf["pos"].to_numpy(dtype=float)
    left = np.flatnonzero(home[:-1] & (np.diff(x) > 1))
    if not len(left):  # no gap, or a block of halo copies only
        return None
    m = second_derivatives(x, pdf["value"].to_numpy(dtype=float))
    return left, x[left].astype("int64"), m[left], m[left + 1]


def _spline_partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve the blocks of a sorted partition; a block may span Arrow batches,
    so the last one of a batch waits for the next."""
    held = None
    for part in parts:
        if part.empty:
            continue
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        changed = (rows[KNOT_KEYS] != rows[KNOT_KEYS].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(changed)
        held = rows.iloc[starts[-1]:]
        yield from _solve_blocks(rows, starts, len(starts) - 1)
    if held is not None:
        yield from _solve_blocks(held, np.array([0]), 1)


def _solve_blocks(rows: pd.DataFrame, starts: np.ndarray, count: int) -> Iterator[pd.DataFrame]:
    ends = [*starts[1:], len(rows)]
    out: list[list] = [[], [], [], [], []]
    for start, end in zip(starts[:count], ends[:count]):
        solved = _spline_block(rows.iloc[start:end])
        if solved is None:
            continue
        left, pos, m0, m1 = solved
        out[0] += [rows["batch_id"].iloc[start]] * len(left)
        out[1] += [rows["variable"].iloc[start]] * len(left)
        for box, values in zip(out[2:], (pos, m0, m1)):
            box.extend(values)
    if out[0]:
        yield pd.DataFrame(dict(zip(("batch_id", "variable", "pos", "m0", "m1"), out)))


def spline_intervals(knots: DataFrame) -> DataFrame:
    """Spline terms per (batch, variable, position of the left knot).

    Blocks of knots are solved apart, each with a halo of neighbours.  The
    influence of a knot at least halves with every knot between, so a halo of
    64 leaves nothing a double can show and long runs never meet in one task.
    """
    size, halo = config.SPLINE_BLOCK, config.SPLINE_HALO
    k = F.col("ordinal") - 1
    block, at = F.floor(k / size), F.pmod(k, F.lit(size))
    blocks = F.array_compact(F.array(
        block,
        F.when((at < halo) & (block > 0), block - 1),
        F.when(at >= size - halo, block + 1),
    ))
    spread = knots.withColumn("_home", block).withColumn("block", F.explode(blocks)).withColumn(
        "home", F.col("_home") == F.col("block")
    ).drop("_home")
    ordered = spread.repartition(*KNOT_KEYS).sortWithinPartitions(*KNOT_KEYS, "ordinal")
    return ordered.mapInPandas(_spline_partition, INTERVALS)


BLOCK_ROWS = 200_000


def _median_row(readings: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row with the global median of every variable."""
    return global_medians(readings, variables).agg(*[
        F.max(F.when(F.col("variable") == v, F.col("median"))).alias(f"_med{i}") for i, v in enumerate(variables)])


def _fill_whole_runs(readings: DataFrame, variables: list[str], cubic: bool) -> DataFrame:
    """Every treatment in one shuffle: runs lie whole in sorted partitions and
    are filled many at a time."""
    schema = T.StructType([
        T.StructField(f.name, T.DoubleType()) if f.name in variables else f for f in readings.schema.fields])
    order = ["batch_id", "time_index", F.xxhash64(*[F.col(f"`{v}`") for v in variables])]
    rows = readings.withColumns({v: as_number(F.col(f"`{v}`")) for v in variables})
    rows = rows.crossJoin(F.broadcast(_median_row(readings, variables))).repartition("batch_id").sortWithinPartitions(*order)
    names = [f.name for f in schema.fields]

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = [table.column(v).to_numpy(zero_copy_only=False).astype(float) for v in variables]
        medians = [table.column(f"_med{i}")[0].as_py() for i in range(len(variables))]
        filled = dict(zip(variables, fill_runs(starts, columns, medians, cubic)))
        return pa.RecordBatch.from_arrays([
            pa.array(filled[c]) if c in filled else table.column(c).combine_chunks() for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < BLOCK_ROWS:
                    continue
            if not sum(b.num_rows for b in held):
                continue
            table = pa.Table.from_batches(held)
            codes = table.column("batch_id").combine_chunks().dictionary_encode().indices
            codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            whole = table.num_rows if batch is None else int(starts[-1])  # the last run may go on
            if whole:
                yield solve(table.slice(0, whole), starts[starts < whole])
            held = table.slice(whole).to_batches()

    return rows.mapInArrow(run, schema)


def impute(readings: DataFrame, variables: Sequence[str], cubic: bool = True) -> DataFrame:
    """Readings without gaps, in the shape they came in.

    With ``cubic=False`` every series of two or more points is filled
    linearly, the ends with the nearest valid value.  Runs above the row limit
    are windowed and solved chunk by chunk.
    """
    variables = list(variables)
    keep = [c for c in readings.columns if c not in variables]
    n = range(len(variables))
    if (readings.groupBy("batch_id").count().agg(F.max("count")).first()[0] or 0) <= config.HOT_ROWS:
        return _fill_whole_runs(readings, variables, cubic)
    rows = neighbours(readings, variables)
    if cubic:
        # valid cells need only their ordinal, gaps only their neighbours
        gap = lambda i, c: F.when(F.col(f"_x{i}").isNull(), F.col(f"{c}{i}"))
        slim = {f"{c}{i}": gap(i, c) for i in n for c in ("_p", "_v", "_q", "_w")}
        slim.update({f"_r{i}": F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_r{i}")) for i in n})
        rows = cut_lineage(rows.withColumns(slim).drop(*variables), "neighbours")
    filled = {}
    for i, v in enumerate(variables):
        p, q = F.col(f"_p{i}"), F.col(f"_q{i}")
        lerp = F.col(f"_v{i}") + (F.col(f"_w{i}") - F.col(f"_v{i}")) * (
            (F.col("pos") - p) / F.nullif(q - p, F.lit(0))
        )
        filled[v] = F.coalesce(
            F.col(f"_x{i}"), lerp, F.col(f"_w{i}"), F.col(f"_v{i}"), F.col(f"_med{i}")
        )
    linear = rows.crossJoin(F.broadcast(_median_row(readings, variables))).select(
        *keep, "pos", *[filled[v].alias(v) for v in variables])
    if not cubic:
        return linear.drop("pos").select(*readings.columns)
    counts = missing_cells(readings, variables)
    splined = counts.where((F.col("n_missing") > 0) & (F.col("n_total") - F.col("n_missing") >= 4))
    curved = {r["variable"] for r in splined.select("variable").distinct().collect()}
    if not curved:
        return linear.drop("pos").select(*readings.columns)
    chosen = [i for i in n if variables[i] in curved]
    point = lambda i, *fields: F.struct(F.lit(variables[i]).alias("variable"), *fields)
    knots = rows.select("batch_id", "pos", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"_x{i}").isNotNull(), point(
            i, F.col(f"_r{i}").alias("ordinal"), F.col(f"_x{i}").alias("value")))
        for i in chosen
    ]))).alias("k")).select("batch_id", "pos", "k.*")
    need = splined.select("batch_id", "variable")
    terms = spline_intervals(lookup(knots, need, ["batch_id", "variable"], "left_semi"))
    # gaps inside the valid range, spread over the position blocks of their interval
    width = config.HOT_ROWS
    inner = [
        F.when(F.col(f"_x{i}").isNull() & F.col(f"_p{i}").isNotNull() & F.col(f"_q{i}").isNotNull(),
               point(i, F.col(f"_p{i}").alias("p"), F.col(f"_v{i}").alias("v"),
                     F.col(f"_q{i}").alias("q"), F.col(f"_w{i}").alias("w")))
        for i in chosen
    ]
    gaps = rows.select("batch_id", "pos", F.explode(F.array_compact(F.array(*inner))).alias("g")).select(
        "batch_id", F.col("pos").alias("at"), "g.*", F.floor(F.col("pos") / width).alias("part")
    )
    # intervals come with their right end, found again from the gap rows
    spans = gaps.groupBy("batch_id", "variable", "p", "part").agg(F.max("q").alias("_q")).drop("_q")
    placed = spans.join(
        terms.withColumnRenamed("pos", "p"), ["batch_id", "variable", "p"]
    )
    h = F.col("q") - F.col("p")
    a, b = (F.col("q") - F.col("at")) / h, (F.col("at") - F.col("p")) / h
    curve = (
        a * F.col("v") + b * F.col("w")
        + ((a * a * a - a) * F.col("m0") + (b * b * b - b) * F.col("m1")) * h * h / 6.0
    )
    solved = gaps.join(placed, ["batch_id", "variable", "p", "part"]).select(
        "batch_id", F.col("at").alias("pos"), "variable", curve.alias("value")
    )
    by_row = solved.groupBy("batch_id", "pos").agg(*[
        F.max(F.when(F.col("variable") == variables[i], F.col("value"))).alias(f"_s{i}")
        for i in chosen
    ])
    out = {variables[i]: F.coalesce(F.col(f"_s{i}"), F.col(f"`{variables[i]}`")) for i in chosen}
    return linear.join(by_row, ["batch_id", "pos"], "left").withColumns(out).select(
        *readings.columns
    )


def fill_matrix(aligned: DataFrame) -> DataFrame:
    """Fill gaps of the unfolded matrix with the column mean (0 if none);
    ``was_missing`` marks the filled cells."""
    # one row per variable and step
    means = aligned.groupBy("variable", "step").agg(F.avg("value").alias("_mean"))
    return aligned.join(means, ["variable", "step"]).select(
        "batch_id", "variable", "step", "time_norm",
        F.coalesce("value", "_mean", F.lit(0.0)).alias("value"),
        F.col("value").isNull().alias("was_missing"),
    )
