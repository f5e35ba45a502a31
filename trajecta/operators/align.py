"""Alignment of runs to a common progress axis, unfolding, phase summaries.

Alignment never orders a whole run.  Each reading falls in one grid cell; a
cell keeps only its first and last sample, which every Arrow batch does on
the map side.  At most ``points`` cells per run and Arrow batch reach the shuffle,
however long the run is, and the interpolation reads neighbouring cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta import config
from trajecta.operators.scale import chunk_table, lookup, plain, positions, split_hot
from trajecta.session import cut_lineage


@dataclass
class RunStats:
    """Per-batch time span, size and variable means, counted once."""

    table: DataFrame
    rows: int
    heaviest: int
    flat: int

    def attach(self, readings: DataFrame, how: str = "inner") -> DataFrame:
        return lookup(readings, self.table, ["batch_id"], how, self.rows, self.heaviest)


def run_stats(readings: DataFrame, variables: Sequence[str] = ()) -> RunStats:
    """One aggregation pass over the readings, kept for the passes after it."""
    t = F.col("time_index")
    table = cut_lineage(readings.where(t.isNotNull()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(t).alias("_t0"),
        F.max(t).alias("_t1"),
        *[F.avg(F.col(f"`{v}`")).alias(f"_avg_{i}") for i, v in enumerate(variables)],
    ), "run-stats")  # one row per run
    rows, heaviest, flat = table.agg(
        F.count(F.lit(1)), F.max("_rows"),
        F.count(F.when((F.col("_t0") == F.col("_t1")) & (F.col("_rows") > 1), 1)),
    ).first()
    return RunStats(table, rows, heaviest or 0, flat)


def _tie_order(variables: Sequence[str]) -> list[Column]:
    """A fixed order for samples that share one instant."""
    return [F.xxhash64(*[F.col(f"`{v}`") for v in variables]), *[F.col(f"`{v}`") for v in variables]]


def normalise_time(
    readings: DataFrame, variables: Sequence[str], stats: RunStats | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add ``progress`` in [0, 1]; a run at one instant is spaced by position.

    ``tie`` names a column that orders samples of one instant (row index);
    without it a hash of the values fixes the order.
    """
    stats = stats or run_stats(readings, variables)
    span = F.col("_t1") - F.col("_t0")
    out = stats.attach(readings.where(F.col("time_index").isNotNull()))
    moving = F.when(span > 0, (F.col("time_index") - F.col("_t0")) / span)
    if stats.flat == 0:
        return out.withColumn("progress", moving.otherwise(F.lit(0.0)))
    flat = out.where((span == 0) & (F.col("_rows") > 1))
    order = [F.col(f"`{tie}`")] if tie else _tie_order(variables)
    placed, _ = positions(flat, ["batch_id"], order, order[0], "_pos", tie=None if tie else order[0])
    placed = plain(placed).withColumn(
        "progress", F.col("_pos") / (F.col("_rows") - 1).cast("double")
    ).drop("_pos")
    rest = out.where((span > 0) | (F.col("_rows") == 1)).withColumn(
        "progress", moving.otherwise(F.lit(0.0))
    )
    return rest.unionByName(placed)


def untimed(readings: DataFrame) -> DataFrame:
    """``(batch_id, n_untimed, n_readings)`` of the runs with readings that have no time."""
    return readings.groupBy("batch_id").agg(
        F.count(F.when(F.col("time_index").isNull(), 1)).alias("n_untimed"), F.count(F.lit(1)).alias("n_readings"),
    ).where("n_untimed > 0")


def edge_cells(rows: DataFrame, n: int) -> DataFrame:
    """``(batch_id, _cell, _ua, _ub, _a*, _b*)`` of rows ``(batch_id, _u, _cell, _v*)``: first and
    last sample of every cell; of one instant the smallest value is the first, the largest the last.

    Arrow batches keep only the ends of their cells, and these go by run in one shuffle, which
    serves the cells and their neighbours; no task sorts its readings.
    """
    double = [f"_v{i}" for i in range(n)]
    ends = ["_ua", "_ub", *[f"_{e}{i}" for e in "ab" for i in range(n)]]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("batch_id").dictionary_encode()
            code = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cell = batch.column("_cell").to_numpy(zero_copy_only=False).astype(np.int64)
            u = batch.column("_u").to_numpy(zero_copy_only=False)
            key = code << 32 | cell
            at = np.lexsort((u, key))
            same = key[at[1:]] == key[at[:-1]]
            first = np.flatnonzero(np.append(True, ~same))
            last = np.append(first[1:], len(key)) - 1
            # one order serves all variables unless samples share an instant: there the values decide
            apart = (u[at[1:]] > u[at[:-1]])[same].all()
            found = []
            for name in double:
                v = batch.column(name).to_numpy(zero_copy_only=False)
                by = at if apart else np.lexsort((v, u, key))
                found.append((v[by[first]], v[by[last]]))
            yield pa.RecordBatch.from_arrays([
                batch.column("batch_id").take(pa.array(at[first])), pa.array(cell[at[first]].astype(np.int32)),
                pa.array(u[at[first]]), pa.array(u[at[last]]),
                *[pa.array(f[0]) for f in found], *[pa.array(f[1]) for f in found],
            ], names=["batch_id", "_cell", *ends])

    typed = rows.select("batch_id", "_u", "_cell", *[F.col(c).cast("double") for c in double])
    parts = typed.mapInArrow(thin, ", ".join(
        [f"batch_id {rows.schema['batch_id'].dataType.simpleString()}", "_cell int", *[f"{c} double" for c in ends]]))
    w = [F.min(F.struct("_ua", f"_a{i}")).alias(f"_f{i}") for i in range(n)]
    w += [F.max(F.struct("_ub", f"_b{i}")).alias(f"_l{i}") for i in range(n)]
    return parts.repartition("batch_id").groupBy("batch_id", "_cell").agg(*w).select(
        "batch_id", "_cell", "_f0._ua", "_l0._ub",
        *[F.col(f"_f{i}._a{i}") for i in range(n)], *[F.col(f"_l{i}._b{i}") for i in range(n)])


def _end_samples(code: np.ndarray, u: np.ndarray, values: list[np.ndarray]):
    """Codes, ``u`` and values of the first and last sample of every (code, cell), in order; as in
    :func:`edge_cells`, of one instant the smallest value is the first, the largest the last.

    Samples that come from here may go in again with others.
    """
    key = code << 32 | np.floor(u).astype(np.int64)
    at = np.lexsort((u, key))
    same = key[at[1:]] == key[at[:-1]]
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(key)) - 1
    apart = (u[at[1:]] > u[at[:-1]])[same].all()
    ends = [np.column_stack([u[at[first]], u[at[last]]])]
    for v in values:
        by = at if apart else np.lexsort((v, u, key))
        ends.append(np.column_stack([v[by[first]], v[by[last]]]))
    kept = np.column_stack([np.full(len(first), True), np.any([e[:, 0] != e[:, 1] for e in ends], axis=0)]).ravel()
    return np.repeat(code[at[first]], 2)[kept], *[e.ravel()[kept] for e in ends]


@dataclass
class AlignedRuns:
    """Aligned runs that are not written out: one row ``(batch_id, u, v0, v1, ...)`` per run, arrays
    with the first and last sample of every cell, which the whole run follows from."""

    table: DataFrame
    variables: list[str]
    points: int

    def matrix(self) -> Callable[[pd.DataFrame], np.ndarray]:
        """Rows of the table as unfolded runs, variable by variable then step by step."""
        names, grid = [f"v{i}" for i in range(len(self.variables))], np.arange(self.points, dtype=float)

        def unfolded(part: pd.DataFrame) -> np.ndarray:
            out = np.empty((len(part), len(names) * len(grid)))
            for i, (u, *values) in enumerate(zip(*(part[c].to_numpy() for c in ("u", *names)))):
                run = out[i].reshape(len(names), -1)
                if u[-1] < 1:  # one cell
                    run[:] = [[v[0]] for v in values]
                    continue
                to = np.bincount(u.astype(np.int64) + 1, minlength=len(grid))[:len(grid)].cumsum()[1:]  # samples below
                of = to - 1
                low = u.take(of)
                share = (grid[1:] - low) / (u.take(to) - low)
                for cells, v in zip(run, values):
                    cells[0], between, low = v[0], cells[1:], v.take(of)
                    np.subtract(v.take(to), low, out=between)
                    between *= share
                    between += low
            return out

        return unfolded


def _end_rows(rows: DataFrame, n: int) -> DataFrame:
    """One row per run of the samples :class:`AlignedRuns` keeps, of rows ``(batch_id, _u, _v*)``.

    Arrow batches drop the rest before the one shuffle, by run; behind it runs lie whole.
    """
    columns = ["_u", *[f"_v{i}" for i in range(n)]]
    kind = rows.schema["batch_id"].dataType.simpleString()

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                runs = batch.column("batch_id").dictionary_encode()
                u, *values = arrays(batch)
                code, *found = _end_samples(
                    runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), u, values)
                yield pa.RecordBatch.from_arrays(
                    [runs.dictionary.take(pa.array(code)), *map(pa.array, found)], names=["batch_id", *columns])

    def gathered(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        code, *found = found
        ends = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(code[ends[:-1]])), *[pa.ListArray.from_arrays(pa.array(ends), pa.array(f)) for f in found]],
            names=["batch_id", "u", *[f"v{i}" for i in range(n)]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # samples of the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch.select(rest.schema.names).cast(rest.schema)]).combine_chunks().to_batches()[0]
            runs = batch.column("batch_id").dictionary_encode()  # in order: runs are sorted
            u, *values = arrays(batch)
            found = _end_samples(runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), u, values)
            done = int(found[0].searchsorted(len(runs.dictionary) - 1))
            if done:
                yield gathered(runs.dictionary, [f[:done] for f in found])
            rest = pa.RecordBatch.from_arrays(
                [runs.dictionary.take(pa.array(found[0][done:])), *[pa.array(f[done:]) for f in found[1:]]],
                names=["batch_id", *columns])
        if rest is not None:
            yield gathered(rest.column("batch_id"), [np.zeros(rest.num_rows, np.int64), *arrays(rest)])

    typed = rows.select("batch_id", *[F.col(c).cast("double") for c in columns])
    parts = typed.mapInArrow(thin, ", ".join([f"batch_id {kind}", *[f"{c} double" for c in columns]]))
    return parts.repartition("batch_id").sortWithinPartitions("batch_id").mapInArrow(gather, ", ".join(
        [f"batch_id {kind}", "u array<double>", *[f"v{i} array<double>" for i in range(n)]]))


def align(
    readings: DataFrame, variables: Sequence[str], points: int = config.GRID_POINTS,
    tie: str | None = None, whole: bool = False,
) -> DataFrame | AlignedRuns:
    """``(batch_id, variable, step, time_norm, value)`` on an even grid.

    Linear interpolation; gaps are first filled with the run's own mean of
    the variable, and a variable the run lacks altogether is zero.  Of samples
    that share an instant the first and the last one count, in the order of
    ``tie`` or else of their values.  Readings without a time take no part;
    :func:`untimed` counts them.

    ``whole`` gives :class:`AlignedRuns`, for wide grids: their cells would be many times the readings.
    """
    if whole and tie:
        raise ValueError("whole runs order the samples of one instant by value")
    variables = list(variables)
    top = points - 1
    timed = normalise_time(readings, variables, run_stats(readings, variables), tie)
    u = F.col("progress") * F.lit(float(top))
    filled = [
        F.coalesce(F.col(f"`{v}`"), F.col(f"_avg_{i}"), F.lit(0.0)).alias(f"_v{i}")
        for i, v in enumerate(variables)
    ]
    n = range(len(variables))
    # samples of one instant: by the given column, else by value, whatever order they come in
    order = [F.col(f"`{tie}`").alias("_tie")] if tie else []
    rows = timed.select("batch_id", u.alias("_u"), F.floor(u).cast("int").alias("_cell"), *filled, *order)
    if tie:
        at = F.struct("_u", "_tie")
        cells = rows.groupBy("batch_id", "_cell").agg(
            F.min("_u").alias("_ua"),
            F.max("_u").alias("_ub"),
            *[F.min_by(f"_v{i}", at).alias(f"_a{i}") for i in n],
            *[F.max_by(f"_v{i}", at).alias(f"_b{i}") for i in n],
        )
    elif whole:
        return AlignedRuns(cut_lineage(_end_rows(rows, len(variables)), "aligned-samples"), variables, points)
    else:
        cells = edge_cells(rows, len(variables))
    # at most `points` cells per run from here on
    w = Window.partitionBy("batch_id").orderBy("_cell")
    ahead = cells.select(
        "*",
        F.lead("_cell").over(w).alias("_to"),
        F.lead("_ua").over(w).alias("_uc"),
        *[F.lead(f"_a{i}").over(w).alias(f"_c{i}") for i in n],
    )
    first = F.col("_cell") == 0
    alone = first & F.col("_to").isNull()
    begin = F.when(first, F.lit(0)).otherwise(F.col("_cell") + 1)
    end = F.when(alone, F.lit(top)).otherwise(F.col("_to"))
    steps = ahead.where(F.col("_to").isNotNull() | first).withColumn(
        "step", F.explode(F.sequence(begin, end))
    )
    share = (F.col("step") - F.col("_ub")) / (F.col("_uc") - F.col("_ub"))
    values = [
        F.when((F.col("step") == 0) | F.col("_to").isNull(), F.col(f"_a{i}"))
        .otherwise(F.col(f"_b{i}") + (F.col(f"_c{i}") - F.col(f"_b{i}")) * share)
        .alias(v)
        for i, v in enumerate(variables)
    ]
    norm = (F.col("step") / F.lit(float(top))).alias("time_norm")
    wide = steps.select("batch_id", "step", norm, *values)
    return wide.unpivot(["batch_id", "step", "time_norm"], variables, "variable", "value").select(
        "batch_id", "variable", "step", "time_norm", "value"
    )


def resample(
    samples: DataFrame, curve: DataFrame, columns: Sequence[str],
    points: int = config.GRID_POINTS, x: str = "x",
) -> DataFrame:
    """Read grid curves at arbitrary ``x`` in [0, 1], clamped at the ends.

    The range lookup becomes an equi-join on the grid cell; ``curve`` holds
    one row per variable and step, so it is always small.
    """
    top = points - 1
    u = F.least(F.greatest(F.col(x) * top, F.lit(0.0)), F.lit(float(top)))
    cell = F.least(F.floor(u), F.lit(top - 1)).cast("int")
    w = Window.partitionBy("variable").orderBy("step")
    pairs = curve.select(
        "variable", F.col("step").alias("_cell"),
        *[F.col(c).alias(f"_l_{c}") for c in columns],
        *[F.lead(c).over(w).alias(f"_r_{c}") for c in columns],
    )
    out = samples.withColumns({"_u": u, "_cell": cell}).join(
        pairs, ["variable", "_cell"]
    )
    share = F.col("_u") - F.col("_cell")
    read = {c: F.col(f"_l_{c}") + (F.col(f"_r_{c}") - F.col(f"_l_{c}")) * share for c in columns}
    drop = ["_u", "_cell", *[f"_l_{c}" for c in columns], *[f"_r_{c}" for c in columns]]
    return out.withColumns(read).drop(*drop)


def outside_band(samples: DataFrame, profile: DataFrame, points: int = config.GRID_POINTS) -> DataFrame:
    """Per trajectory and variable: points outside the band, count and percent."""
    banded = resample(samples, profile, ["lower", "upper"], points)
    out = (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    return banded.groupBy("batch_id", "variable").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count(F.when(out, 1)).alias("n_outside"),
    ).withColumn("pct_outside", F.lit(100.0) * F.col("n_outside") / F.col("n_points"))


def variable_order(df: DataFrame, variables: Sequence[str]) -> Column:
    """Ordinal of ``variable`` in the caller's list."""
    pairs = [F.lit(x) for i, v in enumerate(variables) for x in (v, i)]
    return F.create_map(*pairs)[F.col("variable")]


def unfold(
    aligned: DataFrame, variables: Sequence[str], value: str = "value", name: str = "x"
) -> DataFrame:
    """One array per batch, variable by variable then step by step."""
    wanted = aligned.where(F.col("variable").isin(list(variables)))
    cell = F.struct(
        variable_order(wanted, variables).alias("k"), F.col("step"), F.col(value).alias("v")
    )
    # variables x points cells per batch
    return wanted.groupBy("batch_id").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias(name)
    )


def unfolded_names(variables: Sequence[str], points: int = config.GRID_POINTS) -> list[str]:
    return [f"{v}_t{s + 1:03d}" for v in variables for s in range(points)]


def unfolded_cells(aligned: DataFrame) -> DataFrame:
    """The unfolded matrix in long form, with its column names."""
    return aligned.withColumn(
        "column", F.format_string("%s_t%03d", F.col("variable"), F.col("step") + 1)
    )


def impute_future(aligned: DataFrame, model_terms: DataFrame, current: int) -> DataFrame:
    """A run known up to step ``current``: later cells take the training mean."""
    terms = model_terms.select("variable", "step", "mu")
    seen = F.when(F.col("step") < current, F.col("value")).otherwise(F.col("mu"))
    return aligned.join(terms, ["variable", "step"]).select(
        "batch_id", "variable", "step", seen.alias("value")
    )


def with_phases(df: DataFrame) -> DataFrame:
    """Rows repeated for every inclusive phase mask that holds them."""
    t = F.col("time_norm")
    masks = F.array(*[
        F.when((t >= lo) & (t <= hi), F.lit(name)) for name, lo, hi in config.PHASES
    ])
    return df.withColumn("phase", F.explode(F.array_compact(masks)))


def index_phase(points: int = config.GRID_POINTS) -> Column:
    """Phase by index thirds of the grid."""
    names = [name for name, _, _ in config.PHASES]
    return (
        F.when(F.col("step") < points // 3, names[0])
        .when(F.col("step") < 2 * points // 3, names[1])
        .otherwise(names[2])
    )


def phase_summary(aligned: DataFrame) -> DataFrame:
    """Mean, population std, max and unit-spaced trapezoid area per phase."""
    v = F.col("value")
    ends = F.min_by("value", "step") + F.max_by("value", "step")
    return with_phases(aligned).groupBy("batch_id", "phase", "variable").agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.max(v).alias("max"),
        (F.sum(v) - ends / 2).alias("auc"),
    )


def trapezoid_pairs(readings: DataFrame, x: Column, columns: Sequence[str]) -> DataFrame:
    """Per batch, the trapezoid area of each column over ``x``.

    Oversized runs are summed chunk by chunk; the strips between neighbouring
    chunks come from the chunk ends.
    """
    n = range(len(columns))
    rows = readings.select("batch_id", x.alias("_x"), *[
        F.col(f"`{c}`").alias(f"_y{i}") for i, c in enumerate(columns)
    ])
    tie = F.xxhash64(*[F.col(f"_y{i}") for i in n])
    rows, cell = split_hot(rows, ["batch_id"], F.col("_x"), tie)
    order = [F.col("_x"), tie]
    w = Window.partitionBy(*cell).orderBy(*order)

    def strips(df: DataFrame) -> list[Column]:
        width = F.col("_x") - F.col("_px")
        return [F.sum(width * (F.col(f"_y{i}") + F.col(f"_p{i}")) / 2).alias(f"_area{i}") for i in n]

    paired = rows.withColumn("_px", F.lag("_x").over(w)).withColumns(
        {f"_p{i}": F.lag(f"_y{i}").over(w) for i in n}
    )
    areas = paired.groupBy("batch_id").agg(*strips(paired))
    if cell != ["batch_id"]:
        ends = chunk_table(rows, cell, [
            F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
            *[F.min_by(f"_y{i}", F.struct(*order)).alias(f"_s{i}") for i in n],
            *[F.max_by(f"_y{i}", F.struct(*order)).alias(f"_e{i}") for i in n],
        ])
        across = Window.partitionBy("batch_id").orderBy("_chunk")
        joints = ends.select(
            "batch_id", F.col("_x0").alias("_x"), F.lag("_x1").over(across).alias("_px"),
            *[F.col(f"_s{i}").alias(f"_y{i}") for i in n],
            *[F.lag(f"_e{i}").over(across).alias(f"_p{i}") for i in n],
        )
        areas = areas.unionByName(joints.groupBy("batch_id").agg(*strips(joints)))
        areas = areas.groupBy("batch_id").agg(*[F.sum(f"_area{i}").alias(f"_area{i}") for i in n])
    return areas
