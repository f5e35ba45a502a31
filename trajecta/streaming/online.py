"""Online alignment, monitoring and alarms.

Alignment of a live run needs its start and expected duration; both come from
a table of runs.  A reading then falls in a known grid cell.  Either a streaming
aggregation keeps the first and last sample of each cell (``cell_stream``: a late
reading just updates its cell), or, for streams that never end, the state of a run
holds only the cells that the watermark has not closed yet, and its steps come out
once (``aligned_stream``).

Monitoring follows the aligned steps of a run.  Its input is bounded by
variables x grid points per run, so what it holds of a run is small.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajecta import config


def cell_stream(
    readings: DataFrame, runs: DataFrame, points: int = config.GRID_POINTS,
    time: str = "time_index",
) -> DataFrame:
    """Cells ``(batch_id, variable, cell, first/last progress and value)`` of a
    stream of long readings; ``runs`` is ``(batch_id, start, duration)``."""
    u = (F.col(time) - F.col("start")) / F.col("duration") * (points - 1)
    placed = readings.where(F.col("value").isNotNull()).join(runs, "batch_id").withColumn("_u", u).where(
        (F.col("_u") >= 0) & (F.col("_u") <= points - 1))
    return placed.groupBy("batch_id", "variable", F.floor("_u").cast("int").alias("cell")).agg(
        F.min("_u").alias("ua"), F.min_by("value", F.struct("_u", "value")).alias("va"),
        F.max("_u").alias("ub"), F.max_by("value", F.struct("_u", "value")).alias("vb"),
    )


def outside_schedule(
    readings: DataFrame, runs: DataFrame, points: int = config.GRID_POINTS, time: str = "time_index"
) -> DataFrame:
    """Readings before the start or past the expected end (a side output)."""
    u = (F.col(time) - F.col("start")) / F.col("duration") * (points - 1)
    return readings.join(runs, "batch_id").where((u < 0) | (u > points - 1)).drop("start", "duration")


def steps_of_cells(cells: DataFrame, points: int = config.GRID_POINTS) -> DataFrame:
    """Grid steps of the closed segments between neighbouring cells."""
    w = Window.partitionBy("batch_id", "variable").orderBy("cell")
    ahead = cells.select(
        "*", F.lead("cell").over(w).alias("_to"), F.lead("ua").over(w).alias("_uc"),
        F.lead("va").over(w).alias("_vc"), F.row_number().over(w).alias("_k"),
    )
    start = F.when((F.col("_k") == 1) & (F.col("ua") == F.col("cell")), F.col("cell")).otherwise(F.col("cell") + 1)
    out = ahead.withColumn("_end", F.coalesce("_to", "cell")).where(start <= F.col("_end")).withColumn(
        "step", F.explode(F.sequence(start, F.col("_end"))))
    share = (F.col("step") - F.col("ub")) / (F.col("_uc") - F.col("ub"))
    value = F.when(F.col("step") == F.col("cell"), F.col("va")).otherwise(
        F.col("vb") + (F.col("_vc") - F.col("vb")) * share)
    return out.select(
        "batch_id", "variable", "step", (F.col("step") / float(points - 1)).alias("time_norm"),
        value.alias("value"))


# a share of the runs has one state, so that a micro-batch costs a call per share, not per run
HELD = "data binary, open long"
ALIGNED = "batch_id string, variable string, step int, time_norm double, value double"


def merged_cells(u: np.ndarray, value: np.ndarray, held: tuple) -> tuple:
    """First and last sample of every cell, of new samples and of cells held."""
    cell, ua, va, ub, vb = held
    cells = np.concatenate([cell, np.floor(u)]).astype(np.int64)
    out = [np.unique(cells)]
    for (pu, pv), last in (((ua, va), False), ((ub, vb), True)):
        us, vs = np.concatenate([pu, u]), np.concatenate([pv, value])
        order = np.lexsort((vs, us, cells))
        edge = np.searchsorted(cells[order], out[0], side="right") - 1 if last else np.searchsorted(cells[order], out[0])
        out += [us[order][edge], vs[order][edge]]
    return tuple(out)


def closed_steps(cells: tuple, first: bool, segments: int, ended: bool) -> tuple[np.ndarray, np.ndarray]:
    """Steps and values of the leading ``segments`` between neighbouring cells; of an ended
    run also the step of a single first sample that lies on the grid."""
    cell, ua, va, ub, vb = cells
    start = cell + 1
    if len(cell) and first and ua[0] == cell[0]:
        start[0] = cell[0]
    stop = np.append(cell[1:], cell[-1:])
    use = segments + int(ended)
    many = np.maximum(stop[:use] - start[:use] + 1, 0)
    at = np.repeat(np.arange(use), many)
    step = np.repeat(start[:use], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    ahead = np.minimum(at + 1, len(cell) - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = vb[at] + (va[ahead] - vb[at]) * ((step - ub[at]) / (ua[ahead] - ub[at]))
    return step, np.where(step == cell[at], va[at], between)


def aligned_stream(
    readings: DataFrame, runs: DataFrame, points: int = config.GRID_POINTS, time: str = "time_index",
    clock: str = "ts", delay: str = "2 hours", unit_ms: float = 1.0,
) -> DataFrame:
    """Grid steps ``(batch_id, variable, step, time_norm, value)`` of a stream of long readings,
    in append mode; ``runs`` is ``(batch_id, start, duration)`` in units of ``unit_ms``.

    A segment between two neighbouring samples' cells comes out when the watermark of
    ``clock`` has passed its later sample.  A run's state leaves with its last segment,
    by a timer at its expected end; what comes later than ``delay`` is dropped by Spark.
    """
    top = points - 1
    nothing = (np.zeros(0),) * 5
    pace = F.col("duration") * unit_ms / top  # milliseconds of a grid step
    u = (F.col(time) - F.col("start")) / F.col("duration") * top
    rows = readings.withWatermark(clock, delay).where(F.col("value").isNotNull()).join(runs, "batch_id").select(
        "batch_id", "variable", "value", clock, u.alias("u"), pace.alias("pace"),
        (F.unix_millis(clock) - u * pace).alias("anchor")).where((F.col("u") >= 0) & (F.col("u") <= top))

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = pickle.loads(state.get[0]) if state.exists else {}  # first, anchor, pace, cells held
        mark = state.getCurrentWatermarkMs()
        for name, at, new in split_runs(frames, ["batch_id", "variable"], ["u", "value", "anchor", "pace"]):
            first, anchor, pace, held = series.get(name) or (True, new["anchor"][at[0]], new["pace"][at[0]], nothing)
            series[name] = first, anchor, pace, merged_cells(new["u"][at], new["value"][at], held)
        left, ends, out = {}, [], []
        for name, (first, anchor, pace, held) in series.items():
            settled = (mark - anchor) / pace
            end = int(anchor + top * pace) + 1
            ended = settled > top or (state.hasTimedOut and end <= mark)
            later = held[1][1:]
            segments = len(later) if ended else int(np.argmin(np.append(later < settled, False)))
            step, value = closed_steps(held, first, segments, ended)
            if len(step):
                out.append((name, step, value))
            if not ended:
                left[name] = first and not segments, anchor, pace, tuple(x[segments:] for x in held)
                ends.append(end)
        if left:
            state.update((pickle.dumps(left), len(left)))
            state.setTimeoutTimestamp(max(min(ends), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            many = [len(step) for _, step, _ in out]
            step = np.concatenate([step for _, step, _ in out])
            yield pd.DataFrame({
                "batch_id": np.repeat(np.array([n[0] for n, *_ in out], object), many),
                "variable": np.repeat(np.array([n[1] for n, *_ in out], object), many),
                "step": step.astype(np.int32), "time_norm": step / float(top),
                "value": np.concatenate([value for *_, value in out])})

    return rows.withColumn("share", share_of_run()).groupBy("share").applyInPandasWithState(
        advance, ALIGNED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def share_of_run() -> Column:
    return F.pmod(F.xxhash64("batch_id"), F.lit(config.STREAM_BUCKETS))


def split_runs(
    frames: Iterator[pd.DataFrame], keys: Sequence[str], columns: Sequence[str]
) -> Iterator[tuple[tuple, np.ndarray, dict[str, np.ndarray]]]:
    """Per run (values of ``keys``) of the new rows: the run, the places of its rows in order of
    arrival, and the columns of all rows."""
    parts = list(frames)
    if not parts:
        return
    new = pd.concat(parts, ignore_index=True)
    if not len(new):
        return
    whole = {c: new[c].to_numpy() for c in columns}
    code, names = np.zeros(len(new), np.int64), [new[k].to_numpy(object) for k in keys]
    for name in names:
        part, found = pd.factorize(name, use_na_sentinel=False)  # NULL is a run, too
        code = code * len(found) + part
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    for at in np.split(order, edges):
        yield tuple(None if pd.isna(n[at[0]]) else n[at[0]] for n in names), at, whole


# ── monitoring ───────────────────────────────────────────────────────────────

OUTPUT = (
    "batch_id string, time_step int, t2 double, spe double, predicted_yield double, "
    "t2_breach_95 boolean, t2_breach_99 boolean, spe_breach_95 boolean, spe_breach_99 boolean, "
    "t2_sustained boolean, spe_sustained boolean, late boolean, repeated boolean, variable string, value double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
FLAGS = [c.split()[0] for c in OUTPUT.split(", ") if c.endswith("boolean")]
STEP_COLUMNS = COLUMNS[1:11]


def streaks(breach: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of breaches that ends at each step."""
    at = np.arange(1, len(breach) + 1)
    last_clear = np.maximum.accumulate(np.where(breach, -before, at))
    return np.where(breach, at - last_clear, 0)


def monitor_stream(
    aligned: DataFrame, terms: DataFrame, meta: DataFrame, variables: Sequence[str], components: int,
    points: int = config.GRID_POINTS, idle_ms: int | None = None, run: int = 3,
    clock: str | None = "ts", delay: str = "2 hours",
) -> DataFrame:
    """One row per completed step of every run: T², SPE, forecast, breaches and
    the run rule.  A reading for a closed step comes out ``late``, a second one
    of a variable in an open step ``repeated``, each with its variable and
    value; neither changes the result.

    A step is complete when every variable has arrived and the step before is
    closed, in whatever order readings come.  A finished run keeps only its
    closed mark.  Where the stream has the event time ``clock``, the mark leaves when
    the watermark (``delay`` behind) has passed the run's last reading, as later ones are
    dropped by Spark then, so state is bounded by the open runs.  Without event time
    give ``idle_ms`` on a continuous trigger, and state goes after that long without
    input (such a timer keeps an ``availableNow`` query from ending).

    Runs share a state by a hash of their id (``STREAM_BUCKETS`` of them), in which each keeps
    its closed step, running sums and alarm streaks, its open cells and their sums, the time
    of its last reading and, without event time, of its last input.
    """
    timed = clock is not None and clock in aligned.columns
    if timed:
        aligned = aligned.withWatermark(clock, delay)
    at = [clock, F.unix_millis(clock).alias("_at")] if timed else []
    names = list(variables)
    width, size = len(names), components + 2
    z = (F.col("value") - F.col("mu")) / F.col("sigma")
    known = terms.select("variable", "step", "mu", "sigma", "loadings", "coef")
    rows = aligned.where(F.col("variable").isin(names) & F.col("value").isNotNull()).join(
        known, ["variable", "step"]).select(
        "batch_id", "variable", "value", F.col("step").cast("int").alias("step"),
        (F.array_position(F.array(*map(F.lit, names)), F.col("variable")) - 1).cast("int").alias("slot"),
        z.alias("z"), "loadings", "coef", *at)
    sums = [f"_s{i}" for i in range(size)]
    parts = rows.select(
        "batch_id", "variable", "value", "step", "slot", *([clock, "_at"] if timed else []),
        (F.col("z") * F.col("z")).alias(sums[0]), (F.col("z") * F.col("coef")).alias(sums[1]),
        *[(F.col("loadings")[i] * F.col("z")).alias(sums[2 + i]) for i in range(components)])
    m = meta.first()  # one row
    eigen = np.array(m["eigenvalues"][:components])
    limits = (m["t2_95"], m["t2_99"], m["spe_95"], m["spe_99"])
    base = float(m["intercept"]) if "intercept" in m else 0.0
    fresh = (-1, np.zeros(size), [0, 0], np.zeros(0, np.int64), np.zeros((0, size)), 0, 0)

    def follow(held: tuple, cells: np.ndarray, arrived: np.ndarray) -> tuple:
        """A run with new cells: what it holds then, its completed steps, and the places of
        the late and the repeated ones."""
        closed, total, streak, cell, values, *times = held
        late = cells // width <= closed
        kept = np.flatnonzero(~late)
        cell = np.concatenate([cell, cells[kept]])
        values = np.concatenate([values, arrived[kept]])
        before = len(cell) - len(kept)
        cell, first = np.unique(cell, return_index=True)  # the first arrival of a cell counts
        again = kept[np.setdiff1d(np.arange(before, before + len(kept)), first) - before]
        values = values[first]
        # whole steps that follow the closed one
        counts = np.bincount(cell // width - closed - 1, minlength=1)
        ready = int(np.argmax(np.append(counts, 0) != width))
        done = None
        if ready:
            use = ready * width
            running = total + np.cumsum(values[:use].reshape(ready, width, size).sum(axis=1), axis=0)
            scores = running[:, 2:]
            t2 = (scores ** 2 / eigen).sum(axis=1)
            spe = running[:, 0] - (scores ** 2).sum(axis=1)
            breaches = t2 > limits[0], t2 > limits[1], spe > limits[2], spe > limits[3]
            lengths = [streaks(breach, b) for breach, b in zip((breaches[0], breaches[2]), streak)]
            done = (closed + 2 + np.arange(ready), t2, spe, base + running[:, 1], *breaches, *(n >= run for n in lengths))
            streak = [int(n[-1]) for n in lengths]
            total = running[-1]
            closed += ready
            cell, values = cell[use:], values[use:]
        return (closed, total, streak, cell, values, *times), done, np.flatnonzero(late), again

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = pickle.loads(state.get[0]) if state.exists else {}
        now = 0 if timed else state.getCurrentProcessingTimeMs()
        steps, asides = [], []
        columns = ["step", "slot", "variable", "value", *sums, *(["_at"] if timed else [])]
        for name, at, new in split_runs(frames, ["batch_id"], columns):
            held, done, late, again = follow(
                runs.get(name, fresh), new["step"][at].astype(np.int64) * width + new["slot"][at],
                np.column_stack([new[c][at] for c in sums]).astype(float))
            latest = max(held[5], int(new["_at"][at].max())) if timed else 0
            runs[name] = (*held[:5], latest, now)
            if done is not None:
                steps.append((name[0], *done))
            asides += [(name[0], new["step"][k] + 1, k in lost, new["variable"][k], new["value"][k])
                       for lost, group in [(set(at[late]), at[np.concatenate([late, again])])] for k in group]
        if timed:  # closed marks leave when the watermark has passed the last reading
            mark = state.getCurrentWatermarkMs()
            ends = {k: v[5] + 1 for k, v in runs.items() if v[0] == points - 1}
            runs = {k: v for k, v in runs.items() if ends.get(k, mark + 1) > mark}
            ends = [e for e in ends.values() if e > mark]
        elif idle_ms:
            runs = {k: v for k, v in runs.items() if v[6] + idle_ms > now}
        if runs:
            state.update((pickle.dumps(runs), len(runs)))
            if timed and ends:
                state.setTimeoutTimestamp(min(ends))
            elif idle_ms and not timed:
                state.setTimeoutDuration(max(1, min(v[6] for v in runs.values()) + idle_ms - now))
        elif state.exists:
            state.remove()
        if steps:
            many = [len(s[1]) for s in steps]
            yield pd.DataFrame({
                "batch_id": np.repeat(np.array([s[0] for s in steps], object), many),
                **{c: np.concatenate([s[i + 1] for s in steps]) for i, c in enumerate(STEP_COLUMNS)},
                "late": False, "repeated": False, "variable": None, "value": np.nan,
            }).astype({"time_step": "int32", "variable": "object"})[COLUMNS]
        if asides:
            rows = pd.DataFrame(asides, columns=["batch_id", "time_step", "late", "variable", "value"])
            rows["repeated"] = ~rows["late"]
            yield rows.reindex(columns=COLUMNS).astype({c: "boolean" for c in FLAGS} | {
                "batch_id": "object", "variable": "object", "time_step": "int32"} | {
                c: "float64" for c in ("t2", "spe", "predicted_yield", "value")})

    return parts.withColumn("share", share_of_run()).groupBy("share").applyInPandasWithState(
        advance, OUTPUT, HELD, "append",
        GroupStateTimeout.EventTimeTimeout if timed
        else GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
