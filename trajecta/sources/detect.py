"""Column-role detection for the supported layouts.

Only the schema is read on the driver; the one data-dependent rule (a batch
column has few distinct values) is a single aggregation over all candidates.
Several matching names are settled by the order of the candidate lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Recognised column names, in order of preference.
BATCH_NAMES = ("batch_id", "batch", "batchid", "batch_name", "lot", "lot_id", "run", "run_id")
TIME_NAMES = (
    "time_index", "time", "timestamp", "step", "t", "time_step", "timestep", "elapsed", "index",
)
YIELD_NAMES = (
    "yield", "yield_pct", "yield_%", "product_yield", "batch_yield", "output_yield",
)

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Roles:
    """What each column of an input table is for."""

    batch_col: str | None = None
    time_col: str | None = None
    yield_col: str | None = None
    cpp_cols: list[str] = field(default_factory=list)
    batch_cols: list[str] = field(default_factory=list)
    n_timepoints: int | None = None
    warnings: list[str] = field(default_factory=list)


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _by_name(df: DataFrame, names: tuple[str, ...]) -> str | None:
    known = {c.strip().lower(): c for c in df.columns}
    return next((known[n] for n in names if n in known), None)


def _yield_column(df: DataFrame, taken: set[str]) -> str | None:
    named = _by_name(df, YIELD_NAMES)
    if named is not None:
        return named
    return next((c for c in df.columns if "yield" in c.strip().lower() and c not in taken), None)


def _variables(df: DataFrame, roles: Roles) -> list[str]:
    taken = {roles.batch_col, roles.time_col, roles.yield_col}
    found = [c for c in df.columns if c not in taken and _numeric(df, c)]
    if not found:
        roles.warnings.append("No numeric process-parameter columns were detected.")
    return found


def _repeating_column(df: DataFrame) -> str | None:
    """First column with clearly fewer distinct values than rows."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)],
    ).first()
    limit = counts["_rows"] * 0.6
    return next((c for i, c in enumerate(df.columns) if counts[f"_{i}"] < limit), None)


def detect_long(df: DataFrame) -> Roles:
    """One row per step and batch."""
    roles = Roles(batch_col=_by_name(df, BATCH_NAMES))
    if roles.batch_col is None:
        roles.batch_col = _repeating_column(df)
    if roles.batch_col is None:
        roles.batch_col = df.columns[0]
        roles.warnings.append(f"No clear batch column; '{roles.batch_col}' is assumed.")
    rest = [c for c in df.columns if c != roles.batch_col]
    _pick_time(df, roles, rest)
    roles.yield_col = _yield_column(df, {roles.batch_col, roles.time_col})
    roles.cpp_cols = _variables(df, roles)
    return roles


def _pick_time(df: DataFrame, roles: Roles, rest: list[str]) -> None:
    roles.time_col = _by_name(df, TIME_NAMES) or next(
        (c for c in rest if isinstance(df.schema[c].dataType, _INTEGERS)), None
    )
    if roles.time_col is None and rest:
        roles.time_col = rest[0]
        roles.warnings.append(f"No clear time column; '{roles.time_col}' is assumed.")


def detect_wide(df: DataFrame) -> Roles:
    """One row per batch, no time column."""
    roles = Roles(batch_col=_by_name(df, BATCH_NAMES))
    if roles.batch_col is None:
        roles.batch_col = next((c for c in df.columns if not _numeric(df, c)), None)
    if roles.batch_col is None:
        roles.batch_col = df.columns[0]
        roles.warnings.append(f"No clear batch column; '{roles.batch_col}' is assumed.")
    roles.yield_col = _yield_column(df, {roles.batch_col})
    roles.cpp_cols = _variables(df, roles)
    return roles


def detect_pivot(df: DataFrame) -> Roles:
    """Rows are times, columns are batches; one file per parameter."""
    roles = Roles(time_col=next((c for c in df.columns if not _numeric(df, c)), None))
    if roles.time_col is None:
        roles.time_col = df.columns[0]
        roles.warnings.append(f"All columns are numeric; '{roles.time_col}' is taken as the time.")
    roles.batch_cols = [c for c in df.columns if c != roles.time_col]
    if not roles.batch_cols:
        roles.warnings.append("No batch columns besides the time column.")
    roles.n_timepoints = df.count()
    return roles


def detect_stacked(df: DataFrame) -> Roles:
    """Runs stacked on top of each other without a batch column."""
    roles = Roles()
    _pick_time(df, roles, list(df.columns))
    roles.cpp_cols = _variables(df, roles)
    return roles
