"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_number(col: Column) -> Column:
    """Unparsable text and NaN become NULL."""
    number = col.try_cast("double")
    return F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    number = col.cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(number)


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r as an aggregate; NULL on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def tier(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose cut the value reaches, highest cut first."""
    out = F
    for cut, label in cuts:
        out = out.when(value >= cut, label)
    return out.otherwise(otherwise)


def to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str],
    name: str = "variable", value: str = "value",
) -> DataFrame:
    """One row per key and column, NULL values kept."""
    return df.unpivot(list(keys), list(columns), name, value)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns, the output edge of a report."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def first_rows(ordered: DataFrame, first: int | None) -> DataFrame:
    """An ordered report: all of it, or its head if the caller asks for one."""
    return ordered if first is None else ordered.limit(first)
