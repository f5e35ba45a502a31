"""Registry of the driver's queries and the SQL text shared by their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ENTRIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str | Callable[[], str]] = {}

# Named pieces of the twins.  ``twin`` puts the ones a query needs in front.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
MATERIALISED: set[str] = set()  # pieces read more than once that the other engine shall make once


def entry(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query and, when SQL can express it, its twin."""

    def add(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


def cte(name: str, needs: tuple[str, ...], body: str, once: bool = False) -> None:
    CTES[name] = (needs, body)
    if once:
        MATERIALISED.add(name)


def twin(select: str, *needs: str, recursive: bool = False) -> Callable[[], str]:
    """``WITH`` the needed pieces, in dependency order, then ``select``."""

    def build() -> str:
        ordered: list[str] = []

        def visit(name: str) -> None:
            if name in ordered:
                return
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

        for name in needs:
            visit(name)
        parts = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in MATERIALISED)}({CTES[n][1]})" for n in ordered)
        head = "WITH RECURSIVE " if recursive else "WITH "
        return (head + parts + "\n" if parts else "") + select

    return build


def twins() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for name, sql in TWINS.items()}
