"""The catalogue: every query by name, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query to the catalogue; without ``sql`` only its rows are counted."""

    def add(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered twice")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return add


def _load() -> None:
    from . import monitoring  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: e.run for k, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in _ENTRIES.items() if e.sql}
