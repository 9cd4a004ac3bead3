"""All queries of the reference's operators with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is there already")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def registered_sql(name: str) -> str:
    """The SQL of a query that is registered already, for queries that build on it."""
    return _SQL[name]


def _load() -> None:
    from textloom.plans import modules  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
