"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: registers a query and, where SQL can express it, its DuckDB text."""

    def put(function):
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return put


def _load() -> None:
    """Imports the modules that register queries."""
    for name in ("scoring", "events", "fields", "picks", "fits", "ridges", "etl", "distance", "rasters", "traces", "windows", "ordered"):
        import_module(f"terrastrat.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
