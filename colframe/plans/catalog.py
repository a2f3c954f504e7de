"""Registry of the relational, numeric and learning queries with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that adds a query and, if given, its DuckDB SQL."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    for name in ("relational", "numeric", "learning", "interchange"):
        importlib.import_module(f"colframe.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, null-safe join and grouped aggregates over lineitem and orders."""
    return queries()["flagship"](spark, sf_dir)
