"""The registry of named queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``, with its oracle where SQL can say it."""

    def put(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


def _load() -> None:
    from palimpsest import plans  # noqa: F401  its modules register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
