"""The registry of queries: name, builder and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        _BUILDERS[name] = builder
        if sql:
            _SQL[name] = sql
        return builder

    return add


def queries() -> dict[str, Builder]:
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
