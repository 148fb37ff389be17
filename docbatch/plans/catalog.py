"""All queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this folder that register queries.
AREAS = ("rules", "edits", "annotations", "telemetry", "intake", "fuzzy", "geometry", "text_functions", "streams")

_QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL over the same tables that gives the same rows, if SQL can."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _load() -> None:
    from importlib import import_module

    for area in AREAS:
        import_module(f"docbatch.plans.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
