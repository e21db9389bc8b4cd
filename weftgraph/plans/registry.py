"""All queries of the graph engine by name, with the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: put a query under `name`, with its oracle SQL if it has one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = query
        if sql is not None:
            _ORACLE[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    """Registered queries."""
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    """Oracle SQL of the queries that have one."""
    return _ORACLE
