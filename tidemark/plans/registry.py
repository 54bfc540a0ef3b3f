"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.shared_sql import for_check

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` that of its name, if any, stays."""

    def add(f: Query) -> Query:
        FOUND[name] = f
        if sql:
            SQL[name] = for_check(sql)
        return f

    return add
