"""Queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(views: str | None = None, sql: str | None = None, recursive: bool = False):
    """Register a query by its function's name; ``sql`` may follow further CTEs after a leading comma."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(views or "", sql, recursive)
        return f

    return register
