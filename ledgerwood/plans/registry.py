"""The catalogue of queries: each has a name, a function (spark, sf_dir) and, if SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import every module of queries."""
    from . import analytics, documents, envelopes, indexes, knowledge, layouts, letters, machines, models, more_analytics, more_relations, passages, relations, scalars, search, services  # noqa: F401
