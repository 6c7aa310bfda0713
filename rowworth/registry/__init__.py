"""Named queries over the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowworth.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a `(spark, folder) -> DataFrame` function under an operator's name."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from rowworth.registry import (  # noqa: F401
        apps,
        features,
        filters,
        joins,
        metrics,
        models,
        ordering,
        sources,
        valuation,
    )
