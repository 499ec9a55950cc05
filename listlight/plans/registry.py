"""Queries by name, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Market under its name."""

    def add(f: Callable[[Market], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Market(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
