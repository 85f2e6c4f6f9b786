"""The registry of queries, each with the SQL by which DuckDB gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.views import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{duck(*views)}{sql}" if views else sql
        return f

    return add


def near(c: Column | str, digits: int = 3) -> Column:
    """A measured double as both engines print it."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
