"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


# Quotients of two-decimal values can lie exactly between two six-decimal numbers, where engines round either way.
# The same small shift in both takes them off the middle.
OFF_MIDDLE = "1.7e-9"


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(float(OFF_MIDDLE)), 6) + 0.0


def out(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *(r6(v).alias(v) for v in values))


def q6(expression: str, name: str) -> str:
    return f"round(cast({expression} as double) + {OFF_MIDDLE}, 6) + 0.0 AS {name}"
