"""The catalogue of registered queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named double columns (all columns keep their order)."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r(expr: str, name: str, digits: int = 4) -> str:
    """The same rounding as SQL text; adding 0 turns -0 into 0."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"
