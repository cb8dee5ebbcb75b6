"""Query registry: every operator exposed as (spark, sf_dir) -> DataFrame,
optionally with an equivalent DuckDB SQL oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: Column | str, d: int = 6) -> Column:
    """Rounded double (query and oracle round the same way)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), d)


def sql_r6(expr: str, d: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {d})"
