"""Registered queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` must give the same rows and names."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Float sums depend on their order in the last bits, so compared values are rounded."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def round_columns(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})
