"""Query registry shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def present(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns in place (column order kept)."""
    return df.select(*[round_half_up(c, digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


MONEY = 2
FINE = 6
