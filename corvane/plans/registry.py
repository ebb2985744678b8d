"""The registry of queries, and what their definitions share.

Each query takes (spark, sf_dir). Computed doubles are rounded in the query and in its SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def register(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def table(spark, sf, name):
    return tables.read(spark, sf, name)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """The table with its double columns rounded; negative zero is zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
