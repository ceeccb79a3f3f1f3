"""Collects queries and their SQL twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: Column | str, digits: int = 5) -> Column:
    return F.round(x, digits)


def exploded(df: DataFrame, keys: list[str], vector: Column, digits: int = 5) -> DataFrame:
    """(keys, d, x): a vector as rows, rounded for comparison."""
    return df.select(*keys, F.posexplode(vector).alias("d", "x")).select(*keys, "d", F.round(F.col("x").cast("double"), digits).alias("x"))


def sql_hash(key: str, seed: int) -> str:
    """The SQL of functions.text.hash_number."""
    return f"('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 13))::bigint"
