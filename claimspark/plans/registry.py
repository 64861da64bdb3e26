"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of (spark, sf_dir) under its function's name, with SQL of the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str] | tuple[str, ...], at: Column) -> Column:
    """The value at a number from 0 on."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def text(*parts: object) -> Column:
    """Texts and columns (as text) put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def listed(values: list[str] | tuple[str, ...]) -> str:
    """An SQL list of texts."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
