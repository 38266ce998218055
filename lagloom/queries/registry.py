"""Registered queries: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shown(df: DataFrame, keep, digits: dict) -> DataFrame:
    """``keep`` as it is and other columns rounded: ``{digits: columns}``."""
    return df.select(*keep, *[F.round(c, d).alias(c) for d, names in digits.items() for c in names])


def month_number(date: str) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")
