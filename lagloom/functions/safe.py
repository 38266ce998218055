"""Arithmetic whose undefined cases are NULL, and small argument helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, NULL when ``b`` is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def present(c: str | Column) -> Column:
    """``c`` with NaN and infinite values read as missing."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))


def spread(df: DataFrame, *columns: str, partitions: int | None = None, times: int = 1) -> DataFrame:
    """Hash rows evenly over every core before a step whose cost is not its bytes.

    Before a step that makes ``times`` rows of each, over so many times more tasks.
    """
    spark = df.sparkSession
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition((partitions or width) * times, *columns)


def per_key(df: DataFrame, keys: Iterable[str], *aggs: Column) -> DataFrame:
    """Attach per-key aggregates to every row.

    The aggregate is pre-combined on the map side, so a key holding most of the
    rows costs one row per task in the shuffle; the join is left to the
    optimizer, which broadcasts small sides and splits skewed partitions.
    """
    keys = as_list(keys)
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")
