"""Incremental refresh: refit the latest origins and replace their forecasts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators.features import KEYS
from lagloom.sources.writers import cut_lineage


def upsert(
    old: DataFrame, new: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """``old`` with the rows of the same (series, time, period, model) replaced.

    Only the few refitted rows are compared, by an anti join, so the stored
    forecasts are neither sorted nor windowed.
    """
    on = [*as_list(keys), time, "model"]
    if "period" in old.columns and "period" in new.columns and "period" not in on:
        on.append("period")
    kept = old.join(new.select(*on), on, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def refresh(old: DataFrame, new: DataFrame, path: str, keys: str | Iterable[str] = KEYS, time: str = "t") -> None:
    """``upsert`` into the partitioned table at ``path``, reading and writing the touched times alone.

    The touched times are the refitted origins, a handful of numbers.
    """
    times = [row[0] for row in new.select(time).distinct().collect()]
    if not times:
        return
    merged = cut_lineage(upsert(old.filter(F.col(time).isin(times)), new, keys, time), "merged")
    write_refresh(merged, new, path, time)


def write_refresh(merged: DataFrame, new: DataFrame, path: str, time: str = "t") -> None:
    """Rewrite only the time partitions that the refit touched."""
    touched = merged.join(new.select(time).distinct(), time, "left_semi")
    (
        touched.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(time)
        .parquet(path)
    )
