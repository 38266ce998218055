"""Sub-annual operators: season windows, period labels and observed parts.

Month-days are integers ``100 * month + day``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.metrics import with_errors
from lagloom.functions.safe import as_list, ratio

BOUNDS = ("lo_50", "hi_50", "lo_95", "hi_95")
VALUES = ("predicted_abundance", *BOUNDS)


def month_day(date: str | Column = "date") -> Column:
    return F.month(date) * 100 + F.dayofmonth(date)


def between_dates(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def season_window(df: DataFrame, start_md: int, end_md: int, date: str = "date") -> DataFrame:
    """The same month-day range of every year, both ends included."""
    return df.filter(month_day(date).between(start_md, end_md))


def split_date(
    df: DataFrame,
    keys: str | Iterable[str],
    start_md: int,
    freshest: bool = True,
    date: str = "date",
) -> DataFrame:
    """One row per key: last observed month-day and the month-day period 2 starts.

    Period 2 starts the day after the last observation when fresh data is wanted
    and reaches the forecast start, else on the forecast start.
    """
    last = df.groupBy(*as_list(keys)).agg(F.max(date).alias("last_date"))
    reached = F.lit(freshest) & (F.col("last_md") >= start_md)
    return last.withColumn("last_md", month_day("last_date")).withColumn(
        "split_md",
        F.when(reached, month_day(F.date_add("last_date", 1))).otherwise(F.lit(start_md)),
    )


def label_period(df: DataFrame, splits: DataFrame, keys: str | Iterable[str], date: str = "date") -> DataFrame:
    """Attach ``last_md``, ``split_md`` and the period: 1 before the split, else 2."""
    keys = as_list(keys)
    joined = df.join(splits.select(*keys, "last_md", "split_md"), keys, "left")
    return joined.withColumn("period", F.when(month_day(date) < F.col("split_md"), 1).otherwise(2))


def trim_comparable(labelled: DataFrame, date: str = "date") -> DataFrame:
    """Without the days, in any year, between the last observed day and the split."""
    md = month_day(date)
    return labelled.filter((md <= F.col("last_md")) | (md >= F.col("split_md")))


def observed_in_target(
    labelled: DataFrame,
    keys: str | Iterable[str],
    start_md: int,
    date: str = "date",
    value: str = "abundance",
) -> DataFrame:
    """Per year, the already observed part of the forecast season."""
    return (
        labelled.filter((F.col("period") == 1) & (month_day(date) >= start_md))
        .groupBy(*as_list(keys), "year")
        .agg(F.sum(value).alias("obs_abundance"))
    )


def period_totals(
    labelled: DataFrame,
    keys: str | Iterable[str],
    covariates: Sequence[str] = (),
    value: str = "abundance",
) -> DataFrame:
    by = list(dict.fromkeys([*as_list(keys), "year", "species", "period", *covariates]))
    return labelled.groupBy(*by).agg(
        F.sum(value).alias(value)
    )


def contrast_covariates(
    df: DataFrame, columns: Sequence[str], keys: str | Iterable[str] | None = None
) -> DataFrame:
    """Covariates that act on period 1 only, coded as a contrast in period 2.

    Without ``keys`` period 2 takes minus its own value, with ``keys`` minus the
    period-1 value of the same key and year.
    """

    def contrast(c: str) -> Column:
        if keys is None:
            return -F.col(c)
        year = Window.partitionBy(*as_list(keys), "year")
        return -F.max(F.when(F.col("period") == 1, F.col(c))).over(year)

    return df.withColumns(
        {c: F.when(F.col("period") == 2, contrast(c)).otherwise(F.col(c)) for c in columns}
    )


def complete_periods(
    df: DataFrame,
    keys: str | Iterable[str],
    periods: Sequence[int] = (1, 2),
    value: str = "abundance",
) -> DataFrame:
    """Add the periods missing from each key's last year, response NULL.

    Other columns copy the key's last row.
    """
    keys = as_list(keys)
    carried = [c for c in df.columns if c not in (*keys, "period", value)]
    order = F.struct("year", "period")
    per_key = df.groupBy(*keys).agg(
        F.max_by(F.struct(*carried), order).alias("_row"),
        F.max("year").alias("_last"),
        *[
            F.max(F.when(F.col("period") == p, F.col("year"))).alias(f"_seen{p}")
            for p in periods
        ],
    )
    missing = F.filter(
        F.array(
            *[
                F.when(F.coalesce(F.col(f"_seen{p}") < F.col("_last"), F.lit(True)), F.lit(p))
                for p in periods
            ]
        ),
        lambda p: p.isNotNull(),
    )
    added = per_key.select(*keys, F.explode(missing).alias("period"), "_row.*").withColumn(
        value, F.lit(None).cast(df.schema[value].dataType)
    )
    return df.unionByName(added.select(*df.columns))


def add_observed(fc: DataFrame, observed: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """Season totals: the observed part added to observation, forecast and bounds.

    A year without an observed part gets NULLs; an empty ``observed`` leaves the
    values as they are with ``obs_abundance`` 0.
    """
    keys = as_list(keys)
    none = observed.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    joined = fc.join(observed.select(*keys, "year", "obs_abundance"), [*keys, "year"], "left")
    part = F.when(none, F.lit(0.0)).otherwise(F.col("obs_abundance"))
    return joined.withColumn("obs_abundance", part).withColumns(
        {c: F.col(c) + F.col("obs_abundance") for c in ("abundance", *VALUES)}
    )


def label_errors(fc: DataFrame) -> DataFrame:
    return with_errors(fc).drop("ape", "log10_ratio")


def stack_ensemble(fc: DataFrame, weights: DataFrame, keys: str | Iterable[str], time: str = "year") -> DataFrame:
    """Model rows plus one ``ensemble`` row per year and period, weights attached to all.

    ``weights`` has keys, ``model`` and ``stacking_weight``; a missing weight or
    value makes that ensemble value NULL.
    """
    keys = as_list(keys)
    weighted = fc.join(weights.select(*keys, "model", "stacking_weight"), [*keys, "model"], "left")

    def total(c: str) -> Column:
        term = F.col(c) * F.col("stacking_weight")
        return F.when(F.count(term) == F.count(F.lit(1)), F.sum(term)).alias(c)

    combined = (
        weighted.groupBy(*keys, time, *[c for c in ("period",) if c in fc.columns])
        .agg(
            *[total(c) for c in VALUES],
            F.max("abundance").alias("abundance"),
            F.max("obs_abundance").alias("obs_abundance"),
        )
        .withColumn("model", F.lit("ensemble"))
        .withColumn("error", F.col("predicted_abundance") - F.col("abundance"))
        .withColumn("pct_error", ratio("error", "abundance"))
    )
    return weighted.withColumn("model", F.col("model").cast("string")).unionByName(
        combined, allowMissingColumns=True
    )
