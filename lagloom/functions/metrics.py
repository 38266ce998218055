"""Forecast-accuracy aggregates.

Every function takes Columns and returns an aggregate Column, so any number of
metrics is computed in one pass.  Sign convention of the error: observed minus
predicted, except ``mpe`` which is predicted minus observed.  Undefined terms
(division by zero, logarithm of a non-positive number) are NULL and skipped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, col, ratio

ACCURACY = ("mape", "rmse", "msa", "mase")
WEIGHTED = ("rmse_weighted", "msa_weighted", "mape_weighted", "mase_weighted")


def abs_pct_error(obs: Column, pred: Column) -> Column:
    return F.abs(ratio(obs - pred, obs))


def abs_log_ratio(obs: Column, pred: Column) -> Column:
    return F.abs(F.ln(ratio(obs, pred)))


def sq_error(obs: Column, pred: Column) -> Column:
    return (obs - pred) * (obs - pred)


def mape(obs: Column, pred: Column) -> Column:
    return 100 * F.avg(abs_pct_error(obs, pred))


def rmse(obs: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(sq_error(obs, pred)))


def msa(obs: Column, pred: Column) -> Column:
    return 100 * (F.exp(F.avg(abs_log_ratio(obs, pred))) - 1)


def msa_median(obs: Column, pred: Column) -> Column:
    return 100 * (F.exp(F.median(abs_log_ratio(obs, pred))) - 1)


def mpe(obs: Column, pred: Column) -> Column:
    return F.avg(ratio(pred - obs, obs))


def mase(obs: Column, pred: Column, prev: Column) -> Column:
    return ratio(F.avg(F.abs(obs - pred)), F.avg(F.abs(obs - prev)))


def rmse_weighted(obs: Column, pred: Column) -> Column:
    return F.sqrt(ratio(F.sum(ratio(sq_error(obs, pred), obs)), F.count(obs - pred)))


def mape_weighted(obs: Column, pred: Column) -> Column:
    return 100 * F.avg(ratio(abs_pct_error(obs, pred), obs))


def mase_weighted(obs: Column, pred: Column, prev: Column) -> Column:
    """Scaled error with both means weighted by 1/observed."""

    def weighted_mean(x: Column) -> Column:
        return ratio(F.sum(ratio(x, obs)), F.sum(F.when(x.isNotNull(), ratio(F.lit(1.0), obs))))

    return ratio(weighted_mean(F.abs(obs - pred)), weighted_mean(F.abs(obs - prev)))


# Metrics that need only (observed, predicted); selectable by name.
BY_NAME = {"MAPE": mape, "RMSE": rmse, "MSA": msa, "MPE": mpe, "MSA_MEDIAN": msa_median}


def accuracy(
    df: DataFrame,
    by: str | Iterable[str],
    time: str = "t",
    obs: str = "abundance",
    pred: str = "predicted_abundance",
    weighted: bool = False,
) -> DataFrame:
    """MAPE, RMSE, MSA and MASE per group, over complete pairs only.

    Incomplete pairs are dropped before the previous observation is taken.  A
    group without any complete pair keeps its row, with NULL metrics.
    """
    by = as_list(by)
    complete = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    before = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    pairs = df.select(
        *by, time, F.when(complete, F.col(obs)).alias("_o"), F.when(complete, F.col(pred)).alias("_p")
    ).withColumn("_prev", F.last("_o", ignorenulls=True).over(before))
    o, p, prev = F.col("_o"), F.col("_p"), F.col("_prev")
    aggs = [
        mape(o, p).alias("mape"),
        rmse(o, p).alias("rmse"),
        msa(o, p).alias("msa"),
        mase(o, p, prev).alias("mase"),
    ]
    if weighted:
        aggs += [
            rmse_weighted(o, p).alias("rmse_weighted"),
            msa(o, p).alias("msa_weighted"),
            mape_weighted(o, p).alias("mape_weighted"),
            mase_weighted(o, p, prev).alias("mase_weighted"),
        ]
    return pairs.groupBy(*by).agg(*aggs)


def skill(
    df: DataFrame,
    by: str | Iterable[str],
    time: str = "t",
    obs: str = "abundance",
    pred: str = "predicted_abundance",
) -> DataFrame:
    """Accuracy per group where the previous observation is the previous *row's*.

    Unlike :func:`accuracy`, the lag is taken before incomplete pairs are
    dropped, and groups without a complete pair disappear.
    """
    by = as_list(by)
    order = Window.partitionBy(*by).orderBy(time)
    o, p, prev = F.col(obs), F.col(pred), F.col("_prev")
    return (
        df.select(*by, time, obs, pred, F.lag(obs).over(order).alias("_prev"))
        .filter(o.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            mape(o, p).alias("mape"),
            rmse(o, p).alias("rmse"),
            msa(o, p).alias("msa"),
            mase(o, p, prev).alias("mase"),
        )
    )


def skill_beside_best(
    df: DataFrame,
    by: str | Iterable[str],
    best: Column,
    also: Iterable[Column] = (),
    time: str = "t",
    obs: str = "abundance",
    pred: str = "predicted_abundance",
) -> DataFrame:
    """:func:`accuracy` of the groups where ``best`` holds and :func:`skill` of the others, in one pass, with more aggregates of all their rows."""
    by = as_list(by)
    order = Window.partitionBy(*by).orderBy(time)
    complete = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    known = F.when(complete, F.col(obs))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    prev = F.when(best, before).otherwise(F.lag(obs).over(order))
    pairs = df.select("*", known.alias("_o"), F.when(complete, F.col(pred)).alias("_p"), prev.alias("_prev"))
    o, p, prev = F.col("_o"), F.col("_p"), F.col("_prev")
    scored = pairs.groupBy(*by).agg(
        mape(o, p).alias("mape"),
        rmse(o, p).alias("rmse"),
        msa(o, p).alias("msa"),
        mase(o, p, prev).alias("mase"),
        F.count(o).alias("_pairs"),
        *also,
    )
    return scored.filter(best | (F.col("_pairs") > 0)).drop("_pairs")


def with_errors(
    df: DataFrame,
    obs: str | Column = "abundance",
    pred: str | Column = "predicted_abundance",
    sign: str = "pred-obs",
) -> DataFrame:
    """Per-row error, absolute and signed relative error, percent text, log10 ratio."""
    o, p = col(obs), col(pred)
    error = p - o if sign == "pred-obs" else o - p
    relative = ratio(error, o)
    return df.withColumns(
        {
            "error": error,
            "ape": F.abs(relative),
            "pct_error": relative,
            "pct_text": F.when(relative.isNotNull(), F.format_string("%.1f%%", 100 * relative)),
            "log10_ratio": F.log10(ratio(p, o)),
        }
    )
