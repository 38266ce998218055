"""Rolling-origin backtests: origins, tasks, splits and assembled forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.operators.fit_linear import fit_linear


def origins(
    df: DataFrame,
    last: int,
    covariates: Sequence[str] = (),
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """``last`` origins per series; the final one precedes the series' last row."""
    keys = as_list(keys)
    end = drop_incomplete(df, list(covariates)).groupBy(*keys).agg(F.max(time).alias("_max"))
    return end.select(
        *keys, F.explode(F.sequence(F.col("_max") - last, F.col("_max") - 1)).alias("origin")
    ).withColumn("target", F.col("origin") + 1)


def tasks(origin_rows: DataFrame, candidates: Candidates) -> DataFrame:
    """Every origin with every candidate."""
    return candidates.pair(origin_rows)


def split(
    df: DataFrame,
    origin_rows: DataFrame,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    first_period: int = 1,
) -> DataFrame:
    """Rows up to each target, flagged 1 where they are to be forecast.

    This materialises the training sets and is meant for inspection; the fitters
    use expanding sums instead and never build it.
    """
    keys = as_list(keys)
    later = F.col(time) > F.col("origin")
    in_season = F.col("period") >= first_period if "period" in df.columns else F.lit(True)
    return (
        df.join(origin_rows, keys)
        .filter(F.col(time) <= F.col("target"))
        .withColumn("train_test", F.when(later & in_season, 1).otherwise(0))
    )


def design(df: DataFrame, covariates: Sequence[str], positions: str | Column = "positions") -> DataFrame:
    """The covariate vector of a row restricted to a model's positions."""
    row = F.array(*[F.col(c).cast("double") for c in covariates])
    return df.withColumn("design", F.transform(positions, lambda p: F.get(row, p)))


def backtest(
    df: DataFrame,
    candidates: Candidates,
    last: int,
    fitter: Callable[..., DataFrame] = fit_linear,
    **options,
) -> DataFrame:
    """Forecasts of every (series, origin, model); failures keep a row with ``error``."""
    return fitter(df, candidates, last, **options)


def succeeded(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter(F.col("error").isNull()).drop("error")


def failed(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter(F.col("error").isNotNull())


def order_text(order: str | Column = "order") -> Column:
    """The order digits pasted together; ambiguous for values of ten or more."""
    return F.array_join(F.transform(order, lambda v: v.cast("string")), "")


def with_model(forecasts: DataFrame) -> DataFrame:
    """The fitted model as one struct, with its equation as text."""
    terms = F.transform(
        F.map_entries("coef"), lambda e: F.format_string("%.4f %s", e["value"], e["key"])
    )
    return forecasts.withColumns(
        {
            "mod": F.struct("order", "coef", "sigma2", "aicc"),
            "eq": F.concat(F.lit("log(abundance) = "), F.array_join(terms, " + ")),
        }
    )


def fitted_values(
    df: DataFrame,
    forecasts: DataFrame,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str | None = None,
) -> DataFrame:
    """In-sample values of linear fits: each fit applied to its training rows.

    With ``value``, the response, the lags of ``fit_ar`` are taken from it; a row
    without the lags of its fit has no value.  Fits with other terms that are no column of ``df``
    (moving average, drift) have none anywhere: the query fails rather than return NULL.
    """
    keys = as_list(keys)
    if value is not None:
        terms = forecasts.select(F.explode(F.map_keys("coef")).alias("term")).filter("term LIKE '\\\\_lag\\\\_log%'").distinct().collect()
        ordered = Window.partitionBy(*keys).orderBy(time)
        lags = {row.term: F.lag(F.ln(value), int(row.term[len("_lag_log") :] or 1)).over(ordered) for row in terms}
        df = df.withColumns(lags).drop(value)
    known = F.array(F.lit("intercept"), *[F.lit(c) for c in df.columns])
    stray = F.filter(F.map_keys("coef"), lambda c: ~F.array_contains(known, c))
    message = F.concat(F.lit("no fitted values for fits with "), F.array_join(stray, ", "))
    forecasts = forecasts.withColumn("coef", F.when(F.size(stray) > 0, F.raise_error(message).cast("map<string,double>")).otherwise(F.col("coef")))
    fits = forecasts.filter(F.col("error").isNull()).select(
        *keys, F.col(time).alias("target"), "model", "coef"
    )
    covariates = [c for c in df.columns if c not in (*keys, time)]
    values = F.create_map(
        F.lit("intercept"),
        F.lit(1.0),
        *[v for c in covariates if dict(df.dtypes)[c] in ("double", "int", "bigint") for v in (F.lit(c), F.col(c).cast("double"))],
    )
    rows = df.select(*keys, time, values.alias("_values"))
    joined = rows.join(fits, keys).filter(F.col(time) < F.col("target"))
    mu = F.aggregate(
        F.map_entries("coef"),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.try_element_at("_values", e["key"]),
    )
    return joined.select(*keys, "target", "model", time, F.exp(mu).alias("fitted"))
