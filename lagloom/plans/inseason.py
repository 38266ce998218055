"""In-season forecasting: daily counts to two season periods, backtest and stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators import season as se
from lagloom.operators import stacking as st
from lagloom.operators.backtest import failed, succeeded
from lagloom.operators.candidates import Candidates
from lagloom.operators.error_orders import fit_orders
from lagloom.operators.features import drop_incomplete
from lagloom.sources.writers import cut_lineage


@dataclass(frozen=True)
class SeasonData:
    series: DataFrame
    splits: DataFrame
    observed: DataFrame


def prepare_season(
    daily: DataFrame,
    start: str,
    end: str,
    start_md: int,
    end_md: int,
    forecast_md: int,
    keys: str | Iterable[str],
    freshest: bool = True,
    covariates: Sequence[str] = (),
    period1_only: Sequence[str] = (),
) -> SeasonData:
    """Period sums per key and year of daily rows (date, year, species, abundance).

    ``start``..``end`` bounds the dates; the season is ``start_md``..``end_md``
    of every year; ``forecast_md`` is where the forecast season begins.
    """
    keys = as_list(keys)
    season = se.season_window(se.between_dates(daily, start, end), start_md, end_md)
    splits = se.split_date(season, keys, forecast_md, freshest)
    labelled = se.trim_comparable(se.label_period(season, splits, keys))
    totals = se.period_totals(labelled, keys, covariates)
    if period1_only:
        totals = se.contrast_covariates(totals, period1_only)
    return SeasonData(totals, splits, se.observed_in_target(labelled, keys, forecast_md))


def stack_over_years(fc: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """One stack row per key from all its observed steps and all its models."""
    keys = as_list(keys)
    steps = fc.groupBy(*keys, "year", "period").agg(
        F.max("abundance").alias("obs"),
        F.sort_array(F.collect_list(F.struct("model", F.col("predicted_abundance").alias("pred")))).alias("m"),
    )
    complete = F.forall("m", lambda e: e["pred"].isNotNull())
    rows = steps.filter(F.col("obs").isNotNull() & complete)
    step = F.struct(
        "year",
        "period",
        "obs",
        F.transform("m", lambda e: e["pred"]).alias("preds"),
        F.transform("m", lambda e: e["model"]).alias("models"),
    )
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("s"))
    widest = F.array_max(F.transform("s", lambda e: F.size(e["models"])))
    full = F.filter("s", lambda e: F.size(e["models"]) == F.col("_widest"))
    return (
        grouped.withColumn("_widest", widest)
        .withColumn("s", full)
        .select(
            *keys,
            F.transform("s", lambda e: e["year"])[F.size("s") - 1].alias("target"),
            F.get("s", F.lit(0))["models"].alias("models"),
            F.transform("s", lambda e: e["obs"]).alias("obs"),
            F.transform("s", lambda e: e["preds"]).alias("preds"),
        )
    )


def inseason_backtest(
    season: SeasonData,
    candidates: Candidates,
    last: int | None,
    first_period: int = 2,
    period1_only: Sequence[str] = (),
    stack_metric: str = "MAPE",
    patience: int = 500,
    seed: int = 123,
    fitter: Callable[..., DataFrame] = fit_orders,
    exact: bool = False,
    keys: str | Iterable[str] = ("species",),
    **fit_options,
) -> tuple[DataFrame, DataFrame]:
    """(forecasts with an ``ensemble`` row per year, failed fits) of the season totals.

    ``fit_options`` go to the fitter, e.g. ``seasonal=2`` for the same period one
    year back.  From period 1 on, period 2 is forecast two steps ahead.
    """
    keys = as_list(keys)
    rows = drop_incomplete(season.series, list(candidates.covariates))
    rows = se.complete_periods(rows, keys)
    if period1_only:
        rows = se.contrast_covariates(rows, period1_only, keys)
    fits = fitter(
        rows,
        candidates,
        last,
        keys=keys,
        time="year",
        freq=2,
        first_period=first_period,
        **fit_options,
    )
    fits = cut_lineage(fits, "inseason")
    observed = rows.select(*keys, "year", "period", "abundance")
    fc = succeeded(fits).join(observed, [*keys, "year", "period"], "left")
    totals = se.label_errors(se.add_observed(fc, season.observed, keys))
    found = st.stack_weights(stack_over_years(totals, keys), stack_metric, exact, keys, patience=patience, seed=seed)
    weights = st.weight_rows(found, keys).select(
        *keys, "model", F.round("weight", 4).alias("stacking_weight")
    )
    return se.stack_ensemble(totals, weights, keys), failed(fits)
