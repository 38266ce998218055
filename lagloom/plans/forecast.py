"""The whole run: candidates, backtest, ranking, ensembles and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, spread
from lagloom.operators import backtest as bt
from lagloom.operators import ensemble as en
from lagloom.operators import report as rp
from lagloom.operators import rolling as ro
from lagloom.operators import stacking as st
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS
from lagloom.operators.fit_linear import fit_linear
from lagloom.plans.refresh import upsert
from lagloom.sources.writers import cut_lineage


@dataclass(frozen=True)
class ForecastRun:
    """Lazy results of one run."""

    models: DataFrame
    forecasts: DataFrame
    errors: DataFrame | None
    all_models: DataFrame
    top_models: DataFrame
    performance: DataFrame
    weights: DataFrame
    ensembles: DataFrame
    skill: DataFrame
    summary: DataFrame
    skill_table: DataFrame
    best_by_year: DataFrame
    chosen: DataFrame


def score(
    fc: DataFrame,
    years: int,
    slide: int,
    alpha: float = 0.0,
    metric: str = "aicc",
    stretch: bool = False,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Trailing MAPE, window metrics and rank of every forecast.

    Both trailing operators run on the (keys, model) partitioning before the
    ranking moves the rows to (keys, time), where weighting finds them.  Rows are
    spread explicitly, or the join of the bounds would leave all models of a
    series in one task.
    """
    rows = spread(ro.with_bounds(ro.score_rows(fc), keys, time), *as_list(keys), "model")
    rolled = ro.rolling_mape(rows, years - 1, alpha, keys, time)
    return ro.rank_models(en.window_metrics(rolled, slide, alpha, stretch, keys, time), metric, keys, time)


def forecast(
    df: DataFrame,
    candidates: Candidates,
    years: int = 16,
    slide: int = 15,
    n: int = 25,
    metric: str = "aicc",
    k: float = 1,
    alpha: float = 0.0,
    stretch: bool = False,
    stacking: bool = False,
    stack_metric: str = "MAPE",
    stack_exact: bool = False,
    patience: int = 500,
    seed: int = 123,
    supplied: DataFrame | None = None,
    update_last_year: bool = False,
    fitter: Callable[..., DataFrame] = fit_linear,
    benchmark: DataFrame | None = None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    **fit_options,
) -> ForecastRun:
    """Forecast every series of a feature table.

    The backtest spans ``years + slide`` origins.  ``supplied`` forecasts replace
    the fitting; with ``update_last_year`` the last two origins are refitted and
    replace theirs.  Fits and ranked forecasts, which feed every result, are
    written once to the shared folder; the results themselves are lazy.  With
    ``freq=2`` the results have ``period`` among their keys.
    """
    keys = as_list(keys)
    # with two periods a time has two forecasts, and each period is scored, ranked and combined by itself
    by = [*keys, "period"] if fit_options.get("freq", 1) > 1 else keys
    models = candidates.table(df.sparkSession)
    errors = None
    if supplied is None or update_last_year:
        last = 2 if update_last_year else years + slide
        fits = bt.backtest(
            df, candidates, last, fitter, keys=keys, time=time, carry=["abundance"], **fit_options
        )
        fits = cut_lineage(fits, "fits")
        errors, fc = bt.failed(fits), bt.succeeded(fits)
        if supplied is not None:
            fc = upsert(supplied.drop("abundance"), fc.drop("abundance"), keys, time)
    else:
        fc = supplied
    series = df.select(*keys, time, *[c for c in ("period",) if c in df.columns], "abundance")
    observed = fc if supplied is None else ro.with_obs(fc, series, by, time)
    ranked = cut_lineage(
        score(observed, years, slide, alpha, metric, stretch, by, time), "ranked"
    )
    top = ro.with_names(ro.top_models(ranked, n, years, by, time), candidates)
    performance = ro.best_individual(top, by, time)
    stack_weights = None
    if stacking:
        stacked = st.stack_input(ranked, years, n, slide, by, time)
        found = st.stack_weights(stacked, stack_metric, stack_exact, by, patience=patience, seed=seed)
        stack_weights = cut_lineage(st.weight_rows(found, by), "stacking")
    weights, ensembles = en.ensemble(
        ranked, years, n, slide, k, alpha, stretch, stack_weights, by, time
    )
    skill = en.ensemble_skill(ranked, ensembles, years, by, time)
    table = rp.skill_table(performance, skill, benchmark, by)
    shown = rp.candidate_forecasts(top, ensembles, by, time)
    return ForecastRun(
        models=models,
        forecasts=fc,
        errors=errors,
        all_models=ranked,
        top_models=top,
        performance=performance,
        weights=en.final_weights(weights, by, time),
        ensembles=ensembles,
        skill=skill,
        summary=en.model_summary(ranked, ensembles, weights, years, by, time),
        skill_table=table,
        best_by_year=rp.best_by_year(top, by, time),
        chosen=rp.chosen_forecasts(shown, rp.choose_scheme(table, by), by, time),
    )


def next_forecast(run: ForecastRun, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """The chosen forecast of each series' latest target."""
    rows = run.chosen.groupBy(*as_list(keys)).agg(
        F.max_by(F.struct(*[c for c in run.chosen.columns if c not in as_list(keys)]), time).alias("_r")
    )
    return rows.select(*as_list(keys), "_r.*")
