"""Sweeps over the window length and the decay rate.

The grid value is one more key of a single plan: each forecast row looks
back at its own recent past, is paired with the grid, and goes through the same
ranking, weighting and scoring as an ordinary run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.metrics import skill_beside_best
from lagloom.functions.safe import as_list, spread
from lagloom.operators.ensemble import SCHEMES, VALUES, combine, with_stack_weights, with_weights
from lagloom.operators.features import KEYS
from lagloom.operators.report import BEST
from lagloom.operators.rolling import rank_models, score_grid, top_models, with_bounds_in_place


def _sweep(
    fc: DataFrame,
    grid: Column,
    longest: int,
    window: str,
    alpha: str,
    years: int,
    n: int,
    k: float,
    metric: str,
    keys: list[str],
    time: str,
) -> DataFrame:
    by = ["grid", *keys]
    needed = [*keys, time, "model", "abundance", *VALUES, "aicc", "series_end", "series_observed"]
    given = [c for c in needed if c in fc.columns]
    # A series' rows lie together from here on: bounds, looking back and all that follows need no other move.
    rows = with_bounds_in_place(spread(fc.select(*given), *keys), keys, time).select(*needed)
    # Times that are scored look back at all, but they alone meet the grid.
    recent = F.col(time) > F.col("series_end") - years
    scored = score_grid(rows, longest, grid, window, alpha, keys, time, wanted=recent, deal=keys)
    top = top_models(rank_models(scored, metric, by, time), n, years, by, time)
    schemes = [s for s in SCHEMES if s != "Stack_weighted"]
    weighted = with_stack_weights(with_weights(top, k, by, time), None, by, time)
    target = F.coalesce(F.col(time) <= F.col("series_observed") + 1, F.lit(False))
    members = combine(weighted.withColumn("_target", target), schemes, [*by, "_target"], time, best=BEST)
    own = F.col("model") == BEST
    latest = F.max_by(F.struct(time, *VALUES), time).alias("_f")
    table = skill_beside_best(members.filter(own | F.col("_target")), [*by, "model"], own, [latest], time)
    metrics = [*by, "model", "mape", "rmse", "msa", "mase"]
    return table.withColumn("_f", F.when(~own, F.col("_f"))).select(*metrics, "_f.*")


def sweep_window(
    fc: DataFrame,
    years: int,
    n: int,
    k: float = 1,
    alpha: float = 0.0,
    metric: str = "mape",
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Skill of the best individual and the ensembles for windows 1..years-1.

    The window length is used for both ranking and weighting.  ``fc`` needs
    observations; the forecast of the latest target is attached.
    """
    grid = F.sequence(F.lit(1), F.lit(years - 1))
    out = _sweep(
        fc, grid, years - 1, "grid", f"{float(alpha)}D", years, n, k, metric, as_list(keys), time
    )
    return out.withColumnRenamed("grid", "rolling_window").withColumn("alpha", F.lit(float(alpha)))


def sweep_alpha(
    fc: DataFrame,
    years: int,
    n: int,
    window: int,
    k: float = 1,
    metric: str = "mape",
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """The same for decay rates 0, 0.05, ... 0.95 at a fixed window length."""
    grid = F.sequence(F.lit(0), F.lit(19))
    alpha = "(grid * 5 / 100D)"
    out = _sweep(fc, grid, window, str(window), alpha, years, n, k, metric, as_list(keys), time)
    return out.withColumn("alpha", F.expr(alpha)).drop("grid")


def sweep_view(out: DataFrame, grid: str, model: str = "MAPE_weighted", keys: str | Iterable[str] = KEYS) -> DataFrame:
    """Grid value, MAPE and latest forecast of one scheme: the data of the charts."""
    return out.filter(F.col("model") == model).select(*as_list(keys), grid, "mape", "predicted_abundance")
