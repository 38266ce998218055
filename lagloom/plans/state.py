"""Refresh from stored sums: new rows are forecast without the history.

A state has one row per series: the sums of products of all its rows so far, and the
centre and level they were taken from.  New rows are joined to it, sums over the
new rows before each of them are added, and every candidate is solved from the result.
The state that includes the new rows is the old one plus their sums.  Neither step
reads the history.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, present, spread
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.operators.fit_linear import centred, intervals, moments, solve, uncentred

SUMS, VECTORS = ("n_obs", "sy", "syy"), ("sx", "sxy", "sxx")


def build_state(
    history: DataFrame,
    candidates: Candidates,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str = "abundance",
) -> DataFrame:
    """One row per series: sums over its rows, their last time, and the centre and level of the sums."""
    keys, names = as_list(keys), list(candidates.covariates)
    rows = centred(drop_incomplete(history, names), names, value, keys)
    sums = moments(names, value, cross=candidates.max_vars > 1, level=F.col("_level"))
    shift = [F.first("_centre").alias("_centre"), F.first("_level").alias("_level")]
    return rows.groupBy(*keys).agg(*sums, *shift, F.max(time).alias("last_time"))


def _plus(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(
        F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, zero) + F.coalesce(y, zero)))
    )


def _shifted(rows: DataFrame, state: DataFrame, names: Sequence[str], keys: list[str], value: str) -> DataFrame:
    """New rows with their series' sums, and covariates less the state's centre; a series without a state takes its own."""
    old = state.drop("last_time").withColumnsRenamed({c: f"_{c}" for c in (*SUMS, *VECTORS)})
    rows = rows.join(old, keys, "left")
    whole = Window.partitionBy(*keys)
    logged = F.ln(present(F.col(value).cast("double")))
    own = F.array(*[F.avg(F.col(c).cast("double")).over(whole) for c in names]) if names else F.array().cast("array<double>")
    rows = rows.withColumns({
        "_centre": F.coalesce("_centre", own), "_level": F.coalesce("_level", F.avg(logged).over(whole), F.lit(0.0)),
    })
    return rows.withColumns({c: F.col(c).cast("double") - F.get("_centre", F.lit(i)) for i, c in enumerate(names)})


def advance_state(
    state: DataFrame, new: DataFrame, candidates: Candidates, keys: str | Iterable[str] = KEYS, time: str = "t", value: str = "abundance"
) -> DataFrame:
    """The state after ``new`` rows, which must be later than it."""
    keys, names = as_list(keys), list(candidates.covariates)
    rows = _shifted(drop_incomplete(new, names), state, names, keys, value)
    sums = rows.groupBy(*keys).agg(
        *moments(names, value, cross=candidates.max_vars > 1, level=F.col("_level")),
        F.first("_centre").alias("_centre"), F.first("_level").alias("_level"), F.max(time).alias("last_time"),
    )
    a, b = state.alias("a"), sums.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(b, same, "full")
    added = {c: F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0)) for c in SUMS}
    added |= {c: _plus(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in VECTORS}
    last = F.greatest("a.last_time", "b.last_time").alias("last_time")
    return both.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[v.alias(c) for c, v in added.items()],
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("_centre", "_level")], last,
    )


def forecast_new(
    state: DataFrame,
    new: DataFrame,
    candidates: Candidates,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str = "abundance",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Forecasts of every model for the ``new`` rows, as ``fit_linear`` gives them, from the state and the new rows before each."""
    keys, names = as_list(keys), list(candidates.covariates)
    rows = _shifted(spread(drop_incomplete(new, names), *keys), state, names, keys, value)
    past = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    sums = moments(names, value, cross=candidates.max_vars > 1, over=past, level=F.col("_level"))
    rows = rows.withColumn("x", F.array(*[F.col(c) for c in names]) if names else F.array().cast("array<double>"))
    rows = rows.select("*", *sums)
    total = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in SUMS}
    total |= {c: _plus(F.col(c), F.col(f"_{c}")) for c in VECTORS}
    folds = rows.withColumns(total).select(*keys, time, *carry, "x", "_centre", "_level", *SUMS, *VECTORS)
    tasks = candidates.pair(folds, spread_by=[*keys, time] if candidates.max_vars > 1 else None)
    fits = solve(tasks, len(names), candidates.max_vars)
    fits = intervals(fits.withColumns({"mu": F.col("mu") + F.col("_level"), "coef": uncentred(F.col("coef"))}))
    order = F.array(*[F.lit(v) for v in (0, 0, 0, 0, 1, 0, 0)])
    labels = F.concat(F.array(F.lit("intercept")), "covariates")
    return fits.select(
        *keys, time, "model", "predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95", "aicc", "sigma2", order.alias("order"),
        F.when(F.col("coef").isNotNull(), F.map_from_arrays(labels, "coef")).alias("coef"), "n_obs", "error", *carry,
    )
