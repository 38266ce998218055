"""Performance-weighted combinations of the top models.

For a target time the weights come from the ``slide`` times before it.  Because
a model is eligible at a target exactly when its own forecast row there is
ranked, the window metrics are computed in place, on that row, by a trailing
frame over (keys, model): nothing is exploded per target and no range join is
planned.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.metrics import abs_log_ratio, abs_pct_error, accuracy, skill, sq_error
from lagloom.functions.safe import as_list, ratio
from lagloom.operators.features import KEYS
from lagloom.operators.rolling import past_entry, score_array, with_bounds

WINDOW_METRICS = ("w_rmse", "w_mape", "w_msa", "w_aicc")
VALUES = ("predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95")
# Scheme name -> weight column.
SCHEMES = {
    "MSA_weighted": "msa_weight",
    "RMSE_weighted": "rmse_weight",
    "MAPE_weighted": "mape_weight",
    "AICc_weighted": "aicc_weight",
    "Equal_weighted": "equal_weight",
    "Stack_weighted": "stacking_weight",
}


def year_bounds(fc: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """First, last and last observed time of each series."""
    return fc.groupBy(*as_list(keys)).agg(
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        F.max(F.when(F.col("abundance").isNotNull(), F.col(time))).alias("last_observed"),
    )


def targets(bounds: DataFrame, years: int, keys: str | Iterable[str] = KEYS) -> DataFrame:
    """Target times: one after each of ``last - years .. last_observed``."""
    start, end = F.col("last") - years, F.col("last_observed")
    return bounds.filter(end >= start).select(
        *as_list(keys), F.explode(F.sequence(start + 1, end + 1)).alias("target")
    )


def in_targets(fc: DataFrame, years: int, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """Forecast rows whose own time is a target."""
    step = F.col(time)
    inside = (step > F.col("series_end") - years) & (step <= F.col("series_observed") + 1)
    return with_bounds(fc, keys, time).filter(inside)


def eligible(
    fc: DataFrame, n: int, target_rows: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """(series, target, model) triples ranked ``n`` or better at the target."""
    keys = as_list(keys)
    ranked = fc.filter(F.col("rank") <= n).select(*keys, F.col(time).alias("target"), "model")
    return ranked.join(target_rows, [*keys, "target"], "left_semi")


def window_metrics(
    fc: DataFrame,
    slide: int,
    alpha: float = 0.0,
    stretch: bool = False,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """RMSE, MAPE (a fraction), MSA and latest AICc of each model before each row.

    The window is the ``slide`` times before the row, or every earlier one with
    ``stretch``.  With decay, a row j times back weighs (1 - alpha)^j.
    """
    order = Window.partitionBy(*as_list(keys), "model").orderBy(time)
    frame = order.rangeBetween(Window.unboundedPreceding if stretch else -slide, -1)
    o, p = F.col("abundance"), F.col("predicted_abundance")
    known = (o - p).isNotNull()
    last = F.last(F.when(known, F.struct(F.col("aicc").alias("aicc"))), ignorenulls=True)
    if not alpha:
        return fc.withColumns(
            {
                "w_rmse": F.sqrt(F.avg(sq_error(o, p)).over(frame)),
                "w_mape": F.avg(abs_pct_error(o, p)).over(frame),
                "w_msa": 100 * (F.exp(F.avg(abs_log_ratio(o, p)).over(frame)) - 1),
                "w_aicc": last.over(frame)["aicc"],
            }
        )
    gathered = fc.withColumn("_past", F.collect_list(past_entry(fc, time)).over(frame))
    span = str(2**30) if stretch else str(slide)
    return score_array(gathered, "_past", time, span, float(alpha), WINDOW_METRICS)


def with_weights(
    fc: DataFrame, k: float = 1, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """Weights of the eligible rows of each target from their window metrics.

    A model without any scored row in the window takes no part in the shares and
    gets NULL weights.
    """
    target = Window.partitionBy(*as_list(keys), time)
    scored = F.col("w_rmse").isNotNull()

    def share(x: Column) -> Column:
        return ratio(x, F.sum(x).over(target))

    def inverse(metric: str) -> Column:
        return share(F.pow(ratio(F.lit(1.0), metric), F.lit(float(k))))

    aicc = F.when(scored, F.col("w_aicc"))
    return fc.withColumn("_best", F.min(aicc).over(target)).withColumns(
        {
            "msa_weight": inverse("w_msa"),
            "rmse_weight": inverse("w_rmse"),
            "mape_weight": inverse("w_mape"),
            "aicc_weight": share(F.exp(-0.5 * (aicc - F.col("_best")))),
            "equal_weight": F.when(scored, ratio(F.lit(1.0), F.count(F.when(scored, 1)).over(target))),
        }
    ).drop("_best")


def with_stack_weights(
    fc: DataFrame, weights: DataFrame | None, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """Stacking weights (keys, target, model, weight) rounded to 4 digits; 1 when off."""
    if weights is None:
        return fc.withColumn("stacking_weight", F.lit(1.0))
    keys = as_list(keys)
    rounded = weights.select(
        *keys, F.col("target").alias(time), "model", F.round("weight", 4).alias("stacking_weight")
    )
    return fc.join(rounded, [*keys, time, "model"], "left")


def combine(
    weighted: DataFrame,
    schemes: Sequence[str] = tuple(SCHEMES),
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    best: str | None = None,
) -> DataFrame:
    """Weighted sums of forecast and bounds, one row per (target, scheme).

    A NULL weight or value makes the sum NULL.  All schemes and values are
    aggregated in one pass and turned into rows afterwards; the observation of
    the target comes along.  With ``best``, the model ranked first is one more row by that name.
    """
    by = [*as_list(keys), time]

    def total(value: str, scheme: str) -> Column:
        term = F.col(value) * F.col(SCHEMES[scheme])
        return F.when(F.count(term) == F.count(F.lit(1)), F.sum(term)).alias(value)

    sums = [
        F.struct(F.lit(s).alias("model"), *[total(v, s) for v in VALUES], F.max("abundance").alias("abundance")).alias(s)
        for s in schemes
    ]
    if best is not None:
        first = F.col("rank") == 1  # of one row at most, ties having averaged ranks
        own = F.struct(F.lit(best).alias("model"), *[F.max(F.when(first, F.col(c))).alias(c) for c in (*VALUES, "abundance")])
        sums.append(F.when(F.count(F.when(first, 1)) > 0, own).alias(best))
    every = F.array(*schemes, *[best] * (best is not None))
    rows = weighted.groupBy(*by).agg(*sums).select(*by, F.explode(every).alias("_row"))
    return rows.filter("_row IS NOT NULL").select(*by, "_row.*")


def ensemble(
    ranked: DataFrame,
    years: int,
    n: int,
    slide: int,
    k: float = 1,
    alpha: float = 0.0,
    stretch: bool = False,
    stack_weights: DataFrame | None = None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> tuple[DataFrame, DataFrame]:
    """(weights, ensembles) for every target of every series.

    ``ranked`` needs ``rank``; window metrics already attached are used as they
    are, so a caller that scored the same partitioning earlier saves a shuffle.
    """
    if "w_rmse" not in ranked.columns:
        ranked = window_metrics(ranked, slide, alpha, stretch, keys, time)
    rows = in_targets(ranked, years, keys, time).filter(F.col("rank") <= n)
    weights = with_stack_weights(with_weights(rows, k, keys, time), stack_weights, keys, time)
    schemes = [s for s in SCHEMES if s != "Stack_weighted" or stack_weights is not None]
    return weights, combine(weights, schemes, keys, time)


def models_and_ensembles(
    fc: DataFrame, ensembles: DataFrame, years: int, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """Rows of models and ensembles over the last ``years`` times, with observations."""
    columns = [*as_list(keys), time, "model", "abundance", *VALUES]
    rows = with_bounds(fc, keys, time).filter(F.col(time) > F.col("series_end") - years)
    labelled = rows.withColumn("model", F.col("model").cast("string")).select(*columns)
    return labelled.unionByName(ensembles.select(*columns))


def ensemble_skill(
    fc: DataFrame, ensembles: DataFrame, years: int, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    keys = as_list(keys)
    return skill(models_and_ensembles(fc, ensembles, years, keys, time), [*keys, "model"], time)


def final_weights(weights: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """Weights of the last target of each series."""
    return weights.filter(F.col(time) == F.col("series_observed") + 1)


def model_summary(
    fc: DataFrame,
    ensembles: DataFrame,
    weights: DataFrame,
    years: int,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Accuracy per model and ensemble with the stacking weight of the last target."""
    keys = as_list(keys)
    rows = models_and_ensembles(fc, ensembles, years, keys, time)
    last = final_weights(weights, keys, time).select(
        *keys, F.col("model").cast("string").alias("model"), "stacking_weight"
    )
    return accuracy(rows, [*keys, "model"], time).join(last, [*keys, "model"], "left")
