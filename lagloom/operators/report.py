"""Comparison tables of individual models, ensembles and benchmarks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.metrics import with_errors
from lagloom.functions.safe import as_list
from lagloom.operators.features import KEYS

BEST = "Best_individual"
VALUES = ("predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95")


def skill_table(
    performance: DataFrame,
    ensemble_skill: DataFrame,
    benchmark: DataFrame | None = None,
    keys: str | Iterable[str] = KEYS,
) -> DataFrame:
    """Skill of the best individual, the weighted schemes and, if given, a benchmark.

    ``label`` is the model name with its first underscore turned into a space.
    """
    columns = [*as_list(keys), "model", "mape", "rmse", "msa", "mase"]
    table = (
        performance.withColumn("model", F.lit(BEST))
        .select(*columns)
        .unionByName(ensemble_skill.filter(F.col("model").contains("weight")).select(*columns))
    )
    if benchmark is not None:
        table = table.unionByName(benchmark.select(*columns))
    return table.withColumn("label", F.regexp_replace("model", "^([^_]*)_", "$1 "))


def best_by_year(top: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """The first-ranked model of each time with its forecast and bounds."""
    return top.filter(F.col("rank") == 1).select(*as_list(keys), time, "model_name", *VALUES)


def choose_scheme(table: DataFrame, keys: str | Iterable[str] = KEYS) -> DataFrame:
    """The weighted scheme of least MAPE per series, ties by name."""
    weighted = table.filter(F.col("model").contains("weight") & F.col("mape").isNotNull())
    least = weighted.groupBy(*as_list(keys)).agg(F.min(F.struct("mape", "model")).alias("_b"))
    return least.select(*as_list(keys), F.col("_b.model").alias("model"))


def candidate_forecasts(
    top: DataFrame,
    ensembles: DataFrame,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Best-individual and ensemble forecasts under one model column, with observations."""
    keys = as_list(keys)
    best = top.filter(F.col("rank") == 1).withColumn("model", F.lit(BEST))
    columns = [*keys, time, "model", "model_name", "abundance", *VALUES]
    named = ensembles.withColumn("model_name", F.col("model"))
    return best.select(*columns).unionByName(named.select(*columns))


def chosen_forecasts(
    candidates: DataFrame, scheme: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """The chosen scheme's forecasts with error and relative error."""
    keys = as_list(keys)
    rows = candidates.join(scheme.select(*keys, "model"), [*keys, "model"], "left_semi")
    return with_errors(rows).select(
        *keys, time, "model_name", "abundance", *VALUES, "error", "pct_error", "log10_ratio"
    )


def chart_data(
    chosen: DataFrame,
    benchmark: DataFrame | None = None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Long rows (series, time, chart, line, value) behind the forecast charts.

    The relative-error chart is log10 of predicted over observed.
    """
    keys = as_list(keys)

    def line(df: DataFrame, chart: str, name: str | Column, value: str) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.select(
            *keys, time, F.lit(chart).alias("chart"), label.alias("line"), F.col(value).alias("value")
        )

    label = F.regexp_replace("model_name", "^([^_]*)_", "$1 ")
    long = chosen.unpivot(
        [*keys, time], ["abundance", *VALUES], "line", "value"
    ).select(*keys, time, F.lit("forecast").alias("chart"), "line", "value")
    out = long.unionByName(line(chosen, "relative_error", label, "log10_ratio"))
    if benchmark is not None:
        out = out.unionByName(line(benchmark, "benchmark", "benchmark", "predicted_abundance"))
    return out


def ordered_table(table: DataFrame, keys: str | Iterable[str] = KEYS, by: str = "mape") -> DataFrame:
    """Rows with their position by ``by`` inside each series, for display."""
    order = Window.partitionBy(*as_list(keys)).orderBy(F.col(by).asc_nulls_last(), "model")
    return table.withColumn("position", F.row_number().over(order))
