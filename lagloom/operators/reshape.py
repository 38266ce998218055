"""Wide/long reshaping of cohort tables and indicator sheets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators.features import zscore


def cohort_to_calendar(
    df: DataFrame,
    keys: str | Iterable[str],
    cohort: str,
    ages: Sequence[str] | None = None,
    age_prefix: str = "Age",
    time: str = "return_year",
) -> DataFrame:
    """Move ``Age<n>`` columns from cohort rows to the calendar row ``cohort + n``.

    The pivot values are the column names themselves, so the plan needs no extra
    job to discover them and has a single shuffle.
    """
    keys = as_list(keys)
    ages = list(ages or [c for c in df.columns if age_prefix.lower() in c.lower()])
    long = df.unpivot([*keys, cohort], ages, "_age", "_value").filter(F.col("_value").isNotNull())
    age = F.regexp_extract("_age", r"(\d+)", 1).cast("int")
    return (
        long.withColumn(time, (F.col(cohort) + age).cast("int"))
        .groupBy(*keys, time)
        .pivot("_age", ages)
        .agg(F.sum("_value"))
    )


def derive_response(
    df: DataFrame, ages: Sequence[str], rename: dict[str, str] | None = None, response: str = "abundance"
) -> DataFrame:
    """Sum of age classes, NULL if any class is NULL; optionally rename columns."""
    total = F.col(ages[0])
    for a in ages[1:]:
        total = total + F.col(a)
    return df.withColumn(response, total).withColumnsRenamed(rename or {})


def transpose_indicators(
    df: DataFrame,
    name_col: str,
    indicators: Sequence[str],
    keys: str | Iterable[str] = (),
    time: str = "year",
    year_pattern: str = "12",
    scaled: Sequence[str] = (),
) -> DataFrame:
    """One row per indicator with a column per year -> one row per year.

    Rows with a blank name are dropped; year columns are those whose name starts
    with a digit of ``year_pattern``.  Indicators in ``scaled`` are centred and
    scaled over their years.
    """
    keys = as_list(keys)
    years = [c for c in df.columns if c[:1] and c[:1] in year_pattern]
    long = (
        df.filter(F.col(name_col).isNotNull() & (F.trim(name_col) != ""))
        .unpivot([*keys, name_col], years, "_year", "_value")
        .withColumn(time, F.col("_year").cast("int"))
    )
    if scaled:
        unit = zscore(long.withColumn("_unit", F.col("_value")), ["_unit"], [*keys, name_col])
        long = unit.withColumn(
            "_value", F.when(F.col(name_col).isin(*scaled), F.col("_unit")).otherwise(F.col("_value"))
        )
    return (
        long.groupBy(*keys, time)
        .pivot(name_col, list(indicators))
        .agg(F.first("_value", ignorenulls=True))
    )
