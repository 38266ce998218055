"""Spine, lags, index aggregation, scaling and feature attachment.

Operators that look along a series use one window layout, partitioned by the
series keys and ordered by time, so a chain of them shares a single shuffle.  A
window partition holds one row per time step of one series and is therefore
bounded by the calendar, however many raw rows fed the panel.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, present, ratio

KEYS = ("series_id",)


def along(keys: str | Iterable[str] = KEYS, time: str = "t") -> WindowSpec:
    return Window.partitionBy(*as_list(keys)).orderBy(time)


def complete_spine(
    df: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t", ahead: int = 1
) -> DataFrame:
    """Every time step from a series' first to its last plus ``ahead``.

    Gaps and the extra steps get NULLs.  Each row fills the gap up to its
    successor, so no spine table is built and nothing is joined.
    """
    keys = as_list(keys)
    step = F.col(time)
    successor = F.coalesce(F.lead(time).over(along(keys, time)), step + 1 + ahead)
    bounded = df.withColumn("_end", F.greatest(successor - 1, step))
    filled = bounded.withColumn("_slot", F.explode(F.sequence(step, F.col("_end"))))
    observed = F.col("_slot") == step
    rest = [c for c in df.columns if c not in (*keys, time)]
    return filled.select(
        *keys, F.col("_slot").alias(time), *[F.when(observed, F.col(c)).alias(c) for c in rest]
    )


def with_tags(df: DataFrame, species: str = "all", period: int = 1) -> DataFrame:
    return df.withColumns({"species": F.lit(species), "period": F.lit(period)})


def lag_feature(
    df: DataFrame,
    column: str,
    n: int = 1,
    name: str | None = None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    return df.withColumn(name or f"lag{n}_{column}", F.lag(column, n).over(along(keys, time)))


def log_lag_feature(
    df: DataFrame,
    column: str,
    n: int = 1,
    name: str | None = None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Lagged natural logarithm; NULL where the lagged value is not positive."""
    return df.withColumn(
        name or f"lag{n}_log_{column}", F.lag(F.ln(column), n).over(along(keys, time))
    )


def drop_sentinel(df: DataFrame, column: str, sentinel: float = -99, keep_equal: bool = False) -> DataFrame:
    """Rows whose value is above the missing-value sentinel (or equal, if kept)."""
    value = F.col(column)
    return df.filter(value >= sentinel if keep_equal else value > sentinel)


def annual_mean(
    index: DataFrame, value: str, date: str = "date", keys: str | Iterable[str] = (), name: str | None = None
) -> DataFrame:
    return index.groupBy(*as_list(keys), F.year(date).alias("year")).agg(F.avg(value).alias(name or value))


def month_window_mean(
    index: DataFrame,
    value: str,
    months: Sequence[int],
    date: str = "date",
    keys: str | Iterable[str] = (),
    name: str | None = None,
) -> DataFrame:
    chosen = index.filter(F.month(date).isin(*months))
    return annual_mean(chosen, value, date, keys, name)


def with_group_count(df: DataFrame, by: str | Iterable[str], name: str = "n") -> DataFrame:
    """Number of rows per group on every row.

    Counted with map-side combination and joined back rather than windowed, so a
    group holding most of the rows is never gathered into one task.
    """
    by = as_list(by)
    return df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by, "left")


def zscore(
    df: DataFrame,
    columns: Sequence[str],
    keys: str | Iterable[str] = KEYS,
    asof: str | Column | None = None,
) -> DataFrame:
    """Centre and scale per series; NULLs are ignored, a constant column becomes NULL.

    ``asof`` is an optional condition choosing the rows the mean and deviation
    are learned from (for example ``t <= origin``).
    """
    whole = Window.partitionBy(*as_list(keys))

    def scaled(c: str) -> Column:
        x = present(c)
        basis = x if asof is None else F.when(F.expr(asof) if isinstance(asof, str) else asof, x)
        sd = F.stddev_samp(basis).over(whole)
        return ratio(x - F.avg(basis).over(whole), F.when(sd > 0, sd))

    return df.withColumns({c: scaled(c) for c in columns})


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(present(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def parity(df: DataFrame, time: str = "t", name: str = "pink_ind") -> DataFrame:
    """0 for an even time step, 1 for an odd one."""
    return df.withColumn(name, F.pmod(F.col(time), F.lit(2)).cast("int"))


def pick_day(df: DataFrame, month_day: str = "6-30", column: str = "mm-dd") -> DataFrame:
    """Rows of one calendar day; ``column`` holds a date or a ``month-day`` text."""
    month, day = (int(x) for x in month_day.split("-"))
    if dict(df.dtypes)[column] == "string":
        return df.filter(F.regexp_replace(F.col(f"`{column}`"), r"(^|-)0", "$1") == f"{month}-{day}")
    return df.filter((F.month(column) == month) & (F.dayofmonth(column) == day))


def drop_current(df: DataFrame, asof_year: int, time: str = "year") -> DataFrame:
    """Without the incomplete year.  The year is an argument, never the clock."""
    return df.filter(F.col(time) != F.lit(asof_year))


def shift_year(df: DataFrame, years: int = 2, time: str = "year") -> DataFrame:
    return df.withColumn(time, F.col(time) + F.lit(years))


def attach_features(
    df: DataFrame,
    feeds: Mapping[str, tuple[DataFrame, Sequence[str]]],
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Left-join feeds ``{name: (feed, join columns)}`` onto the panel.

    With ``wanted``, a feed that supplies none of the wanted columns is left out
    of the plan and the others are pruned to the wanted columns.
    """
    for feed, on in feeds.values():
        supplied = [c for c in feed.columns if c not in on]
        if wanted is not None:
            supplied = [c for c in supplied if c in wanted]
        if supplied:
            df = df.join(feed.select(*on, *supplied), list(on), "left")
    return df


def project(df: DataFrame, covariates: Sequence[str], keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    return df.select(*as_list(keys), time, "species", "period", "abundance", *covariates)


def keep_observed_or_target(
    df: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t", value: str = "abundance"
) -> DataFrame:
    """Observed rows plus the last row of each series, the one to forecast."""
    last = F.max(time).over(Window.partitionBy(*as_list(keys)))
    return (
        df.withColumn("_last", last)
        .filter(F.col(value).isNotNull() | (F.col(time) == F.col("_last")))
        .drop("_last")
    )


def clean_names(df: DataFrame) -> DataFrame:
    """Column names restricted to ``[a-z0-9_]``."""
    fixed = {
        c: "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in c.lower()).strip("_")
        for c in df.columns
    }
    return df.withColumnsRenamed({k: v for k, v in fixed.items() if k != v})


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete cases over ``columns``; NaN and infinite values count as missing."""
    if not columns:
        return df
    real = [c for c, kind in df.dtypes if c in columns and kind in ("double", "float")]
    for c in real:
        df = df.filter(present(c).isNotNull())
    return df.dropna(subset=list(columns))


