"""The feature table: spine, own lags, feeds, scaling and row choice in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators import features as op
from lagloom.operators.reshape import transpose_indicators
from lagloom.operators.smooth import survival_features

# Names of the three indicator rows and the features made of them (fixed values).
INDICATORS = {
    "Physical Spring Trans.\nUI based (day of year)": "lag2_sp_phys_trans",
    "Principal Component scores (PC1)": "lag2_pc1",
    "Principal Component scores (PC2)": "lag2_pc2",
}
OWN = {"lag1_log_jack": ("jack", 1), "lag4_log_adults": ("abundance", 4), "lag5_log_adults": ("abundance", 5)}


def _later(feed: DataFrame, columns: Mapping[str, str], years: int) -> DataFrame:
    """A feed's values moved to later years, on the years the feed covers."""
    moved = feed.select(
        (F.col("year") + years).cast("int").alias("year"), *[F.col(f"`{a}`").alias(b) for a, b in columns.items()]
    )
    return feed.select("year").join(moved, "year", "left")


def indicator_features(sheet: DataFrame, name_col: str, names: Mapping[str, str] = INDICATORS) -> DataFrame:
    """Two-year lags of the transposed sheet; the component scores are scaled first."""
    scores = [n for n, feature in names.items() if "_pc" in feature]
    return _later(transpose_indicators(sheet, name_col, list(names), scaled=scores), names, 2)


def make_features(
    returns: DataFrame,
    feeds: Mapping[str, DataFrame],
    covariates: Sequence[str],
    asof_year: int | None = None,
    keys: str | Iterable[str] = op.KEYS,
    species: str = "fish",
    name_col: str = "indicator",
) -> DataFrame:
    """The scaled, lagged feature table of a return table (keys, year, abundance, jack).

    ``feeds`` may hold: ``pdo``, ``npgo``, ``enso`` (date, value), ``indicators``
    (wide by year), ``pit`` (year, juv_count, ocean1_count, ocean2_count) and
    ``smolt`` (year, mm-dd, value).  A feed none of whose features is wanted is
    not planned at all.
    """
    keys = as_list(keys)
    wanted = set(covariates)
    panel = op.with_tags(op.complete_spine(returns, keys, "year", 1), species)
    for name, (column, n) in OWN.items():
        if name in wanted:
            panel = op.log_lag_feature(panel, column, n, name, keys, "year")
    if "pdo" in feeds and wanted & {"lag1_pdo", "lag2_pdo"}:
        index = op.drop_sentinel(feeds["pdo"], "value", keep_equal=True)
        panel = panel.join(op.annual_mean(index, "value", name="_pdo"), "year", "left")
        panel = op.lag_feature(panel, "_pdo", 1, "lag1_pdo", keys, "year")
        panel = op.lag_feature(panel, "_pdo", 2, "lag2_pdo", keys, "year")
        panel = panel.withColumn("lag2_pdo", F.when(F.col("lag1_pdo").isNotNull(), F.col("lag2_pdo")))
    if "npgo" in feeds and wanted & {"lag1_npgo", "lag2_npgo"}:
        index = feeds["npgo"].filter(F.col("value").isNotNull())
        panel = panel.join(op.month_window_mean(index, "value", (4, 5), name="_npgo"), "year", "left")
        for n in (1, 2):
            panel = op.lag_feature(panel, "_npgo", n, f"lag{n}_npgo", keys, "year")
    if "enso" in feeds and "lag2_fall_nino" in wanted:
        index = op.drop_sentinel(feeds["enso"], "value")
        fall = op.month_window_mean(index, "value", (10, 11, 12), name="_fall")
        panel = panel.join(fall, "year", "left")
        panel = op.lag_feature(panel, "_fall", 2, "lag2_fall_nino", keys, "year")
    if "smolt" in feeds and "lag1_log_socksmolt" in wanted:
        day = op.pick_day(feeds["smolt"]).select("year", F.ln("value").alias("v"))
        panel = panel.join(_later(day, {"v": "lag1_log_socksmolt"}, 1), "year", "left")
    tables = {}
    if "indicators" in feeds and wanted & set(INDICATORS.values()):
        tables["indicators"] = (indicator_features(feeds["indicators"], name_col), ["year"])
    if "pit" in feeds and wanted & {"lag1_log_sar", "lag2_log_sar"}:
        counts = feeds["pit"].withColumn("_all", F.lit(0))
        survival = survival_features(counts, asof_year, "_all").drop("_all")
        tables["pit"] = (survival, ["year"])
    panel = op.attach_features(panel, tables, covariates)
    panel = op.parity(panel, "year")
    panel = op.project(panel, covariates, keys, "year")
    panel = op.fill_zero(op.zscore(panel, covariates, keys), covariates)
    return op.keep_observed_or_target(panel, keys, "year")
