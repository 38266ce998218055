"""Sweeps, tables, whole runs, refresh and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import report as rp
from lagloom.operators import rolling as ro
from lagloom.operators import tuning as tu
from lagloom.plans.forecast import forecast
from lagloom.plans.refresh import refresh as refresh_table
from lagloom.plans.state import advance_state, build_state, forecast_new
from lagloom.queries import panels as pa
from lagloom.queries import sql
from lagloom.queries.registry import query, rounded, shown
from lagloom.queries.scoring import (
    ENSEMBLE_SQL,
    FIT_COLUMNS,
    FIT_SQL,
    SINGLES,
    _fit_view,
    fits,
    ranked,
    stored_fits,
)
from lagloom.queries.sql import LAST, METRICS, SLIDE, TOP, VALUES, YEARS
from lagloom.sources import readers, snapshots, writers

# --- sweeps ------------------------------------------------------------------


def sweep_sql(grid: str, window: str, alpha: str) -> str:
    """The sweep as tables: ``sweep`` has one row per (series, grid value, model)."""
    by = "series_id, g"
    return f"""{sql.FITS},
terms AS (SELECT *, {sql.APE} AS ape, {sql.SE} AS se, {sql.ALR} AS alr,
  row_number() OVER (PARTITION BY series_id, model ORDER BY t) AS rn FROM fits),
grid AS (SELECT CAST(unnest({grid}) AS INTEGER) AS g),
cells AS (SELECT r.series_id, r.t, r.model, g, p.t AS pt, r.rn - p.rn AS back, r.t - p.t AS age, p.ape, p.se, p.alr, p.aicc,
    {window} AS win, {alpha} AS alpha
  FROM terms r, grid LEFT JOIN terms p ON p.series_id = r.series_id AND p.model = r.model AND p.t < r.t
    AND r.rn - p.rn <= {window}),
agg AS (SELECT series_id, t, model, g,
    CASE WHEN count(ape) = max(win) THEN 100 * sum(ape * (1 - alpha) ** back) / sum((1 - alpha) ** back) END AS mape,
    sqrt(sum(se * (1 - alpha) ** age) FILTER (age <= win) / sum((1 - alpha) ** age) FILTER (age <= win AND se IS NOT NULL)) AS w_rmse,
    sum(ape * (1 - alpha) ** age) FILTER (age <= win) / sum((1 - alpha) ** age) FILTER (age <= win AND ape IS NOT NULL) AS w_mape,
    100 * (exp(sum(alr * (1 - alpha) ** age) FILTER (age <= win)
      / sum((1 - alpha) ** age) FILTER (age <= win AND alr IS NOT NULL)) - 1) AS w_msa,
    arg_max(aicc, pt) FILTER (age <= win AND se IS NOT NULL) AS w_aicc
  FROM cells GROUP BY 1, 2, 3, 4),
scored AS (SELECT f.*, g, mape, w_rmse, w_mape, w_msa, w_aicc FROM fits f JOIN agg USING (series_id, t, model)),
{sql.ranked("scored", "mape", by)}, {sql.weighted(by)}, {sql.ensembles(by)}, {sql.all_rows(by)}, {sql.skill(by)}, {sql.best(by)},
ends_ens AS (SELECT {by}, max(t) AS t FROM ens GROUP BY {by}),
latest AS (SELECT ens.* FROM ens JOIN ends_ens USING ({by}, t)),
sweep AS (SELECT s.*, l.t, l.predicted_abundance, l.lo_95, l.hi_95 FROM (
  SELECT {by}, 'Best_individual' AS model, mape, rmse, msa, mase FROM best UNION ALL
  SELECT {by}, model, mape, rmse, msa, mase FROM skill WHERE contains(model, 'weight')) s
  LEFT JOIN latest l USING ({by}, model))"""


SWEEP_VALUES = ("predicted_abundance", "lo_95", "hi_95")
BY_WINDOW = sweep_sql(f"generate_series(1, {YEARS - 1})", "g", "0.0")
BY_ALPHA = sweep_sql("generate_series(0, 19)", str(SLIDE), "g * 5 / 100.0")


def _sweep_window(spark, sf_dir):
    return tu.sweep_window(stored_fits(spark, sf_dir), YEARS, TOP)


@query(
    "q_sweep_window",
    f"WITH {BY_WINDOW} SELECT series_id, g AS rolling_window, CAST(0 AS DOUBLE) AS alpha, model, {sql.columns(METRICS, 4)}, t, "
    f"{sql.columns(SWEEP_VALUES, 3)} FROM sweep",
)
def sweep_window(spark, sf_dir):
    keep = ("series_id", "rolling_window", "alpha", "model", "t")
    return shown(_sweep_window(spark, sf_dir), keep, {4: METRICS, 3: SWEEP_VALUES})


@query(
    "q_sweep_alpha",
    f"WITH {BY_ALPHA} SELECT series_id, round(g * 5 / 100.0, 2) AS alpha, model, {sql.columns(METRICS, 4)}, t, "
    f"{sql.columns(SWEEP_VALUES, 3)} FROM sweep",
)
def sweep_alpha(spark, sf_dir):
    out = tu.sweep_alpha(stored_fits(spark, sf_dir), YEARS, TOP, SLIDE)
    return shown(out, ("series_id", "model", "t"), {2: ("alpha",), 4: METRICS, 3: SWEEP_VALUES})


@query(
    "q_sweep_view",
    f"WITH {BY_WINDOW} SELECT series_id, g AS rolling_window, round(mape, 4) AS mape, "
    "round(predicted_abundance, 3) AS predicted_abundance FROM sweep WHERE model = 'MAPE_weighted'",
)
def sweep_view(spark, sf_dir):
    out = tu.sweep_view(_sweep_window(spark, sf_dir), "rolling_window")
    return shown(out, ("series_id", "rolling_window"), {4: ("mape",), 3: ("predicted_abundance",)})


# --- tables and whole runs ---------------------------------------------------

TABLES = f"""{ENSEMBLE_SQL}, {sql.skill()}, {sql.best()},
tbl AS (SELECT series_id, 'Best_individual' AS model, mape, rmse, msa, mase FROM best UNION ALL
        SELECT series_id, model, mape, rmse, msa, mase FROM skill WHERE contains(model, 'weight')),
choice AS (SELECT series_id, arg_min(model, (mape, model)) AS model FROM tbl WHERE contains(model, 'weight') GROUP BY 1),
candidates AS (
  SELECT series_id, t, 'Best_individual' AS model, model_name, predicted_abundance, lo_50, hi_50, lo_95, hi_95 FROM firsts UNION ALL
  SELECT series_id, t, model, model, predicted_abundance, lo_50, hi_50, lo_95, hi_95 FROM ens),
chosen AS (SELECT c.series_id, c.t, c.model_name, f.abundance, c.predicted_abundance, c.lo_50, c.hi_50, c.lo_95, c.hi_95,
    c.predicted_abundance - f.abundance AS error, (c.predicted_abundance - f.abundance) / f.abundance AS pct_error,
    log10(c.predicted_abundance / f.abundance) AS log10_ratio
  FROM candidates c JOIN choice USING (series_id, model) LEFT JOIN feat f ON f.series_id = c.series_id AND f.t = c.t)"""


def run(spark, sf_dir, **options):
    return forecast(pa.supplier_features(spark, sf_dir), SINGLES, YEARS, SLIDE, TOP, **options)


@query(
    "q_skill_table",
    f"WITH {TABLES} SELECT series_id, model, regexp_replace(model, '_', ' ') AS label, {sql.columns(METRICS, 5)} FROM tbl "
    "UNION ALL SELECT series_id, 'naive', 'naive', 1, 2, 3, 4 FROM best",
)
def skill_table(spark, sf_dir):
    """Best individual, weighted schemes and an outside benchmark."""
    result = run(spark, sf_dir)
    bench = result.performance.select(
        "series_id", F.lit("naive").alias("model"), *[F.lit(float(i + 1)).alias(m) for i, m in enumerate(METRICS)]
    )
    table = rp.skill_table(result.performance, result.skill, bench)
    return rounded(table, 5, *METRICS)


@query(
    "q_best_by_year",
    f"WITH {TABLES} SELECT series_id, t, model_name, {sql.columns(VALUES, 4)} FROM firsts",
)
def best_by_year(spark, sf_dir):
    return rounded(run(spark, sf_dir).best_by_year, 4, *VALUES)


@query("q_choose_scheme", f"WITH {TABLES} SELECT series_id, model FROM choice")
def choose_scheme(spark, sf_dir):
    return rp.choose_scheme(run(spark, sf_dir).skill_table)


CHOSEN_SQL = (
    f"WITH {TABLES} SELECT series_id, t, model_name, abundance, {sql.columns((*VALUES, 'error'), 4)}, "
    "round(pct_error, 6) AS pct_error, round(log10_ratio, 6) AS log10_ratio FROM chosen"
)


def _chosen_view(df):
    keep = ("series_id", "t", "model_name", "abundance")
    return shown(df, keep, {4: (*VALUES, "error"), 6: ("pct_error", "log10_ratio")})


@query("q_chosen", CHOSEN_SQL)
def forecast_run(spark, sf_dir):
    """The whole run: the chosen scheme's forecasts of every series."""
    return _chosen_view(run(spark, sf_dir).chosen)


@query("q_supplied", CHOSEN_SQL)
def supplied(spark, sf_dir):
    """Forecasts written earlier and read back replace the fitting."""
    path = writers.scratch_path(spark, "forecasts")
    writers.write_results({"forecasts": fits(spark, sf_dir)}, path, partition_by=["t"])
    earlier = readers.read_forecasts(spark, f"{path}/forecasts")
    return _chosen_view(run(spark, sf_dir, supplied=earlier).chosen)


@query("q_refresh", CHOSEN_SQL)
def refresh(spark, sf_dir):
    """Only the last two origins are refitted; stale rows of the store are replaced."""
    old = stored_fits(spark, sf_dir, ()).withColumn("_end", F.max("t").over(Window.partitionBy("series_id")))
    stale = F.col("t") > F.col("_end") - 2
    old = old.withColumn(
        "predicted_abundance", F.when(stale, F.lit(1.0)).otherwise(F.col("predicted_abundance"))
    ).drop("_end")
    return _chosen_view(run(spark, sf_dir, supplied=old, update_last_year=True).chosen)


@query("q_refresh_state", CHOSEN_SQL)
def refresh_from_state(spark, sf_dir):
    """The last two origins are refitted from stored sums of all earlier rows; the history is not read for it."""
    features = pa.supplier_features(spark, sf_dir).withColumn("_end", F.max("t").over(Window.partitionBy("series_id")))
    features = writers.cut_lineage(features, "features")
    earlier, new = features.filter("t <= _end - 2").drop("_end"), writers.cut_lineage(features.filter("t > _end - 2").drop("_end"), "new")
    # the sums as they were two times ago: those of three times ago and one time's rows
    state = writers.cut_lineage(build_state(features.filter("t <= _end - 3"), SINGLES), "state")
    state = writers.cut_lineage(advance_state(state, features.filter("t = _end - 2"), SINGLES), "state")
    fresh = forecast_new(state, new, SINGLES, carry=["period"])
    fresh = writers.cut_lineage(fresh, "fresh").filter("error IS NULL").drop("error")
    old = stored_fits(spark, sf_dir, ()).join(fresh.select("series_id", "t", "model"), ["series_id", "t", "model"], "left_anti")
    return _chosen_view(run(spark, sf_dir, supplied=old.unionByName(fresh)).chosen)


TWO_PERIODS = (
    CHOSEN_SQL.replace(f"WHERE t > last_t - {LAST} AND", f"WHERE t % 2 = 1 AND t // 2 > last_t // 2 - {LAST} AND")
    .replace("fits AS (\n  SELECT series_id, t, abundance,", "fits AS (\n  SELECT series_id, CAST(t // 2 AS INTEGER) AS t, abundance,")
    .replace("LEFT JOIN feat f ON f.series_id = c.series_id AND f.t = c.t", "LEFT JOIN feat f ON f.series_id = c.series_id AND f.t = 2 * c.t + 1")
    .replace(" SELECT series_id, t, model_name, abundance, ", " SELECT series_id, 2 AS period, t, model_name, abundance, ")
)


@query("q_chosen_two_period", TWO_PERIODS)
def chosen_two_period(spark, sf_dir):
    """The whole run on months as halves of two-month times, the second half forecast after the first."""
    halves = {"period": (F.col("t") % 2 + 1).cast("int"), "t": F.floor(F.col("t") / 2).cast("int")}
    rows = pa.supplier_features(spark, sf_dir).withColumns(halves)
    result = forecast(rows, SINGLES, YEARS, SLIDE, TOP, freq=2, first_period=2)
    keep = ("series_id", "period", "t", "model_name", "abundance")
    return shown(result.chosen, keep, {4: (*VALUES, "error"), 6: ("pct_error", "log10_ratio")})


@query("q_write_snapshot", FIT_SQL)
def write_snapshot(spark, sf_dir):
    """A published table whose refitted times are published again, beside the old ones."""
    path = writers.scratch_path(spark, "published")
    everything = writers.cut_lineage(fits(spark, sf_dir).select("series_id", "t", "model", *FIT_COLUMNS, "aicc"), "fits")
    end = everything.agg(F.max("t")).first()[0] or 0
    snapshots.publish(everything.withColumn("aicc", F.when(F.col("t") < end - 1, F.col("aicc"))), path)
    snapshots.publish(everything.filter(F.col("t") >= end - 1), path)
    return _fit_view(snapshots.snapshot(spark, path))


@query(
    "q_chart_data",
    f"""WITH {TABLES} SELECT series_id, t, 'forecast' AS chart, line, round(value, 4) AS value FROM (
    SELECT series_id, t, v.line, v.value FROM chosen, LATERAL (VALUES ('abundance', abundance),
      ('predicted_abundance', predicted_abundance), ('lo_50', lo_50), ('hi_50', hi_50), ('lo_95', lo_95),
      ('hi_95', hi_95)) v(line, value))
    UNION ALL SELECT series_id, t, 'relative_error', regexp_replace(model_name, '_', ' '), round(log10_ratio, 4) FROM chosen
    UNION ALL SELECT series_id, t, 'benchmark', 'benchmark', round(predicted_abundance, 4) FROM firsts""",
)
def chart_data(spark, sf_dir):
    result = run(spark, sf_dir)
    return rounded(rp.chart_data(result.chosen, result.best_by_year), 4, "value")


@query(
    "q_rerank",
    f"WITH {sql.scored(metric='mape')}, again AS (SELECT * EXCLUDE (rank, end_t, end_target) FROM ranked), "
    f"{sql.ranked('again', 'aicc').replace('ranked AS', 'reranked AS')} SELECT series_id, t, model, rank FROM reranked",
)
def rerank(spark, sf_dir):
    """Ranked by MAPE, then re-ranked by the screening metric before weighting."""
    return ro.rank_models(ranked(spark, sf_dir, "mape"), "aicc").select("series_id", "t", "model", "rank")


# --- sinks -------------------------------------------------------------------


@query(
    "q_write_results",
    f"WITH {TABLES} SELECT 'performance' AS name, count(*) AS n, round(sum(mape), 3) AS total FROM best UNION ALL "
    "SELECT 'top_models', count(*), round(sum(predicted_abundance), 3) FROM top",
)
def write_results(spark, sf_dir):
    """Results written as partitioned parquet and as text, summarised after reading back."""
    result = run(spark, sf_dir)
    path = writers.scratch_path(spark, "results")
    parquet = writers.write_results({"performance": result.performance}, path)
    text = writers.write_results({"top_models": result.top_models}, path, ["t"], "csv")
    performance = spark.read.parquet(parquet["performance"])
    top = spark.read.csv(text["top_models"], header=True, nullValue="NA").select(
        F.col("predicted_abundance").try_cast("double")
    )
    return performance.agg(
        F.lit("performance").alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum("mape"), 3).alias("total")
    ).unionByName(
        top.agg(
            F.lit("top_models").alias("name"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("predicted_abundance"), 3).alias("total"),
        )
    )


@query(
    "q_write_tasks",
    f"WITH {sql.FITS} SELECT t - 1 AS origin_year, model, count(*) AS n, round(sum(predicted_abundance), 3) AS total "
    "FROM fits GROUP BY 1, 2",
)
def write_tasks(spark, sf_dir):
    """One folder per (origin, model) beside a combined table, read back by folder."""
    path = writers.scratch_path(spark, "tasks")
    writers.write_tasks(stored_fits(spark, sf_dir, ()).select("series_id", "t", "model", "predicted_abundance"), path)
    back = spark.read.parquet(f"{path}/by_task")
    return back.groupBy("origin_year", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("predicted_abundance"), 3).alias("total")
    )


@query("q_write_refresh", FIT_SQL)
def refresh_store(spark, sf_dir):
    """A stored table whose touched time partitions alone are rewritten."""
    path = writers.scratch_path(spark, "store")
    everything = stored_fits(spark, sf_dir, ()).select("series_id", "t", "model", *FIT_COLUMNS, "aicc")
    end = everything.agg(F.max("t")).first()[0] or 0  # the refit replaces the last two times
    stale = everything.withColumn("aicc", F.when(F.col("t") < end - 1, F.col("aicc")))
    stale.write.partitionBy("t").parquet(f"{path}/forecasts")
    new = everything.filter(F.col("t") >= end - 1)
    refresh_table(readers.read_forecasts(spark, f"{path}/forecasts"), new, f"{path}/forecasts")
    return _fit_view(readers.read_forecasts(spark, f"{path}/forecasts"))
