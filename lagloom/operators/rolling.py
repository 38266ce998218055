"""Trailing performance of models and their ranking.

``forecasts`` has one row per (keys, time, model).  Trailing operators share the
partitioning (keys, model), ranking and weighting the partitioning (keys, time),
so scoring a whole panel takes one shuffle for each.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.metrics import abs_log_ratio, abs_pct_error, accuracy, sq_error
from lagloom.functions.safe import as_list, per_key, ratio, spread
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS
from lagloom.sources.session import ship


def with_obs(
    forecasts: DataFrame,
    series: DataFrame,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str = "abundance",
) -> DataFrame:
    """Observations on forecasts; joins on the period as well where both have one."""
    on = [*as_list(keys), time]
    if "period" in forecasts.columns and "period" in series.columns and "period" not in on:
        on.append("period")
    return forecasts.drop(value).join(series.select(*on, value), on, "left")


def score_rows(fc: DataFrame) -> DataFrame:
    """Error terms of each row: observed minus predicted, and its relatives."""
    o, p = F.col("abundance"), F.col("predicted_abundance")
    return fc.withColumns({"error": o - p, "ape": abs_pct_error(o, p)})


def past_entry(fc: DataFrame, time: str = "t") -> Column:
    """The scored terms of one row, as later rows look back at them."""
    o, p = F.col("abundance"), F.col("predicted_abundance")
    aicc = F.col("aicc") if "aicc" in fc.columns else F.lit(None)
    return F.struct(
        F.col(time).cast("int").alias("at"),
        abs_pct_error(o, p).alias("ape"),
        sq_error(o, p).alias("se"),
        abs_log_ratio(o, p).alias("alr"),
        aicc.cast("double").alias("aicc"),
    )


def score_grid(
    fc: DataFrame,
    rows: int,
    grid: Column,
    window: str,
    alpha: str,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    wanted: Column | None = None,
    deal: Iterable[str] | None = None,
) -> DataFrame:
    """Trailing MAPE and window metrics of every row for every value of ``grid``; of the ``wanted`` rows alone, if given.

    ``window`` and ``alpha`` are SQL expressions of ``grid``; no window may
    exceed ``rows``.  The trailing MAPE counts rows back (NULL unless ``window``
    of them are there), the window metrics count times back; the j-th back
    weighs (1 - alpha)^j.

    A row keeps its recent past as one array, from which a batch of rows is scored for the
    whole grid at once.  Rows move by (keys, model) to look back and then by keys and time,
    each with its scores as arrays; the grid multiplies them after that.  With ``deal``, some of the
    keys, they are taken as lying together by these and look back where they are, and then move by
    these.  As the rows of a task are multiplied, so is the number of tasks.
    """
    by = [*as_list(keys), "model", time]
    order = Window.partitionBy(*by[:-1]).orderBy(time)
    past = F.collect_list(past_entry(fc, time)).over(order.rowsBetween(-rows, -1))
    kept = [*by, *[c for c in fc.columns if c not in by]]
    wide = (fc if deal else spread(fc, *by[:-1])).withColumn("_past", past)
    if wanted is not None:
        wide = wide.filter(wanted)
    spark = fc.sparkSession
    steps = spark.sql("SELECT 1 AS _").select(F.explode(grid).alias("grid"))
    steps = steps.select("grid", F.expr(window).cast("double"), F.expr(alpha).cast("double")).collect()  # the caller's grid
    grids, lengths, decays = ([r[i] for r in steps] for i in range(3))
    names = ("mape", "w_rmse", "w_mape", "w_msa", "w_aicc")

    def scores(now: pa.Array, past: pa.Array) -> pa.Array:
        return _grid_scores(now, past, rows, np.array(lengths), np.array(decays), names)

    ship(spark)
    shape = ", ".join(f"{c}: array<double>" for c in names)
    wide = wide.withColumn("_s", F.arrow_udf(scores, f"struct<{shape}>")(F.col(time).cast("int"), "_past")).select(*kept, "_s.*")
    wide = spread(wide, *(deal or [*as_list(keys), time]), times=max(len(grids), 1))
    values = F.array(*[F.lit(g) for g in grids]) if grids else F.array().cast("array<int>")
    cells = F.explode(F.arrays_zip(values.alias("grid"), *[F.col(c).alias(c) for c in names])).alias("_c")
    return wide.select(*kept, cells).select(*kept, "_c.*").select(*kept, F.col("grid"), *names)


def _grid_scores(now: pa.Array, past: pa.Array, rows: int, window: np.ndarray, alpha: np.ndarray, names: Iterable[str]) -> pa.Array:
    """The metrics of ``score_grid`` as one array per row and metric, NULL where undefined; ``past`` has the oldest entry first."""
    entries, ends, t = past.values, past.offsets.to_numpy()[1:], now.to_numpy(zero_copy_only=False)
    lengths, shape = np.diff(past.offsets.to_numpy()), (len(t), len(window))
    column = {c: pc.struct_field(entries, c) for c in ("at", "ape", "se", "alr", "aicc")}
    is_known = {c: v.is_valid().to_numpy(zero_copy_only=False) for c, v in column.items()}
    value = {c: np.where(is_known[c], v.to_numpy(zero_copy_only=False), 0.0) for c, v in column.items()}
    sums = {c: np.zeros(shape) for c in ("back", "roll", "se", "se_w", "ape", "ape_w", "alr", "alr_w")}
    seen, latest, has_latest, settled = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    with np.errstate(all="ignore"):
        for j in range(1, rows + 1):
            own = np.flatnonzero(lengths >= j)
            if not len(own):
                break
            at = ends[own] - j
            near = np.broadcast_to(j <= window, (len(own), len(window)))
            age = (t[own] - value["at"][at])[:, None]
            back = np.where(near, (1 - alpha) ** j, 0.0)
            known = is_known["ape"][at][:, None]
            sums["back"][own] += back
            sums["roll"][own] += np.where(known, value["ape"][at][:, None] * back, 0.0)
            seen[own] += near & known
            used = near & (age <= window) & is_known["se"][at][:, None]
            weight = np.where(used, (1 - alpha) ** age, 0.0)
            for c in ("se", "ape", "alr"):
                share = used & is_known[c][at][:, None]
                sums[c][own] += np.where(share, value[c][at][:, None] * weight, 0.0)
                sums[c + "_w"][own] += np.where(share, weight, 0.0)
            first = used & ~settled[own]
            latest[own] = np.where(first, value["aicc"][at][:, None], latest[own])
            has_latest[own] |= first & is_known["aicc"][at][:, None]
            settled[own] |= used
        mean = {c: sums[c] / sums[c + "_w"] for c in ("se", "ape", "alr")}
        out = {
            "mape": (100 * (sums["roll"] / sums["back"]), (seen == window) & (sums["back"] != 0)),
            "w_rmse": (np.sqrt(mean["se"]), sums["se_w"] != 0),
            "w_mape": (mean["ape"], sums["ape_w"] != 0),
            "w_msa": (100 * (np.exp(mean["alr"]) - 1), sums["alr_w"] != 0),
            "w_aicc": (latest, has_latest),
        }
    cuts = pa.array(np.arange(len(t) + 1) * len(window), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(out[c][0].ravel(), mask=~out[c][1].ravel())) for c in names]
    return pa.StructArray.from_arrays(lists, list(names))


def score_array(fc: DataFrame, past: str, time: str, slide: str, alpha: float, wanted: Iterable[str]) -> DataFrame:
    """Decay-weighted metrics of one row from its ``past`` entries, oldest first."""
    weight = f"pow(1 - {alpha}D, {time} - e.at)"
    start, fields = ["'aicc', CAST(NULL AS DOUBLE)"], []
    inside = f"e.at >= {time} - {slide} AND e.se IS NOT NULL"
    for term in ("se", "ape", "alr"):
        used = f"{inside} AND e.{term} IS NOT NULL"
        start += [f"'{term}', 0D", f"'{term}_w', 0D"]
        fields += [
            f"IF({used}, acc.{term} + e.{term} * {weight}, acc.{term}) AS {term}",
            f"IF({used}, acc.{term}_w + {weight}, acc.{term}_w) AS {term}_w",
        ]
    fields.insert(0, f"IF({inside}, e.aicc, acc.aicc) AS aicc")
    totals = f"aggregate({past}, named_struct({', '.join(start)}), (acc, e) -> struct({', '.join(fields)}))"
    s = F.col("_s")
    metrics = {
        "mape": 100 * ratio(s["ape"], s["ape_w"]),
        "w_rmse": F.sqrt(ratio(s["se"], s["se_w"])),
        "w_mape": ratio(s["ape"], s["ape_w"]),
        "w_msa": 100 * (F.exp(ratio(s["alr"], s["alr_w"])) - 1),
        "w_aicc": s["aicc"],
    }
    return fc.withColumn("_s", F.expr(totals)).withColumns({m: metrics[m] for m in wanted}).drop(past, "_s")


def rolling_mape(
    fc: DataFrame,
    window: int,
    alpha: float = 0.0,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    name: str = "mape",
) -> DataFrame:
    """Trailing MAPE as known before each row's own time."""
    frame = Window.partitionBy(*as_list(keys), "model").orderBy(time).rowsBetween(-window, -1)
    if alpha:
        step = F.row_number().over(Window.partitionBy(*as_list(keys), "model").orderBy(time))
        numbered = fc.withColumn("_row", step)
        past = numbered.withColumn("_past", F.collect_list(past_entry(numbered, "_row")).over(frame))
        whole = F.expr(f"size(_past) = {window} AND forall(_past, e -> e.ape IS NOT NULL)")
        scored = score_array(past.withColumn("_whole", whole), "_past", "_row", str(window), float(alpha), ["mape"])
        value = F.when(F.col("_whole"), F.col("mape"))
        return scored.withColumn("mape", value).drop("_row", "_whole").withColumnRenamed("mape", name)
    ape = abs_pct_error(F.col("abundance"), F.col("predicted_abundance"))
    full = F.count(ape).over(frame) == window
    return fc.withColumn(name, F.when(full, 100 * F.avg(ape).over(frame)))


def rank_models(
    fc: DataFrame,
    metric: str = "mape",
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    name: str = "rank",
    tie: str = "average",
) -> DataFrame:
    """Rank of each model within its time, ties averaged, undefined metrics unranked.

    ``tie="first"`` breaks ties by model instead.  Both window functions read the
    same sorted partition.
    """
    within = Window.partitionBy(*as_list(keys), time).orderBy(F.col(metric).asc_nulls_last())
    if tie == "first":
        broken = Window.partitionBy(*as_list(keys), time).orderBy(
            F.col(metric).asc_nulls_last(), "model"
        )
        rank = F.row_number().over(broken).cast("double")
    else:
        peers = within.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(within) + (F.count(F.lit(1)).over(peers) - 1) / 2
    return fc.withColumn(name, F.when(F.col(metric).isNotNull(), rank))


def with_bounds(fc: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """Attach each series' last time and last observed time, unless already there."""
    if "series_end" in fc.columns:
        return fc
    observed = F.max(F.when(F.col("abundance").isNotNull(), F.col(time)))
    return per_key(fc, keys, F.max(time).alias("series_end"), observed.alias("series_observed"))


def with_bounds_in_place(fc: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """``with_bounds`` for rows that lie together by their keys: neither they nor the bounds move.

    As there, a row without its whole key has no bounds.  Rows are sorted as models look back, and so only once.
    """
    if "series_end" in fc.columns:
        return fc
    ordered = Window.partitionBy(*as_list(keys)).orderBy("model", time)
    series = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    observed = F.max(F.when(F.col("abundance").isNotNull(), F.col(time))).over(series)
    known = reduce(and_, [F.col(c).isNotNull() for c in as_list(keys)])
    return fc.withColumns({"series_end": F.when(known, F.max(time).over(series)), "series_observed": F.when(known, observed)})


def top_models(
    ranked: DataFrame, n: int, years: int, keys: str | Iterable[str] = KEYS, time: str = "t"
) -> DataFrame:
    """Rows ranked ``n`` or better in the last ``years`` times of their series."""
    recent = F.col(time) > F.col("series_end") - years
    return with_bounds(ranked, keys, time).filter(recent & (F.col("rank") <= n))


def with_names(fc: DataFrame, candidates: Candidates) -> DataFrame:
    """Model names; how to join the table is left to the optimizer."""
    return fc.join(candidates.table(fc.sparkSession).select("model", "model_name"), "model", "left")


def best_individual(top: DataFrame, keys: str | Iterable[str] = KEYS, time: str = "t") -> DataFrame:
    """Accuracy of the model ranked first at each time."""
    return accuracy(top.filter(F.col("rank") == 1), as_list(keys), time)
