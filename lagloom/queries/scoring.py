"""Candidates, backtests, metrics, rolling performance, ensembles and stacking."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import functions as F

from lagloom.functions import metrics as me
from lagloom.operators import backtest as bt
from lagloom.operators import ensemble as en
from lagloom.operators import features as op
from lagloom.operators import report as rp
from lagloom.operators import rolling as ro
from lagloom.operators import stacking as st
from lagloom.operators.candidates import Candidates, with_labels
from lagloom.operators.error_orders import choose_differences, fit_orders
from lagloom.operators.fit_linear import fit_ar, fit_linear
from lagloom.operators.screen import screen_subsets
from lagloom.operators.subsets import best_subset, screen_all
from lagloom.plans.forecast import score
from lagloom.queries import panels as pa
from lagloom.queries import sql
from lagloom.queries import sql_orders as so
from lagloom.queries.registry import query, rounded, shown
from lagloom.queries.sql import LAST, METRICS, SLIDE, TOP, VALUES, YEARS
from lagloom.sources.writers import cut_lineage

SINGLES = Candidates(pa.COVARIATES, 0, 1)
PAIRS = Candidates(pa.COVARIATES, 2, 2)


def fits(spark, sf_dir, candidates=SINGLES, fitter=fit_linear, last=LAST, **options):
    return bt.succeeded(bt.backtest(pa.supplier_features(spark, sf_dir), candidates, last, fitter, **options))


def observed_fits(spark, sf_dir, **options):
    return fits(spark, sf_dir, carry=["abundance"], **options)


def ranked(spark, sf_dir, metric="aicc", alpha=0.0, stretch=False):
    return score(stored_fits(spark, sf_dir), YEARS, SLIDE, alpha, metric, stretch)


def stored_fits(spark, sf_dir, carry=("abundance",)):
    """Fits written once and then filtered, as every later step reads them.

    A filter on ``error`` before that would go below the fits and repeat them in itself.
    """
    every = bt.backtest(pa.supplier_features(spark, sf_dir), SINGLES, LAST, carry=carry)
    return bt.succeeded(cut_lineage(every, "fits"))


LAGGED = f"""{pa.SUP_FEATURES}, lags AS (
  SELECT series_id, t, abundance, CASE WHEN abundance > 0 THEN ln(abundance) END AS y, max(t) OVER (PARTITION BY series_id) AS last_t,
    lag(CASE WHEN abundance > 0 THEN ln(abundance) END) OVER (PARTITION BY series_id ORDER BY t) AS x FROM feat)"""

ORDERS_BY_SUMS = """sums AS (
  SELECT *, count(y) OVER w AS n0, var_pop(y) OVER w * count(y) OVER w AS rss0, avg(y) OVER w AS mu0 FROM lags
  WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
with_lag AS (
  SELECT *, regr_count(y, x) OVER w AS n1, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a,
    regr_sxx(y, x) OVER w AS sxx, regr_syy(y, x) OVER w - regr_slope(y, x) OVER w * regr_sxy(y, x) OVER w AS rss1
  FROM lags WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
each AS (
  SELECT series_id, t, last_t, 0 AS p, mu0 AS mu, mu0 AS a, 0.0 AS b, n0 * (ln(2 * pi() * rss0 / n0) + 1) + 4 + 12.0 / (n0 - 3) AS aicc
  FROM sums WHERE n0 > 3 AND rss0 > 0 UNION ALL
  SELECT series_id, t, last_t, 1, a + b * x, a, b, n1 * (ln(2 * pi() * rss1 / n1) + 1) + 6 + 24.0 / (n1 - 4)
  FROM with_lag WHERE n1 > 4 AND sxx > 1e-9 AND rss1 > 0)"""


# --- candidates --------------------------------------------------------------

MASKS = (
    "subsets AS (SELECT m, list_filter(["
    + ", ".join(f"CASE WHEN m & {1 << i} > 0 THEN '{c}' END" for i, c in enumerate(pa.COVARIATES))
    + "], lambda c: c IS NOT NULL) AS covariates, list_filter(["
    + ", ".join(f"CASE WHEN m & {1 << i} > 0 THEN {i} END" for i in range(len(pa.COVARIATES)))
    + f"], lambda c: c IS NOT NULL) AS pos FROM range({1 << len(pa.COVARIATES)}) r(m) WHERE m > 0),\n"
    "numbered AS (SELECT CAST(row_number() OVER (ORDER BY len(pos), pos) AS INTEGER) AS model, pos, "
    "array_to_string(covariates, ' + ') AS model_name FROM subsets)"
)


@query(
    "q_subsets",
    f"WITH {pa.SUP}, {MASKS} SELECT series_id, n, model, model_name, 'abundance ~ ' || model_name AS formula "
    "FROM (SELECT series_id, count(*) AS n FROM sup GROUP BY 1), numbered",
)
def subsets(spark, sf_dir):
    """Every subset of the covariates for every series of the panel."""
    sizes = pa.supplier_months(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    every = Candidates(pa.COVARIATES, 1, len(pa.COVARIATES))
    return with_labels(every.pair(sizes)).select("series_id", "n", "model", "model_name", "formula")


@query(
    "q_model_list",
    f"WITH {sql.FITS} SELECT model, model_name, count(*) AS n_fits FROM fits GROUP BY 1, 2",
)
def model_list(spark, sf_dir):
    """Number and name of each candidate with how often it was fitted."""
    named = ro.with_names(fits(spark, sf_dir), SINGLES)
    return named.groupBy("model", "model_name").agg(F.count(F.lit(1)).alias("n_fits"))


@query(
    "q_complete_cases",
    f"WITH {pa.SUP_FEATURES} SELECT series_id, t, abundance, lag12_log_qty FROM (SELECT series_id, t, abundance, "
    "round(lag12_log_qty, 6) AS lag12_log_qty FROM lagged) WHERE abundance IS NOT NULL AND lag12_log_qty IS NOT NULL",
)
def complete_cases(spark, sf_dir):
    panel = op.complete_spine(pa.supplier_months(spark, sf_dir).select("series_id", "t", "abundance"))
    panel = op.log_lag_feature(panel, "abundance", 12, "lag12_log_qty")
    return rounded(op.drop_incomplete(panel, ["abundance", "lag12_log_qty"]), 6, "lag12_log_qty")


@query(
    "q_screen",
    f"""WITH {pa.SUP_FEATURES}, long AS (SELECT series_id, ln(abundance) AS y, m.* FROM feat, LATERAL {sql.MODELS}
    WHERE abundance IS NOT NULL), s AS (SELECT series_id, model, model_name, count(*) AS n,
    regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM long GROUP BY 1, 2, 3)
    SELECT series_id, model, 'abundance ~ ' || model_name AS formula, n AS n_obs,
    round(n * (ln(2 * pi() * rss / n) + 1) + 6 + 24.0 / (n - 4), 6) AS aicc FROM s""",
)
def screen(spark, sf_dir):
    return rounded(screen_subsets(pa.supplier_features(spark, sf_dir), SINGLES), 6, "aicc")


@query(
    "q_screen_ordered",
    f"""WITH {pa.SUP_FEATURES}, long AS (SELECT series_id, ln(abundance) AS y, m.* FROM feat, LATERAL {sql.MODELS}
    WHERE abundance IS NOT NULL), s AS (SELECT series_id, model, count(*) AS n,
    regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM long GROUP BY 1, 2),
    a AS (SELECT series_id, model, n * (ln(2 * pi() * rss / n) + 1) + 6 + 24.0 / (n - 4) AS aicc FROM s)
    SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY aicc NULLS LAST, model) AS position FROM a""",
)
def screen_ordered(spark, sf_dir):
    """The screen with each model's position in its series, the best first."""
    table = screen_subsets(pa.supplier_features(spark, sf_dir), SINGLES)
    return rp.ordered_table(table, by="aicc").select("series_id", "model", "position")


# Two covariates: the closed-form solution of the centred normal equations.
PAIR_SQL = f"""{pa.SUP_FEATURES}, {MASKS.replace("m > 0", "bit_count(m) = 2")},
long AS (SELECT series_id, t, abundance, CASE WHEN abundance > 0 THEN ln(abundance) END AS y,
  max(t) OVER (PARTITION BY series_id) AS last_t, model, model_name,
  [{", ".join(pa.COVARIATES)}][pos[1] + 1] AS x1, [{", ".join(pa.COVARIATES)}][pos[2] + 1] AS x2
  FROM feat, numbered),
s AS (SELECT *, regr_count(y, x1) OVER w AS n, regr_avgy(y, x1) OVER w AS my, regr_avgx(y, x1) OVER w AS m1,
  regr_avgx(y, x2) OVER w AS m2, regr_sxx(y, x1) OVER w AS s11, regr_sxx(y, x2) OVER w AS s22,
  regr_sxy(CASE WHEN y IS NOT NULL THEN x1 END, x2) OVER w AS s12, regr_sxy(y, x1) OVER w AS s1y,
  regr_sxy(y, x2) OVER w AS s2y, regr_syy(y, x1) OVER w AS syy FROM long
  WINDOW w AS (PARTITION BY series_id, model ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
  (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s WHERE t > last_t - {LAST} AND n > 5),
pairfits AS (SELECT series_id, t, model, model_name, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS mu,
  syy - b1 * s1y - b2 * s2y AS rss, n FROM b)"""


@query(
    "q_backtest_gram",
    f"WITH {PAIR_SQL} SELECT series_id, t, model, round(exp(mu), 4) AS predicted_abundance, "
    "round(n * (ln(2 * pi() * rss / n) + 1) + 8 + 40.0 / (n - 5), 6) AS aicc, round(rss / (n - 3), 8) AS sigma2 FROM pairfits",
)
def backtest_gram(spark, sf_dir):
    """Every pair of covariates solved from the shared sums of products."""
    out = fits(spark, sf_dir, PAIRS)
    return shown(out, ("series_id", "t", "model"), {4: ("predicted_abundance",), 6: ("aicc",), 8: ("sigma2",)})


def _subset_sql(response: str, lagged: bool, whole: bool) -> str:
    """Tables up to ``fitted``: all subsets of the covariates, each by its own elimination, with the lagged response or not."""
    n = len(pa.COVARIATES)
    sets = sorted((c for size in range(1, n + 1) for c in combinations(range(n), size)), key=lambda c: (len(c), c)) + [()]
    tables, parts = [], []
    pool = [f"x{i}" for i in range(n)] + ["z1"] * lagged
    for number, chosen in enumerate(sets, 1):
        xs = [f"x{i}" for i in chosen] + ["z1"] * lagged
        params = len(xs) + 2
        tables.append(so.regression(f"s{number}", "design", xs, [*pool, "z"], "series_id", "t"))
        parts.append(
            f"SELECT series_id, t, last_t, level, {number} AS model, n, mu, rss, rss / (n - {len(xs) + 1}) AS sigma2, n * (ln(2 * pi() * rss / n) + 1) "
            f"+ {2 * params} + {2.0 * params * (params + 1)} / (n - {params + 1}) AS aicc FROM s{number} WHERE n > {params + 1} AND rss > 1e-12 * c0_z_z"
        )
    own = ", ".join(f"{c} - avg({c}) OVER s AS x{i}" for i, c in enumerate(pa.COVARIATES))
    # for the whole sample a row after the last holds the sums of all rows
    rows = "feat" if not whole else (
        f"(SELECT series_id, t, abundance, {', '.join(pa.COVARIATES)} FROM feat WHERE abundance IS NOT NULL UNION ALL "
        f"SELECT series_id, max(t) + 1, NULL, {', '.join('0' for _ in pa.COVARIATES)} FROM feat GROUP BY 1)"
    )
    return f"""{pa.SUP_FEATURES}, design AS (
  SELECT series_id, t, max(t) OVER s AS last_t, coalesce(avg(ln(abundance)) OVER s, 0) AS level, ln(abundance) - avg(ln(abundance)) OVER s AS z,
    lag(ln(abundance)) OVER (PARTITION BY series_id ORDER BY t) - avg(ln(abundance)) OVER s AS z1, {own}
  FROM {rows} WINDOW s AS (PARTITION BY series_id)),
{", ".join(tables)}, fitted AS ({" UNION ALL ".join(parts)})"""


@query(
    "q_backtest_all_subsets",
    f"WITH {_subset_sql('abundance', True, False)} SELECT series_id, t, model, {so.bounds('(mu + level)', 'sigma2', 4)}, round(aicc, 6) AS aicc "
    f"FROM fitted WHERE t > last_t - {LAST} AND mu IS NOT NULL",
)
def backtest_all_subsets(spark, sf_dir):
    """All 15 subsets plus the intercept-only model with the lagged response in each."""
    every = Candidates(pa.COVARIATES, 0, len(pa.COVARIATES), include_null=True)
    return shown(fits(spark, sf_dir, every, ar=1), ("series_id", "t", "model"), {4: VALUES, 6: ("aicc",)})


ALL = Candidates(pa.COVARIATES, 0, len(pa.COVARIATES), include_null=True)


@query(
    "q_screen_all",
    f"WITH {_subset_sql('abundance', False, True)} SELECT series_id, model, n AS n_obs, round(aicc, 6) AS aicc FROM fitted WHERE t = last_t",
)
def screen_tree(spark, sf_dir):
    """Every subset and the empty one, each by one pivot more than its parent."""
    return rounded(screen_all(pa.supplier_features(spark, sf_dir), ALL), 6, "aicc").drop("formula").filter("aicc IS NOT NULL")


@query(
    "q_best_subset",
    f"WITH {_subset_sql('abundance', False, True)} SELECT series_id, arg_min(model, aicc) AS model, max(n) AS n_obs, round(min(aicc), 6) AS aicc "
    "FROM fitted WHERE t = last_t GROUP BY 1",
)
def best_by_bounds(spark, sf_dir):
    """The subset of least AICc, found without looking at branches whose bound is worse."""
    return rounded(best_subset(pa.supplier_features(spark, sf_dir), ALL), 6, "aicc").drop("formula", "visited")


@query(
    "q_screen_pairs",
    f"""WITH {PAIR_SQL.split("s AS (SELECT *,")[0]} g AS (SELECT series_id, model, model_name, count(*) AS n,
    regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1y,
    regr_sxy(y, x2) AS s2y, regr_syy(y, x1) AS syy FROM long WHERE y IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, syy - (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) * s1y
      - (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) * s2y AS rss FROM g)
    SELECT series_id, model, 'abundance ~ ' || model_name AS formula, n AS n_obs,
    round(n * (ln(2 * pi() * rss / n) + 1) + 8 + 40.0 / (n - 5), 6) AS aicc FROM r""",
)
def screen_pairs(spark, sf_dir):
    return rounded(screen_subsets(pa.supplier_features(spark, sf_dir), PAIRS), 6, "aicc")


# --- origins and backtests ---------------------------------------------------

ORIGINS = f"""origins AS (SELECT series_id, CAST(unnest(generate_series(last_t - 5, last_t - 1)) AS INTEGER) AS origin
  FROM (SELECT series_id, max(t) AS last_t FROM feat GROUP BY 1))"""


def _origins(spark, sf_dir):
    return bt.origins(pa.supplier_features(spark, sf_dir), 5, pa.COVARIATES)


@query("q_origins", f"WITH {pa.SUP_FEATURES}, {ORIGINS} SELECT *, origin + 1 AS target FROM origins")
def origins(spark, sf_dir):
    return _origins(spark, sf_dir)


@query(
    "q_tasks",
    f"WITH {pa.SUP_FEATURES}, {ORIGINS}, {MASKS} SELECT series_id, origin, origin + 1 AS target, model, model_name "
    "FROM origins, numbered WHERE len(pos) <= 2",
)
def tasks(spark, sf_dir):
    paired = bt.tasks(_origins(spark, sf_dir), Candidates(pa.COVARIATES, 0, 2))
    return with_labels(paired).select("series_id", "origin", "target", "model", "model_name")


@query(
    "q_split",
    f"WITH {pa.SUP_FEATURES}, {ORIGINS} SELECT series_id, origin, sum(CASE WHEN t <= origin THEN 1 ELSE 0 END)::BIGINT "
    "AS n_train, sum(CASE WHEN t > origin THEN 1 ELSE 0 END)::BIGINT AS n_test FROM feat JOIN origins USING (series_id) "
    "WHERE t <= origin + 1 GROUP BY 1, 2",
)
def split(spark, sf_dir):
    """Sizes of the training and target sets of each origin."""
    rows = bt.split(pa.supplier_features(spark, sf_dir), _origins(spark, sf_dir))
    return rows.groupBy("series_id", "origin").agg(
        F.count(F.when(F.col("train_test") == 0, 1)).alias("n_train"),
        F.count(F.when(F.col("train_test") == 1, 1)).alias("n_test"),
    )


@query(
    "q_design",
    f"""WITH {pa.SUP_FEATURES}, {MASKS} SELECT series_id, t, model,
    round(list_sum([{", ".join(f"CASE WHEN list_contains(pos, {i}) THEN {c} ELSE 0 END" for i, c in enumerate(pa.COVARIATES))}]), 6)
    AS total FROM feat, numbered WHERE len(pos) = 2""",
)
def design(spark, sf_dir):
    """Sum of each row's design vector under every pair of covariates."""
    rows = bt.design(PAIRS.pair(pa.supplier_features(spark, sf_dir)), pa.COVARIATES)
    total = F.aggregate("design", F.lit(0.0), lambda acc, v: acc + v)
    all_pairs = rows.select("series_id", "t", "model", F.round(total, 6).alias("total"))
    return all_pairs.withColumn("model", (F.col("model") + len(pa.COVARIATES)).cast("int"))


FIT_COLUMNS = ("predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95")
FIT_SQL = f"WITH {sql.FITS} SELECT series_id, t, model, {sql.columns(FIT_COLUMNS, 4)}, round(aicc, 6) AS aicc FROM fits"


def _fit_view(df):
    return shown(df, ("series_id", "t", "model"), {4: FIT_COLUMNS, 6: ("aicc",)})


@query("q_backtest_linear", FIT_SQL)
def backtest_linear(spark, sf_dir):
    return _fit_view(fits(spark, sf_dir))


@query(
    "q_backtest_two_period",
    f"""WITH {sql.FITS}, ends AS (SELECT series_id, max(t) AS end_t FROM feat GROUP BY 1)
    SELECT series_id, (t // 2)::INT AS t, 2 AS period, model, {sql.columns(FIT_COLUMNS, 4)}, round(aicc, 6) AS aicc
    FROM fits JOIN ends USING (series_id) WHERE t % 2 = 1 AND t // 2 > end_t // 2 - {LAST // 2}""",
)
def backtest_two_period(spark, sf_dir):
    """Months as halves of two-month times: the second half forecast from all months before it."""
    rows = pa.supplier_features(spark, sf_dir)
    halves = {"period": (F.col("t") % 2 + 1).cast("int"), "t": F.floor(F.col("t") / 2).cast("int")}
    out = bt.succeeded(bt.backtest(rows.withColumns(halves), SINGLES, LAST // 2, freq=2, first_period=2))
    return shown(out, ("series_id", "t", "period", "model"), {4: FIT_COLUMNS, 6: ("aicc",)})


@query(
    "q_intervals",
    f"""WITH {sql.FITS} SELECT series_id, t, model, round(ln(hi_95 / lo_95) / ln(hi_50 / lo_50), 6) AS width_ratio,
    round(sqrt(lo_95 * hi_95) / predicted_abundance, 6) AS centre FROM fits""",
)
def interval_shape(spark, sf_dir):
    """Bounds symmetric around the median on the log scale."""
    width = F.ln(F.col("hi_95") / F.col("lo_95")) / F.ln(F.col("hi_50") / F.col("lo_50"))
    centre = F.sqrt(F.col("lo_95") * F.col("hi_95")) / F.col("predicted_abundance")
    return fits(spark, sf_dir).select(
        "series_id", "t", "model", F.round(width, 6).alias("width_ratio"), F.round(centre, 6).alias("centre")
    )


@query(
    "q_with_model",
    f"WITH {sql.FITS} SELECT series_id, t, model, round(a, 5) AS intercept, round(b, 5) AS slope, '0000100' AS arma, "
    "round(sigma2, 8) AS sigma2 FROM fits",
)
def with_model(spark, sf_dir):
    """The fitted model struct: coefficients, order digits and variance."""
    out = bt.with_model(fits(spark, sf_dir))
    slope = F.element_at(F.map_values("mod.coef"), 2)
    return out.select(
        "series_id",
        "t",
        "model",
        F.round(F.element_at("mod.coef", "intercept"), 5).alias("intercept"),
        F.round(slope, 5).alias("slope"),
        bt.order_text().alias("arma"),
        F.round("mod.sigma2", 8).alias("sigma2"),
    )


@query(
    "q_fitted",
    f"""WITH {sql.FITS} SELECT f.series_id, f.t AS target, f.model, count(*) AS n, round(avg(exp(f.a + f.b * l.x)), 4) AS fitted
    FROM fits f JOIN long l ON l.series_id = f.series_id AND l.model = f.model AND l.t < f.t GROUP BY 1, 2, 3""",
)
def fitted(spark, sf_dir):
    """Mean in-sample value and number of training rows of each fit."""
    series = pa.supplier_features(spark, sf_dir)
    forecasts = bt.backtest(series, SINGLES, LAST)
    rows = bt.fitted_values(series.select("series_id", "t", *pa.COVARIATES), forecasts)
    return rows.groupBy("series_id", "target", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 4).alias("fitted")
    )


@query(
    "q_fitted_ar",
    f"""WITH {LAGGED}, {ORDERS_BY_SUMS}, chosen AS (
  SELECT series_id, t, arg_min(p, aicc) AS p, arg_min(a, aicc) AS a, arg_min(b, aicc) AS b FROM each WHERE t > last_t - {LAST} GROUP BY 1, 2)
SELECT c.series_id, c.t AS target, count(*) AS n, round(avg(exp(a + b * coalesce(l.x, 0))), 4) AS fitted FROM chosen c
JOIN lags l ON l.series_id = c.series_id AND l.t < c.t WHERE p = 0 OR l.x IS NOT NULL GROUP BY 1, 2""",
)
def fitted_ar(spark, sf_dir):
    """The same of fits whose autoregressive order is chosen by AICc."""
    series = pa.supplier_features(spark, sf_dir)
    forecasts = bt.backtest(series, Candidates((), 0, 0), LAST, fit_ar, max_p=1)
    rows = bt.fitted_values(series.select("series_id", "t", "abundance"), forecasts, value="abundance")
    return rows.filter("fitted IS NOT NULL").groupBy("series_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 4).alias("fitted")
    )


@query(
    "q_failed_fits",
    f"""WITH {pa.SUP_FEATURES}, long AS (SELECT series_id, t, abundance, max(t) OVER (PARTITION BY series_id) AS last_t,
    count(abundance) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM feat)
    SELECT series_id, t, m.model, m.n_params, CASE WHEN n <= n_params + 1 THEN 'too few observations'
      ELSE 'singular design' END AS error FROM long, (VALUES (1, 3), (2, 3)) m(model, n_params)
    WHERE t IS NOT NULL AND (m.model = 2 OR n <= n_params + 1)""",
)
def failed_fits(spark, sf_dir):
    """All origins, early ones included, with one constant covariate: failures only."""
    series = pa.supplier_features(spark, sf_dir).withColumn("flat", F.lit(3.0))
    every = bt.backtest(series, Candidates(("lag1_log_qty", "flat"), 0, 1), None)
    bad = bt.failed(every)
    return bad.select("series_id", "t", "model", F.lit(3).alias("n_params"), "error")


@query("q_backtest_offset", FIT_SQL)
def backtest_offset(spark, sf_dir):
    """The same regressions with a million added to every covariate: forecasts do not depend on the origin of a scale."""
    moved = pa.supplier_features(spark, sf_dir)
    moved = moved.withColumns({c: F.col(c) + 1e6 for c in pa.COVARIATES})
    return _fit_view(bt.succeeded(bt.backtest(moved, SINGLES, LAST)))


@query(
    "q_backtest_order",
    f"""WITH {LAGGED}, {ORDERS_BY_SUMS}
SELECT series_id, t, arg_min(p, aicc)::INT AS p, round(exp(arg_min(mu, aicc)), 6) AS predicted_abundance, round(min(aicc), 6) AS aicc
FROM each WHERE t > last_t - {LAST} GROUP BY 1, 2""",
)
def backtest_order(spark, sf_dir):
    """Autoregressive order 0 or 1 chosen by AICc for every series and origin."""
    rows = pa.supplier_features(spark, sf_dir)
    out = bt.succeeded(bt.backtest(rows, Candidates((), 0, 0), LAST, fit_ar, max_p=1))
    return out.select(
        "series_id", "t", F.get("order", F.lit(0)).alias("p"), F.round("predicted_abundance", 6).alias("predicted_abundance"),
        F.round("aicc", 6).alias("aicc"),
    )


# Centred log responses and their first two differences, rows that have a response or are the target.
LOGGED = f"""{pa.SUP_FEATURES}, logged AS (
  SELECT series_id, t, ln(abundance) - avg(ln(abundance)) OVER (PARTITION BY series_id) AS y,
    coalesce(avg(ln(abundance)) OVER (PARTITION BY series_id), 0) AS level, pink_ind - avg(pink_ind) OVER (PARTITION BY series_id) AS x0,
    max(t) OVER (PARTITION BY series_id) AS last_t FROM feat),
steps AS (
  SELECT *, lag(y) OVER o AS y1, lag(y, 2) OVER o AS y2, y - lag(y) OVER o AS dy, x0 - lag(x0) OVER o AS dx0 FROM logged
  WINDOW o AS (PARTITION BY series_id ORDER BY t)),
twice AS (SELECT *, dy - lag(dy) OVER (PARTITION BY series_id ORDER BY t) AS ddy FROM steps)"""
ORDER_COLUMNS = ("predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95")


def _order_view(df, digits=5, aicc=6):
    picked = {"p": 0, "q": 1, "sp": 2, "d": 5}
    df = df.withColumns({k: F.get("order", F.lit(i)) for k, i in picked.items()})
    return shown(bt.succeeded(df), ("series_id", "t", "model", *picked, "n_obs"), {digits: ORDER_COLUMNS, aicc: ("aicc",)})


@query(
    "q_backtest_ma",
    f"""WITH {LOGGED}, rows0 AS (SELECT series_id, t, last_t, level, y AS z FROM logged),
{so.orders("m", "rows0", "series_id, t, last_t, level", [], {1: []}, 1, 1, 0, 2)}, {so.best("b", "m_every", "series_id, t")}
SELECT series_id, t, model, p, q, sp, 0 AS d, n AS n_obs, {so.bounds("(mu + level)", "sigma2")}, round(aicc, 6) AS aicc
FROM b WHERE t > last_t - {LAST}""",
)
def backtest_ma(spark, sf_dir):
    """Autoregressive and moving-average orders 0 and 1 of the errors, in two stages."""
    return _order_view(bt.backtest(pa.supplier_features(spark, sf_dir), Candidates((), 0, 0), LAST, fit_orders))


@query(
    "q_choose_differences",
    f"""WITH {LOGGED}, {so.statistic("stat0", "twice", "y")}, {so.statistic("stat1", "twice", "dy")},
{so.chosen("c", "twice", ["stat0", "stat1"])} SELECT series_id, t, round(stat, 6) AS statistic, d FROM c""",
)
def differences(spark, sf_dir):
    """The number of differences at every row, from the rows before it."""
    rows = choose_differences(pa.supplier_features(spark, sf_dir), max_d=2)
    return rows.select("series_id", "t", F.round("statistic", 6).alias("statistic"), "d")


@query(
    "q_backtest_differences",
    f"""WITH {LOGGED}, {so.statistic("stat0", "twice", "y")}, {so.chosen("c", "twice", ["stat0"])},
rows0 AS (SELECT series_id, t, last_t, level, y1, x0 AS w0, y AS z FROM steps),
rows1 AS (SELECT series_id, t, last_t, level, y1, dx0 AS w0, dy AS z FROM steps),
{so.orders("m0", "rows0", "series_id, t, last_t, level, y1", ["w0"], {1: ["w0"], 2: []}, 1, 1, 12, 2)},
{so.orders("m1", "rows1", "series_id, t, last_t, level, y1", ["w0"], {1: ["w0"], 2: []}, 1, 1, 12, 2)},
every AS (
  SELECT e.*, 0 AS d, mu + level AS centre FROM m0_every e UNION ALL SELECT e.*, 1, mu + y1 + level FROM m1_every e),
{so.best("b", "(SELECT e.*, c.d AS want FROM every e JOIN c USING (series_id, t) WHERE e.d = c.d)", "series_id, t")}
SELECT series_id, t, model, p, q, sp, d, n AS n_obs, {so.bounds("centre", "sigma2")}, round(aicc, 6) AS aicc
FROM b WHERE t > last_t - {LAST}""",
)
def backtest_differences(spark, sf_dir):
    """Differences chosen per fit, then orders and a yearly lag, with and without the parity covariate; forecasts are levels again."""
    fit = partial(fit_orders, max_d=1, seasonal=12)
    return _order_view(bt.backtest(pa.supplier_features(spark, sf_dir), Candidates(("pink_ind",), 0, 1, include_null=True), LAST, fit))


@query("q_arima_white", FIT_SQL)
def arima_white(spark, sf_dir):
    """The order-choosing fitter held to white errors: equal to the linear regression."""
    return _fit_view(fits(spark, sf_dir, fitter=partial(fit_orders, max_p=0, max_q=0)))


SEGMENT_ROWS = f"""{pa.SEG}, {pa.spine_sql("seg")},
tagged AS (
  SELECT series_id, t, abundance, lag(CASE WHEN n_orders > 0 THEN ln(n_orders) END) OVER (PARTITION BY series_id ORDER BY t) AS n1,
    CAST(t % 2 AS DOUBLE) AS pink, max(t) OVER (PARTITION BY series_id) AS last_t FROM spine),
scaled AS (
  SELECT series_id, t, last_t, abundance, coalesce((n1 - avg(n1) OVER s) / nullif(stddev_samp(n1) OVER s, 0), 0) AS n1,
    coalesce((pink - avg(pink) OVER s) / nullif(stddev_samp(pink) OVER s, 0), 0) AS pink
  FROM tagged WINDOW s AS (PARTITION BY series_id) QUALIFY abundance IS NOT NULL OR t = last_t),
logged AS (
  SELECT series_id, t, last_t, ln(abundance) - avg(ln(abundance)) OVER s AS y, coalesce(avg(ln(abundance)) OVER s, 0) AS level,
    n1 - avg(n1) OVER s AS x0, pink - avg(pink) OVER s AS x1 FROM scaled WINDOW s AS (PARTITION BY series_id)),
steps AS (
  SELECT *, lag(y) OVER o AS y1, y - lag(y) OVER o AS dy, x0 - lag(x0) OVER o AS dx0, x1 - lag(x1) OVER o AS dx1
  FROM logged WINDOW o AS (PARTITION BY series_id ORDER BY t))"""


@query(
    "q_backtest_arima",
    f"""WITH {SEGMENT_ROWS}, {so.statistic("stat0", "steps", "y")}, {so.chosen("c", "steps", ["stat0"])},
rows0 AS (SELECT series_id, t, last_t, level, y1, x0 AS w0, x1 AS w1, y AS z FROM steps),
rows1 AS (SELECT series_id, t, last_t, level, y1, dx0 AS w0, dx1 AS w1, dy AS z FROM steps),
{so.orders("m0", "rows0", "series_id, t, last_t, level, y1", ["w0", "w1"], {1: ["w0"], 2: ["w1"], 3: []}, 2, 1, 0, 3)},
{so.orders("m1", "rows1", "series_id, t, last_t, level, y1", ["w0", "w1"], {1: ["w0"], 2: ["w1"], 3: []}, 2, 1, 0, 3)},
every AS (
  SELECT e.*, 0 AS d, mu + level AS centre FROM m0_every e UNION ALL SELECT e.*, 1, mu + y1 + level FROM m1_every e),
{so.best("b", "(SELECT e.*, c.d AS want FROM every e JOIN c USING (series_id, t) WHERE e.d = c.d)", "series_id, t")}
SELECT series_id, t, model, p, q, sp, d, n AS n_obs, {so.bounds("centre", "sigma2", 2)}, round(aicc, 5) AS aicc FROM b""",
)
def backtest_arima(spark, sf_dir):
    """Order-choosing fits of the segment series with two covariates and a null model, at every origin."""
    panel = op.with_tags(op.complete_spine(pa.segment_months(spark, sf_dir)), "segment")
    panel = op.parity(op.log_lag_feature(panel, "n_orders", 1))
    names = ("lag1_log_n_orders", "pink_ind")
    panel = op.keep_observed_or_target(op.fill_zero(op.zscore(panel, names), names))
    fit = partial(fit_orders, max_p=2, max_d=1, long=3)
    return _order_view(bt.backtest(panel, Candidates(names, 0, 1, include_null=True), None, fit), 2, 5)


# --- metrics -----------------------------------------------------------------

PAIRED = f"{sql.FITS}, paired AS (SELECT series_id, t, model, abundance, predicted_abundance FROM fits)"


@query(
    "q_metrics",
    f"WITH {PAIRED}, {sql.accuracy('paired', 'series_id, model')} SELECT series_id, model, {sql.columns(METRICS, 5)} FROM acc",
)
def accuracy(spark, sf_dir):
    return rounded(me.accuracy(observed_fits(spark, sf_dir), ["series_id", "model"]), 5, *METRICS)


@query(
    "q_weighted_metrics",
    f"""WITH {PAIRED}, p AS (SELECT *, lag(abundance) OVER (PARTITION BY series_id, model ORDER BY t) AS prev FROM paired
    WHERE abundance IS NOT NULL) SELECT series_id, model,
    round(sqrt(sum({sql.SE} / abundance) / count(*)), 6) AS rmse_weighted,
    round(100 * (exp(avg({sql.ALR})) - 1), 6) AS msa_weighted, round(100 * avg({sql.APE} / abundance), 6) AS mape_weighted,
    round((sum(abs(abundance - predicted_abundance) / abundance) / sum(1 / abundance))
      / (sum(abs(abundance - prev) / abundance) / sum(1 / abundance) FILTER (prev IS NOT NULL)), 6) AS mase_weighted
    FROM p GROUP BY 1, 2""",
)
def weighted_metrics(spark, sf_dir):
    out = me.accuracy(observed_fits(spark, sf_dir), ["series_id", "model"], weighted=True)
    return rounded(out, 6, *me.WEIGHTED).select("series_id", "model", *me.WEIGHTED)


@query(
    "q_named_metrics",
    f"""WITH {PAIRED} SELECT series_id, model, round(avg((predicted_abundance - abundance) / abundance), 6) AS mpe,
    round(100 * (exp(median({sql.ALR})) - 1), 5) AS msa_median FROM paired GROUP BY 1, 2""",
)
def named_metrics(spark, sf_dir):
    o, p = F.col("abundance"), F.col("predicted_abundance")
    return (
        observed_fits(spark, sf_dir)
        .groupBy("series_id", "model")
        .agg(F.round(me.mpe(o, p), 6).alias("mpe"), F.round(me.msa_median(o, p), 5).alias("msa_median"))
    )


@query(
    "q_skill",
    f"WITH {PAIRED}, {sql.skill(source='paired')} SELECT series_id, model, {sql.columns(METRICS, 5)} FROM skill",
)
def skill(spark, sf_dir):
    return rounded(me.skill(observed_fits(spark, sf_dir), ["series_id", "model"]), 5, *METRICS)


ERRORS = ("error", "ape", "pct_error", "log10_ratio")


@query(
    "q_with_errors",
    f"""WITH {PAIRED} SELECT series_id, t, model, round(predicted_abundance - abundance, 4) AS error,
    round({sql.APE}, 6) AS ape, round((predicted_abundance - abundance) / abundance, 6) AS pct_error,
    round(log10(predicted_abundance / abundance), 6) AS log10_ratio FROM paired""",
)
def with_errors(spark, sf_dir):
    out = me.with_errors(observed_fits(spark, sf_dir))
    return shown(out, ("series_id", "t", "model"), {4: ("error",), 6: ERRORS[1:]})


# --- rolling performance -----------------------------------------------------


@query(
    "q_with_obs",
    f"WITH {sql.FITS} SELECT series_id, t, model, round(predicted_abundance, 4) AS predicted_abundance, abundance FROM fits",
)
def with_obs(spark, sf_dir):
    out = ro.with_obs(fits(spark, sf_dir), pa.supplier_features(spark, sf_dir))
    return shown(out, ("series_id", "t", "model", "abundance"), {4: ("predicted_abundance",)})


@query(
    "q_rolling_mape",
    f"WITH {sql.scored()} SELECT series_id, t, model, round(mape, 5) AS mape FROM ranked",
)
def rolling_mape(spark, sf_dir):
    out = ro.rolling_mape(observed_fits(spark, sf_dir), YEARS - 1)
    return rounded(out, 5, "mape").select("series_id", "t", "model", "mape")


@query(
    "q_rolling_mape_decay",
    f"WITH {sql.scored(alpha=sql.DECAY)} SELECT series_id, t, model, round(mape, 5) AS mape FROM ranked",
)
def rolling_mape_decay(spark, sf_dir):
    out = ro.rolling_mape(observed_fits(spark, sf_dir), YEARS - 1, sql.DECAY)
    return rounded(out, 5, "mape").select("series_id", "t", "model", "mape")


@query(
    "q_avg_rank",
    f"""WITH {pa.SUP} SELECT series_id, t, n_lines, rank() OVER (PARTITION BY series_id, (t - 1) // 12 ORDER BY n_lines)
    + (count(*) OVER (PARTITION BY series_id, (t - 1) // 12, n_lines) - 1) / 2.0 AS rank FROM sup""",
)
def avg_rank(spark, sf_dir):
    """Average ranks with many ties: the months of a supplier's year by line count."""
    months = pa.supplier_months(spark, sf_dir).withColumn("year", F.floor((F.col("t") - 1) / 12))
    return ro.rank_models(months, "n_lines", time="year").select("series_id", "t", "n_lines", "rank")


@query(
    "q_rank_by_mape",
    f"WITH {sql.scored(metric='mape')} SELECT series_id, t, model, round(mape, 5) AS mape, rank FROM ranked",
)
def rank_by_mape(spark, sf_dir):
    out = ranked(spark, sf_dir, "mape")
    return rounded(out, 5, "mape").select("series_id", "t", "model", "mape", "rank")


@query(
    "q_top_models",
    f"WITH {sql.scored()}, {sql.best()} SELECT series_id, t, model, model_name, rank, round(aicc, 6) AS aicc FROM top",
)
def top_models(spark, sf_dir):
    top = ro.with_names(ro.top_models(ranked(spark, sf_dir), TOP, YEARS), SINGLES)
    return rounded(top, 6, "aicc").select("series_id", "t", "model", "model_name", "rank", "aicc")


@query(
    "q_best_individual",
    f"WITH {sql.scored()}, {sql.best()} SELECT series_id, {sql.columns(METRICS, 5)} FROM best",
)
def best_individual(spark, sf_dir):
    top = ro.top_models(ranked(spark, sf_dir), TOP, YEARS)
    return rounded(ro.best_individual(top), 5, *METRICS)


# --- ensembles ---------------------------------------------------------------


@query(
    "q_year_bounds",
    f"WITH {sql.FITS} SELECT series_id, min(t) AS first, max(t) AS last, max(t) FILTER (abundance IS NOT NULL) "
    "AS last_observed FROM fits GROUP BY 1",
)
def year_bounds(spark, sf_dir):
    return en.year_bounds(observed_fits(spark, sf_dir))


TARGETS = f"""targets AS (SELECT series_id, CAST(unnest(generate_series(end_t - {YEARS} + 1, end_target)) AS INTEGER) AS target
  FROM (SELECT DISTINCT series_id, end_t, end_target FROM ranked))"""


@query("q_targets", f"WITH {sql.scored()}, {TARGETS} SELECT * FROM targets")
def targets(spark, sf_dir):
    return en.targets(en.year_bounds(observed_fits(spark, sf_dir)), YEARS)


@query(
    "q_eligible",
    f"WITH {sql.scored()}, {TARGETS} SELECT series_id, target, model FROM ranked JOIN targets USING (series_id) "
    f"WHERE t = target AND rank <= {TOP}",
)
def eligible(spark, sf_dir):
    rows = ranked(spark, sf_dir)
    return en.eligible(rows, TOP, en.targets(en.year_bounds(rows), YEARS))


WINDOW_METRICS = ("w_rmse", "w_mape", "w_msa", "w_aicc")


def _window_query(name, **how):
    @query(
        name,
        f"WITH {sql.scored(**how)} SELECT series_id, t, model, {sql.columns(WINDOW_METRICS, 5)} FROM ranked",
    )
    def window_metrics(spark, sf_dir):
        out = en.window_metrics(observed_fits(spark, sf_dir), SLIDE, **how)
        return rounded(out, 5, *WINDOW_METRICS).select("series_id", "t", "model", *WINDOW_METRICS)

    return window_metrics


window_metrics = _window_query("q_window_metrics")
window_metrics_decay = _window_query("q_window_metrics_decay", alpha=sql.DECAY)
window_metrics_stretch = _window_query("q_window_metrics_stretch", stretch=True)
window_metrics_both = _window_query("q_window_metrics_stretch_decay", stretch=True, alpha=sql.DECAY)


def _weights_query(name, columns, k=1):
    @query(
        name,
        f"WITH {sql.scored()}, {sql.weighted(k=k)} SELECT series_id, t, model, {sql.columns(columns, 6)} FROM weighted",
    )
    def weights(spark, sf_dir):
        rows, _ = en.ensemble(ranked(spark, sf_dir), YEARS, TOP, SLIDE, k)
        return rounded(rows, 6, *columns).select("series_id", "t", "model", *columns)

    return weights


INVERSE = ("msa_weight", "rmse_weight", "mape_weight")
weights_inverse = _weights_query("q_weights_inverse", INVERSE)
weights_power = _weights_query("q_weights_power", INVERSE, k=3)
weights_aicc = _weights_query("q_weights_aicc", ("aicc_weight",))
weights_equal = _weights_query("q_weights_equal", ("equal_weight",))


def _combine_query(name, **how):
    @query(
        name,
        f"WITH {sql.scored(**how)}, {sql.weighted()}, {sql.ensembles()} "
        f"SELECT series_id, t, model, {sql.columns(VALUES, 4)} FROM ens",
    )
    def combined(spark, sf_dir):
        _, out = en.ensemble(ranked(spark, sf_dir, **how), YEARS, TOP, SLIDE)
        return rounded(out, 4, *VALUES).drop("abundance")

    return combined


combine = _combine_query("q_combine")
combine_mape = _combine_query("q_ensemble_mape", metric="mape")
combine_stretch = _combine_query("q_ensemble_stretch", stretch=True)
combine_decay = _combine_query("q_ensemble_decay", alpha=sql.DECAY)

@query(
    "q_combine_stacked",
    f"WITH {sql.scored()}, {sql.weighted()} SELECT series_id, t, 'Stack_weighted' AS model, "
    + ", ".join(f"round(sum({v} * round(model / 7.0, 4)), 3) AS {v}" for v in VALUES)
    + " FROM weighted GROUP BY 1, 2",
)
def combine_stacked(spark, sf_dir):
    """The sixth scheme, from weights that follow the model's number."""
    rows = ranked(spark, sf_dir)
    given = rows.filter(F.col("rank") <= TOP).select("series_id", F.col("t").alias("target"), "model", (F.col("model") / 7).alias("weight"))
    _, out = en.ensemble(rows, YEARS, TOP, SLIDE, stack_weights=given)
    return rounded(out.filter("model = 'Stack_weighted'"), 3, *VALUES).drop("abundance")


ENSEMBLE_SQL = f"{sql.scored()}, {sql.weighted()}, {sql.ensembles()}, {sql.all_rows()}"


@query(
    "q_ensemble_skill",
    f"WITH {ENSEMBLE_SQL}, {sql.skill()} SELECT series_id, model, {sql.columns(METRICS, 5)} FROM skill",
)
def ensemble_skill(spark, sf_dir):
    rows = ranked(spark, sf_dir)
    _, combined = en.ensemble(rows, YEARS, TOP, SLIDE)
    return rounded(en.ensemble_skill(rows, combined, YEARS), 5, *METRICS)


@query(
    "q_model_summary",
    f"""WITH {ENSEMBLE_SQL}, {sql.accuracy("allrows", "series_id, model")},
    last_weights AS (SELECT series_id, CAST(model AS VARCHAR) AS model, 1.0 AS stacking_weight FROM weighted WHERE t = end_target)
    SELECT series_id, model, {sql.columns(METRICS, 5)}, CAST(stacking_weight AS DOUBLE) AS stacking_weight
    FROM acc LEFT JOIN last_weights USING (series_id, model)""",
)
def model_summary(spark, sf_dir):
    rows = ranked(spark, sf_dir)
    weights, combined = en.ensemble(rows, YEARS, TOP, SLIDE)
    return rounded(en.model_summary(rows, combined, weights, YEARS), 5, *METRICS)


ALL_WEIGHTS = (*INVERSE, "aicc_weight", "equal_weight")


@query(
    "q_final_weights",
    f"WITH {sql.scored()}, {sql.weighted()} SELECT series_id, t, model, {sql.columns(ALL_WEIGHTS, 6)} "
    "FROM weighted WHERE t = end_target",
)
def final_weights(spark, sf_dir):
    weights, _ = en.ensemble(ranked(spark, sf_dir), YEARS, TOP, SLIDE)
    return rounded(en.final_weights(weights), 6, *ALL_WEIGHTS).select("series_id", "t", "model", *ALL_WEIGHTS)


# --- stacking ----------------------------------------------------------------

STEPS = 4

STACK = f"""{sql.scored()}, {sql.weighted()},
members AS (SELECT series_id, t AS target, model, row_number() OVER (PARTITION BY series_id, t ORDER BY model) AS slot,
            count(*) OVER (PARTITION BY series_id, t) AS size FROM eligible),
points AS (SELECT m.series_id, m.target, m.size, m.slot, f.t, f.abundance, f.predicted_abundance
           FROM members m JOIN fits f ON f.series_id = m.series_id AND f.model = m.model
             AND f.t BETWEEN m.target - {SLIDE} AND m.target - 1 WHERE f.abundance IS NOT NULL),
whole AS (SELECT series_id, target, t, size, max(abundance) AS obs, list(predicted_abundance ORDER BY slot) AS preds
          FROM points GROUP BY 1, 2, 3, 4 HAVING count(*) = size)"""

GRID = f"""parts AS (SELECT a, b, {STEPS} - a - b AS c FROM range({STEPS + 1}) x(a), range({STEPS + 1}) y(b) WHERE a + b <= {STEPS}),
cands AS (SELECT 3 AS size, a || '-' || b || '-' || c AS cand, [a / {STEPS}.0, b / {STEPS}.0, c / {STEPS}.0] AS w FROM parts
  UNION ALL SELECT 2, a || '-' || ({STEPS} - a), [a / {STEPS}.0, ({STEPS} - a) / {STEPS}.0] FROM range({STEPS + 1}) x(a)
  UNION ALL SELECT 1, '{STEPS}', [1.0]),
scores AS (SELECT series_id, target, cand,
  100 * avg(abs((list_dot_product(preds, CAST(w AS DOUBLE[])) - obs) / obs)) AS mape_score,
  sqrt(avg((list_dot_product(preds, CAST(w AS DOUBLE[])) - obs) ** 2)) AS rmse_score
  FROM whole JOIN cands USING (size) GROUP BY 1, 2, 3)"""


def _stacked(spark, sf_dir):
    return st.stack_input(ranked(spark, sf_dir), YEARS, TOP, SLIDE)


@query(
    "q_stack_input",
    f"WITH {STACK} SELECT series_id, target, count(*) AS n_rows, max(size) AS n_models, round(sum(obs), 4) AS total_obs, "
    "round(sum(list_sum(preds)), 3) AS total_pred FROM whole GROUP BY 1, 2",
)
def stack_input(spark, sf_dir):
    """Shape and totals of the search input of each target."""
    add = lambda acc, v: acc + v
    total = F.aggregate(F.flatten("preds"), F.lit(0.0), add)
    return _stacked(spark, sf_dir).select(
        "series_id",
        "target",
        F.size("at").cast("long").alias("n_rows"),
        F.size("models").cast("long").alias("n_models"),
        F.round(F.aggregate("obs", F.lit(0.0), add), 4).alias("total_obs"),
        F.round(total, 3).alias("total_pred"),
    )


@query(
    "q_score_grid",
    f"WITH {STACK}, {GRID} SELECT series_id, target, cand, round(mape_score, 5) AS mape_score, "
    "round(rmse_score, 5) AS rmse_score FROM scores",
)
def score_grid(spark, sf_dir):
    """Every weight vector on the simplex grid scored by two metrics."""
    paired = st.pair_simplex(_stacked(spark, sf_dir), STEPS)
    both = st.score_weights(paired, ("MAPE", "RMSE"))
    return rounded(both, 5, "mape_score", "rmse_score")


@query(
    "q_best_candidate",
    f"WITH {STACK}, {GRID} SELECT series_id, target, round(min(rmse_score), 4) AS score FROM scores GROUP BY 1, 2",
)
def best_candidate(spark, sf_dir):
    paired = st.pair_simplex(_stacked(spark, sf_dir), STEPS)
    return rounded(st.best_candidate(st.score_weights(paired, "RMSE")), 4, "score").drop("cand")


@query(
    "q_stack_exact",
    f"""WITH {STACK}, member_errors AS (SELECT series_id, target, size, obs - preds[1] AS e1, obs - preds[2] AS e2, obs - preds[3] AS e3 FROM whole),
g AS (SELECT series_id, target, max(size) AS n, count(*) AS k, sum(e1 * e1) AS g11, sum(e1 * e2) AS g12, sum(e1 * e3) AS g13,
    sum(e2 * e2) AS g22, sum(e2 * e3) AS g23, sum(e3 * e3) AS g33 FROM member_errors GROUP BY 1, 2),
pair AS (
  SELECT *, (g22 - g12) / nullif(g11 - 2 * g12 + g22, 0) AS b12, (g33 - g13) / nullif(g11 - 2 * g13 + g33, 0) AS b13,
    (g33 - g23) / nullif(g22 - 2 * g23 + g33, 0) AS b23, g11 - 2 * g13 + g33 AS d11, g22 - 2 * g23 + g33 AS d22,
    g12 - g13 - g23 + g33 AS d12, g33 - g13 AS r1, g33 - g23 AS r2 FROM g),
triple AS (SELECT *, d11 * d22 - d12 * d12 AS det, (r1 * d22 - r2 * d12) / nullif(d11 * d22 - d12 * d12, 0) AS t1,
    (r2 * d11 - r1 * d12) / nullif(d11 * d22 - d12 * d12, 0) AS t2 FROM pair),
tried AS (
  SELECT series_id, target, k, g11 AS rss, 1.0 AS w1, 0.0 AS w2, 0.0 AS w3 FROM triple UNION ALL
  SELECT series_id, target, k, g22, 0, 1, 0 FROM triple UNION ALL SELECT series_id, target, k, g33, 0, 0, 1 FROM triple UNION ALL
  SELECT series_id, target, k, g22 - b12 * (g22 - g12), b12, 1 - b12, 0 FROM triple UNION ALL
  SELECT series_id, target, k, g33 - b13 * (g33 - g13), b13, 0, 1 - b13 FROM triple UNION ALL
  SELECT series_id, target, k, g33 - b23 * (g33 - g23), 0, b23, 1 - b23 FROM triple UNION ALL
  SELECT series_id, target, k, g33 - t1 * r1 - t2 * r2, t1, t2, 1 - t1 - t2 FROM triple WHERE det > 1e-10 * d11 * d22)
SELECT series_id, target, round(sqrt(greatest(min(rss), 0) / max(k)), 4) AS score FROM tried
WHERE rss IS NOT NULL AND w1 >= 0 AND w2 >= 0 AND w3 >= 0 GROUP BY 1, 2""",
)
def stack_exact(spark, sf_dir):
    """The least RMSE that any weights on the simplex reach; never above the grid's."""
    return rounded(st.exact_weights(_stacked(spark, sf_dir)), 4, "score").select("series_id", "target", "score")


@query("q_stack_search")
def stack_search(spark, sf_dir):
    """Random search per (series, target); each chain ends after 500 idle proposals."""
    found = st.find_stack_weights(_stacked(spark, sf_dir), "MAPE")
    rounds = F.size("history").alias("rounds")
    pairs = F.explode(F.arrays_zip("models", "weights")).alias("p")
    return found.select("series_id", "target", "score", rounds, pairs).select(
        "series_id", "target", "score", "rounds", F.col("p.models").alias("model"), F.col("p.weights").alias("weight")
    )
