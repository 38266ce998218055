"""SQL common tables of the forecasting steps on the supplier panel."""

from __future__ import annotations

from lagloom.operators.fit_linear import Z50, Z95
from lagloom.queries.panels import COVARIATES, SUP_FEATURES

# Run settings of the registered queries: target years, window, models kept.
YEARS, SLIDE, TOP = 12, 8, 3
LAST = YEARS + SLIDE
DECAY = 0.2
VALUES = ("predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95")


def columns(names, digits: int, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in names)


MODELS = "(VALUES " + ", ".join(f"({i + 1}, {c}, '{c}')" for i, c in enumerate(COVARIATES)) + ") m(model, x, model_name)"

# One regression per covariate over an expanding frame.
FITS = f"""{SUP_FEATURES}, long AS (
  SELECT series_id, t, abundance, CASE WHEN abundance > 0 THEN ln(abundance) END AS y, m.model, m.x, m.model_name,
         max(t) OVER (PARTITION BY series_id) AS last_t
  FROM feat, LATERAL {MODELS}),
sums AS (
  SELECT *, regr_count(y, x) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a,
    regr_sxx(y, x) OVER w AS sxx, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy
  FROM long WINDOW w AS (PARTITION BY series_id, model ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
solved AS (
  SELECT series_id, t, abundance, model, model_name, n, a, b, x, a + b * x AS mu, syy - b * sxy AS rss
  FROM sums WHERE t > last_t - {LAST} AND n > 4 AND sxx > 1e-9),
fits AS (
  SELECT series_id, t, abundance, model, model_name, n, a, b, x, exp(mu) AS predicted_abundance,
    exp(mu - {Z50} * sqrt(rss / (n - 2))) AS lo_50, exp(mu + {Z50} * sqrt(rss / (n - 2))) AS hi_50,
    exp(mu - {Z95} * sqrt(rss / (n - 2))) AS lo_95, exp(mu + {Z95} * sqrt(rss / (n - 2))) AS hi_95,
    n * (ln(2 * pi() * rss / n) + 1) + 6 + 24.0 / (n - 4) AS aicc, rss / (n - 2) AS sigma2
  FROM solved WHERE rss > 0)"""

APE = "abs((abundance - predicted_abundance) / nullif(abundance, 0))"
SE = "(abundance - predicted_abundance) ** 2"
ALR = "abs(ln(abundance / predicted_abundance))"


def scored(slide: int = SLIDE, alpha: float = 0.0, stretch: bool = False, metric: str = "aicc") -> str:
    """Trailing MAPE, window metrics and rank, as tables ``scored`` and ``ranked``."""
    w = YEARS - 1
    start = "UNBOUNDED" if stretch else str(slide)
    if not alpha:
        body = f"""scored AS (
  SELECT *, CASE WHEN count(ape) OVER trail = {w} THEN 100 * avg(ape) OVER trail END AS mape,
    sqrt(avg(se) OVER win) AS w_rmse, avg(ape) OVER win AS w_mape, 100 * (exp(avg(alr) OVER win) - 1) AS w_msa,
    arg_max(aicc, t) FILTER (se IS NOT NULL) OVER win AS w_aicc
  FROM terms
  WINDOW trail AS (PARTITION BY series_id, model ORDER BY t ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING),
         win AS (PARTITION BY series_id, model ORDER BY t RANGE BETWEEN {start} PRECEDING AND 1 PRECEDING))"""
    else:
        body = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY t) AS rn FROM terms),
paired AS (
  SELECT r.series_id, r.t, r.model, p.t AS pt, r.rn - p.rn AS back, r.t - p.t AS age, p.ape, p.se, p.alr, p.aicc
  FROM numbered r JOIN numbered p ON p.series_id = r.series_id AND p.model = r.model AND p.t < r.t),
agg AS (
  SELECT series_id, t, model,
    CASE WHEN count(ape) FILTER (back <= {w}) = {w} THEN 100 * sum(ape * (1 - {alpha}) ** back) FILTER (back <= {w})
      / sum((1 - {alpha}) ** back) FILTER (back <= {w}) END AS mape,
    sqrt(sum(se * (1 - {alpha}) ** age) FILTER ({"true" if stretch else f"age <= {slide}"})
      / sum((1 - {alpha}) ** age) FILTER (se IS NOT NULL AND {"true" if stretch else f"age <= {slide}"})) AS w_rmse,
    sum(ape * (1 - {alpha}) ** age) FILTER ({"true" if stretch else f"age <= {slide}"})
      / sum((1 - {alpha}) ** age) FILTER (ape IS NOT NULL AND {"true" if stretch else f"age <= {slide}"}) AS w_mape,
    100 * (exp(sum(alr * (1 - {alpha}) ** age) FILTER ({"true" if stretch else f"age <= {slide}"})
      / sum((1 - {alpha}) ** age) FILTER (alr IS NOT NULL AND {"true" if stretch else f"age <= {slide}"})) - 1) AS w_msa,
    arg_max(aicc, pt) FILTER (se IS NOT NULL AND {"true" if stretch else f"age <= {slide}"}) AS w_aicc
  FROM paired GROUP BY 1, 2, 3),
scored AS (SELECT f.*, mape, w_rmse, w_mape, w_msa, w_aicc FROM terms f LEFT JOIN agg USING (series_id, t, model))"""
    return f"""{FITS},
terms AS (SELECT *, {APE} AS ape, {SE} AS se, {ALR} AS alr FROM fits),
{body},
{ranked("scored", metric)}"""


def ranked(source: str, metric: str, by: str = "series_id") -> str:
    return f"""ranked AS (
  SELECT *, CASE WHEN {metric} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, t ORDER BY {metric} NULLS LAST)
      + (count(*) OVER (PARTITION BY {by}, t, {metric}) - 1) / 2.0 END AS rank,
    max(t) OVER (PARTITION BY {by}) AS end_t,
    1 + max(CASE WHEN abundance IS NOT NULL THEN t END) OVER (PARTITION BY {by}) AS end_target
  FROM {source})"""


def weighted(by: str = "series_id", k: int = 1) -> str:
    def share(x: str) -> str:
        return f"({x}) / sum({x}) OVER tgt"

    return f"""eligible AS (SELECT * FROM ranked WHERE t > end_t - {YEARS} AND t <= end_target AND rank <= {TOP}),
relative AS (SELECT *, exp(-0.5 * (w_aicc - min(w_aicc) OVER (PARTITION BY {by}, t))) AS likeness FROM eligible),
weighted AS (
  SELECT *, {share(f"(1 / w_msa) ** {k}")} AS msa_weight, {share(f"(1 / w_rmse) ** {k}")} AS rmse_weight,
    {share(f"(1 / w_mape) ** {k}")} AS mape_weight, {share("likeness")} AS aicc_weight,
    CASE WHEN w_rmse IS NOT NULL THEN 1.0 / count(w_rmse) OVER tgt END AS equal_weight
  FROM relative WINDOW tgt AS (PARTITION BY {by}, t))"""


SCHEMES = {
    "MSA_weighted": "msa_weight",
    "RMSE_weighted": "rmse_weight",
    "MAPE_weighted": "mape_weight",
    "AICc_weighted": "aicc_weight",
    "Equal_weighted": "equal_weight",
}


def ensembles(by: str = "series_id") -> str:
    parts = []
    for scheme, weight in SCHEMES.items():
        sums = ", ".join(
            f"CASE WHEN count({v} * {weight}) = count(*) THEN sum({v} * {weight}) END AS {v}" for v in VALUES
        )
        parts.append(f"SELECT {by}, t, '{scheme}' AS model, {sums} FROM weighted GROUP BY {by}, t")
    return "ens AS (" + " UNION ALL ".join(parts) + ")"


def all_rows(by: str = "series_id") -> str:
    """Models and ensembles over the last YEARS times with observations."""
    keys = by.split(", ")
    on = " AND ".join(f"o.{k} = e.{k}" for k in [*keys, "t"])
    ends = " AND ".join(f"z.{k} = u.{k}" for k in keys)
    prefixed = ", ".join(f"e.{k}" for k in keys)
    return f"""obs AS (SELECT {by}, t, max(abundance) AS abundance FROM ranked GROUP BY {by}, t),
ends AS (SELECT {by}, max(t) AS end_t FROM ranked GROUP BY {by}),
allrows AS (
  SELECT u.* FROM (
    SELECT {by}, t, CAST(model AS VARCHAR) AS model, abundance, predicted_abundance FROM ranked UNION ALL
    SELECT {prefixed}, e.t, e.model, o.abundance, e.predicted_abundance FROM ens e LEFT JOIN obs o ON {on}) u
  JOIN ends z ON {ends} WHERE u.t > z.end_t - {YEARS})"""


def accuracy_columns(prev: str = "prev") -> str:
    return f"""100 * avg({APE}) AS mape, sqrt(avg({SE})) AS rmse, 100 * (exp(avg({ALR})) - 1) AS msa,
    avg(abs(abundance - predicted_abundance)) / avg(abs(abundance - {prev})) AS mase"""


def skill(by: str = "series_id", source: str = "allrows") -> str:
    """Accuracy with the lag taken before incomplete rows drop."""
    return f"""skill AS (
  SELECT {by}, model, {accuracy_columns()} FROM (
    SELECT *, lag(abundance) OVER (PARTITION BY {by}, model ORDER BY t) AS prev FROM {source})
  WHERE abundance IS NOT NULL AND predicted_abundance IS NOT NULL GROUP BY {by}, model)"""


def accuracy(source: str, by: str, name: str = "acc") -> str:
    """Accuracy over complete pairs; groups without one keep a row of NULLs."""
    return f"""{name}_pairs AS (SELECT *, lag(abundance) OVER (PARTITION BY {by} ORDER BY t) AS prev FROM {source}
  WHERE abundance IS NOT NULL AND predicted_abundance IS NOT NULL),
{name} AS (SELECT g.*, mape, rmse, msa, mase FROM (SELECT DISTINCT {by} FROM {source}) g LEFT JOIN (
  SELECT {by}, {accuracy_columns()} FROM {name}_pairs GROUP BY {by}) USING ({by}))"""


def best(by: str = "series_id") -> str:
    """Rows ranked first in the last YEARS times and their accuracy ``best``."""
    return f"""top AS (SELECT * FROM ranked WHERE t > end_t - {YEARS} AND rank <= {TOP}),
firsts AS (SELECT * FROM top WHERE rank = 1), {accuracy("firsts", by, "best")}"""


METRICS = ("mape", "rmse", "msa", "mase")
