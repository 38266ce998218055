"""In-season operators on daily order totals per segment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import season as se
from lagloom.operators.candidates import Candidates
from lagloom.plans.inseason import inseason_backtest, prepare_season
from lagloom.queries import panels as pa
from lagloom.queries import sql_orders as so
from lagloom.queries.registry import query, rounded

# The season is 1 April to 30 September, its forecast part starts on 1 July; the
# data end on 15 July 2001, inside the last season.
START, END = "1995-01-01", "2001-07-15"
START_MD, END_MD, FORECAST_MD = 401, 930, 701

SEASON = f"""{pa.DAYS},
season AS (SELECT *, CAST(month(date) * 100 + day(date) AS INTEGER) AS md FROM days
           WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
             AND month(date) * 100 + day(date) BETWEEN {START_MD} AND {END_MD}),
splits AS (SELECT species, last_date, CAST(month(last_date) * 100 + day(last_date) AS INTEGER) AS last_md,
           CAST(CASE WHEN month(last_date) * 100 + day(last_date) >= {FORECAST_MD}
                THEN month(last_date + 1) * 100 + day(last_date + 1) ELSE {FORECAST_MD} END AS INTEGER) AS split_md
           FROM (SELECT species, max(date) AS last_date FROM season GROUP BY 1)),
labelled AS (SELECT s.*, last_md, split_md, CASE WHEN md < split_md THEN 1 ELSE 2 END AS period
             FROM season s JOIN splits USING (species)),
trimmed AS (SELECT * FROM labelled WHERE md <= last_md OR md >= split_md),
totals AS (SELECT species, year, period, round(sum(abundance), 2) AS abundance,
           CAST(sum(n_orders) AS BIGINT) AS n_orders FROM trimmed GROUP BY 1, 2, 3),
observed AS (SELECT species, year, round(sum(abundance), 2) AS obs_abundance FROM trimmed
             WHERE period = 1 AND md >= {FORECAST_MD} GROUP BY 1, 2)"""


def season(spark, sf_dir, end=END):
    daily = se.between_dates(pa.segment_days(spark, sf_dir), START, end)
    return se.season_window(daily, START_MD, END_MD)


def labelled(spark, sf_dir):
    rows = season(spark, sf_dir)
    return se.label_period(rows, se.split_date(rows, "species", FORECAST_MD), "species")


def totals(spark, sf_dir):
    """Period totals with the order count as a covariate-like second sum."""
    rows = se.trim_comparable(labelled(spark, sf_dir))
    return rows.groupBy("species", "year", "period").agg(
        F.round(F.sum("abundance"), 2).alias("abundance"), F.sum("n_orders").alias("n_orders")
    )


@query(
    "q_between_dates",
    f"WITH {pa.DAYS} SELECT * FROM days WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'",
)
def between_dates(spark, sf_dir):
    return se.between_dates(pa.segment_days(spark, sf_dir), "1996-03-01", "1999-02-28")


@query("q_season_window", f"WITH {SEASON} SELECT species, date, year, abundance, n_orders FROM season")
def season_window(spark, sf_dir):
    return season(spark, sf_dir)


@query(
    "q_split_date",
    f"WITH {SEASON} SELECT species, last_date, last_md, split_md, 'freshest' AS rule FROM splits UNION ALL "
    f"SELECT species, last_date, last_md, {FORECAST_MD}, 'fixed' FROM splits",
)
def split_date(spark, sf_dir):
    rows = season(spark, sf_dir)
    fresh = se.split_date(rows, "species", FORECAST_MD).withColumn("rule", F.lit("freshest"))
    fixed = se.split_date(rows, "species", FORECAST_MD, freshest=False).withColumn("rule", F.lit("fixed"))
    return fresh.unionByName(fixed)


@query("q_label_period", f"WITH {SEASON} SELECT species, date, period FROM labelled")
def label_period(spark, sf_dir):
    return labelled(spark, sf_dir).select("species", "date", "period")


@query(
    "q_trim",
    f"""WITH {pa.DAYS}, season AS (SELECT *, month(date) * 100 + day(date) AS md FROM days
    WHERE date BETWEEN DATE '{START}' AND DATE '2001-06-10'
      AND month(date) * 100 + day(date) BETWEEN {START_MD} AND {END_MD}),
    last AS (SELECT species, month(max(date)) * 100 + day(max(date)) AS last_md FROM season GROUP BY 1)
    SELECT species, date, abundance, CASE WHEN md < {FORECAST_MD} THEN 1 ELSE 2 END AS period
    FROM season JOIN last USING (species) WHERE md <= last_md OR md >= {FORECAST_MD}""",
)
def trim(spark, sf_dir):
    """Data end before the split, so the days in between go in every year."""
    rows = season(spark, sf_dir, "2001-06-10")
    labels = se.label_period(rows, se.split_date(rows, "species", FORECAST_MD), "species")
    return se.trim_comparable(labels).select("species", "date", "abundance", "period")


@query("q_observed", f"WITH {SEASON} SELECT * FROM observed")
def observed(spark, sf_dir):
    rows = se.trim_comparable(labelled(spark, sf_dir))
    return rounded(se.observed_in_target(rows, "species", FORECAST_MD), 2, "obs_abundance")


@query("q_period_totals", f"WITH {SEASON} SELECT species, year, period, abundance FROM totals")
def period_totals(spark, sf_dir):
    rows = se.trim_comparable(labelled(spark, sf_dir))
    return rounded(se.period_totals(rows, "species"), 2, "abundance")


@query(
    "q_contrast",
    f"WITH {SEASON} SELECT species, year, period, CASE WHEN period = 2 THEN -n_orders ELSE n_orders END AS own, "
    "CASE WHEN period = 2 THEN -max(n_orders) FILTER (period = 1) OVER (PARTITION BY species, year) "
    "ELSE n_orders END AS paired FROM totals",
)
def contrast(spark, sf_dir):
    rows = totals(spark, sf_dir).withColumns({"own": F.col("n_orders"), "paired": F.col("n_orders")})
    out = se.contrast_covariates(se.contrast_covariates(rows, ["own"]), ["paired"], "species")
    return out.select("species", "year", "period", "own", "paired")


COMPLETED = f"""{SEASON}, last_row AS (
  SELECT species, max(year) AS year, arg_max(n_orders, year * 2 + period) AS n_orders FROM totals GROUP BY 1),
completed AS (
  SELECT species, year, period, abundance, n_orders FROM totals UNION ALL
  SELECT l.species, l.year, p.period, NULL, l.n_orders FROM last_row l CROSS JOIN (VALUES (1), (2)) p(period)
  WHERE NOT EXISTS (SELECT 1 FROM totals x WHERE x.species = l.species AND x.year = l.year AND x.period = p.period))"""


@query("q_complete_periods", f"WITH {COMPLETED} SELECT * FROM completed")
def complete_periods(spark, sf_dir):
    return se.complete_periods(totals(spark, sf_dir), "species")


# A simple forecast of period 2 with bounds: the mean of the earlier years.
NAIVE = f"""{COMPLETED}, pairs AS (
  SELECT species, year, period, abundance, m.model AS model,
    CASE WHEN m.model = 1 THEN avg(abundance) OVER w ELSE max(abundance) OVER w END AS predicted_abundance
  FROM completed CROSS JOIN (VALUES (1), (2)) m(model) WHERE period = 2
  WINDOW w AS (PARTITION BY species, m.model ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
naive AS (SELECT *, predicted_abundance * 0.81377 AS lo_50, predicted_abundance * 1.22913 AS hi_50,
  predicted_abundance * 0.64131 AS lo_95, predicted_abundance * 1.56197 AS hi_95 FROM pairs
  WHERE predicted_abundance IS NOT NULL),
added AS (SELECT species, n.year, period, model, obs_abundance, abundance + obs_abundance AS abundance, """ + ", ".join(
    f"{c} + obs_abundance AS {c}" for c in se.VALUES
) + """ FROM naive n LEFT JOIN observed o USING (species, year)),
wts AS (SELECT species, model, CASE WHEN model = 1 THEN 0.6181 ELSE 0.3819 END AS stacking_weight
        FROM (SELECT DISTINCT species, model FROM added))"""


def _naive(spark, sf_dir):
    rows = se.complete_periods(totals(spark, sf_dir), "species").filter(F.col("period") == 2)
    rows = rows.drop("n_orders").withColumn("model", F.explode(F.array(F.lit(1), F.lit(2))))
    past = Window.partitionBy("species", "model").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    point = F.when(F.col("model") == 1, F.avg("abundance").over(past)).otherwise(F.max("abundance").over(past))
    fc = rows.withColumn("predicted_abundance", point).filter(F.col("predicted_abundance").isNotNull())
    for name, factor in (("lo_50", 0.81377), ("hi_50", 1.22913), ("lo_95", 0.64131), ("hi_95", 1.56197)):
        fc = fc.withColumn(name, F.col("predicted_abundance") * factor)
    return fc


def _added(spark, sf_dir):
    rows = se.trim_comparable(labelled(spark, sf_dir))
    part = se.observed_in_target(rows, "species", FORECAST_MD)
    return se.add_observed(_naive(spark, sf_dir), part, "species")


ADDED_COLUMNS = ("abundance", "obs_abundance", *se.VALUES)


@query(
    "q_add_observed",
    f"WITH {NAIVE} SELECT species, year, period, model, "
    + ", ".join(f"round({c}, 2) AS {c}" for c in ADDED_COLUMNS)
    + " FROM added",
)
def add_observed(spark, sf_dir):
    out = rounded(_added(spark, sf_dir), 2, *ADDED_COLUMNS)
    return out.select("species", "year", "period", "model", *ADDED_COLUMNS)


@query(
    "q_label_errors",
    f"WITH {NAIVE} SELECT species, year, model, round(predicted_abundance - abundance, 2) AS error, "
    "round((predicted_abundance - abundance) / abundance, 6) AS pct_error FROM added",
)
def label_errors(spark, sf_dir):
    out = se.label_errors(_added(spark, sf_dir))
    return out.select("species", "year", "model", F.round("error", 2).alias("error"), F.round("pct_error", 6).alias("pct_error"))


@query(
    "q_stack_ensemble",
    f"""WITH {NAIVE}, j AS (SELECT * FROM added JOIN wts USING (species, model)),
    ens AS (SELECT species, year, 'ensemble' AS model, NULL AS stacking_weight, max(abundance) AS abundance, """
    + ", ".join(f"sum({c} * stacking_weight) AS {c}" for c in se.VALUES)
    + """ FROM j GROUP BY 1, 2)
    SELECT species, year, CAST(model AS VARCHAR) AS model, stacking_weight, round(abundance, 2) AS abundance, """
    + ", ".join(f"round({c}, 2) AS {c}" for c in se.VALUES)
    + " FROM j UNION ALL SELECT species, year, model, CAST(stacking_weight AS DOUBLE), round(abundance, 2), "
    + ", ".join(f"round({c}, 2)" for c in se.VALUES)
    + " FROM ens",
)
def stack_ensemble(spark, sf_dir):
    added = _added(spark, sf_dir)
    weight = F.when(F.col("model") == 1, 0.6181).otherwise(0.3819)
    weights = added.select("species", "model").distinct().withColumn("stacking_weight", weight)
    out = se.stack_ensemble(se.label_errors(added), weights, "species")
    return rounded(out, 2, "abundance", *se.VALUES).select(
        "species", "year", "model", "stacking_weight", "abundance", *se.VALUES
    )


def _inseason_sql(first: int) -> str:
    """Tables up to ``done{first}``: the season's forecasts starting from a period, with the ensemble."""
    own, tag, by = f"period = {first}", f"f{first}", "species, year, period"
    mus = "SELECT species, year, period, level, model, mu, sigma2 FROM " + f"best{first}"
    if first == 1:
        mus += f""" UNION ALL SELECT b.species, b.year, 2, b.level, b.model, b.a + b.b_x0 * n.x0 + b.b_z1 * b.mu + b.b_z2 * n.z2,
    sigma2 * (1 + b.b_z1 ** 2) FROM best1 b JOIN f1_lag n ON n.species = b.species AND n.step = b.step + 1"""
    bounds = ", ".join(f"exp(mu + level {sign} {z} * sqrt(sigma2)) AS {c}" for c, sign, z in (
        ("lo_50", "-", so.Z50), ("hi_50", "+", so.Z50), ("lo_95", "-", so.Z95), ("hi_95", "+", so.Z95)))
    values = ", ".join(f"p.{c} + o.obs_abundance AS {c}" for c in se.VALUES)
    mixed = ", ".join(f"CASE WHEN count({c} * stacking_weight) = count(*) THEN sum({c} * stacking_weight) END AS {c}" for c in se.VALUES)
    return f"""{so.orders(tag, "season_rows", "species, year, period, step, level", ["x0"], {1: ["x0"], 2: []}, 1, 0, 2, 2, "species", "step")},
{so.best(f"best{first}", f"(SELECT * FROM {tag}_every WHERE {own})", by)},
mus{first} AS ({mus}),
points{first} AS (SELECT species, year, period, model, exp(mu + level) AS predicted_abundance, {bounds} FROM mus{first} WHERE mu IS NOT NULL),
totals{first} AS (
  SELECT p.species, p.year, p.period, p.model, r.abundance + o.obs_abundance AS abundance, {values} FROM points{first} p
  LEFT JOIN season_rows r ON r.species = p.species AND r.year = p.year AND r.period = p.period
  LEFT JOIN observed o ON o.species = p.species AND o.year = p.year),
errors{first} AS (
  SELECT x.species, x.predicted_abundance - x.abundance AS e1, y.predicted_abundance - y.abundance AS e2 FROM totals{first} x
  JOIN totals{first} y ON x.species = y.species AND x.year = y.year AND x.period = y.period AND x.model = 1 AND y.model = 2
  WHERE x.abundance IS NOT NULL AND x.predicted_abundance IS NOT NULL AND y.predicted_abundance IS NOT NULL),
share{first} AS (
  SELECT species, greatest(0, least(1, sum(e2 * (e2 - e1)) / sum((e1 - e2) ** 2))) AS w FROM errors{first} GROUP BY 1),
given{first} AS (
  SELECT t.*, round(CASE WHEN model = 1 THEN w ELSE 1 - w END, 4) AS stacking_weight FROM totals{first} t LEFT JOIN share{first} USING (species)),
done{first} AS (
  SELECT species, year, period, CAST(model AS VARCHAR) AS model, abundance, stacking_weight, {", ".join(se.VALUES)} FROM given{first} UNION ALL
  SELECT species, year, period, 'ensemble', max(abundance), NULL, {mixed} FROM given{first} GROUP BY 1, 2, 3)"""


IN_SEASON = f"""{COMPLETED}, ordered AS (
  SELECT species, year, period, abundance, CAST(CASE WHEN period = 1 THEN year % 2 ELSE -(year % 2) END AS DOUBLE) AS odd FROM completed),
season_rows AS (
  SELECT species, year, period, 2 * year + period - 1 AS step, abundance, odd - avg(odd) OVER s AS x0,
    coalesce(avg(ln(abundance)) OVER s, 0) AS level, ln(abundance) - avg(ln(abundance)) OVER s AS z
  FROM ordered WINDOW s AS (PARTITION BY species)),
{_inseason_sql(1)}, {_inseason_sql(2)}"""


@query(
    "q_inseason",
    f"WITH {IN_SEASON} "
    + " UNION ALL ".join(
        f"SELECT {first} AS first_period, species, year, period, model, {', '.join(f'round({c}, 2) AS {c}' for c in ('abundance', *se.VALUES))}, "
        f"round(stacking_weight, 4) AS stacking_weight FROM done{first}"
        for first in (1, 2)
    ),
)
def inseason(spark, sf_dir):
    """Season totals of all years from either period on: orders and the lag of a year, stacked exactly by RMSE."""
    daily = pa.segment_days(spark, sf_dir).withColumn("odd", F.pmod("year", F.lit(2)).cast("double"))
    prepared = prepare_season(
        daily, START, END, START_MD, END_MD, FORECAST_MD, "species", covariates=["odd"], period1_only=["odd"]
    )
    out = None
    for first in (1, 2):
        fc, _ = inseason_backtest(
            prepared, Candidates(("odd",), 0, 1, include_null=True), None, first, ["odd"], "RMSE", exact=True,
            max_p=1, max_q=0, seasonal=2,
        )
        values = rounded(fc, 2, "abundance", *se.VALUES)
        own = values.select(
            F.lit(first).alias("first_period"), "species", "year", "period", "model", "abundance", *se.VALUES,
            F.round("stacking_weight", 4).alias("stacking_weight"),
        )
        out = own if out is None else out.union(own)
    return out
