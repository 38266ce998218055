"""Reading, reshaping and feature preparation on panels of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lagloom.operators import features as op
from lagloom.operators import reshape as rs
from lagloom.operators.smooth import binomial_smooth
from lagloom.plans.features import INDICATORS, make_features
from lagloom.queries import panels as pa
from lagloom.queries.registry import month_number, query, rounded, table
from lagloom.queries.sql_smooth import smooth
from lagloom.sources import readers, writers

# --- sources and sinks -------------------------------------------------------


@query(
    "q_read_series",
    f"WITH {pa.SEG}, {pa.spine_sql('seg')} SELECT series_id, t AS year, 'seg' AS species, 1 AS period, "
    "abundance, CAST(n_orders AS DOUBLE) AS n_orders FROM spine",
)
def read_series(spark, sf_dir):
    """Panel written as text with NA for missing, read back with a schema."""
    panel = op.with_tags(op.complete_spine(pa.segment_months(spark, sf_dir)), "seg")
    out = panel.select(
        "series_id", F.col("t").alias("year"), "species", "period", "abundance", F.col("n_orders").cast("double")
    )
    path = writers.scratch_path(spark, "series")
    folder = writers.write_results({"series": out}, path, file_format="csv")["series"]
    return readers.read_series(spark, folder, readers.series_schema(["n_orders"], series_id=True))


@query(
    "q_read_index",
    f"WITH {pa.IDX} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
    "CAST(day(date) AS INTEGER) AS day, value FROM idx WHERE value > 4.5",
)
def read_index(spark, sf_dir):
    """Feed landed as text with prose, comments and a sentinel; the sentinel rows drop."""
    feed = pa.discount_index(spark, sf_dir)
    value = F.when(F.col("value") > 4.5, F.col("value")).otherwise(F.lit(-99.0))
    data = F.format_string(
        "%5d %3d %3d %s # landed", F.year("date"), F.month("date"), F.dayofmonth("date"), value.cast("string")
    )
    prose = F.concat(F.lit("Index feed, row of "), F.col("date").cast("string"))
    lines = feed.select(F.explode(F.array(prose, F.lit("# comment"), data)).alias("value"))
    path = writers.scratch_path(spark, "feed")
    lines.write.text(path)
    columns = [("year", "int"), ("month", "int"), ("day", "int"), ("value", "double")]
    return op.drop_sentinel(readers.read_index(spark, path, columns), "value", -99)


@query(
    "q_read_table",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, "
    "CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) AS ocean1 FROM orders GROUP BY 1",
)
def read_table(spark, sf_dir):
    """Typed table; a count that is not a number reads as NULL and is then dropped."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("ocean1")
    )
    bad = counts.select(F.col("year").cast("string"), F.lit("n/a").alias("n"), F.lit("x").alias("ocean1"))
    text = counts.select(F.col("year").cast("string"), F.col("n").cast("string"), F.col("ocean1").cast("string"))
    path = writers.scratch_path(spark, "counts")
    text.unionByName(bad).write.option("header", True).csv(path)
    kinds = [("year", "int"), ("n", "bigint"), ("ocean1", "int")]
    return readers.read_table(spark, path, kinds).dropna(subset=["n"])


BROOD_INT = "WITH " + pa.COHORT + " SELECT stock, brood_year, " + ", ".join(
    f"CAST(floor(Age{a}) AS INTEGER) AS Age{a}" for a in range(7)
)


@query("q_read_brood", BROOD_INT + " FROM brood")
def read_brood(spark, sf_dir):
    brood = pa.cohort_table(spark, sf_dir)
    whole = brood.select("stock", "brood_year", *[F.floor(a).cast("bigint").alias(a) for a in pa.ages(brood)])
    folder = writers.write_results(
        {"brood": whole}, writers.scratch_path(spark, "brood"), file_format="csv"
    )["brood"]
    return readers.read_brood(spark, folder, pa.ages(brood), "stock", "brood_year")


# --- reshaping ---------------------------------------------------------------

CALENDAR = (
    "WITH "
    + pa.COHORT
    + ", cal AS (SELECT stock, CAST(brood_year + substr(name, 4)::INTEGER AS INTEGER) AS return_year, name, value "
    "FROM (UNPIVOT brood ON COLUMNS('Age.*') INTO NAME name VALUE value)), wide AS (SELECT stock, return_year, "
    + ", ".join(f"sum(value) FILTER (name = 'Age{a}') AS Age{a}" for a in range(7))
    + " FROM cal GROUP BY 1, 2)"
)


@query("q_cohort_to_calendar", CALENDAR + " SELECT * FROM wide")
def cohort_to_calendar(spark, sf_dir):
    brood = pa.cohort_table(spark, sf_dir)
    return rs.cohort_to_calendar(brood, "stock", "brood_year", pa.ages(brood))


@query(
    "q_derive_response",
    CALENDAR
    + " SELECT stock, return_year, round(Age0 + Age1 + Age2, 2) AS abundance, Age0 AS jack, Age1, Age2 FROM wide",
)
def derive_response(spark, sf_dir):
    calendar = cohort_to_calendar(spark, sf_dir)
    out = rs.derive_response(calendar, ["Age0", "Age1", "Age2"], {"Age0": "jack"})
    return rounded(out, 2, "abundance").select("stock", "return_year", "abundance", "jack", "Age1", "Age2")


@query(
    "q_transpose",
    f"""WITH {pa.SEG} SELECT CAST(t // 12 - CASE WHEN t % 12 = 0 THEN 1 ELSE 0 END AS INTEGER) AS year, """
    + ", ".join(
        f"round(sum(abundance) FILTER (series_id = '{s}'), 2) AS \"{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM seg GROUP BY 1",
)
def transpose(spark, sf_dir):
    """Segment rows with one column per year, turned into one row per year."""
    months = pa.segment_months(spark, sf_dir).withColumn("year", F.floor((F.col("t") - 1) / 12).cast("string"))
    sheet = months.groupBy(F.col("series_id").alias("indicator")).pivot("year").agg(F.round(F.sum("abundance"), 2))
    segments = sorted(row[0] for row in sheet.select("indicator").collect())  # one short name per indicator
    blank = sheet.select(F.lit("").alias("indicator"), *[c for c in sheet.columns if c != "indicator"])
    return rs.transpose_indicators(sheet.unionByName(blank), "indicator", segments)


# --- spine, lags, index feeds ------------------------------------------------


@query("q_spine", f"WITH {pa.NAT}, {pa.spine_sql('nat')} SELECT * FROM spine")
def spine(spark, sf_dir):
    return op.complete_spine(pa.nation_months(spark, sf_dir))


@query(
    "q_tags",
    f"WITH {pa.SUP}, {pa.spine_sql('sup')} SELECT series_id, t, abundance, 'supplier' AS species, 1 AS period FROM spine",
)
def tags(spark, sf_dir):
    panel = op.complete_spine(pa.supplier_months(spark, sf_dir).select("series_id", "t", "abundance"))
    return op.with_tags(panel, "supplier")


@query(
    "q_lag",
    f"WITH {pa.SUP}, {pa.spine_sql('sup')} SELECT series_id, t, lag(n_lines, 1) OVER w AS lag1_n_lines, "
    "round(lag(disc, 2) OVER w, 6) AS lag2_disc FROM spine WINDOW w AS (PARTITION BY series_id ORDER BY t)",
)
def lag(spark, sf_dir):
    panel = op.complete_spine(pa.supplier_months(spark, sf_dir))
    panel = op.lag_feature(op.lag_feature(panel, "n_lines", 1), "disc", 2)
    return rounded(panel, 6, "lag2_disc").select("series_id", "t", "lag1_n_lines", "lag2_disc")


@query(
    "q_log_lag",
    f"WITH {pa.SUP}, {pa.spine_sql('sup')} SELECT series_id, t, "
    + ", ".join(f"round(lag(ln(abundance), {n}) OVER w, 6) AS lag{n}_log_abundance" for n in (1, 4, 5))
    + " FROM spine WINDOW w AS (PARTITION BY series_id ORDER BY t)",
)
def log_lag(spark, sf_dir):
    panel = op.complete_spine(pa.supplier_months(spark, sf_dir))
    names = [f"lag{n}_log_abundance" for n in (1, 4, 5)]
    for n in (1, 4, 5):
        panel = op.log_lag_feature(panel, "abundance", n)
    return rounded(panel, 6, *names).select("series_id", "t", *names)


@query(
    "q_drop_sentinel",
    f"WITH {pa.IDX} SELECT date, value FROM idx WHERE value >= 4.8",
)
def drop_sentinel(spark, sf_dir):
    """Values at or above the sentinel; every value below it counts as missing."""
    return op.drop_sentinel(pa.discount_index(spark, sf_dir), "value", 4.8, keep_equal=True)


@query(
    "q_annual_mean",
    f"WITH {pa.IDX} SELECT CAST(year(date) AS INTEGER) AS year, round(avg(value), 6) AS value FROM idx GROUP BY 1",
)
def annual_mean(spark, sf_dir):
    return rounded(op.annual_mean(pa.discount_index(spark, sf_dir), "value"), 6, "value")


@query(
    "q_month_window_mean",
    f"WITH {pa.IDX} SELECT 'fall' AS part, CAST(year(date) AS INTEGER) AS year, round(avg(value), 6) AS value FROM idx "
    "WHERE month(date) IN (10, 11, 12) GROUP BY 1, 2 UNION ALL "
    "SELECT 'spring', CAST(year(date) AS INTEGER), round(avg(value), 6) FROM idx WHERE month(date) IN (4, 5) GROUP BY 1, 2",
)
def month_window_mean(spark, sf_dir):
    index = pa.discount_index(spark, sf_dir)
    fall = op.month_window_mean(index, "value", (10, 11, 12)).withColumn("part", F.lit("fall"))
    spring = op.month_window_mean(index, "value", (4, 5)).withColumn("part", F.lit("spring"))
    return rounded(fall.unionByName(spring), 6, "value")


@query(
    "q_group_count",
    f"WITH {pa.IDX} SELECT date, value, CAST(year(date) AS INTEGER) AS year, "
    "count(*) OVER (PARTITION BY year(date)) AS n FROM idx",
)
def group_count(spark, sf_dir):
    index = pa.discount_index(spark, sf_dir).withColumn("year", F.year("date"))
    return op.with_group_count(index, "year")


@query(
    "q_zscore",
    f"WITH {pa.SUP} SELECT series_id, t, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 6) AS {c}"
        for c in ("abundance", "disc")
    )
    + " FROM sup WINDOW s AS (PARTITION BY series_id)",
)
def zscore(spark, sf_dir):
    out = op.zscore(pa.supplier_months(spark, sf_dir), ["abundance", "disc"])
    return rounded(out, 6, "abundance", "disc").select("series_id", "t", "abundance", "disc")


@query(
    "q_zscore_asof",
    f"WITH {pa.SUP}, flagged AS (SELECT *, CASE WHEN t <= 23990 THEN disc END AS basis FROM sup) "
    "SELECT series_id, t, round((disc - avg(basis) OVER s) / nullif(stddev_samp(basis) OVER s, 0), 6) AS disc "
    "FROM flagged WINDOW s AS (PARTITION BY series_id)",
)
def zscore_asof(spark, sf_dir):
    out = op.zscore(pa.supplier_months(spark, sf_dir), ["disc"], asof="t <= 23990")
    return rounded(out, 6, "disc").select("series_id", "t", "disc")


@query(
    "q_fill_zero",
    f"WITH {pa.SUP}, {pa.spine_sql('sup')} SELECT series_id, t, coalesce(abundance, 0) AS abundance, "
    "round(coalesce(disc, 0), 6) AS disc FROM spine",
)
def fill_zero(spark, sf_dir):
    out = op.fill_zero(op.complete_spine(pa.supplier_months(spark, sf_dir)), ["abundance", "disc"])
    return rounded(out, 6, "disc").select("series_id", "t", "abundance", "disc")


@query("q_parity", f"WITH {pa.SUP} SELECT series_id, t, CAST(t % 2 AS INTEGER) AS pink_ind FROM sup")
def parity(spark, sf_dir):
    return op.parity(pa.supplier_months(spark, sf_dir)).select("series_id", "t", "pink_ind")


@query(
    "q_pick_day",
    f"WITH {pa.IDX} SELECT CAST(year(date) AS INTEGER) AS year, round(running, 4) AS smolt FROM ("
    "SELECT date, sum(value) OVER (PARTITION BY year(date) ORDER BY date) AS running FROM idx) "
    "WHERE month(date) = 6 AND day(date) = 30",
)
def pick_day(spark, sf_dir):
    """The cumulative daily index on one calendar day of each year."""
    index = pa.discount_index(spark, sf_dir).withColumn("year", F.year("date"))
    running = F.sum("value").over(Window.partitionBy("year").orderBy("date"))
    daily = index.withColumn("running", running).withColumn("mm-dd", F.date_format("date", "M-dd"))
    return op.pick_day(daily, "6-30").select("year", F.round("running", 4).alias("smolt"))


@query(
    "q_drop_current",
    "SELECT CAST(year(o_orderdate) + 2 AS INTEGER) AS year, count(*) AS n FROM orders "
    "WHERE year(o_orderdate) <> 2001 GROUP BY 1",
)
def drop_current(spark, sf_dir):
    """Counts per year without the incomplete one, moved to the return year."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    counts = op.drop_current(orders, 2001).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return op.shift_year(counts, 2)


ATTACHED = f"""WITH {pa.SUP}, {pa.IDX},
monthly AS (SELECT CAST(12*year(date)+month(date) AS INTEGER) AS t, avg(value) AS index_mean FROM idx GROUP BY 1),
counts AS (SELECT CAST(12*year(o_orderdate)+month(o_orderdate) AS INTEGER) AS t, count(*) AS all_orders
           FROM orders GROUP BY 1)
SELECT series_id, t, abundance, round(index_mean, 6) AS index_mean"""


def _feeds(spark, sf_dir):
    index = pa.discount_index(spark, sf_dir)
    monthly = index.groupBy(month_number("date").alias("t")).agg(F.avg("value").alias("index_mean"))
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(month_number("o_orderdate").alias("t")).agg(F.count(F.lit(1)).alias("all_orders"))
    return {"index": (monthly, ["t"]), "orders": (counts, ["t"])}


@query(
    "q_attach_features",
    ATTACHED + ", all_orders FROM sup LEFT JOIN monthly USING (t) LEFT JOIN counts USING (t)",
)
def attach_features(spark, sf_dir):
    panel = pa.supplier_months(spark, sf_dir).select("series_id", "t", "abundance")
    return rounded(op.attach_features(panel, _feeds(spark, sf_dir)), 6, "index_mean")


@query("q_attach_wanted", ATTACHED + " FROM sup LEFT JOIN monthly USING (t)")
def attach_wanted(spark, sf_dir):
    """Only the wanted feature's feed is planned; the orders table is never read."""
    panel = pa.supplier_months(spark, sf_dir).select("series_id", "t", "abundance")
    return rounded(op.attach_features(panel, _feeds(spark, sf_dir), ["index_mean"]), 6, "index_mean")


@query(
    "q_keep_target",
    f"WITH {pa.NAT}, {pa.spine_sql('nat')} SELECT series_id, t, abundance FROM spine "
    "QUALIFY abundance IS NOT NULL OR t = max(t) OVER (PARTITION BY series_id)",
)
def keep_target(spark, sf_dir):
    panel = op.complete_spine(pa.nation_months(spark, sf_dir))
    return op.keep_observed_or_target(panel).select("series_id", "t", "abundance")


@query(
    "q_feature_table",
    f"WITH {pa.SUP_FEATURES} SELECT series_id, t, 'supplier' AS species, 1 AS period, abundance, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in pa.COVARIATES)
    + " FROM feat",
)
def feature_table(spark, sf_dir):
    return rounded(pa.supplier_features(spark, sf_dir), 6, *pa.COVARIATES)


RETURN_COVARIATES = (
    "lag1_log_jack",
    "lag4_log_adults",
    "lag5_log_adults",
    "lag1_log_sar",
    "lag2_log_sar",
    "lag1_pdo",
    "lag2_pdo",
    "lag1_npgo",
    "lag2_npgo",
    "lag2_pc1",
    "lag2_pc2",
    "lag2_sp_phys_trans",
    "lag2_fall_nino",
    "lag1_log_socksmolt",
    "pink_ind",
)
# The segments that stand for the three indicators, and a year after the data, whose counts are not in yet.
SHEET = dict(zip(INDICATORS, ("AUTOMOBILE", "BUILDING", "FURNITURE")))
ASOF = 2002

RETURNS_SQL = f"""WITH RECURSIVE {pa.IDX}, {pa.SEG},
ret AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, CAST(year(o_orderdate) AS INTEGER) AS t,
        round(sum(o_totalprice), 2) AS abundance, CAST(count(*) AS BIGINT) AS jack
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
{pa.spine_sql('ret')},
yearly AS (SELECT CAST(year(date) AS INTEGER) AS t, avg(value) AS pdo,
           avg(value) FILTER (month(date) IN (4, 5)) AS npgo,
           avg(value) FILTER (month(date) IN (10, 11, 12)) AS fall,
           max(value) FILTER (month(date) = 6 AND day(date) = 30) AS smolt FROM idx GROUP BY 1),
sheet AS (SELECT CAST((t - 1) // 12 AS INTEGER) AS t, round(sum(abundance) FILTER (series_id = 'AUTOMOBILE'), 2) AS a,
  round(sum(abundance) FILTER (series_id = 'BUILDING'), 2) AS b, round(sum(abundance) FILTER (series_id = 'FURNITURE'), 2) AS c FROM seg GROUP BY 1),
scaled AS (SELECT t, a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_samp(c) OVER () AS c FROM sheet),
indicators AS (SELECT x.t, y.a AS lag2_sp_phys_trans, y.b AS lag2_pc1, y.c AS lag2_pc2 FROM scaled x LEFT JOIN scaled y ON y.t = x.t - 2),
pit AS (SELECT 0 AS series_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS trials, count(*) FILTER (o_orderstatus = 'F') AS one,
  count(*) FILTER (o_orderstatus = 'O') AS two FROM orders GROUP BY 2),
pit1 AS (SELECT series_id, year, trials, one AS success FROM pit), pit2 AS (SELECT series_id, year, trials, two AS success FROM pit),
{smooth("pit1", range(1995, 2002), name="sar1")},
{smooth("pit2", range(1995, 2001), name="sar2")},
survival AS (
  SELECT p.year + 2 AS t, ln(sar1.rate) AS lag1_log_sar, lag(ln(sar2.rate)) OVER (ORDER BY p.year) AS lag2_log_sar
  FROM pit p LEFT JOIN sar1 USING (year) LEFT JOIN sar2 USING (year)),
raw AS (
  SELECT series_id, t, abundance, lag(ln(jack)) OVER w AS lag1_log_jack, lag(ln(abundance), 4) OVER w AS lag4_log_adults,
    lag(ln(abundance), 5) OVER w AS lag5_log_adults, lag1_log_sar, lag2_log_sar, lag2_pc1, lag2_pc2, lag2_sp_phys_trans,
    lag(pdo) OVER w AS lag1_pdo, CASE WHEN lag(pdo) OVER w IS NOT NULL THEN lag(pdo, 2) OVER w END AS lag2_pdo,
    lag(npgo) OVER w AS lag1_npgo, lag(npgo, 2) OVER w AS lag2_npgo, lag(fall, 2) OVER w AS lag2_fall_nino,
    CASE WHEN s.before IS NOT NULL THEN s.v END AS lag1_log_socksmolt, CAST(t % 2 AS DOUBLE) AS pink_ind,
    max(t) OVER (PARTITION BY series_id) AS last_t
  FROM spine LEFT JOIN yearly USING (t) LEFT JOIN indicators USING (t) LEFT JOIN survival USING (t) LEFT JOIN (
    SELECT a.t, ln(b.smolt) AS v, b.smolt AS before FROM yearly a JOIN yearly b ON b.t = a.t - 1
    WHERE a.smolt IS NOT NULL) s USING (t)
  WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t AS year, 'fish' AS species, 1 AS period, abundance, """ + ", ".join(
    f"round(coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0), 6) AS {c}"
    for c in RETURN_COVARIATES
) + " FROM raw WINDOW s AS (PARTITION BY series_id) QUALIFY abundance IS NOT NULL OR t = last_t"


@query("q_make_features", RETURNS_SQL)
def returns_features(spark, sf_dir):
    """The annual feature table with all feeds and all its features, per nation."""
    returns = pa.orders_by(spark, sf_dir, "c_nationkey", F.year("o_orderdate")).select(
        "series_id", F.col("t").alias("year"), "abundance", F.col("n_orders").alias("jack")
    )
    index = pa.discount_index(spark, sf_dir)
    daily = index.select(F.year("date").alias("year"), F.date_format("date", "M-d").alias("mm-dd"), "value")
    months = pa.segment_months(spark, sf_dir).withColumn("year", F.floor((F.col("t") - 1) / 12).cast("string"))
    named = F.create_map(*[F.lit(x) for name, segment in SHEET.items() for x in (segment, name)])
    months = months.withColumn("indicator", F.try_element_at(named, F.col("series_id")))
    sheet = months.groupBy("indicator").pivot("year").agg(F.round(F.sum("abundance"), 2))
    status = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("juv_count"), F.count_if(F.col("o_orderstatus") == "F").alias("ocean1_count"),
        F.count_if(F.col("o_orderstatus") == "O").alias("ocean2_count"),
    )
    feeds = {"pdo": index, "npgo": index, "enso": index, "smolt": daily, "indicators": sheet, "pit": status}
    out = make_features(returns, feeds, RETURN_COVARIATES, ASOF)
    return rounded(out, 6, *RETURN_COVARIATES)


@query(
    "q_binomial_smooth",
    f"""WITH RECURSIVE counts AS (
  SELECT c_mktsegment AS series_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS trials,
    count(*) FILTER (o_orderstatus = 'F') AS success FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
{smooth("counts", range(1995, 2002))}
SELECT series_id, year, success, trials, round(rate, 8) AS rate FROM counts JOIN smooth USING (series_id, year)""",
)
def smoothed_share(spark, sf_dir):
    """Smoothed yearly share of finished orders per customer segment."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").cast("long").alias("done")
    )
    yearly = orders.groupBy("o_custkey", "year").agg(F.count(F.lit(1)).alias("trials"), F.sum("done").alias("done"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    counts = (
        yearly.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("series_id", "year")
        .agg(F.sum("done").alias("success"), F.sum("trials").alias("trials"))
    )
    return rounded(binomial_smooth(counts, "success", "trials"), 8, "rate")
