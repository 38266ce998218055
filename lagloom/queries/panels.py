"""Panels derived from the given tables, as Spark plans and as SQL common tables.

Monetary sums are rounded to cents, their true precision, so that the order of
summation cannot show; quantities and discount percents are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators import features as op
from lagloom.queries.registry import month_number, table

COVARIATES = ("lag1_log_qty", "lag12_log_qty", "lag1_disc", "pink_ind")


def orders_by(spark: SparkSession, sf_dir: str, attribute: str, time) -> DataFrame:
    """Order totals by a customer attribute and time.

    Orders are combined per customer and time before the join, so a customer
    holding most of the orders adds one row per time step to it.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", time.alias("t"), "o_totalprice"
    )
    per_customer = orders.groupBy("o_custkey", "t").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", attribute)
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col(attribute).cast("string").alias("series_id"), "t")
        .agg(F.round(F.sum("total"), 2).alias("abundance"), F.sum("n_orders").alias("n_orders"))
    )


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by(spark, sf_dir, "c_mktsegment", month_number("o_orderdate"))


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by(spark, sf_dir, "c_nationkey", month_number("o_orderdate"))


def segment_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts for the in-season operators: species, date, year, abundance."""
    days = orders_by(spark, sf_dir, "c_mktsegment", F.to_date("o_orderdate"))
    return days.select(
        F.col("series_id").alias("species"),
        F.col("t").alias("date"),
        F.year("t").alias("year"),
        "abundance",
        "n_orders",
    )


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped quantity per supplier, with the mean discount in percent."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").cast("string").alias("series_id"), month_number("l_shipdate").alias("t")
    ).agg(
        F.sum("l_quantity").alias("abundance"),
        F.count(F.lit(1)).alias("n_lines"),
        (F.sum(F.round(F.col("l_discount") * 100)) / F.count(F.lit(1))).alias("disc"),
    )


def discount_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily index feed: mean discount in percent by ship date."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.sum(F.round(F.col("l_discount") * 100)) / F.count(F.lit(1)), 6).alias("value")
    )


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel with lagged, scaled covariates and one row to forecast."""
    panel = op.with_tags(op.complete_spine(supplier_months(spark, sf_dir)), "supplier")
    panel = op.log_lag_feature(panel, "abundance", 1, "lag1_log_qty")
    panel = op.log_lag_feature(panel, "abundance", 12, "lag12_log_qty")
    panel = op.lag_feature(panel, "disc", 1, "lag1_disc")
    panel = op.project(op.parity(panel), COVARIATES)
    panel = op.fill_zero(op.zscore(panel, COVARIATES), COVARIATES)
    return op.keep_observed_or_target(panel)


def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brood-table shape: order value by segment, first-order year and age.

    The first year is found per customer from map-side combined minima.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice"
    )
    yearly = orders.groupBy("o_custkey", "y").agg(F.sum("o_totalprice").alias("total"))
    first = yearly.groupBy("o_custkey").agg(F.min("y").alias("cohort"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    aged = (
        yearly.join(first, "o_custkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("stock"),
            F.col("cohort").alias("brood_year"),
            F.concat(F.lit("Age"), (F.col("y") - F.col("cohort")).cast("string")).alias("age"),
            "total",
        )
    )
    # the ages are those that occur; the calendar bounds them
    return aged.groupBy("stock", "brood_year").pivot("age").agg(F.round(F.sum("total"), 2))


def ages(brood: DataFrame) -> list[str]:
    return [c for c in brood.columns if c.startswith("Age")]


SEG = """seg AS (
  SELECT c_mktsegment AS series_id, CAST(12*year(o_orderdate)+month(o_orderdate) AS INTEGER) AS t,
         round(sum(o_totalprice), 2) AS abundance, CAST(count(*) AS BIGINT) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

NAT = """nat AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS series_id,
         CAST(12*year(o_orderdate)+month(o_orderdate) AS INTEGER) AS t,
         round(sum(o_totalprice), 2) AS abundance, CAST(count(*) AS BIGINT) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

DAYS = """days AS (
  SELECT c_mktsegment AS species, CAST(o_orderdate AS DATE) AS date,
         CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS abundance,
         CAST(count(*) AS BIGINT) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""

SUP = """sup AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
         CAST(12*year(l_shipdate)+month(l_shipdate) AS INTEGER) AS t,
         sum(l_quantity) AS abundance, CAST(count(*) AS BIGINT) AS n_lines,
         sum(round(l_discount*100)) / count(*) AS disc
  FROM lineitem GROUP BY 1, 2)"""

IDX = """idx AS (
  SELECT CAST(l_shipdate AS DATE) AS date, round(sum(round(l_discount*100)) / count(*), 6) AS value
  FROM lineitem GROUP BY 1)"""


def spine_sql(source: str, name: str = "spine", ahead: int = 1) -> str:
    return f"""{name} AS (
  SELECT k.series_id, CAST(k.t AS INTEGER) AS t, s.* EXCLUDE (series_id, t)
  FROM (SELECT series_id, unnest(generate_series(min(t), max(t)+{ahead})) AS t FROM {source} GROUP BY 1) k
  LEFT JOIN {source} s ON s.series_id = k.series_id AND s.t = k.t)"""


SUP_FEATURES = (
    SUP
    + ", "
    + spine_sql("sup")
    + """, lagged AS (
  SELECT series_id, t, abundance,
    lag(CASE WHEN abundance > 0 THEN ln(abundance) END, 1) OVER w AS lag1_log_qty,
    lag(CASE WHEN abundance > 0 THEN ln(abundance) END, 12) OVER w AS lag12_log_qty,
    lag(disc, 1) OVER w AS lag1_disc, CAST(t % 2 AS DOUBLE) AS pink_ind,
    max(t) OVER (PARTITION BY series_id) AS last_t
  FROM spine WINDOW w AS (PARTITION BY series_id ORDER BY t)),
feat AS (
  SELECT series_id, t, abundance, """
    + ", ".join(
        f"coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0) AS {c}" for c in COVARIATES
    )
    + """
  FROM lagged WINDOW s AS (PARTITION BY series_id) QUALIFY abundance IS NOT NULL OR t = last_t)"""
)

COHORT = (
    """first_year AS (SELECT o_custkey, min(year(o_orderdate)) AS cohort FROM orders GROUP BY 1),
brood AS (
  SELECT c_mktsegment AS stock, CAST(cohort AS INTEGER) AS brood_year, """
    + ", ".join(
        f"round(sum(o_totalprice) FILTER (year(o_orderdate) - cohort = {a}), 2) AS Age{a}" for a in range(7)
    )
    + """
  FROM orders JOIN first_year USING (o_custkey) JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
)
