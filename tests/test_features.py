import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagloom.operators import features as op
from lagloom.operators import reshape as rs
from lagloom.plans.features import INDICATORS, make_features
from lagloom.queries import QUERIES
from lagloom.sources import readers, writers


def collect(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_spine_fills_gaps_and_adds_the_target(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 4, 8.0), ("b", 7, 1.0)], "series_id string, t int, v double")
    got = collect(op.complete_spine(df).fillna(-1.0), "series_id", "t", "v")
    assert got == [("a", 1, 5.0), ("a", 2, -1.0), ("a", 3, -1.0), ("a", 4, 8.0), ("a", 5, -1.0), ("b", 7, 1.0), ("b", 8, -1.0)]
    assert op.complete_spine(df, ahead=0).count() == 5


def test_lags_follow_time_not_row_order(spark):
    df = spark.createDataFrame([("a", 3, 30.0), ("a", 1, 0.0), ("a", 2, -5.0)], "series_id string, t int, v double")
    out = op.log_lag_feature(op.lag_feature(df, "v", 1), "v", 1)
    got = {r.t: (r.lag1_v, r.lag1_log_v) for r in out.collect()}
    # logarithms of zero and of negatives are missing
    assert got == {1: (None, None), 2: (0.0, None), 3: (-5.0, None)}


def test_scaling_edges(spark):
    rows = [("a", i, float(i), 7.0, None) for i in range(4)] + [("b", 1, float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double, const double, none double")
    out = op.fill_zero(op.zscore(df, ["x", "const", "none"]), ["x", "const", "none"])
    got = {(r.series_id, r.t): r for r in out.collect()}
    assert got["a", 0].x == pytest.approx(-1.161895) and got["a", 3].x == pytest.approx(1.161895)
    assert all(r.const == 0 and r["none"] == 0 for r in got.values())
    assert got["b", 1].x == 0


def test_keep_observed_or_target(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, None)]
    df = spark.createDataFrame(rows, "series_id string, t int, abundance double")
    assert [t for _, t in collect(op.keep_observed_or_target(df), "series_id", "t")] == [1, 3, 4]


def test_sentinels(spark):
    df = spark.createDataFrame([(-99.0,), (-99.9,), (None,), (3.0,)], "v double")
    assert op.drop_sentinel(df, "v").count() == 1
    assert op.drop_sentinel(df, "v", keep_equal=True).count() == 2


def test_names_and_days(spark):
    df = spark.createDataFrame([(1.0, "6-30"), (2.0, "06-30"), (3.0, "6-3")], "`PDO.MJJ` double, `mm-dd` string")
    assert op.clean_names(df).columns == ["pdo_mjj", "mm_dd"]
    assert collect(op.pick_day(df).select(F.col("`PDO.MJJ`").alias("v")), "v") == [(1.0,), (2.0,)]


def test_text_sources_round_trip(spark, tmp_path):
    path = tmp_path / "series.csv"
    path.write_text("year,species,period,abundance,x\n1982,Coho,1,5.5,0.1\n1983,Coho,1,NA,0.2\n")
    rows = readers.read_series(spark, str(path), readers.series_schema(["x"])).collect()
    assert [(r.year, r.abundance, r.x) for r in rows] == [(1982, 5.5, 0.1), (1983, None, 0.2)]
    feed = tmp_path / "feed.txt"
    feed.write_text("# header\n  Some title\n 1990 1  0.5\n1990 2 -9999 # note\nfooter\n")
    columns = [("year", "int"), ("month", "int"), ("value", "double")]
    got = collect(readers.read_index(spark, str(feed), columns), "year", "month", "value")
    assert got == [(1990, 1, 0.5), (1990, 2, -9999.0)]
    df = spark.createDataFrame([(1, [1, 2], {"a": 1.0})], "t int, o array<int>, m map<string,double>")
    folder = writers.write_results({"r": df}, str(tmp_path / "out"), ["t"], "csv")["r"]
    assert spark.read.csv(folder, header=True).first()["o"] == "[1,2]"


def test_cohort_table(spark):
    rows = [("s", 2000, 1.0, None), ("s", 2001, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "stock string, brood int, Age3 double, Age4 double")
    out = rs.cohort_to_calendar(df, "stock", "brood")
    got = {r.return_year: (r.Age3, r.Age4) for r in out.collect()}
    assert got == {2003: (1.0, None), 2004: (3.0, None), 2005: (None, 4.0)}
    totals = rs.derive_response(out, ["Age3", "Age4"], {"Age3": "jack"})
    assert all(r.abundance is None for r in totals.collect()) and "jack" in totals.columns


def test_make_features_with_every_feed(spark):
    years = range(1990, 2001)
    returns = spark.createDataFrame(
        [("s", y, 100.0 + 7 * (y % 5), 10.0 + y % 3) for y in years if y != 1994],
        "series_id string, year int, abundance double, jack double",
    )
    index = spark.createDataFrame(
        [(dt.date(y, m, 1), float((y * m) % 11)) for y in range(1985, 2001) for m in range(1, 13)],
        "date date, value double",
    )
    sheet = spark.createDataFrame(
        [(n, *[float((i + 3) * y % 7) for y in range(1988, 2001)]) for i, n in enumerate(INDICATORS)],
        "indicator string, " + ", ".join(f"`{y}` double" for y in range(1988, 2001)),
    )
    pit = spark.createDataFrame(
        [(y, 1000, 20 + y % 4, 10 + y % 3) for y in range(1988, 2000)],
        "year int, juv_count int, ocean1_count int, ocean2_count int",
    )
    smolt = spark.createDataFrame([(y, "6-30", 50.0 + y % 4) for y in range(1988, 2001)], "year int, `mm-dd` string, value double")
    covariates = [
        "lag1_log_jack", "lag4_log_adults", "lag5_log_adults", "lag1_log_sar", "lag2_log_sar", "lag1_pdo",
        "lag2_pdo", "lag1_npgo", "lag2_npgo", "lag2_pc1", "lag2_pc2", "lag2_sp_phys_trans", "lag2_fall_nino",
        "pink_ind", "lag1_log_socksmolt",
    ]
    feeds = {"pdo": index, "npgo": index, "enso": index, "indicators": sheet, "pit": pit, "smolt": smolt}
    out = make_features(returns, feeds, covariates, asof_year=1999)
    rows = {r.year: r for r in out.collect()}
    assert sorted(rows) == [y for y in range(1990, 2002) if y != 1994]
    assert rows[2001].abundance is None
    for c in covariates:
        values = [rows[y][c] for y in rows]
        assert all(v is not None for v in values) and any(v != 0 for v in values), c
    # only what is asked for is planned
    few = make_features(returns, feeds, ["pink_ind"])
    assert "LogicalRDD" not in few._jdf.queryExecution().optimizedPlan().toString().replace("LogicalRDD", "", 1)


def test_brood_counts_past_an_int_are_kept(spark, tmp_path):
    small, large = tmp_path / "small.csv", tmp_path / "large.csv"
    small.write_text("stock,y,Age2,Age3\nA,2000,5,NA\nB,2001,x,2147483647\n")
    large.write_text("stock,y,Age2,Age3\nA,2000,5,NA\nB,2001,x,6967293885\n")
    got = readers.read_brood(spark, str(small), ["Age2", "Age3"], "stock", "y")
    assert [t for _, t in got.dtypes] == ["string", "int", "int", "int"]
    assert sorted(map(tuple, got.collect())) == [("A", 2000, 5, None), ("B", 2001, None, 2147483647)]
    got = readers.read_brood(spark, str(large), ["Age2", "Age3"], "stock", "y")
    assert [t for _, t in got.dtypes] == ["string", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == [("A", 2000, 5, None), ("B", 2001, None, 6967293885)]


def test_brood_query_of_large_totals(spark, tmp_path):
    customer = "SELECT 1L AS c_custkey, 'A' AS c_mktsegment"
    orders = "SELECT id AS o_orderkey, 1L AS o_custkey, DATE'1995-03-01' AS o_orderdate, 4e8D AS o_totalprice FROM range(10)"
    for name, text in (("customer", customer), ("orders", orders)):
        spark.sql(text).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [tuple(r) for r in QUERIES["q_read_brood"](spark, str(tmp_path)).collect()] == [("A", 1995, 4000000000)]
