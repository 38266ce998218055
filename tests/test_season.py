import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagloom.operators import season as se
from lagloom.operators import smooth as sm
from lagloom.operators.candidates import Candidates
from lagloom.plans.inseason import inseason_backtest, prepare_season


def daily(spark, last=dt.date(2012, 7, 10), first_year=1995):
    rows, day = [], dt.date(first_year, 1, 1)
    while day <= last:
        rows.append(("fish", day, day.year, 10.0 + day.month + (day.toordinal() * 7) % 5, float(day.year % 3)))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "species string, date date, year int, abundance double, x double")


@pytest.mark.parametrize("last, freshest, split", [("2012-07-10", True, 711), ("2012-07-10", False, 701), ("2012-06-20", True, 701)])
def test_split(spark, last, freshest, split):
    df = se.between_dates(daily(spark), "1995-01-01", last)
    assert se.split_date(df, "species", 701, freshest).first().split_md == split


def test_days_after_the_last_observation_go_in_every_year(spark):
    out = prepare_season(daily(spark, dt.date(2012, 6, 20)), "1995-01-01", "2012-12-31", 401, 930, 701, "species")
    totals = {(r.year, r.period): r.abundance for r in out.series.collect()}
    assert (2012, 2) not in totals and (2011, 2) in totals
    rows = daily(spark).filter((se.month_day("date") >= 401) & (se.month_day("date") <= 620) & (F.year("date") == 2000))
    assert totals[2000, 1] == pytest.approx(rows.agg(F.sum("abundance")).first()[0])
    assert out.observed.count() == 0


def test_missing_periods_copy_the_last_row(spark):
    rows = [("a", 2000, 1, 1.0, 5.0), ("a", 2000, 2, 2.0, 6.0), ("a", 2001, 1, 3.0, 7.0), ("b", 2000, 1, 4.0, 8.0), ("b", 2000, 2, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "species string, year int, period int, abundance double, x double")
    got = {(r.species, r.year, r.period): (r.abundance, r.x) for r in se.complete_periods(df, "species").collect()}
    assert len(got) == 6 and got["a", 2001, 2] == (None, 7.0)
    contrast = {(r.species, r.year, r.period): r.x for r in se.contrast_covariates(df, ["x"], "species").collect()}
    assert contrast["a", 2000, 2] == -5.0 and contrast["a", 2001, 1] == 7.0


def test_observed_part_is_added_or_absent(spark):
    fc = spark.createDataFrame(
        [("a", 2000, 10.0, 12.0, 11.0, 13.0, 9.0, 15.0), ("a", 2001, 10.0, 12.0, 11.0, 13.0, 9.0, 15.0)],
        "species string, year int, abundance double, predicted_abundance double, lo_50 double, hi_50 double, lo_95 double, hi_95 double",
    )
    part = spark.createDataFrame([("a", 2000, 5.0)], "species string, year int, obs_abundance double")
    got = {r.year: r for r in se.add_observed(fc, part, "species").collect()}
    assert got[2000].hi_95 == 20.0 and got[2001].predicted_abundance is None
    none = {r.year: r for r in se.add_observed(fc, part.filter("year < 0"), "species").collect()}
    assert none[2001].predicted_abundance == 12.0 and none[2001].obs_abundance == 0


def test_inseason_backtest_has_an_ensemble_per_year(spark):
    data = prepare_season(daily(spark), "1995-01-01", "2012-12-31", 401, 930, 701, "species", covariates=["x"])
    fc, failed = inseason_backtest(
        data, Candidates(("x",), 0, 1, include_null=True), 3, first_period=2, period1_only=["x"],
        patience=50, seasonal=2, max_p=1, max_q=0,
    )
    rows = fc.collect()
    assert {r.year for r in rows} == {2010, 2011, 2012} and failed.count() == 0
    both = [r for r in rows if r.year == 2011]
    models = {r.model: r for r in both}
    assert set(models) == {"1", "2", "ensemble"}
    mixed = sum(models[m].predicted_abundance * models[m].stacking_weight for m in ("1", "2"))
    assert models["ensemble"].predicted_abundance == pytest.approx(mixed)
    assert models["ensemble"].predicted_abundance == pytest.approx(models["ensemble"].abundance, rel=0.1)


def test_binomial_smooth(spark):
    rows = [("a", 2000 + i, 1000, int(1000 * (0.2 + 0.02 * i))) for i in range(12)]
    rows += [("b", 2000 + i, 500, 50) for i in range(12)] + [("c", 2000, 10, None)]
    df = spark.createDataFrame(rows, "series_id string, year int, trials int, success int")
    out = {(r.series_id, r.year): r.rate for r in sm.binomial_smooth(df, "success", "trials").collect()}
    assert len(out) == 25 and out["c", 2000] is None
    assert all(out["b", 2000 + i] == pytest.approx(0.1, abs=1e-3) for i in range(12))
    assert all(out["a", 2000 + i] == pytest.approx(0.2 + 0.02 * i, abs=0.02) for i in range(12))
    assert all(out["a", 2001 + i] > out["a", 2000 + i] for i in range(11))
