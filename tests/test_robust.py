"""Values far from zero, values that are not finite, chosen orders, and work spread over tasks."""

import numpy as np
import pytest
from panels import panel, to_spark
from pyspark.sql import functions as F

from lagloom.operators import backtest as bt
from lagloom.operators.candidates import Candidates
from lagloom.operators.error_orders import fit_orders
from lagloom.operators.fit_linear import fit_ar, fit_linear
from lagloom.operators.screen import screen_subsets

NAMES = ("a", "b", "c")


def by_fit(df, value="predicted_abundance"):
    return {(r.series_id, r.t, r.model): r[value] for r in df.collect()}


@pytest.mark.parametrize("offset", [1e5, 1e9])
def test_fits_do_not_depend_on_the_origin_of_a_scale(spark, offset):
    frame = panel()
    made = Candidates(NAMES, 1, 2)
    plain = by_fit(fit_linear(to_spark(spark, frame), made, 5))
    moved = frame.copy()
    moved[list(NAMES)] += offset
    moved = to_spark(spark, moved)
    found = by_fit(fit_linear(moved, made, 5))
    assert all(found[k] == pytest.approx(v, rel=1e-4) for k, v in plain.items())
    assert fit_linear(moved, made, 5).filter("error IS NOT NULL").count() == 0
    assert screen_subsets(moved, made).filter("aicc IS NULL").count() == 0


@pytest.mark.parametrize("fitter", [fit_linear, fit_orders])
def test_a_bad_value_touches_its_own_series_alone(spark, fitter):
    frame = panel(n_series=2, n_times=30)
    made = Candidates(NAMES, 1, 1)
    options = {"max_p": 1, "max_q": 0} if fitter is fit_orders else {}
    plain = by_fit(fitter(to_spark(spark, frame), made, 3, **options))
    bad = frame.copy()
    rows = bad.series_id == "s0"
    bad.loc[rows & (bad.t == 105), "a"] = np.inf
    bad.loc[rows & (bad.t == 107), "abundance"] = np.inf
    out = fitter(to_spark(spark, bad), made, 3, **options)
    found = by_fit(out)
    assert set(found) == set(plain)
    assert all(found[k] == pytest.approx(v) for k, v in plain.items() if k[0] == "s1")
    good = bt.succeeded(out)
    assert good.count() and good.filter("isnan(predicted_abundance) OR predicted_abundance IS NULL").count() == 0


def test_order_is_the_one_of_least_aicc(spark):
    rows = to_spark(spark, panel())
    made = Candidates(NAMES, 0, 1, include_null=True)
    each = [by_fit(fit_linear(rows, made, 4, ar=p), "aicc") for p in range(3)]
    chosen = fit_ar(rows, made, 4, max_p=2).collect()
    assert len(chosen) == len(each[0])
    for r in chosen:
        values = [e[r.series_id, r.t, r.model] for e in each]
        assert r.aicc == pytest.approx(min(values)) and r.order[0] == int(np.argmin(values))


def test_fitted_values_refuse_terms_that_are_no_column(spark):
    rows = to_spark(spark, panel(n_series=1))
    fits = fit_ar(rows, Candidates((), 0, 0), 2, max_p=1)
    if fits.filter("order[0] = 1").count():
        with pytest.raises(Exception, match="no fitted values"):
            bt.fitted_values(rows, fits).collect()


def test_models_of_one_series_use_many_tasks(spark):
    names = tuple("abcdefgh")
    fits = fit_linear(to_spark(spark, panel(1, 60, covariates=names)), Candidates(names, 1, 4), 31)
    used = fits.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert fits.count() == 31 * 162 and used >= spark.sparkContext.defaultParallelism


def test_two_periods_are_ranked_apart(spark):
    from lagloom.plans.forecast import forecast

    frame = panel(1, 40)
    two = frame.copy()
    two["period"], frame["period"] = 2, 1
    two["abundance"] *= 3
    run = forecast(
        to_spark(spark, frame).unionByName(to_spark(spark, two)), Candidates(NAMES, 1, 1), years=4, slide=8, n=2, freq=2
    )
    rows = run.chosen.collect()
    assert len({(r.t, r.period) for r in rows}) == len(rows) and {r.period for r in rows} == {1, 2}
    fits = {(r.t, r.period, r.model) for r in run.top_models.collect()}
    assert all(sum(1 for f in fits if f[:2] == (t, p)) == 2 for t, p, _ in fits)
