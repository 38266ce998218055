import numpy as np
import pytest
from panels import panel, to_spark
from pyspark.sql import functions as F

from lagloom.operators import backtest as bt
from lagloom.operators.candidates import Candidates
from lagloom.operators.fit_linear import Z50, Z95, fit_linear
from lagloom.operators.screen import screen_subsets

NAMES = ("a", "b", "c")


def least_squares(x, y, at):
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rss = float(((y - design @ beta) ** 2).sum())
    n, k = len(y), x.shape[1]
    params = k + 2
    loglik = -n / 2 * (np.log(2 * np.pi * rss / n) + 1)
    aicc = -2 * loglik + 2 * params + 2 * params * (params + 1) / (n - params - 1)
    return float(np.concatenate([[1.0], at]) @ beta), rss / (n - k - 1), aicc


@pytest.mark.parametrize("high", [1, 3])
def test_equals_least_squares(spark, high):
    frame = panel()
    made = Candidates(NAMES, 0, high, include_null=True)
    subsets = {r.model: r.covariates for r in made.table(spark).collect()}
    rows = fit_linear(to_spark(spark, frame), made, 6).collect()
    assert len(rows) == 3 * 6 * made.count
    for r in rows:
        past = frame[(frame.series_id == r.series_id) & (frame.t < r.t)]
        here = frame[(frame.series_id == r.series_id) & (frame.t == r.t)]
        x = subsets[r.model]
        mu, s2, aicc = least_squares(past[x].to_numpy(), np.log(past.abundance.to_numpy()), here[x].to_numpy()[0])
        assert np.log(r.predicted_abundance) == pytest.approx(mu, abs=1e-8)
        assert r.aicc == pytest.approx(aicc, abs=1e-6) and r.sigma2 == pytest.approx(s2, rel=1e-8)
        assert np.log(r.hi_95 / r.predicted_abundance) == pytest.approx(Z95 * np.sqrt(s2))
        assert np.log(r.predicted_abundance / r.lo_50) == pytest.approx(Z50 * np.sqrt(s2))
        assert r.lo_95 < r.lo_50 < r.predicted_abundance < r.hi_50 < r.hi_95


def test_target_is_never_read(spark):
    frame = panel(n_series=1)
    changed = frame.copy()
    changed.loc[changed.t == 135, "abundance"] = 1e9
    made = Candidates(NAMES, 1, 2)
    before, after = (
        {(r.t, r.model): r.predicted_abundance for r in fit_linear(to_spark(spark, f), made, 8).collect()}
        for f in (frame, changed)
    )
    assert all(before[k] == pytest.approx(after[k], rel=1e-9) for k in before if k[0] <= 135)
    assert any(abs(before[k] - after[k]) > 1 for k in before if k[0] > 135)


def test_gaps_missing_responses_and_series_independence(spark):
    frame = panel()
    frame.loc[(frame.series_id == "s1") & (frame.t == 110), "abundance"] = np.nan
    frame.loc[(frame.series_id == "s1") & (frame.t == 120), "abundance"] = -4.0
    frame = frame[~((frame.series_id == "s1") & (frame.t == 115))]
    made = Candidates(NAMES, 1, 1)
    whole = fit_linear(to_spark(spark, frame), made, 5)
    alone = fit_linear(to_spark(spark, frame[frame.series_id == "s1"]), made, 5)
    key = lambda r: (r.t, r.model)
    a = sorted(whole.filter("series_id = 's1'").collect(), key=key)
    b = sorted(alone.collect(), key=key)
    assert [r.predicted_abundance for r in a] == pytest.approx([r.predicted_abundance for r in b])
    assert a[-1].n_obs == 36  # 40 rows less gap, missing, negative and the target


def test_failures_are_isolated(spark):
    frame = panel()
    frame["flat"] = 2.0
    frame = frame[(frame.series_id != "s2") | (frame.t < 103)]
    out = bt.backtest(to_spark(spark, frame), Candidates(("a", "flat"), 1, 2), 3)
    bad = {(r.series_id, r.model, r.error) for r in bt.failed(out).collect()}
    assert ("s0", 2, "singular design") in bad and ("s2", 1, "too few observations") in bad
    good = bt.succeeded(out).collect()
    assert {(r.series_id, r.model) for r in good} == {("s0", 1), ("s1", 1)}


def test_lagged_response_and_two_periods(spark):
    frame = panel(n_series=1)
    with_lag = fit_linear(to_spark(spark, frame), Candidates(NAMES, 1, 1), 3, ar=1).collect()
    assert all(set(r.coef) == {"intercept", NAMES[r.model - 1], "_lag_log"} for r in with_lag)
    frame["period"] = frame.t % 2 + 1
    frame["t"] = 2000 + (frame.t - 100) // 2
    frame.loc[frame.index[-2:], "abundance"] = np.nan
    df = to_spark(spark, frame)
    both = fit_linear(df, Candidates(("a",), 1, 1), 2, freq=2).collect()
    assert sorted((r.t, r.period) for r in both) == [(2018, 1), (2018, 2), (2019, 1), (2019, 2)]
    assert len({r.n_obs for r in both if r.t == 2018}) == 1
    second = fit_linear(df, Candidates(("a",), 1, 1), 2, freq=2, first_period=2).collect()
    assert {r.t: r.n_obs for r in second} == {2018: 37, 2019: 38}


def test_screen_is_one_fit_on_everything(spark):
    frame = panel(n_series=2)
    rows = {(r.series_id, r.model): r for r in screen_subsets(to_spark(spark, frame), Candidates(NAMES, 1, 2)).collect()}
    past = frame[(frame.series_id == "s1")].dropna()
    _, _, aicc = least_squares(past[["a", "b"]].to_numpy(), np.log(past.abundance.to_numpy()), np.zeros(2))
    assert rows["s1", 4].aicc == pytest.approx(aicc) and rows["s1", 4].formula == "abundance ~ a + b"


def test_model_struct_and_fitted(spark):
    frame = panel(n_series=1)
    df = to_spark(spark, frame)
    fits = fit_linear(df, Candidates(NAMES, 2, 2), 2)
    row = bt.with_model(fits).withColumn("arma", bt.order_text()).first()
    assert row.arma == "0000100" and row.eq.startswith("log(abundance) = ") and "intercept" in row.eq
    rows = bt.fitted_values(df.select("series_id", "t", *NAMES), fits)
    r = rows.filter("t = 105 and model = 1").orderBy(F.desc("target")).first()
    coef = fits.filter(f"t = {r.target} and model = 1").first().coef
    x = frame[frame.t == 105].iloc[0]
    assert r.fitted == pytest.approx(np.exp(coef["intercept"] + coef["a"] * x.a + coef["b"] * x.b))
