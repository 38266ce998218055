"""Orders from expanding sums against plain least squares, origin by origin."""

import numpy as np
import pandas as pd
import pytest
from panels import panel, to_spark
from pyspark.sql import functions as F

from lagloom.operators.candidates import Candidates
from lagloom.operators.error_orders import choose_differences, fit_orders


def least_squares(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ b) ** 2).sum()
    n, params = len(y), x.shape[1] + 2
    if n <= params + 1:
        return None
    return b, rss, n * (np.log(2 * np.pi * rss / n) + 1) + 2 * params + 2 * params * (params + 1) / (n - params - 1)


def statistic(y):
    n = len(y)
    e = y - y.mean()
    lags = int(3 * np.sqrt(n) / 13)
    long_run = (e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / long_run


def lag(v, j):
    return np.concatenate([np.full(j, np.nan), v[: len(v) - j]]) if j else v


def plain(y, x, max_p, max_q, d, seasonal, long, at):
    """(mean of ln, aicc, order) of one model at row ``at``; ``x`` are the model's and ``all_x`` all covariates."""
    z, w = y, x["all"]
    for _ in range(d):
        z, w = z - lag(z, 1), w - np.vstack([np.full(w.shape[1], np.nan), w[:-1]])
    first = np.column_stack([w, *[lag(z, j) for j in range(1, long + 1)]])
    e = np.full(len(z), np.nan)
    for i in range(len(z)):
        good = np.flatnonzero(np.isfinite(first[:i]).all(axis=1) & np.isfinite(z[:i]))
        if len(good) > first.shape[1] + 2 and np.isfinite(first[i]).all():
            b = least_squares(first[good], z[good])
            b = b[0] if b else np.linalg.lstsq(np.column_stack([np.ones(len(good)), first[good]]), z[good], rcond=None)[0]
            e[i] = z[i] - b[0] - first[i] @ b[1:]
    pool = np.column_stack([w, *[lag(z, j) for j in range(1, max_p + 1)], *[lag(e, j) for j in range(1, max_q + 1)], *[lag(z, seasonal)] * bool(seasonal)])
    good = np.flatnonzero(np.isfinite(pool[:at]).all(axis=1) & np.isfinite(z[:at]))
    best = None
    n_x = w.shape[1]
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            for s in range(2 if seasonal else 1):
                use = [*x["own"], *[n_x + j for j in range(p)], *[n_x + max_p + j for j in range(q)], *[n_x + max_p + max_q] * s]
                got = least_squares(pool[good][:, use], z[good])
                if got and np.isfinite(pool[at, use]).all():
                    mu = got[0][0] + pool[at, use] @ got[0][1:]
                    mu += 0 if d == 0 else y[at - 1] if d == 1 else 2 * y[at - 1] - y[at - 2]
                    if best is None or got[2] < best[1] - 1e-12:
                        best = mu, got[2], (p, q, s)
    return best


def walk(seed, n=60):
    """Series that need a difference and others that need none, with an error that has memory."""
    frame = panel(n_series=3, n_times=n, seed=seed, covariates=("a", "b"))
    rng = np.random.default_rng(seed)
    for k, s in enumerate(frame.series_id.unique()):
        own = frame.index[frame.series_id == s]
        shock = rng.normal(size=n)
        noise = shock + 0.7 * np.concatenate([[0], shock[:-1]])
        y = 5 + 0.4 * frame.loc[own, "a"].to_numpy() + 0.3 * (np.cumsum(noise) if k == 0 else noise)
        frame.loc[own[:-1], "abundance"] = np.exp(y[:-1])
    return frame


def test_differences_follow_the_statistic(spark):
    frame = walk(3)
    got = choose_differences(to_spark(spark, frame), max_d=2).toPandas()
    chosen = set()
    for s, own in frame.groupby("series_id"):
        y = np.log(own.abundance.to_numpy())
        rows = got[got.series_id == s].sort_values("t")
        for i in range(8, len(y)):
            assert rows.statistic.iloc[i] == pytest.approx(statistic(y[:i]), rel=1e-9)
            d = next((k for k in range(2) if statistic(np.diff(y[:i], n=k)) <= 0.463), 2)
            assert rows.d.iloc[i] == d
            chosen.add(d)
    assert {0, 1} <= chosen


@pytest.mark.parametrize("max_p, max_q, max_d, seasonal", [(1, 1, 0, 0), (2, 1, 2, 0), (1, 2, 1, 4), (0, 0, 1, 0)])
def test_orders_equal_plain_least_squares(spark, max_p, max_q, max_d, seasonal):
    frame = walk(7)
    got = fit_orders(to_spark(spark, frame), Candidates(("a", "b"), 0, 1, include_null=True), 6, max_p, max_q, max_d, seasonal).toPandas()
    assert got.error.isna().all() and len(got) == 3 * 6 * 3
    for r in got.itertuples():
        own = frame[frame.series_id == r.series_id]
        y, at = np.log(own.abundance.to_numpy()), int(np.flatnonzero(own.t == r.t)[0])
        d = next((k for k in range(max_d) if statistic(np.diff(y[:at], n=k)) <= 0.463), max_d)
        x = {"all": own[["a", "b"]].to_numpy(), "own": [[0], [1], []][r.model - 1]}
        mu, aicc, order = plain(y, x, max_p, max_q, d, seasonal, 2, at)
        assert (r.order[0], r.order[1], r.order[2], r.order[5]) == (*order, d)
        assert np.log(r.predicted_abundance) == pytest.approx(mu, abs=1e-8) and r.aicc == pytest.approx(aicc, abs=1e-7)


def test_second_period_from_the_forecast_of_the_first(spark):
    frame = walk(11, 48).drop(columns=["b"])
    frame["period"] = frame.t % 2 + 1
    frame["year"] = frame.t // 2
    rows = to_spark(spark, frame.drop(columns=["t"])).drop("t")
    options = dict(max_p=1, max_q=1, max_d=1, seasonal=2, keys="series_id", time="year", freq=2)
    two = fit_orders(rows, Candidates(("a",), 0, 1, include_null=True), 5, first_period=1, **options).toPandas()
    assert sorted(set(two.period)) == [1, 2] and two.error.isna().all() and len(two) == 3 * 5 * 2 * 2
    one = two[two.period == 1].set_index(["series_id", "year", "model"])
    for r in two[two.period == 2].itertuples():
        first = one.loc[r.series_id, r.year, r.model]
        own = frame[frame.series_id == r.series_id]
        at = int(np.flatnonzero((own.year == r.year) & (own.period == 2))[0])
        y, a = np.log(own.abundance.to_numpy()), own.a.to_numpy()
        d, c = r.order[5], r.coef
        z = y - lag(y, 1) if d else y
        x = a - lag(a, 1) if d else a
        centre = a.mean() if not d else 0.0
        level = np.nanmean(y)
        z_first = np.log(first.predicted_abundance) - (y[at - 2] if d else level)
        z_season = z[at - 2] - (0 if d else level)
        mu = c["intercept"] + c.get("a", 0) * (x[at] - centre) + c.get("ar1", 0) * z_first + c.get("sar1", 0) * z_season
        mu += np.log(first.predicted_abundance) if d else level
        assert np.log(r.predicted_abundance) == pytest.approx(mu, abs=1e-8)
        psi = d + c.get("ar1", 0) + c.get("ma1", 0)
        width = np.log(r.hi_95 / r.lo_95) / np.log(first.hi_95 / first.lo_95)
        assert width == pytest.approx(np.sqrt(1 + psi**2))


def test_missing_and_short_series(spark):
    rows = [("a", i, 1.0) for i in range(5)] + [("b", 1, None)] + [("c", i, None if i % 3 == 0 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, t int, abundance double")
    out = fit_orders(df, Candidates((), 0, 0), None, max_d=1).toPandas()
    assert len(out) == 36 and out[out.series_id != "c"].error.notna().all()
    assert fit_orders(df.limit(0), Candidates((), 0, 0), None, max_d=1).count() == 0
