import numpy as np
import pandas as pd
import pytest
from panels import to_spark
from pyspark.sql import functions as F

from lagloom.operators import ensemble as en
from lagloom.operators import report as rp
from lagloom.operators import rolling as ro
from lagloom.operators import tuning as tu
from lagloom.plans.forecast import score


def forecasts(n_times=12, n_models=4, series=("s", "r"), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name in series:
        observed = rng.uniform(50, 150, n_times)
        for m in range(1, n_models + 1):
            for t in range(n_times):
                p = observed[t] * np.exp(rng.normal() * 0.1 * m)
                rows.append((name, 2000 + t, m, observed[t] if t < n_times - 1 else None, p, p * 0.9, p * 1.1, p * 0.7, p * 1.4, rng.normal()))
    columns = ["series_id", "t", "model", "abundance", "predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95", "aicc"]
    return pd.DataFrame(rows, columns=columns)


def brute_weights(frame, name, target, slide, k, alpha, n, metric="aicc"):
    one = frame[frame.series_id == name]
    at = one[one.t == target].copy()
    at["rank"] = at[metric].rank()
    models = at[at["rank"] <= n].model.tolist()
    out = {}
    for m in models:
        w = one[(one.model == m) & (one.t >= target - slide) & (one.t < target)].dropna(subset=["abundance"])
        decay = (1 - alpha) ** (target - w.t)
        err = w.abundance - w.predicted_abundance
        out[m] = (
            np.sqrt(np.average(err**2, weights=decay)),
            np.average(np.abs(err / w.abundance), weights=decay),
            100 * (np.exp(np.average(np.abs(np.log(w.abundance / w.predicted_abundance)), weights=decay)) - 1),
            w.sort_values("t").aicc.iloc[-1],
        )
    metrics = pd.DataFrame(out, index=["rmse", "mape", "msa", "aicc"]).T
    shares = {c: (1 / metrics[c]) ** k / ((1 / metrics[c]) ** k).sum() for c in ("rmse", "mape", "msa")}
    like = np.exp(-0.5 * (metrics.aicc - metrics.aicc.min()))
    return pd.DataFrame({**shares, "aicc": like / like.sum(), "equal": 1 / len(models)})


@pytest.mark.parametrize("k, alpha", [(1, 0.0), (2, 0.0), (1, 0.3)])
def test_weights_and_combination_equal_brute_force(spark, k, alpha):
    frame = forecasts()
    ranked = score(to_spark(spark, frame), years=6, slide=4, alpha=alpha)
    weights, ensembles = en.ensemble(ranked, years=6, n=3, slide=4, k=k, alpha=alpha)
    rows = weights.toPandas()
    combined = ensembles.toPandas().set_index(["series_id", "t", "model"])
    assert sorted(rows.t.unique()) == list(range(2006, 2012))
    for (name, t), part in rows.groupby(["series_id", "t"]):
        expected = brute_weights(frame, name, t, 4, k, alpha, 3)
        got = part.set_index("model").sort_index()
        for column in expected:
            assert got[f"{column}_weight"].to_numpy() == pytest.approx(expected[column].sort_index().to_numpy())
            assert got[f"{column}_weight"].sum() == pytest.approx(1)
        total = (got.hi_95 * got.rmse_weight).sum()
        assert combined.loc[(name, t, "RMSE_weighted"), "hi_95"] == pytest.approx(total)
    assert "Stack_weighted" not in combined.index.get_level_values(2)


def test_rolling_mape_waits_for_a_full_window(spark):
    frame = forecasts(series=("s",), n_models=1)
    frame.loc[frame.t == 2003, "abundance"] = np.nan
    ape = (frame.abundance - frame.predicted_abundance).abs() / frame.abundance
    for alpha in (0.0, 0.25):
        out = ro.rolling_mape(to_spark(spark, frame), 3, alpha).orderBy("t").toPandas()
        weights = (1 - alpha) ** np.array([3, 2, 1])
        for i in range(len(frame)):
            window = ape.iloc[max(i - 3, 0) : i]
            if len(window) < 3 or window.isna().any():
                assert pd.isna(out.mape[i])
            else:
                assert out.mape[i] == pytest.approx(100 * np.average(window, weights=weights))


def test_average_rank_and_first_tie(spark):
    rows = [("s", 1, 1, 5.0), ("s", 1, 2, 5.0), ("s", 1, 3, 7.0), ("s", 1, 4, None)]
    df = spark.createDataFrame(rows, "series_id string, t int, model int, mape double")
    got = {r.model: r["rank"] for r in ro.rank_models(df).collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0, 4: None}
    first = {r.model: r["rank"] for r in ro.rank_models(df, tie="first").collect()}
    assert first == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_model_without_history_makes_the_sum_null(spark):
    frame = forecasts(series=("s",), n_models=2)
    frame = frame[(frame.model == 1) | (frame.t >= 2008)]
    df = ro.rank_models(to_spark(spark, frame), "aicc")
    weights, ensembles = en.ensemble(df, years=6, n=2, slide=3)
    new = weights.filter("t = 2008 and model = 2").first()
    assert new.rmse_weight is None and new.equal_weight is None
    assert weights.filter("t = 2008 and model = 1").first().rmse_weight == pytest.approx(1)
    assert ensembles.filter("t = 2008 and model = 'RMSE_weighted'").first().predicted_abundance is None
    assert ensembles.filter("t = 2010 and model = 'RMSE_weighted'").first().predicted_abundance is not None


def test_perfect_model_has_no_inverse(spark):
    frame = forecasts(series=("s",), n_models=2)
    frame.loc[frame.model == 1, "predicted_abundance"] = frame.loc[frame.model == 1, "abundance"].fillna(1.0)
    df = ro.rank_models(to_spark(spark, frame), "aicc")
    weights, _ = en.ensemble(df, years=3, n=2, slide=3)
    assert all(r.rmse_weight is None for r in weights.filter("model = 1").collect())


@pytest.mark.parametrize("which", ["window", "alpha"])
def test_sweep_equals_single_runs(spark, which):
    df = to_spark(spark, forecasts())
    years, n = 6, 3
    if which == "window":
        out, value, window, alpha = tu.sweep_window(df, years, n), 3, 3, 0.0
        picked = out.filter(F.col("rolling_window") == value)
        assert out.select("rolling_window").distinct().count() == years - 1
    else:
        out, value, window, alpha = tu.sweep_alpha(df, years, n, 4), 0.35, 4, 0.35
        picked = out.filter(F.abs(F.col("alpha") - value) < 1e-9)
        assert out.select("alpha").distinct().count() == 20
    scored = en.window_metrics(ro.rolling_mape(ro.with_bounds(df), window, alpha), window, alpha)
    ranked = ro.rank_models(scored, "mape")
    _, ensembles = en.ensemble(ranked, years, n, window, alpha=alpha)
    best = ro.best_individual(ro.top_models(ranked, n, years))
    table = rp.skill_table(best, en.ensemble_skill(ranked, ensembles, years))
    expected = {(r.series_id, r.model): r for r in table.collect()}
    rows = picked.collect()
    assert {(r.series_id, r.model) for r in rows} == set(expected)
    for r in rows:
        e = expected[r.series_id, r.model]
        assert (r.mape, r.rmse, r.msa) == pytest.approx((e.mape, e.rmse, e.msa))
        if r.model != rp.BEST:
            last = ensembles.filter((F.col("series_id") == r.series_id) & (F.col("model") == r.model))
            assert r.predicted_abundance == pytest.approx(last.orderBy(F.desc("t")).first().predicted_abundance)


def test_scheme_choice_and_table(spark):
    rows = [("s", "Best_individual", 1.0), ("s", "naive", 2.0), ("s", "MSA_weighted", 4.0), ("s", "RMSE_weighted", 3.0)]
    df = spark.createDataFrame(rows, "series_id string, model string, mape double")
    assert rp.choose_scheme(df).first().model == "RMSE_weighted"
    assert [r.position for r in rp.ordered_table(df).orderBy("mape").collect()] == [1, 2, 3, 4]
