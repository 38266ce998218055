from math import comb

import numpy as np
import pytest
from test_ensemble import forecasts
from panels import to_spark
from pyspark.sql import functions as F

from lagloom.operators import rolling as ro
from lagloom.operators import stacking as st


@pytest.fixture(scope="module")
def stacked(spark):
    ranked = ro.rank_models(to_spark(spark, forecasts(n_times=14)), "aicc")
    return st.stack_input(ranked, years=5, n=3, slide=6).cache()


def test_input_holds_only_the_past(stacked):
    rows = stacked.collect()
    assert len(rows) == 2 * 5
    for r in rows:
        assert len(r.models) == 3 and max(r["at"]) < r.target and min(r["at"]) >= r.target - 6
        assert len(r.preds) == len(r.obs) == len(r["at"]) and all(len(p) == 3 for p in r.preds)


def test_grid_scores_equal_direct_scores(stacked):
    paired = st.pair_simplex(stacked, 5)
    assert paired.count() == 10 * comb(7, 2)
    inputs = {(r.series_id, r.target): r for r in stacked.collect()}
    weights = {(r.series_id, r.target, r.cand): r.weights for r in paired.collect()}
    assert all(sum(w) == pytest.approx(1) for w in weights.values())
    for metric in ("RMSE", "MAPE", "MSA_MEDIAN", "MPE"):
        for r in st.score_weights(paired, metric).filter(F.col("cand") == "1-3-1").collect():
            row = inputs[r.series_id, r.target]
            o, p = np.array(row.obs), np.array(row.preds) @ np.array(weights[r.series_id, r.target, r.cand])
            expected = {
                "RMSE": np.sqrt(np.mean((o - p) ** 2)),
                "MAPE": 100 * np.mean(np.abs((o - p) / o)),
                "MPE": np.mean((p - o) / o),
                "MSA_MEDIAN": 100 * (np.exp(np.median(np.abs(np.log(o / p)))) - 1),
            }[metric]
            assert r.score == pytest.approx(expected)


def test_search_is_seeded_and_no_worse_than_its_start(stacked):
    first, again = (
        {(r.series_id, r.target): r for r in st.find_stack_weights(s, "RMSE", 300).collect()}
        for s in (stacked, stacked.repartition(7))
    )
    for key, r in first.items():
        assert r.weights == again[key].weights
        assert sum(r.weights) == pytest.approx(1) and min(r.weights) >= 0
        assert r.score <= r.history[0] and r.history == sorted(r.history, reverse=True)
    other = st.find_stack_weights(stacked, "RMSE", 300, seed=7).first()
    assert other.weights != first[other.series_id, other.target].weights
    grid = st.best_candidate(st.score_weights(st.pair_simplex(stacked, 10), "RMSE"))
    best = {(r.series_id, r.target): r.score for r in grid.collect()}
    patient = st.find_stack_weights(stacked, "RMSE", 4000).collect()
    assert all(r.score <= best[r.series_id, r.target] * 1.05 for r in patient)
    rows = st.weight_rows(st.find_stack_weights(stacked, "RMSE", 50))
    assert rows.count() == 30


def test_exact_weights_are_the_optimum(spark, stacked):
    inputs = {(r.series_id, r.target): r for r in stacked.collect()}
    got = {(r.series_id, r.target): r for r in st.exact_weights(stacked).collect()}
    assert set(got) == set(inputs)
    rng = np.random.default_rng(0)
    for key, r in got.items():
        o, p, w = np.array(inputs[key].obs), np.array(inputs[key].preds), np.array(r.weights)
        score = lambda v: np.sqrt(np.mean((o - p @ v) ** 2))
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and r.score == pytest.approx(score(w)) and list(r.models) == list(inputs[key].models)
        others = rng.dirichlet(np.full(3, 0.5), 3000)
        assert all(score(v) >= r.score - 1e-9 for v in others)
    grid = st.best_candidate(st.score_weights(st.pair_simplex(stacked, 10), "RMSE"))
    assert all(got[r.series_id, r.target].score <= r.score + 1e-9 for r in grid.collect())


def test_exact_weights_of_dependent_perfect_and_single_members(spark):
    rows = [
        ("one", 1, [3], [5.0, 6.0], [[4.0], [7.0]]), ("same", 1, [1, 2], [5.0, 6.0], [[4.0, 4.0], [7.0, 7.0]]),
        ("between", 1, [1, 2], [5.0], [[4.0, 6.0]]), ("perfect", 1, [1, 2, 3], [5.0, 6.0], [[4.0, 5.0, 9.0], [7.0, 6.0, 9.0]]), ("empty", 1, [1], [], []),
    ]
    df = spark.createDataFrame(rows, "series_id string, target int, models array<int>, obs array<double>, preds array<array<double>>")
    got = {r.series_id: r for r in st.exact_weights(df).collect()}
    assert set(got) == {"one", "same", "between", "perfect"}
    assert got["one"].weights == [1.0] and got["one"].score == pytest.approx(1)
    assert got["same"].weights == [1.0, 0.0] and got["same"].score == pytest.approx(1)
    assert got["between"].weights == pytest.approx([0.5, 0.5]) and got["between"].score == pytest.approx(0, abs=1e-9)
    assert got["perfect"].weights == [0.0, 1.0, 0.0] and got["perfect"].score == 0


def test_draws_follow_their_distributions():
    chain = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = st.uniform_draws(chain, 3, 1, 0)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, st.uniform_draws(chain, 4, 1, 0))[0, 1]) < 0.03
    for a in (0.01, 0.34, 1.0, 2.5):
        g = st.gamma_draws(chain, 1, np.full((len(chain), 2), a))
        assert g.mean(axis=0) == pytest.approx([a, a], rel=0.1, abs=2e-3) and g.var(axis=0) == pytest.approx([a, a], rel=0.25, abs=4e-3)
        assert abs(np.corrcoef(g.T)[0, 1]) < 0.03
    part = st.gamma_draws(chain[5:9], 1, np.full((4, 2), 2.5))
    assert (part == g[5:9]).all()
