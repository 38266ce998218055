"""Refresh from stored sums, published snapshots and the tree of subsets."""

import numpy as np
import pytest
from panels import panel, to_spark
from pyspark.sql import functions as F

from lagloom.operators.backtest import fitted_values
from lagloom.operators.candidates import Candidates
from lagloom.operators.fit_linear import fit_ar, fit_linear
from lagloom.operators.screen import screen_subsets
from lagloom.operators.subsets import best_subset, screen_all
from lagloom.plans.state import advance_state, build_state, forecast_new
from lagloom.sources.snapshots import latest, publish, snapshot
from lagloom.sources.writers import cut_lineage, scratch_path

NAMES = ("a", "b", "c")


@pytest.mark.parametrize("made", [Candidates(NAMES, 0, 1, include_null=True), Candidates(NAMES, 1, 3)])
def test_state_gives_the_forecasts_of_the_whole_history(spark, made):
    rows = to_spark(spark, panel(4, 40))
    late = "series_id = 's3' AND t >= 128"  # a series without a state
    state = build_state(rows.filter("t < 130").filter(f"NOT ({late}) AND series_id <> 's3'"), made)
    state = cut_lineage(advance_state(state, rows.filter("t BETWEEN 130 AND 134 AND series_id <> 's3'"), made), "state")
    new = cut_lineage(rows.filter("t >= 135 AND series_id <> 's3'").unionByName(rows.filter("series_id = 's3'")), "new")
    out = forecast_new(state, new, made)
    want = {(r.series_id, r.t, r.model): r for r in fit_linear(rows, made, None).collect()}
    got = out.collect()
    assert len(got) == (3 * 5 + 40) * made.count
    for r in got:
        own = want[r.series_id, r.t, r.model]
        assert (r.n_obs, r.error) == (own.n_obs, own.error)
        if r.error is None:
            assert r.predicted_abundance == pytest.approx(own.predicted_abundance, rel=1e-9) and r.aicc == pytest.approx(own.aicc)
            assert r.coef == pytest.approx(own.coef, rel=1e-6, abs=1e-9)
    files = {f.rsplit("/", 2)[-2].split("-")[0] for f in out.inputFiles()}
    assert files == {"state", "new"}
    assert {r.series_id: r.last_time for r in state.collect()} == {f"s{i}": 134 for i in range(3)}


def test_snapshots_switch_whole(spark):
    path = scratch_path(spark, "published")
    first = spark.createDataFrame([(t, m, 1.0) for t in (1, 2, 3) for m in (1, 2)], "t int, model int, x double")
    assert latest(spark, path) == 0
    with pytest.raises(ValueError):
        snapshot(spark, path)
    assert publish(first, path) == 1
    assert publish(first.filter("t >= 2 AND model = 1").withColumn("x", F.lit(2.0)), path) == 2
    rows = lambda v=None: sorted(tuple(r) for r in snapshot(spark, path, v).select("t", "model", "x").collect())
    second = [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 2.0), (3, 1, 2.0)]
    assert rows() == second and rows(1) == sorted(tuple(r) for r in first.collect())
    bad = first.withColumn("x", F.when(F.col("t") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(9.0)).repartition(3, "t")
    with pytest.raises(Exception, match="lost"):
        publish(bad, path)
    assert rows() == second and latest(spark, path) == 2
    assert publish(first.filter("t = 4"), path) == 3 and rows() == second
    untouched = {f for f in snapshot(spark, path, 1).inputFiles() if "_part=1" in f}
    assert untouched and untouched <= set(snapshot(spark, path).inputFiles())


def test_tree_of_subsets_equals_a_solve_each(spark):
    frame = panel(3, 30, covariates=("a", "b", "c", "d"))
    frame["d"] = np.where(frame.series_id == "s1", frame.a + frame.b, frame.d)  # dependent in one series
    rows = to_spark(spark, frame)
    for made in (Candidates(("a", "b", "c", "d"), 0, 4, include_null=True), Candidates(("a", "b", "c", "d"), 2, 3)):
        each = {(r.series_id, r.model): r for r in screen_subsets(rows, made).collect()}
        tree = {(r.series_id, r.model): r for r in screen_all(rows, made).collect()}
        assert set(tree) == set(each)
        for key, r in tree.items():
            assert r.formula == each[key].formula and r.aicc == (None if each[key].aicc is None else pytest.approx(each[key].aicc))
        for r in best_subset(rows, made).collect():
            own = {m: v.aicc for (s, m), v in each.items() if s == r.series_id and v.aicc is not None}
            assert r.model == min(own, key=own.get) and r.aicc == pytest.approx(min(own.values())) and r.visited <= len(own) + made.count


def test_bounds_leave_out_branches(spark):
    names = tuple("abcdefgh")
    rows = to_spark(spark, panel(2, 60, covariates=names))
    made = Candidates(names, 0, 8, include_null=True)
    best = {r.series_id: r for r in best_subset(rows, made).collect()}
    each = {}
    for r in screen_all(rows, made).filter("aicc IS NOT NULL").collect():
        each.setdefault(r.series_id, {})[r.model] = r.aicc
    for s, r in best.items():
        assert r.model == min(each[s], key=each[s].get) and r.visited < made.count // 2
    assert best_subset(rows.limit(0), made).count() == 0


def test_fitted_values_of_autoregressive_fits(spark):
    frame = panel(1, 40)
    rows = to_spark(spark, frame)
    fits = fit_ar(rows, Candidates(("a",), 1, 1), 3, max_p=2)
    got = fitted_values(rows.select("series_id", "t", "a", "abundance"), fits, value="abundance").collect()
    y = np.log(frame.abundance.to_numpy())
    for f in fits.collect():
        own = {r.t: r.fitted for r in got if r.target == f.t and r.model == f.model}
        assert sorted(own) == list(range(100, f.t))
        for i in range(2, f.t - 100):
            mu = f.coef["intercept"] + f.coef["a"] * frame.a[i]
            mu += f.coef.get("_lag_log", 0) * y[i - 1] + f.coef.get("_lag_log2", 0) * y[i - 2]
            assert np.log(own[100 + i]) == pytest.approx(mu, abs=1e-9)
