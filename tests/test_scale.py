"""Plans and results under a hot key."""

import glob

import pytest
from pyspark.sql import functions as F

from lagloom.functions.safe import per_key
from lagloom.operators import features as op
from lagloom.operators import stacking as st
from lagloom.operators.rolling import with_bounds, with_bounds_in_place
from lagloom.queries import QUERIES
from lagloom.queries import panels as pa
from lagloom.queries.scoring import _stacked, ranked
from lagloom.queries.sql import YEARS

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_counted_by_partial_sums(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") < 20000, 7).otherwise(F.col("id") % 100).cast("int").alias("g"), "id"
    )
    out = op.with_group_count(rows, "g")
    assert out.filter("g = 7").agg(F.max("n"), F.min("n"), F.count("*")).first()[:] == (20100, 20100, 20100)
    assert "Window" not in physical(out) and "partial_count" in physical(out)
    assert "Window" not in physical(per_key(rows, "g", F.max("id").alias("m")))


def test_panel_reads_only_its_columns_and_combines_before_joining(spark):
    plan = physical(pa.segment_months(spark, SMALL))
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan
    assert plan.count("partial_sum") >= 2


def test_no_plan_pairs_rows_with_rows(spark):
    for df in (ranked(spark, SMALL), pa.supplier_features(spark, SMALL)):
        assert "CartesianProduct" not in physical(df) and "NestedLoop" not in physical(df)


def test_models_of_a_series_are_not_gathered_to_score_them(spark):
    plan = physical(ranked(spark, SMALL))
    spreads = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("model#" in line and "series_id#" in line for line in spreads)
    assert any("t#" in line and "series_id#" in line and "model#" not in line for line in spreads)


def test_feature_table_joins_nothing(spark):
    assert "Join" not in physical(pa.supplier_features(spark, SMALL))


def spread_by_grid(df):
    return [line for line in physical(df).splitlines() if "Exchange hashpartitioning" in line and "grid#" in line]


def test_sweep_alpha_meets_the_grid_after_its_last_shuffle(spark):
    assert not spread_by_grid(QUERIES["q_sweep_alpha"](spark, SMALL))


def test_sweep_window_meets_the_grid_after_its_last_shuffle(spark):
    assert not spread_by_grid(QUERIES["q_sweep_window"](spark, SMALL))


def test_sweep_view_meets_the_grid_after_its_last_shuffle(spark):
    assert not spread_by_grid(QUERIES["q_sweep_view"](spark, SMALL))


def moves(df):
    """Partitions of each explicit repartition, the last one first; other exchanges and joins count as none."""
    lines = physical(df).splitlines()
    asked = [int(line.split("), REPARTITION_BY_NUM")[0].rsplit(", ", 1)[1]) for line in lines if "REPARTITION_BY_NUM" in line]
    return asked, [line for line in lines if "Join" in line or "ENSURE_REQUIREMENTS" in line]


def test_sweep_moves_fits_by_series_and_spreads_what_it_multiplies(spark):
    asked, others = moves(QUERIES["q_sweep_view"](spark, SMALL))
    assert len(asked) == 2 and asked[0] == (YEARS - 1) * asked[1] and not others


def test_bounds_of_a_sweep_need_no_sort_of_their_own(spark):
    """Rows are sorted to look back, to rank and to score."""
    assert sum("- Sort [" in line for line in physical(QUERIES["q_sweep_view"](spark, SMALL)).splitlines()) == 3


def test_bounds_in_place_are_those_of_the_join(spark):
    rows = [("a", 1, 1, 5.0), ("a", 1, 2, None), ("a", 2, 2, None), ("b", 1, 4, None), (None, 1, 9, 3.0), ("a", 1, 1, 5.0)]
    fc = spark.createDataFrame(rows, "series_id string, model int, t int, abundance double")

    def found(df):
        return sorted((tuple(r) for r in df.select(*fc.columns, "series_end", "series_observed").collect()), key=str)

    assert found(with_bounds_in_place(fc)) == found(with_bounds(fc))
    assert found(with_bounds_in_place(with_bounds(fc).withColumn("series_end", F.lit(7))))[0][4] == 7


def test_orders_of_a_fit_are_no_rows(spark):
    plan = physical(QUERIES["q_backtest_differences"](spark, SMALL))
    assert "_order#" not in plan and plan.count("MapInArrow") >= 1


def test_supports_of_a_stack_are_no_rows(spark):
    assert "_mask#" not in physical(QUERIES["q_stack_exact"](spark, SMALL))


def stored(spark):
    return len(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/lagloom/fits-*"))


@pytest.mark.parametrize("name, times", [("q_refresh_state", 1), ("q_refresh", 2), ("q_write_refresh", 1), ("q_write_tasks", 1)])
def test_fits_are_stored_before_they_are_filtered(spark, name, times):
    """A filter on a fit's error goes below the fit and makes it anew; several readers make it once more each."""
    before = stored(spark)
    QUERIES[name](spark, SMALL)
    assert stored(spark) == before + times


def test_search_is_the_same_whatever_is_stepped_together(spark, monkeypatch):
    stacked = _stacked(spark, SMALL)
    whole = {(r.series_id, r.target): r for r in st.find_stack_weights(stacked, patience=40).collect()}
    monkeypatch.setattr(st, "CHAINS", 3)
    assert {(r.series_id, r.target): r for r in st.find_stack_weights(stacked, patience=40).collect()} == whole


def test_subsets_of_all_sizes_come_from_one_pass(spark):
    assert "Union" not in physical(QUERIES["q_screen_all"](spark, SMALL))
