"""Registered queries beside their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "q_cohort_to_calendar", "q_transpose", "q_spine", "q_group_count", "q_make_features", "q_feature_table",
    "q_read_index", "q_add_observed", "q_complete_periods", "q_tasks", "q_screen", "q_backtest_linear",
    "q_backtest_gram", "q_arima_white", "q_backtest_ma", "q_choose_differences", "q_backtest_differences", "q_stack_exact",
    "q_inseason", "q_weighted_metrics", "q_avg_rank", "q_rank_by_mape", "q_combine",
    "q_ensemble_decay", "q_score_grid", "q_sweep_window", "q_chosen",
]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = contract.queries()[name](spark, SMALL).toPandas()
    assert len(got) and compare(got, connect(SMALL).execute(contract.oracle_sql()[name]).df()) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
