import numpy as np
import pytest
from panels import panel, to_spark
from pyspark.sql import functions as F

from lagloom.operators.candidates import Candidates
from lagloom.operators.error_orders import fit_orders
from lagloom.plans.forecast import forecast, next_forecast
from lagloom.plans.refresh import upsert
from lagloom.sources import readers, writers

MADE = Candidates(("a", "b", "c"), 0, 2)


def rows(df, *columns):
    keep = columns or ("series_id", "t", "predicted_abundance", "lo_95", "hi_95")
    return sorted(tuple(r[c] for c in keep) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    return to_spark(spark, panel(n_series=2, n_times=45))


@pytest.fixture(scope="module")
def full(data):
    return forecast(data, MADE, years=6, slide=5, n=4)


def close(a, b):
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert np.array([r[2:] for r in a]) == pytest.approx(np.array([r[2:] for r in b]), rel=1e-9)


def test_run_is_complete(full):
    assert full.forecasts.count() == 2 * 11 * 6 and full.errors.count() == 0
    assert full.chosen.count() == 2 * 6 and full.best_by_year.count() == 2 * 6
    assert full.skill_table.count() == 2 * 6
    latest = next_forecast(full).collect()
    assert len(latest) == 2 and all(r.t == 144 and r.abundance is None for r in latest)
    assert full.weights.count() == 2 * 4
    assert {r.model for r in full.summary.collect()} >= {"1", "Equal_weighted"}


def test_supplied_and_refreshed_runs_equal_the_full_run(spark, data, full):
    options = dict(years=6, slide=5, n=4)
    close(rows(forecast(data, MADE, supplied=full.forecasts, **options).chosen), rows(full.chosen))
    stale = full.forecasts.withColumn(
        "aicc", F.when(F.col("t") >= 143, F.lit(-1e6)).otherwise(F.col("aicc"))
    )
    again = forecast(data, MADE, supplied=stale, update_last_year=True, **options)
    close(rows(again.chosen), rows(full.chosen))
    merged = upsert(stale, full.forecasts.filter("t >= 143"))
    assert merged.count() == full.forecasts.count()


def test_one_series_equals_the_same_series_in_the_panel(data, full):
    alone = forecast(data.filter("series_id = 's1'"), MADE, years=6, slide=5, n=4)
    close(rows(alone.chosen), rows(full.chosen.filter("series_id = 's1'")))


def test_stacking_and_order_runs(data):
    run = forecast(data, Candidates(("a", "b"), 0, 1), 3, 4, 2, stacking=True, patience=30, fitter=fit_orders, max_p=1, max_q=0)
    schemes = {r.model for r in run.ensembles.select("model").distinct().collect()}
    assert "Stack_weighted" in schemes and len(schemes) == 6
    weights = run.weights.collect()
    assert sum(r.stacking_weight for r in weights if r.series_id == "s0") == pytest.approx(1, abs=1e-3)


def test_results_can_be_written_and_read(spark, full, tmp_path):
    folders = writers.write_results({"f": full.forecasts, "p": full.performance}, str(tmp_path), ["t"])
    back = readers.read_forecasts(spark, folders["f"])
    close(rows(back), rows(full.forecasts))
    writers.write_tasks(full.forecasts, str(tmp_path / "tasks"))
    one = spark.read.parquet(str(tmp_path / "tasks" / "by_task" / "origin_year=140" / "model=1"))
    assert one.count() == 2


def test_shared_folder_is_the_one_the_session_names(spark):
    assert writers.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert writers.shared_folder(spark) in writers.cut_lineage(spark.range(5)).inputFiles()[0]
