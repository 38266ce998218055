import pytest
from pyspark.sql import functions as F

from lagloom.functions import metrics as me

# Observations of 2008-2022 and two published forecast series.
OBSERVED = [576.9, 1051, 546.5, 454.2, 183.1, 335.1, 1316.5, 268.9, 247.7, 291.8, 182.8, 340.7, 387.7, 841.3, 696]
BEST = [302.50, 650.22, 827.24, 803.54, 352.12, 503.21, 986.32, 760.15, 360.50, 417.04, 342.75, 874.73, 216.86, 329.44, 735.67]
RMSE_WEIGHTED = [562.03, 749.82, 678.21, 688.24, 491.88, 333.75, 410.75, 648.39, 495.24, 341.16, 311.24, 337.65, 269.57, 427.23, 669.24]


def pairs(spark, observed, predicted):
    rows = [("s", 2008 + i, o, p) for i, (o, p) in enumerate(zip(observed, predicted))]
    return spark.createDataFrame(rows, "series_id string, t int, abundance double, predicted_abundance double")


@pytest.mark.parametrize(
    "predicted, expected",
    [(BEST, (67.17, 313.68, 74.80, 0.85)), (RMSE_WEIGHTED, (50.49, 315.08, 54.27, 0.68))],
)
def test_published_metrics(spark, predicted, expected):
    df = pairs(spark, [float(o) for o in OBSERVED] + [None], [*predicted, 808.37])
    for out in (me.accuracy(df, "series_id"), me.skill(df, "series_id")):
        row = out.first()
        assert tuple(round(row[m], 2) for m in me.ACCURACY) == expected


def test_undefined_terms_are_null_and_empty_groups_stay(spark):
    rows = [("zero", 1, 0.0, 5.0), ("zero", 2, 10.0, 5.0), ("none", 1, None, 5.0), ("same", 1, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "series_id string, t int, abundance double, predicted_abundance double")
    out = {r.series_id: r for r in me.accuracy(df, "series_id", weighted=True).collect()}
    assert out["zero"].mape == pytest.approx(50.0) and out["zero"].rmse == pytest.approx(5.0)
    assert out["none"].mape is None and out["none"].rmse is None
    assert out["same"].mape == 0 and out["same"].msa == 0 and out["same"].mase is None
    assert {r.series_id for r in me.skill(df, "series_id").collect()} == {"zero", "same"}


def test_previous_observation_differs_between_accuracy_and_skill(spark):
    df = pairs(spark, [10.0, None, 30.0], [11.0, 5.0, 33.0])
    # accuracy compares 30 with 10; skill's previous row has no observation.
    assert me.accuracy(df, "series_id").first().mase == pytest.approx(2.0 / 20.0)
    assert me.skill(df, "series_id").first().mase is None


def test_errors_and_percent_text(spark):
    row = me.with_errors(pairs(spark, [200.0], [150.0])).first()
    assert (row.error, row.ape, row.pct_error, row.pct_text) == (-50.0, 0.25, -0.25, "-25.0%")
    flipped = me.with_errors(pairs(spark, [200.0], [150.0]), sign="obs-pred").first()
    assert flipped.error == 50.0
    assert me.with_errors(pairs(spark, [0.0], [1.0])).first().pct_text is None


def test_named_metrics(spark):
    df = pairs(spark, [100.0, 200.0, 400.0], [110.0, 100.0, 400.0])
    o, p = F.col("abundance"), F.col("predicted_abundance")
    row = df.agg(me.mpe(o, p).alias("mpe"), me.msa_median(o, p).alias("med")).first()
    assert row.mpe == pytest.approx((0.1 - 0.5 + 0) / 3)
    assert row.med == pytest.approx(10.0)
