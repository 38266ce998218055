"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "q_feature_table",
    "q_backtest_linear",
    "q_backtest_gram",
    "q_backtest_all_subsets",
    "q_rolling_mape",
    "q_combine",
    "q_ensemble_skill",
    "q_sweep_window",
    "q_sweep_alpha",
    "q_stack_search",
    "q_backtest_arima",
    "q_chosen",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lagloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lagloom.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times, rows = {}, {}
    for name in names:
        began = time.perf_counter()
        out = QUERIES[name](spark, sf_dir).toPandas()
        times[name] = round(time.perf_counter() - began, 3)
        rows[name] = len(out)
    fits = sum(rows.get(n, 0) for n in ("q_backtest_linear", "q_backtest_gram", "q_backtest_all_subsets"))
    spent = sum(times.get(n, 0) for n in ("q_backtest_linear", "q_backtest_gram", "q_backtest_all_subsets"))
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "fits_per_sec": round(fits / spent, 1) if spent else None,
                "cpus": int(cpus),
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
