"""Small generated panels for brute-force comparisons."""

import numpy as np
import pandas as pd


def panel(n_series=3, n_times=40, seed=0, covariates=("a", "b", "c"), target=True):
    """Log-linear series with covariates; the last row of each is to be forecast."""
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(n_series):
        x = rng.normal(size=(n_times, len(covariates)))
        y = np.exp(4 + 0.5 * x[:, 0] - 0.2 * x[:, 1] + 0.3 * rng.normal(size=n_times))
        frame = pd.DataFrame(x, columns=list(covariates))
        frame.insert(0, "t", np.arange(100, 100 + n_times))
        frame.insert(0, "series_id", f"s{s}")
        frame["abundance"] = y
        if target:
            frame.loc[n_times - 1, "abundance"] = np.nan
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, frame):
    frame = frame.astype(object).where(frame.notna(), None)
    kinds = {"series_id": "string", "t": "int", "year": "int", "period": "int", "model": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in frame.columns)
    rows = [tuple(r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)
