"""In-sample screening of candidate models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list
from lagloom.operators.candidates import Candidates, with_labels
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.operators.fit_linear import centred, moments, solve


def screen_subsets(
    df: DataFrame,
    candidates: Candidates,
    keys: str | Iterable[str] = KEYS,
    value: str = "abundance",
) -> DataFrame:
    """AICc of every subset fitted once to all complete rows of each series.

    The rows are reduced to one vector of sums per series by an ordinary
    aggregation, and every subset is solved from those sums.
    """
    keys, names = as_list(keys), list(candidates.covariates)
    complete = drop_incomplete(df, [value, *names])
    complete = centred(complete, names, value, keys)
    sums = complete.groupBy(*keys).agg(*moments(names, value, cross=candidates.max_vars > 1, level=F.col("_level")))
    tasks = candidates.pair(sums, spread_by=keys if candidates.max_vars > 1 else None)
    fits = solve(tasks, len(names), candidates.max_vars, targets=False)
    return with_labels(fits).select(*keys, "model", "formula", "n_obs", "aicc")
