"""All subsets of the covariates from one matrix per series, neighbours sharing their elimination.

The subsets form a tree: a child adds one later covariate to its parent.  A
row carries its matrix as swept so far, so a child costs one more pivot, never a
solve of its own; a level of the tree is one projection over all series.

``best_subset`` prunes the tree.  Adding covariates never raises the residual sum of
squares, so below a node it is no less than with everything that may still be added; if even that,
with one more parameter alone, does not reach the best AICc known for the series, the branch is left out.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, spread
from lagloom.operators.candidates import Candidates, with_labels
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.operators.fit_linear import centred, moments
from lagloom.operators.sweep import TOLERANCE, corner, swept
from lagloom.sources.writers import cut_lineage


def _matrices(df: DataFrame, names: list[str], keys: list[str], value: str) -> DataFrame:
    """Per series: n_obs and the centred products of covariates and response, row by row, with their diagonal."""
    rows = centred(drop_incomplete(df, [value, *names]), names, value, keys)
    sums = rows.groupBy(*keys).agg(*moments(names, value, cross=True, level=F.col("_level")))
    p = len(names)

    def product(i: int, j: int) -> Column:
        n = F.col("n_obs")
        if i == p and j == p:
            return F.col("syy") - F.col("sy") * F.col("sy") / n
        if p in (i, j):
            k = min(i, j)
            return F.get("sxy", F.lit(k)) - F.get("sx", F.lit(k)) * F.col("sy") / n
        low, high = min(i, j), max(i, j)
        at = low * p - low * (low - 1) // 2 + high - low
        return F.get("sxx", F.lit(at)) - F.get("sx", F.lit(low)) * F.get("sx", F.lit(high)) / n

    cells = F.array(*[product(i, j) for i in range(p + 1) for j in range(p + 1)])
    out = sums.select(*keys, "n_obs", cells.alias("m"))
    return out.withColumn("first", F.array(*[F.get("m", F.lit(i * (p + 2))) for i in range(p + 1)]))


def _aicc(rss: Column, size: Column) -> Column:
    n, params = F.col("n_obs"), size + 2
    value = n * (F.ln(2 * np.pi * rss / n) + 1) + 2 * params + 2 * params * (params + 1) / (n - params - 1)
    return F.when((n > params + 1) & (rss > 1e-12 * F.element_at("first", -1)), value)


def _children(nodes: DataFrame, p: int, keep: bool = False) -> DataFrame:
    """Every node with one more, later covariate, swept into its matrix; NULL where it depends on those before.

    With ``keep`` nodes have ``_open``; the parents stay, closed, and closed ones have no children.
    """
    last = F.coalesce(F.try_element_at("positions", F.lit(-1)), F.lit(-1))
    later = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: i > last)
    if keep:
        later = F.concat(F.array(F.lit(-1)), F.when(F.col("_open"), later).otherwise(F.array().cast("array<int>")))
    out = nodes.withColumn("_add", F.explode(later))
    grow = F.col("_add") >= 0
    solid = F.get("m", F.col("_add") * (p + 2)) > TOLERANCE * F.get("first", F.col("_add"))
    made = F.when(solid, swept(F.col("m"), F.array("_add"), F.lit(p + 1)))
    out = out.withColumn("m", F.when(grow, made).otherwise(F.col("m")) if keep else made)
    out = out.withColumn("positions", F.when(grow, F.concat("positions", F.array("_add"))).otherwise(F.col("positions")))
    if keep:
        out = out.withColumn("_open", grow)
    aicc = _aicc(corner(F.col("m")), F.size("positions"))
    return out.withColumn("aicc", F.when(grow, aicc).otherwise(F.col("aicc")) if keep else aicc).drop("_add")


def _root(df: DataFrame, names: list[str], keys: list[str], value: str) -> DataFrame:
    rows = spread(_matrices(df, names, keys, value), *keys)
    rows = rows.withColumn("positions", F.array().cast("array<int>"))
    return rows.withColumn("aicc", _aicc(corner(F.col("m")), F.lit(0)))


def _labelled(nodes: DataFrame, candidates: Candidates, keys: list[str], more: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in candidates.covariates])
    out = nodes.withColumn("covariates", F.transform("positions", lambda p: F.get(names, p)))
    out = with_labels(out.withColumn("model", candidates._number().cast("int")))
    return out.select(*keys, "model", "formula", "n_obs", "aicc", *more)


def screen_all(
    df: DataFrame, candidates: Candidates, keys: str | Iterable[str] = KEYS, value: str = "abundance"
) -> DataFrame:
    """AICc of every subset, as ``screen_subsets`` gives it, by one pivot each; NULL where covariates depend on each other."""
    keys, names = as_list(keys), list(candidates.covariates)
    # a level keeps its parents, closed; beside one another the levels would each hold their own sums in every task
    found = _root(df, names, keys, value).withColumn("_open", F.lit(True))
    for _ in range(candidates.sizes[-1] if candidates.sizes else 0):
        found = _children(found, len(names), keep=True)
    size = F.size("positions")
    wanted = size.isin([*candidates.sizes, *[0] * candidates.with_null])
    return _labelled(found.filter(wanted), candidates, keys, [])


def best_subset(
    df: DataFrame, candidates: Candidates, keys: str | Iterable[str] = KEYS, value: str = "abundance"
) -> DataFrame:
    """The subset of least AICc per series, the smaller number on ties, with ``visited``, the subsets looked at to find it."""
    keys, names = as_list(keys), list(candidates.covariates)
    p, sizes = len(names), candidates.sizes
    open_nodes = _root(df, names, keys, value)
    level = open_nodes if candidates.with_null else open_nodes.withColumn("aicc", F.lit(None).cast("double"))
    found = cut_lineage(level, "subsets")
    open_nodes = found
    for size in range(1, (sizes[-1] if sizes else 0) + 1):
        least = found.groupBy(*keys).agg(F.min("aicc").alias("_least"))
        rest = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: i > F.coalesce(F.try_element_at("positions", F.lit(-1)), F.lit(-1)))
        # the residual with all that may still be added; a dependent covariate adds nothing, so the bound is then left open
        full = corner(swept(F.col("m"), rest, F.lit(p + 1)))
        bound = _aicc(full, F.size("positions") + 1)
        same = [open_nodes[k].eqNullSafe(least[k]) for k in keys]
        wide = open_nodes.join(least, same).select(open_nodes["*"], "_least").withColumn("_bound", bound)
        hope = F.col("_least").isNull() | F.col("_bound").isNull() | (F.col("_bound") <= F.col("_least"))
        open_nodes = cut_lineage(_children(wide.filter(hope).drop("_least", "_bound"), p).filter("m IS NOT NULL"), "subsets")
        if size < sizes[0]:
            continue
        found = found.union(open_nodes)
    own = found.withColumn("_number", candidates._number())
    best = own.groupBy(*keys).agg(
        F.min_by(F.struct("positions", "n_obs", "aicc"), F.struct(F.col("aicc").isNull(), "aicc", "_number")).alias("b"),
        F.count("aicc").alias("visited"),
    )
    best = best.select(*keys, "b.*", "visited").filter("aicc IS NOT NULL")
    return _labelled(best, candidates, keys, ["visited"])
