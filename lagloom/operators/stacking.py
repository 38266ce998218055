"""Stacking weights: scoring candidate weight vectors and searching for good ones.

The input of a (series, target) is one row of arrays sized by the window and the
number of eligible models, both parameters; it never grows with the data.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagloom.functions.metrics import BY_NAME
from lagloom.functions.safe import as_list, spread
from lagloom.operators.ensemble import in_targets
from lagloom.operators.features import KEYS
from lagloom.operators.sweep import eliminated
from lagloom.sources.session import ship


#: Chains stepped together; a worker holds the histories of so many, however many rows a batch has.
CHAINS = 4096


def stack_input(
    ranked: DataFrame,
    years: int,
    n: int,
    slide: int,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
) -> DataFrame:
    """Per (series, target): models, window times, observations, predictions.

    ``preds`` holds one vector per time, ordered as ``models``.  Only observed
    times for which every eligible model has a forecast are kept.
    """
    keys = as_list(keys)
    frame = Window.partitionBy(*keys, "model").orderBy(time).rangeBetween(-slide, -1)
    known = F.col("abundance").isNotNull() & F.col("predicted_abundance").isNotNull()
    entry = F.struct(
        F.col(time).alias("at"), F.col("abundance").alias("obs"), F.col("predicted_abundance").alias("pred")
    )
    past = F.collect_list(F.when(known, entry)).over(frame)
    rows = in_targets(ranked.withColumn("_past", past), years, keys, time).filter(F.col("rank") <= n)
    groups = rows.groupBy(*keys, F.col(time).alias("target")).agg(
        F.sort_array(F.collect_list(F.struct("model", F.col("_past").alias("past")))).alias("m")
    )
    first = F.transform(F.get("m", F.lit(0))["past"], lambda e: e["at"])
    common = F.aggregate(
        "m", first, lambda acc, m: F.array_intersect(acc, F.transform(m["past"], lambda e: e["at"]))
    )

    def at(m: Column, when: Column) -> Column:
        return F.get(F.filter(m["past"], lambda e: e["at"] == when), F.lit(0))

    wide = groups.withColumn("at", F.array_sort(common))
    return wide.select(
        *keys,
        "target",
        F.transform("m", lambda m: m["model"]).alias("models"),
        "at",
        F.transform("at", lambda s: at(F.get("m", F.lit(0)), s)["obs"]).alias("obs"),
        F.transform("at", lambda s: F.transform("m", lambda m: at(m, s)["pred"])).alias("preds"),
    ).filter(F.size("at") > 0)


def pair_simplex(stacked: DataFrame, steps: int) -> DataFrame:
    """Every stack row with the weight vectors on a grid of ``1 / steps``.

    The vectors, one weight per model of the row, are generated inside the row:
    ``cand`` is the text of their integer parts, ``weights`` the vector.
    """
    size = F.size("models")
    cuts = F.sequence(F.lit(0), F.lit(steps))

    def longer(parts: Column) -> Column:
        left = F.lit(steps) - F.aggregate(parts, F.lit(0), lambda acc, v: acc + v)
        return F.transform(
            F.filter(cuts, lambda c: c <= left), lambda c: F.concat(parts, F.array(c))
        )

    def closed(parts: Column) -> Column:
        used = F.aggregate(parts, F.lit(0), lambda acc, v: acc + v)
        return F.concat(parts, F.array(F.lit(steps) - used))

    start = F.array(F.array().cast("array<int>"))
    grown = F.aggregate(
        F.slice("models", F.lit(1), size - 1), start, lambda acc, _: F.flatten(F.transform(acc, longer))
    )
    parts = F.transform(grown, closed)
    return (
        stacked.withColumn("_parts", F.explode(parts))
        .withColumn("cand", F.array_join(F.transform("_parts", lambda v: v.cast("string")), "-"))
        .withColumn("weights", F.transform("_parts", lambda v: v / F.lit(float(steps))))
        .drop("_parts")
    )


def score_weights(
    paired: DataFrame, metric: str | Sequence[str] = "MAPE", keys: str | Iterable[str] = KEYS
) -> DataFrame:
    """The metric of every (stack row, ``cand``, ``weights``) as ``score``; of several, each as ``<name>_score``.

    The sums are combined on the map side, one result per (row, candidate).
    """
    by = [*as_list(keys), "target"]
    points = paired.select(*by, "cand", "weights", F.explode(F.arrays_zip("obs", "preds")).alias("r"))
    mixed = F.aggregate(
        F.zip_with("r.preds", "weights", lambda p, w: p * w), F.lit(0.0), lambda acc, v: acc + v
    )
    wanted = {"score": metric} if isinstance(metric, str) else {f"{m.lower()}_score": m for m in metric}
    return points.groupBy(*by, "cand").agg(*[BY_NAME[m](F.col("r.obs"), mixed).alias(c) for c, m in wanted.items()])


def best_candidate(scores: DataFrame, keys: str | Iterable[str] = KEYS) -> DataFrame:
    """The candidate of least score per stack row, ties to the first by name."""
    by = [*as_list(keys), "target"]
    least = scores.groupBy(*by).agg(F.min(F.struct("score", "cand")).alias("b"))
    return least.select(*by, "b.score", "b.cand")


def exact_weights(stacked: DataFrame, keys: str | Iterable[str] = KEYS) -> DataFrame:
    """The weights of least RMSE on the simplex, exactly: keys, target, models, weights, score.

    With weights that sum to one, the error of a mixture is the mixture of the
    errors, so all that matters is the members' Gram matrix of errors.  On each support the
    weights solve a small system in the differences to the support's last member; supports
    with a negative weight or dependent members are no optimum of their own, and the least of the rest is the
    optimum.  The 2 ** n - 1 supports of n models are solved one after the other for all rows of a batch.
    """
    by = [*as_list(keys), "target"]
    rows = stacked.filter((F.size("models") > 0) & (F.size("obs") > 0)).select(*by, "models", "obs", "preds")
    found = [T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("score", T.DoubleType())]
    result = T.StructType([*[rows.schema[c] for c in (*by, "models")], *found])
    ship(stacked.sparkSession)
    return spread(rows, *by).mapInArrow(_exact_batches, result).filter("score IS NOT NULL")


def _exact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``weights`` and ``score`` in place of ``obs`` and ``preds``, rows of one shape solved together."""
    for batch in batches:
        obs, preds = batch.column("obs"), batch.column("preds")
        times, members = (batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(int) for c in ("obs", "models"))
        weights, score = [None] * batch.num_rows, np.full(batch.num_rows, np.nan)
        known = np.zeros(batch.num_rows, bool)
        for t, n in set(zip(times.tolist(), members.tolist())):
            rows = np.flatnonzero((times == t) & (members == n))
            o = obs.take(pa.array(rows)).flatten()
            p = preds.take(pa.array(rows)).flatten().flatten()
            gone = p.is_null().to_numpy(zero_copy_only=False).reshape(-1, t, n).any(axis=1)
            gone |= o.is_null().to_numpy(zero_copy_only=False).reshape(-1, t).any(axis=1)[:, None]
            o, p = o.to_numpy(zero_copy_only=False).reshape(-1, t), p.to_numpy(zero_copy_only=False).reshape(-1, t, n)
            w, s, good = _exact(p - o[:, :, None], gone)
            known[rows], score[rows] = good, s
            for row, own, ok in zip(rows.tolist(), w, good.tolist()):
                weights[row] = own if ok else None
        kept = [c for c in batch.schema.names if c not in ("obs", "preds")]
        solved = [pa.array(weights, pa.list_(pa.float64())), pa.array(score, mask=~known)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *solved], names=[*kept, "weights", "score"])


def _exact(errors: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, score, whether there are any) of errors ``[row, time, member]``; members that are ``gone`` take no part."""
    count, t, n = errors.shape
    with np.errstate(all="ignore"):
        g = np.zeros((count, n, n))
        for at in range(t):
            g = g + errors[:, at, :, None] * errors[:, at, None, :]
        best, least, found = np.zeros((count, n)), np.full(count, np.nan), np.zeros(count, bool)
        # smaller supports first, so that an equal score keeps them
        for mask in sorted(range(1, 2**n), key=lambda m: (m.bit_count(), m)):
            own = [i for i in range(n) if mask >> i & 1]
            size, end = len(own) - 1, own[-1]
            # regressors: the other members' errors less the last one's; response: minus the last one's
            matrix = np.empty((count, size + 1, size + 1))
            last = g[:, end, end]
            for a, i in enumerate(own[:-1]):
                for b, j in enumerate(own[:-1]):
                    matrix[:, a, b] = g[:, i, j] - g[:, i, end] - g[:, j, end] + last
                matrix[:, a, size], matrix[:, size, a] = last - g[:, i, end], last - g[:, end, i]
            matrix[:, size, size] = last
            matrix, good = eliminated(matrix, size)
            w = matrix[:, :size, size]
            total = np.zeros(count)
            for a in range(size):
                total = total + w[:, a]
            w = np.column_stack([w, 1 - total])
            value = np.sqrt(np.maximum(matrix[:, size, size], 0.0) / t)
            good = good & ~(w < 0).any(axis=1) & ~gone[:, own].any(axis=1)
            better = good & (~found | (value < least) | (np.isnan(least) & ~np.isnan(value)))
            least, found = np.where(better, value, least), found | better
            here = np.zeros((count, n))
            here[:, own] = w
            best = np.where(better[:, None], here, best)
    return best, least, found


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit counters: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform_draws(chain: np.ndarray, turn: int, slot: int, trial: int) -> np.ndarray:
    """Numbers between 0 and 1, one per chain, a function of chain, turn, slot and trial."""
    counter = np.uint64((turn * 0x9E3779B97F4A7C15 + slot * 0xD1B54A32D192ED03 + trial * 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF)
    return ((_mixed_bits(chain + counter) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gamma_draws(chain: np.ndarray, turn: int, shape: np.ndarray) -> np.ndarray:
    """Gamma variates ``[chain, slot]`` of the given shapes, by squeezed normal cubes; small shapes by a power of a uniform."""
    out = np.empty_like(shape)
    for slot in range(shape.shape[1]):
        a = shape[:, slot]
        d = np.where(a < 1, a + 1, a) - 1 / 3
        c = 1 / np.sqrt(9 * d)
        value, left, trial = np.empty(len(a)), np.arange(len(a)), 0
        while len(left):
            u = [uniform_draws(chain[left], turn, 4 * slot + 1 + i, trial) for i in range(3)]
            x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
            v = (1 + c[left] * x) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                good = (v > 0) & (np.log(u[2]) < 0.5 * x * x + d[left] * (1 - v + np.log(np.where(v > 0, v, 1.0))))
            value[left[good]] = d[left[good]] * v[good]
            left, trial = left[~good], trial + 1
        power = np.where(a < 1, 1 / a, 0.0)
        out[:, slot] = value * uniform_draws(chain, turn, 4 * slot + 4, 0) ** power
    return out


def find_stack_weights(
    stacked: DataFrame,
    metric: str = "MAPE",
    patience: int = 500,
    tau: float = 1.0,
    seed: int = 123,
    keys: str | Iterable[str] = KEYS,
) -> DataFrame:
    """Random search on the simplex, one independent chain per (series, target).

    A better vector is kept; a worse one is kept as the starting point of the
    next proposal with probability best/current.  Proposals are Dirichlet with
    parameters ``current * tau + 0.01``; the chain stops after ``patience``
    proposals without improvement.  Every draw is a function of seed, key and step, so
    all chains of a batch are drawn together and none depends on its neighbours.

    Returns keys, target, models, weights, score and the score history.
    """
    keys = as_list(keys)
    metric = "MSA_MEDIAN" if metric == "MSA" else metric  # the search has always meant the median by that name
    if metric not in BY_NAME:
        raise ValueError(f"unknown metric {metric}")
    key_seed = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.col("target"))
    tasks = stacked.select(*keys, "target", "models", "obs", "preds", key_seed.alias("_seed"))
    kept = [*keys, "target", "models"]
    result = T.StructType(
        [tasks.schema[c] for c in kept]
        + [
            T.StructField("weights", T.ArrayType(T.DoubleType())),
            T.StructField("score", T.DoubleType()),
            T.StructField("history", T.ArrayType(T.DoubleType())),
        ]
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (batch.iloc[at : at + CHAINS].reset_index(drop=True) for batch in batches for at in range(0, len(batch), CHAINS))
        for batch in pieces:
            found = pd.DataFrame({"weights": None, "score": np.nan, "history": None}, index=range(len(batch)), dtype=object)
            sizes = batch["preds"].map(lambda p: (len(p), len(p[0]) if len(p) else 0)).to_numpy()
            for shape in sorted(set(sizes)):
                rows = np.flatnonzero([x == shape for x in sizes])
                if min(shape) < 1:
                    continue
                obs = np.stack(batch["obs"].iloc[rows]).astype(float)
                preds = np.array([[list(r) for r in p] for p in batch["preds"].iloc[rows]], float)
                for i, chain in zip(rows, _chains(obs, preds, batch["_seed"].iloc[rows].to_numpy())):
                    found.iloc[i] = chain
                del obs, preds
            found["score"] = found["score"].astype(float)
            yield pd.concat([batch[kept].reset_index(drop=True), found], axis=1)

    def score(obs: np.ndarray, pred: np.ndarray) -> np.ndarray:
        """Of every chain: rows are chains, columns its observed times."""
        relative = (pred - obs) / obs
        if metric == "RMSE":
            return np.sqrt(np.mean((obs - pred) ** 2, axis=1))
        if metric == "MAPE":
            return 100 * np.mean(np.abs(relative), axis=1)
        if metric == "MPE":
            return np.mean(relative, axis=1)
        log_ratio = np.abs(np.log(obs / pred))
        centre = np.median(log_ratio, axis=1) if metric == "MSA_MEDIAN" else np.mean(log_ratio, axis=1)
        return 100 * (np.exp(centre) - 1)

    def _chains(obs: np.ndarray, preds: np.ndarray, seeds: np.ndarray):
        """All chains of one shape, stepped together."""
        count, _, k = preds.shape
        mixed = lambda w, own: np.matmul(preds[own], w[:, :, None])[:, :, 0]
        start = _mixed_bits(seeds.astype(np.int64).view(np.uint64) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
        turn = 0
        best = np.full((count, k), 1 / k)
        current, idle = best.copy(), np.ones(count, int)
        with np.errstate(all="ignore"):
            least = score(obs, mixed(best, slice(None)))
            history = [array("d", [v]) for v in least]
            own = np.flatnonzero(np.isfinite(least) & (idle < patience))
            while len(own):
                turn += 1
                raw = gamma_draws(start[own], turn, current[own] * tau + 0.01)
                toss = uniform_draws(start[own], turn, 0, 0)
                total = raw.sum(axis=1, keepdims=True)
                proposal = np.where(total > 0, raw / total, best[own])
                value = score(obs[own], mixed(proposal, own))
                better = value < least[own]
                least[own] = np.where(better, value, least[own])
                best[own] = np.where(better[:, None], proposal, best[own])
                idle[own] = np.where(better, 1, idle[own] + 1)
                keep = (value != 0) & (toss < least[own] / value)
                current[own] = np.where(keep[:, None], proposal, best[own])
                for i, v in zip(own.tolist(), least[own].tolist()):
                    history[i].append(v)
                own = own[idle[own] < patience]
        for i in range(count):
            yield (best[i], least[i], np.array(history[i])) if np.isfinite(least[i]) else (None, np.nan, None)

    ship(stacked.sparkSession)
    return spread(tasks, *keys, "target").mapInPandas(search, result)


def stack_weights(
    stacked: DataFrame, metric: str = "MAPE", exact: bool = False, keys: str | Iterable[str] = KEYS, **search
) -> DataFrame:
    """Weights by the random search, or the optimum itself where ``exact`` (RMSE only)."""
    if not exact:
        return find_stack_weights(stacked, metric, keys=keys, **search)
    if metric != "RMSE":
        raise ValueError("the optimum is known for RMSE only")
    return exact_weights(stacked, keys)


def weight_rows(found: DataFrame, keys: str | Iterable[str] = KEYS) -> DataFrame:
    """One row per (series, target, model) from arrays of models and weights."""
    pair = F.explode(F.arrays_zip("models", "weights")).alias("_p")
    return found.select(*as_list(keys), "target", pair).select(
        *as_list(keys), "target", F.col("_p.models").alias("model"), F.col("_p.weights").alias("weight")
    )
