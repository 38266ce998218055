"""Regressions whose errors are autoregressive, moving-average, seasonal or integrated, from expanding sums.

Four steps, all windows over (series, time) and none of them an iteration:

1. The number of differences is read from a level-stationarity statistic of all
   earlier rows, whose squared partial sums are sums of products as well.
2. A long autoregression, fitted anew at every row from the rows before it, leaves
   one prediction error per row.
3. These errors, lagged, are regressors like the lagged response and the response
   one season back (Hannan and Rissanen's second stage).  One expanding matrix of cross products holds
   them all; every order and every subset of covariates is swept out of it.
4. The order with the least AICc is kept.  All orders of a fit see the same rows, so
   their AICc are comparable; the number of differences is chosen before.

Nothing looks ahead: the errors at a row come from fits of earlier rows only, so they
do not change with the origin.  With two periods to forecast, the second takes the forecast of the first
as its lag, an error of zero, and the variance that this adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagloom.functions.safe import as_list, present, spread
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.operators.fit_linear import intervals
from lagloom.operators.sweep import dot, eliminated, gram
from lagloom.sources.session import ship

# 5 % critical value of the level-stationarity statistic (fixed value).
CRITICAL = 0.463


def stationarity_lags(n: Column | int):
    """Lags of the long-run variance for ``n`` values."""
    return int(3 * np.sqrt(n) / 13) if isinstance(n, int) else F.floor(3 * F.sqrt(n) / 13)


def level_statistic(df: DataFrame, column: str, name: str, keys: Sequence[str], time: str, lags: int) -> DataFrame:
    """``name``: the level-stationarity statistic of the earlier values of ``column``, missing ones left out.

    With prefix sums ``P_i``, the partial sums of the centred values are ``P_i -
    i * mean``; their squares and the autocovariances up to ``lags`` open into
    sums that grow by one row.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    y = F.col(column)
    rows = df.withColumns({"_p": F.sum(y).over(upto), "_i": F.when(y.isNotNull(), F.count(y).over(upto))})
    held = F.when(y.isNotNull(), F.col("_p"))
    total = {
        "_m": F.count(y), "_sy": F.sum(y), "_syy": F.sum(y * y), "_spp": F.sum(held * held), "_sip": F.sum(F.col("_i") * held),
    }
    for j in range(1, lags + 1):
        total[f"_c{j}"] = F.sum(y * F.col(f"_l{j}"))
        total[f"_h{j}"] = F.sum(F.when(F.col("_i") <= j, y))
        total[f"_t{j}"] = F.sum(F.col(f"_l{j}"))  # all but the last j
    rows = rows.withColumns({f"_l{j}": F.lag(y, j).over(order) for j in range(1, lags + 1)})
    rows = rows.withColumns({k: v.over(past) for k, v in total.items()})
    m, mean = F.col("_m"), F.col("_sy") / F.col("_m")
    squares = F.col("_spp") - 2 * mean * F.col("_sip") + mean * mean * m * (m + 1) * (2 * m + 1) / 6
    long_run = F.col("_syy") - m * mean * mean
    for j in range(1, lags + 1):
        covariance = F.col(f"_c{j}") - mean * (F.col("_sy") - F.col(f"_h{j}") + F.col(f"_t{j}")) + (m - j) * mean * mean
        share = 1 - F.lit(float(j)) / (stationarity_lags(m) + 1)
        long_run = long_run + F.when(share > 0, 2 * share * covariance).otherwise(0.0)
    helpers = ["_p", "_i", *total, *[f"_l{j}" for j in range(1, lags + 1)]]
    return rows.withColumn(name, F.when(long_run > 0, squares / m / long_run)).drop(*helpers)


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the longest series: the calendar's length."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def differenced(df: DataFrame, column: str, name: str, times: int, keys: Sequence[str], time: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(time)
    value = F.col(column)
    for _ in range(times):
        df = df.withColumn(name, value - F.lag(value).over(order))
        value = F.col(name)
    return df if times else df.withColumn(name, value)


def choose_differences(
    df: DataFrame,
    value: str = "abundance",
    max_d: int = 1,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    critical: float = CRITICAL,
) -> DataFrame:
    """``df`` with ``d``, the differences that make the earlier ln(value) stationary, and ``statistic`` at no difference.

    Rows with a NULL or not positive value count as missing; a series too short or too flat for the
    statistic has 0.
    """
    keys = as_list(keys)
    whole = Window.partitionBy(*keys)
    logged = F.ln(present(F.col(value).cast("double")))
    rows = df.withColumn("_y", logged - F.avg(logged).over(whole))
    lags = stationarity_lags(longest(df, keys))
    d = F.lit(max_d)
    for times in range(max_d - 1, -1, -1):
        rows = differenced(rows, "_y", "_z", times, keys, time)
        rows = level_statistic(rows, "_z", f"_stat{times}", keys, time, lags)
        d = F.when(F.coalesce(F.col(f"_stat{times}"), F.lit(0.0)) <= critical, F.lit(times)).otherwise(d)
    statistic = F.col("_stat0") if max_d else F.lit(None).cast("double")
    helpers = ["_y", "_z", *[f"_stat{i}" for i in range(max_d)]]
    return rows.withColumns({"statistic": statistic, "d": d}).drop(*helpers)


def fit_orders(
    df: DataFrame,
    candidates: Candidates,
    last: int | None,
    max_p: int = 1,
    max_q: int = 1,
    max_d: int = 0,
    seasonal: int = 0,
    long: int = 2,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str = "abundance",
    freq: int = 1,
    first_period: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Forecasts of every model for the last ``last`` times of each series (None: all), each with its best order.

    Orders are ``p <= max_p`` lags of the response, ``q <= max_q`` lags of the
    prediction errors of an autoregression of ``long`` lags and all covariates,
    and, with ``seasonal``, the response that many rows back or not.  With ``freq=2`` a
    row is a (time, period) and ``first_period`` is as in ``fit_linear``; starting
    from period 1 the second period is two steps ahead.

    Returns the columns of ``fit_linear``; ``order`` is (p, q, P, 0, freq, d, 0), and lags
    have the coefficients ``ar1``.., ``ma1``.. and ``sar1``.
    """
    keys = as_list(keys)
    names = list(candidates.covariates)
    tags = ["period"] if "period" in df.columns else []
    two_steps = freq == 2 and first_period == 1
    rows = spread(drop_incomplete(df, names), *keys)
    rows = rows.withColumn("_step", F.col(time) if freq == 1 else F.col(time) * freq + F.col("period") - 1)
    logged = F.ln(present(F.col(value).cast("double")))
    every = Window.partitionBy(*keys)
    rows = rows.withColumns({"_level": F.coalesce(F.avg(logged).over(every), F.lit(0.0)), "_last": F.max(time).over(every)})
    rows = choose_differences(rows, value, max_d, keys, "_step")
    rows = rows.withColumn("_y", logged - F.col("_level"))
    means = {f"_x{i}": F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(every) for i, c in enumerate(names)}
    rows = rows.withColumns(means)
    frames = [
        _folds(rows, d, len(names), max_p, max_q, seasonal, long, keys, two_steps, [*keys, time, *tags, *carry]) for d in range(max_d + 1)
    ]
    folds = frames[0]
    for more in frames[1:]:
        folds = folds.unionByName(more)
    if last is not None:
        folds = folds.filter(F.col(time) > F.col("_last") - last)
    if freq > 1:
        folds = folds.filter(F.col("period") == first_period)
    terms = [*names, *[f"ar{j}" for j in range(1, max_p + 1)], *[f"ma{j}" for j in range(1, max_q + 1)], *["sar1"] * bool(seasonal)]
    fits = _best(_with_orders(folds, candidates, max_p, max_q, seasonal), [*keys, time, *tags, "model"])
    fits = _two_steps(fits, terms, time) if two_steps else fits
    fits = intervals(fits.withColumn("mu", F.col("mu") + F.col("_level")), "_variance")
    order = F.array("p", "q", "sp", F.lit(0), F.lit(freq), "d", F.lit(0))
    labels = F.transform("positions", lambda i: F.get(F.array(*[F.lit(t) for t in terms]), i)) if terms else F.array().cast("array<string>")
    coef = F.map_from_arrays(F.concat(F.array(F.lit("intercept")), labels), F.concat(F.array("_constant"), "_b"))
    return fits.select(
        *keys, time, *tags, "model", "predicted_abundance", "lo_50", "hi_50", "lo_95", "hi_95", "aicc", "sigma2",
        order.alias("order"), F.when(F.col("error").isNull(), coef).alias("coef"), F.col("_n").alias("n_obs"), "error", *carry,
    )


def _folds(rows, d, n_x, max_p, max_q, seasonal, long, keys, two_steps, kept) -> DataFrame:
    """Rows whose chosen number of differences is ``d``, with sums over all earlier rows and their own regressors."""
    order = Window.partitionBy(*keys).orderBy("_step")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = differenced(rows, "_y", "_z", d, keys, "_step")
    for i in range(n_x):
        rows = differenced(rows, f"_x{i}", f"_w{i}", d, keys, "_step")
    xs = [F.col(f"_w{i}") for i in range(n_x)]
    lagged = {f"_z{j}": F.lag("_z", j).over(order) for j in range(1, max(max_p, long, seasonal) + 1)}
    lagged |= {f"_y{j}": F.lag("_y", j).over(order) for j in range(1, d + 1)}
    rows = rows.withColumns(lagged)
    if max_q:
        first = [*xs, *[F.col(f"_z{j}") for j in range(1, long + 1)]]
        k = len(first)
        rows = rows.withColumns(gram([*first, F.col("_z")], past))
        ship(rows.sparkSession)

        def missed(n: pa.Array, s: pa.Array, q: pa.Array, x: pa.Array, z: pa.Array) -> pa.Array:
            return _prediction_errors(k, n, s, q, x, z)

        rows = rows.withColumn("_e", F.arrow_udf(missed, "double")("_n", "_s", "_q", F.array(*first).cast("array<double>"), "_z"))
        rows = rows.withColumns({f"_e{j}": F.lag("_e", j).over(order) for j in range(1, max_q + 1)})
    pool = [*xs, *[F.col(f"_z{j}") for j in range(1, max_p + 1)], *[F.col(f"_e{j}") for j in range(1, max_q + 1)]]
    if seasonal:
        pool.append(F.col(f"_z{seasonal}"))
    rows = rows.withColumns(gram([*pool, F.col("_z")], past))
    x = F.array(*pool) if pool else F.array().cast("array<double>")
    base = {0: F.lit(0.0), 1: F.col("_y1") if d else None, 2: 2 * F.col("_y1") - F.col("_y2") if d > 1 else None}[d]
    out = rows.withColumns({"_x": x, "_base": base, "_d": F.lit(d)})
    if two_steps:  # what the second period has, beside the first's sums
        out = out.withColumn("_x2", F.lead("_x").over(order))
        out = out.withColumns({"_next": F.lead("_step").over(order), "_before": F.lit(0.0) if d < 2 else F.col("_y1")})
        if "abundance" in kept:
            raise ValueError("a value to carry belongs to one period")
        out = out.withColumn("_x2", F.when(F.col("_next") == F.col("_step") + 1, F.col("_x2")))
    extra = ["_x2", "_before"] if two_steps else []
    return out.filter(F.col("d") == d).select(*kept, "d", "_level", "_last", "_n", "_s", "_q", "_x", "_base", *extra)


SOLUTION = T.StructType([
    *[T.StructField(c, T.IntegerType()) for c in ("p", "q", "sp")], T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("_b", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.DoubleType()) for c in ("_constant", "mu", "sigma2", "aicc")],
    T.StructField("error", T.StringType()),
])


def _with_orders(folds: DataFrame, candidates: Candidates, max_p: int, max_q: int, seasonal: int) -> DataFrame:
    """Every fold with every model, fitted with all orders; the one of least AICc is kept, the smaller one on ties.

    ``positions`` are those of its regressors in ``_x``.
    """
    n_x = len(candidates.covariates)
    orders = []
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            for s in range(2 if seasonal else 1):
                at = [n_x + j for j in range(p)] + [n_x + max_p + j for j in range(q)] + [n_x + max_p + max_q] * s
                orders.append((p, q, s, at))
    orders.sort(key=lambda o: (sum(o[:3]), *o[:2]))
    width = n_x + max_p + max_q + bool(seasonal) + 1
    tasks = candidates.pair(folds).drop("covariates").withColumn("_base", F.col("_base").cast("double"))
    used = ("positions", "_s", "_q", "_x")
    kept = [f for f in tasks.schema if f.name not in used]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = _solve_orders(batch, orders, width)
            rest = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, *solved], names=[*[f.name for f in kept], *SOLUTION.names])

    ship(folds.sparkSession)
    return tasks.mapInArrow(fitted, T.StructType([*kept, *SOLUTION.fields])).withColumn("_variance", F.col("sigma2"))


def _places(width: int) -> np.ndarray:
    """Where a packed upper triangle holds each entry of the matrix."""
    place = np.zeros((width, width), int)
    place[np.triu_indices(width)] = np.arange(width * (width + 1) // 2)
    return np.maximum(place, place.T)


def _prediction_errors(k: int, n: pa.Array, s: pa.Array, q: pa.Array, x: pa.Array, z: pa.Array) -> pa.Array:
    """What the regression of all ``k`` regressors on earlier rows misses of ``z``; NULL with too few rows or dependent regressors."""
    count = len(n)
    sums, products, own = (a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(count, -1) for a in (s, q, x))
    m, value = (a.to_numpy(zero_copy_only=False).astype(float) for a in (n, z))
    with np.errstate(all="ignore"):
        matrix = products[:, _places(k + 1)] - sums[:, :, None] * sums[:, None, :] / m[:, None, None]
        solved, solid = eliminated(matrix, k)
        fitted = np.zeros(count)
        for i in range(k):
            fitted = fitted + solved[:, i, k] * (own[:, i] - sums[:, i] / m)
        out = np.where(solid & (m > k + 2), value - sums[:, k] / m - fitted, np.nan)
    return pa.array(out, from_pandas=True)


def _solve_orders(batch: pa.RecordBatch, orders: Sequence[tuple], width: int) -> list[pa.Array]:
    """The columns of ``SOLUTION``: coefficients, variance, AICc and the mean one step ahead of each row's best order."""
    count = batch.num_rows

    def table(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(count, -1)

    n, base = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_n", "_base"))
    sums, products, x = table("_s"), table("_q"), table("_x")
    positions = [tuple(p) for p in batch.column("positions").to_pylist()]
    choice, least = np.full(count, -1), np.full(count, np.nan)
    numbers = {c: np.full(count, np.nan) for c in ("_constant", "mu", "sigma2", "aicc")}
    slopes_of, error = [None] * count, np.full(count, None, object)
    place = _places(width)
    for own in set(positions):
        rows = np.flatnonzero([p == own for p in positions])
        for number, (*_, at) in enumerate(orders):
            used = [*own, *at]
            size, with_response = len(used), [*used, width - 1]
            m, s = n[rows], sums[rows]
            with np.errstate(all="ignore"):
                crossed = products[rows][:, place[np.ix_(with_response, with_response)]]
                matrix = crossed - s[:, with_response][:, :, None] * s[:, with_response][:, None, :] / m[:, None, None]
                swept_matrix, solid = eliminated(matrix, size)
                b, rss = swept_matrix[:, :size, size], swept_matrix[:, size, size]
                step, ahead = np.zeros(len(rows)), np.zeros(len(rows))
                for i, position in enumerate(used):
                    step = step + b[:, i] * (s[:, position] / m)
                    ahead = ahead + b[:, i] * x[rows, position]
                constant = s[:, width - 1] / m - step
                mu = constant + ahead + base[rows]
                params = size + 2
                found = np.select(
                    [m <= params + 1, ~solid, ~np.isfinite(rss), rss <= 1e-12 * matrix[:, size, size], np.isnan(mu)],
                    ["too few observations", "singular design", "not finite", "perfect fit", "no regressors at the target"], "",
                )
                loglik = -m / 2.0 * (np.log(2 * np.pi * rss / m) + 1)
                aicc = -2 * loglik + 2 * params + 2 * params * (params + 1) / (m - params - 1)
                variance = rss / (m - size - 1)
            good = found == ""
            aicc = np.where(good, aicc, np.nan)
            values = (np.where(solid, constant, np.nan), np.where(good, mu, np.nan), np.where(good, variance, np.nan), aicc)
            better = (choice[rows] < 0) | (good & (np.isnan(least[rows]) | (aicc < least[rows])))
            new = rows[better]
            choice[new], least[new] = number, aicc[better]
            for c, value in zip(numbers, values):
                numbers[c][new] = value[better]
            error[new] = np.where(good, None, found)[better]
            for row, coefficients, ok in zip(new.tolist(), b[better], solid[better].tolist()):
                slopes_of[row] = coefficients if ok else None
    taken = [orders[c] for c in choice.tolist()]
    return [
        *[pa.array([o[i] for o in taken], pa.int32()) for i in range(3)],
        pa.array([[*p, *o[3]] for p, o in zip(positions, taken)], pa.list_(pa.int32())),
        pa.array(slopes_of, pa.list_(pa.float64())),
        *[pa.array(v, from_pandas=True) for v in numbers.values()],
        pa.array(error.tolist(), pa.string()),
    ]


def _best(tasks: DataFrame, on: Sequence[str]) -> DataFrame:
    """The order of least AICc of each fit, the smaller one on ties; rows that repeat a key and time are one fit."""
    rest = [c for c in tasks.columns if c not in on]
    rank = F.struct(F.col("error").isNotNull(), F.col("aicc"), F.col("p") + F.col("q") + F.col("sp"), "p", "q")
    best = tasks.groupBy(*on).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*on, "_best.*")


def _two_steps(fits: DataFrame, terms: Sequence[str], time: str) -> DataFrame:
    """Each fit of a period 1 as two rows: its own, and period 2 from its forecast."""
    ar1 = terms.index("ar1") if "ar1" in terms else -1
    ma1 = terms.index("ma1") if "ma1" in terms else -1

    def part(i: int) -> Column:
        return F.coalesce(F.get("_b", (F.array_position("positions", i) - 1).cast("int")), F.lit(0.0)) if i >= 0 else F.lit(0.0)

    ahead = F.col("mu") - F.col("_base")  # of the differences, where some are taken
    at = F.transform(
        "positions",
        lambda i: F.when(i == ar1, ahead).when(i == ma1, F.lit(0.0)).otherwise(F.get("_x2", i)),
    )
    step = F.col("_constant") + dot(F.col("_b"), at)
    level = F.when(F.col("d") == 0, F.lit(0.0)).when(F.col("d") == 1, F.col("mu")).otherwise(2 * F.col("mu") - F.col("_before"))
    passed = F.col("d") + F.when(F.array_contains("positions", ar1), part(ar1)).otherwise(0.0)
    passed = passed + F.when(F.array_contains("positions", ma1), part(ma1)).otherwise(0.0)
    first = F.struct(F.lit(1).alias("period"), F.col("mu"), F.col("_variance"))
    second = F.struct(F.lit(2).alias("period"), (step + level).alias("mu"), (F.col("_variance") * (1 + passed * passed)).alias("_variance"))
    both = fits.withColumn("_two", F.explode(F.array(first, second))).drop("period", "mu", "_variance")
    return both.select("*", "_two.*").drop("_two").filter((F.col("period") == 1) | F.col("mu").isNotNull() | F.col("error").isNotNull())
