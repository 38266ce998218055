"""Log-scale regressions from shared sums.

Every subset of covariates needs only sums of products over its training rows.
They are computed once per (series, forecast time) by an expanding window, and
all subsets are then solved from that one row: training rows are never copied
per model or per origin.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagloom.functions.safe import as_list, present, spread
from lagloom.operators.candidates import Candidates
from lagloom.operators.features import KEYS, drop_incomplete
from lagloom.sources.session import ship

# Standard normal quantiles of the central 50 % and 95 % intervals (fixed values).
Z50 = 0.6744897501960817
Z95 = 1.959963984540054


def moments(
    covariates: Sequence[str],
    value: str = "abundance",
    cross: bool = False,
    over: WindowSpec | None = None,
    level: Column | None = None,
) -> list[Column]:
    """Sums over the rows with a defined ln(value), less ``level``, aggregated or over a window.

    ``sxx`` is the packed upper triangle of the cross products with ``cross``,
    else its diagonal, which is all that models of one covariate need.
    """
    y = F.ln(present(F.col(value).cast("double")))
    y = y - level if level is not None else y
    xs = [F.when(y.isNotNull(), F.col(c).cast("double")) for c in covariates]

    def total(term: Column) -> Column:
        return F.sum(term) if over is None else F.sum(term).over(over)

    n = F.count(y) if over is None else F.count(y).over(over)
    if cross:
        products = [xs[i] * xs[j] for i in range(len(xs)) for j in range(i, len(xs))]
    else:
        products = [x * x for x in xs]

    def vector(terms: list[Column]) -> Column:
        return F.array(*[total(t) for t in terms]) if terms else F.array().cast("array<double>")

    return [
        n.alias("n_obs"),
        total(y).alias("sy"),
        total(y * y).alias("syy"),
        vector(xs).alias("sx"),
        vector([x * y for x in xs]).alias("sxy"),
        vector(products).alias("sxx"),
    ]


def centred(rows: DataFrame, covariates: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """Covariates less their series' mean, which ``_centre`` holds, ``_level`` being that of ln(value).

    Sums of products of values far from zero lose the digits in which the
    values differ; the fits are the same after the shift.  Rows of a series
    share the partitioning of the windows that follow.
    """
    whole = Window.partitionBy(*keys)
    logged = F.ln(present(F.col(value).cast("double")))
    means = [F.avg(F.col(c).cast("double")).over(whole) for c in covariates]
    rows = rows.withColumns(
        {
            "_centre": F.array(*means) if means else F.array().cast("array<double>"),
            "_level": F.coalesce(F.avg(logged).over(whole), F.lit(0.0)),
        }
    )
    return rows.withColumns({c: F.col(c) - F.get("_centre", F.lit(i)) for i, c in enumerate(covariates)})


def uncentred(coef: Column, positions: Column | str = "positions") -> Column:
    """Coefficients of the values as they were: the shift moves the intercept alone."""
    slopes = F.slice(coef, F.lit(2), F.greatest(F.size(coef) - 1, F.lit(0)))
    shift = F.aggregate(
        F.zip_with(slopes, positions, lambda b, p: b * F.get("_centre", p)), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.when(coef.isNotNull(), F.concat(F.array(F.get(coef, F.lit(0)) + F.col("_level") - shift), slopes))


def solve(df: DataFrame, n_covariates: int, max_vars: int, targets: bool = True) -> DataFrame:
    """Least squares of each row's ``positions`` from its sums.

    Adds ``coef`` (intercept first), ``rss``, ``sigma2``, ``aicc``, ``error``
    and, with ``targets``, the forecast mean ``mu`` at covariates ``x``.  Models
    of at most one covariate are closed-form Column expressions; larger ones
    solve their small system in an Arrow batch.
    """
    if max_vars <= 1:
        fitted = _closed_form(df)
    else:
        chosen = df.withColumns(_slices(n_covariates)).drop("sx", "sxy", "sxx")
        solved = T.StructType([*chosen.schema.fields, *SOLUTION.fields])
        ship(df.sparkSession)
        fitted = chosen.mapInArrow(_solve_batches, solved).drop("_sx", "_sxy", "_sxx")
    n, k = F.col("n_obs"), F.size("positions")
    params = k + 2
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.when(n > 0, n)
    finite = present("rss").isNotNull() & F.forall("coef", lambda b: present(b).isNotNull())
    error = (
        F.when(n <= params + 1, F.lit("too few observations"))
        .when(F.col("coef").isNull(), F.lit("singular design"))
        .when(~finite, F.lit("not finite"))
        .when(F.col("rss") <= 1e-12 * spread, F.lit("perfect fit"))
    )
    fitted = fitted.withColumn("error", error)
    good = F.col("error").isNull()
    loglik = -n / 2.0 * (F.ln(2 * np.pi * F.col("rss") / n) + 1)
    out = fitted.withColumns(
        {
            "coef": F.when(good, F.col("coef")),
            "sigma2": F.when(good, F.col("rss") / (n - k - 1)),
            "aicc": F.when(good, -2 * loglik + 2 * params + 2 * params * (params + 1) / (n - params - 1)),
        }
    )
    if targets and max_vars <= 1:
        out = out.withColumn("mu", F.when(good, F.col("_a") + F.coalesce(F.col("_b") * F.get("x", F.get("positions", F.lit(0))), F.lit(0.0))))
    elif targets:
        at = F.concat(F.array(F.lit(1.0)), F.transform("positions", lambda p: F.get("x", p)))
        dot = F.aggregate(
            F.zip_with("coef", at, lambda b, v: b * v), F.lit(0.0), lambda acc, v: acc + v
        )
        out = out.withColumn("mu", dot)
    return out.drop("_a", "_b")


def _closed_form(df: DataFrame) -> DataFrame:
    """Intercept and slope of the one covariate, or the mean without any."""
    position = F.get("positions", F.lit(0))
    n = F.when(F.col("n_obs") > 0, F.col("n_obs"))
    one = df.withColumns({f"_{c}": F.get(c, position) for c in ("sx", "sxy", "sxx")})
    centred = one.withColumns(
        {
            "_cyy": F.expr("syy - sy * sy / nullif(n_obs, 0)"),
            "_cxx": F.expr("_sxx - _sx * _sx / nullif(n_obs, 0)"),
            "_cxy": F.expr("_sxy - _sx * sy / nullif(n_obs, 0)"),
        }
    ).withColumn("_b", F.expr("IF(_cxx > 1e-10 * _sxx, _cxy / nullif(_cxx, 0D), NULL)"))
    empty = F.size("positions") == 0
    line = F.when(F.col("_b").isNotNull(), (F.col("sy") - F.col("_b") * F.col("_sx")) / n)
    solved = centred.withColumns(
        {
            "_a": F.when(empty, F.col("sy") / n).otherwise(line),
            "rss": F.when(empty, F.col("_cyy")).otherwise(F.expr("_cyy - _b * _cxy")),
        }
    )
    coef = F.when(empty, F.array("_a")).otherwise(F.array("_a", "_b"))
    return solved.withColumn("coef", F.when(F.col("_a").isNotNull(), coef)).drop(
        "_sx", "_sxy", "_sxx", "_cyy", "_cxx", "_cxy"
    )


def _slices(p: int) -> dict[str, Column]:
    """The sums of one model, cut out of the sums of all covariates."""

    def entry(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        before = low * p - F.shiftright(low * (low - 1), 1)
        return F.get("sxx", (before + high - low).cast("int"))

    square = F.flatten(
        F.transform("positions", lambda i: F.transform("positions", lambda j: entry(i, j)))
    )
    return {
        "_sx": F.transform("positions", lambda i: F.get("sx", i)),
        "_sxy": F.transform("positions", lambda i: F.get("sxy", i)),
        "_sxx": square,
    }


SOLUTION = T.StructType(
    [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType())]
)


def _solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append coefficients and residual sums of squares to each Arrow batch."""
    for batch in batches:
        n, sy, syy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_obs", "sy", "syy"))
        size = batch.column("_sx").value_lengths().to_numpy(zero_copy_only=False)
        coef: list = [None] * len(n)
        rss = np.full(len(n), np.nan)
        for k in np.unique(size):
            rows = np.flatnonzero((size == k) & (n > k + 1))
            if not len(rows):
                continue
            sx, sxy, sxx = (
                batch.column(c).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                for c in ("_sx", "_sxy", "_sxx")
            )
            good, beta, fit_rss = _solve_same_size(n[rows].astype(float), sy[rows], syy[rows], sx, sxy, sxx)
            rss[rows[good]] = fit_rss
            for row, b in zip(rows[good], beta):
                coef[row] = b
        solution = [pa.array(coef, pa.list_(pa.float64())), pa.array(rss, from_pandas=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *solution], names=[*batch.schema.names, *SOLUTION.names]
        )


def _solve_same_size(n, sy, syy, sx, sxy, sxx):
    """(solvable, coefficients, rss) of fits with equally many covariates."""
    k = sx.shape[1]
    cyy = syy - sy * sy / n
    if not k:
        return np.ones(len(n), bool), (sy / n)[:, None], cyy
    raw = sxx.reshape(-1, k, k)
    cxx = raw - sx[:, :, None] * sx[:, None, :] / n[:, None, None]
    cxy = sxy - sx * (sy / n)[:, None]
    scale = np.sqrt(np.einsum("bii->bi", cxx).clip(min=0))
    varies = (scale > 1e-5 * np.sqrt(np.einsum("bii->bi", raw))).all(axis=1)
    scale = np.where(scale > 0, scale, 1.0)
    corr = cxx / (scale[:, :, None] * scale[:, None, :])
    good = varies & (np.linalg.eigvalsh(corr)[:, 0] > 1e-10)
    beta = np.linalg.solve(corr[good], (cxy / scale)[good][:, :, None])[:, :, 0] / scale[good]
    constant = (sy[good] - (beta * sx[good]).sum(axis=1)) / n[good]
    rss = cyy[good] - (beta * cxy[good]).sum(axis=1)
    return good, np.column_stack([constant, beta]), rss


def intervals(fits: DataFrame, variance: str = "sigma2") -> DataFrame:
    """Median forecast and bounds, normal on the log scale."""
    mu, se = F.col("mu"), F.sqrt(variance)
    return fits.withColumns(
        {
            "predicted_abundance": F.exp(mu),
            "lo_50": F.exp(mu - Z50 * se),
            "hi_50": F.exp(mu + Z50 * se),
            "lo_95": F.exp(mu - Z95 * se),
            "hi_95": F.exp(mu + Z95 * se),
        }
    )


def fit_linear(
    df: DataFrame,
    candidates: Candidates,
    last: int | None,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    value: str = "abundance",
    always: Sequence[str] = (),
    ar: int = 0,
    freq: int = 1,
    first_period: int = 1,
    partitions: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One-step forecasts of every model for the last ``last`` times of each series (None: all).

    ``always`` are covariates in every model; ``ar`` adds that many lags of the
    log response to them.  ``partitions`` overrides the number of tasks;
    ``carry`` names columns of the forecast row to keep.  With
    ``freq=2`` a row is a (time, period): starting from period 1 both periods of
    the target time are forecast from earlier times, starting from period 2 only
    that one, from all earlier rows.
    """
    keys, always = as_list(keys), list(always)
    rows = df
    step = F.col(time) if freq == 1 else F.col(time) * freq + F.col("period") - 1
    rows = rows.withColumn("_step", step)
    if ar:
        if freq > 1 and first_period == 1:
            raise ValueError("the lagged response is unknown for the second step")
        ordered = Window.partitionBy(*keys).orderBy("_step")
        lags = {f"_lag_log{j}" if j > 1 else "_lag_log": F.lag(F.ln(value), j).over(ordered) for j in range(1, ar + 1)}
        rows = rows.withColumns(lags)
        always = [*always, *lags]
    pool = [*candidates.covariates, *always]
    # Every row becomes one task per candidate below, so spread rows by count, not bytes.
    rows = centred(spread(drop_incomplete(rows, pool), *keys, partitions=partitions), pool, value, keys)
    frame_time = time if first_period == 1 else "_step"
    past = Window.partitionBy(*keys).orderBy(frame_time).rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    size = candidates.max_vars + len(always)
    tags = [c for c in ("period",) if c in df.columns]
    folds = rows.select(
        *keys,
        time,
        *tags,
        *carry,
        (F.array(*[F.col(c).cast("double") for c in pool]) if pool else F.array().cast("array<double>")).alias("x"),
        "_centre",
        "_level",
        *moments(pool, value, cross=size > 1, over=past, level=F.col("_level")),
        F.max(time).over(whole).alias("_max"),
    )
    if last is not None:
        folds = folds.filter(F.col(time) > F.col("_max") - last)
    if freq > 1:
        folds = folds.filter(F.col("period") >= first_period)
    # Larger models are solved in Python; a series' fits then go to many tasks.
    tasks = candidates.pair(folds, spread_by=[*keys, time, *tags] if size > 1 else None)
    if always:
        first = len(candidates.covariates)
        extra = F.array(*[F.lit(first + i) for i in range(len(always))])
        tasks = tasks.withColumns(
            {
                "positions": F.concat("positions", extra),
                "covariates": F.concat("covariates", F.array(*[F.lit(c) for c in always])),
            }
        )
    fits = solve(tasks, len(pool), size)
    fits = intervals(fits.withColumns({"mu": F.col("mu") + F.col("_level"), "coef": uncentred(F.col("coef"))}))
    order = F.array(*[F.lit(v) for v in (ar, 0, 0, 0, freq, 0, 0)])
    names = F.concat(F.array(F.lit("intercept")), "covariates")
    return fits.select(
        *keys,
        time,
        *tags,
        "model",
        "predicted_abundance",
        "lo_50",
        "hi_50",
        "lo_95",
        "hi_95",
        "aicc",
        "sigma2",
        order.alias("order"),
        F.when(F.col("coef").isNotNull(), F.map_from_arrays(names, "coef")).alias("coef"),
        "n_obs",
        "error",
        *carry,
    )


def fit_ar(
    df: DataFrame,
    candidates: Candidates,
    last: int | None,
    max_p: int = 2,
    keys: str | Iterable[str] = KEYS,
    time: str = "t",
    **options,
) -> DataFrame:
    """``fit_linear`` with 0 to ``max_p`` lags of the log response, the number chosen per fit by least AICc.

    A fit is one (series, target, model).  All orders solve their systems from
    the same kind of sums; the choice is an ordinary aggregate.  A fit for
    which every order fails keeps the failure of the smallest.
    """
    orders = [fit_linear(df, candidates, last, keys=keys, time=time, ar=p, **options) for p in range(max_p + 1)]
    every = orders[0]
    for more in orders[1:]:
        every = every.unionByName(more)
    on = [*as_list(keys), time, *[c for c in ("period",) if c in every.columns], "model"]
    rest = [c for c in every.columns if c not in on]
    rank = F.struct(F.col("error").isNotNull(), F.col("aicc"), F.get("order", F.lit(0)))
    best = every.groupBy(*on).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*on, "_best.*").select(*every.columns)
