"""Penalised-spline smooth of a binomial rate over time, all series and penalties at once.

A series is one row of arrays, one entry per time step, so it is bounded by the
calendar.  It is paired with a grid of penalties; every round solves the weighted normal
equations of all pairs that still move, as expressions over their arrays, and is
written before the next one reads it.  The equations are banded (a quadratic spline
meets its two neighbours), so a solution and its degrees of freedom take one fold
forth and one back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.safe import as_list, spread
from lagloom.operators.features import KEYS, shift_year
from lagloom.sources.writers import cut_lineage

#: ln of the penalties tried: from -8 to 18 in steps of a quarter.
GRID = [i / 4 for i in range(-32, 73)]
TOLERANCE, RIDGE, MOST_ROUNDS = 1e-9, 1e-10, 60


def spline(t: Column, low: Column, high: Column, size: Column) -> dict[str, Column]:
    """Quadratic B-splines on ``size`` evenly spaced supports: the first of the three that meet ``t``, and their values."""
    intervals = F.greatest(size - 2, F.lit(1))
    u = (t - low) / F.greatest((high - low) / intervals, F.lit(1e-9))
    at = F.least(F.floor(u), intervals - 1).cast("int")
    v = u - at
    return {"at": at, "b0": (1 - v) * (1 - v) / 2, "b1": 0.5 + v - v * v, "b2": v * v / 2}


def _bands(points: Column, size: Column, penalty: Column) -> Column:
    """Per coefficient: diagonal, first and second band of the normal equations, and their right side."""

    def total(term) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + term(p))

    def weight(p: Column, i: Column, j: Column) -> Column:
        """The product of the splines i and j at a point."""

        def value(k):
            return F.when(k == p["at"], p["b0"]).when(k == p["at"] + 1, p["b1"]).when(k == p["at"] + 2, p["b2"]).otherwise(0.0)

        return value(i) * value(j) * p["w"]

    def row(i: Column) -> Column:
        inner = F.when((i == 0) | (i == size - 1), 1.0).otherwise(2.0)
        return F.struct(
            (total(lambda p: weight(p, i, i)) + penalty * inner + RIDGE).alias("a0"),
            (total(lambda p: weight(p, i, i + 1)) - penalty).alias("a1"),
            total(lambda p: weight(p, i, i + 2)).alias("a2"),
            total(lambda p: F.when(i == p["at"], p["b0"]).when(i == p["at"] + 1, p["b1"]).when(i == p["at"] + 2, p["b2"]).otherwise(0.0) * p["w"] * p["z"]).alias("r"),
            inner.alias("p"),
        )

    return F.transform(F.sequence(F.lit(0), size - 1), row)


LOWER = "struct<d:double,l1:double,l2:double,y:double,p:double>"


def _forward(bands: Column) -> Column:
    """The factors of the banded equations, one entry per coefficient."""
    zero = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("l1"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a1"), F.lit(0.0).alias("a2"))
    start = F.struct(zero.alias("last"), zero.alias("before"), F.array().cast(f"array<{LOWER}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        last, before = acc["last"], acc["before"]
        l2 = before["a2"] / before["d"]
        l1 = (last["a1"] - l2 * before["d"] * last["l1"]) / last["d"]
        d = row["a0"] - l1 * l1 * last["d"] - l2 * l2 * before["d"]
        y = row["r"] - l1 * last["y"] - l2 * before["y"]
        own = F.struct(d.alias("d"), l1.alias("l1"), y.alias("y"), row["a1"].alias("a1"), row["a2"].alias("a2"))
        entry = F.struct(d.alias("d"), l1.alias("l1"), l2.alias("l2"), y.alias("y"), row["p"].alias("p"))
        return F.struct(own.alias("last"), last.alias("before"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.aggregate(bands, start, step, lambda acc: acc["out"])


def _backward(factors: Column) -> Column:
    """Coefficients, and the trace of penalty times inverse, from the inverse's own band."""
    none = F.lit(0.0)
    names = ("b1", "b2", "z11", "z12", "z22", "l1", "m2", "k2", "trace")
    start = F.struct(*[none.alias(n) for n in names], F.array().cast("array<double>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        # l1: L[j+1, j]; k2: L[j+2, j]; m2: L[j+1, j-1], which is the next one's k2
        b = f["y"] / f["d"] - acc["l1"] * acc["b1"] - acc["k2"] * acc["b2"]
        z01 = -acc["l1"] * acc["z11"] - acc["k2"] * acc["z12"]
        z02 = -acc["l1"] * acc["z12"] - acc["k2"] * acc["z22"]
        z00 = 1 / f["d"] - acc["l1"] * z01 - acc["k2"] * z02
        return F.struct(
            b.alias("b1"), acc["b1"].alias("b2"), z00.alias("z11"), z01.alias("z12"), acc["z11"].alias("z22"),
            f["l1"].alias("l1"), f["l2"].alias("m2"), acc["m2"].alias("k2"),
            (acc["trace"] + f["p"] * z00 - 2 * z01).alias("trace"), F.concat(F.array(b), acc["out"]).alias("out"),
        )

    done = F.aggregate(F.reverse(factors), start, step)
    return F.struct(done["out"].alias("beta"), done["trace"].alias("trace"))


def _expected(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def _round(state: DataFrame) -> DataFrame:
    """One weighted least-squares step of every row."""
    size = F.size("points")

    def weighed(p: Column) -> Column:
        mu = _expected(p["eta"])
        w = F.greatest(p["n"] * mu * (1 - mu), F.lit(1e-10))
        z = p["eta"] + (p["s"] - p["n"] * mu) / w
        return F.struct(p["at"].alias("at"), p["b0"].alias("b0"), p["b1"].alias("b1"), p["b2"].alias("b2"), w.alias("w"), z.alias("z"))

    rows = state.withColumn("_w", F.transform("points", weighed))
    rows = rows.withColumn("_bands", _bands(F.col("_w"), size, F.exp("penalty")))
    rows = rows.withColumn("_f", _forward(F.col("_bands"))).withColumn("_b", _backward(F.col("_f")))

    def moved(p: Column) -> Column:
        beta = [F.get("_b.beta", p["at"] + k) for k in range(3)]
        eta = p["b0"] * beta[0] + p["b1"] * beta[1] + p["b2"] * beta[2]
        kept = [p[n].alias(n) for n in ("row", "at", "b0", "b1", "b2", "s", "n")]
        return F.struct(*kept, F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)).alias("eta"), F.abs(eta - p["eta"]).alias("change"))

    rows = rows.withColumn("points", F.transform("points", moved))
    free = size - F.exp("penalty") * F.col("_b.trace")
    change = F.array_max(F.transform("points", lambda p: p["change"]))
    return rows.withColumns({"free": free, "change": change}).drop("_w", "_bands", "_f", "_b")


def binomial_smooth(
    df: DataFrame,
    success: str,
    trials: str,
    time: str = "year",
    keys: str | Iterable[str] = KEYS,
    name: str = "rate",
) -> DataFrame:
    """Attach the smoothed rate ``success / trials`` of each series.

    Rows without a count keep their place with a NULL rate, as do series of fewer than three counts.
    The penalty is the one of the grid with the least deviance per count plus twice the degrees of
    freedom per count.
    """
    keys = as_list(keys)
    usable = F.col(success).isNotNull() & (F.col(trials) > 0)
    order = Window.partitionBy(*keys, usable).orderBy(time)
    rows = cut_lineage(df.withColumn("_row", F.when(usable, F.row_number().over(order))), "counts")
    entry = F.struct(
        F.col("_row").alias("row"), F.col(time).cast("double").alias("t"), F.col(success).cast("double").alias("s"), F.col(trials).cast("double").alias("n")
    )
    series = rows.filter("_row IS NOT NULL").groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("raw"), F.min(time).cast("double").alias("low"), F.max(time).cast("double").alias("high")
    )
    series = series.filter(F.size("raw") >= 3)

    def point(p: Column) -> Column:
        x = spline(p["t"], F.col("low"), F.col("high"), F.size("raw"))
        rate = (p["s"] + 0.5) / (p["n"] + 1)
        eta = F.ln(rate / (1 - rate))
        values = [x[n].alias(n) for n in ("at", "b0", "b1", "b2")]
        return F.struct(p["row"].alias("row"), *values, p["s"].alias("s"), p["n"].alias("n"), eta.alias("eta"), F.lit(0.0).alias("change"))

    points = F.transform("raw", point).alias("points")
    state = series.select(*keys, points).withColumn("penalty", F.explode(F.array(*[F.lit(g) for g in GRID])))
    open_rows = cut_lineage(spread(state, *keys, "penalty"), "irls")
    done = None
    for turn in range(MOST_ROUNDS):
        step = cut_lineage(_round(open_rows), "irls")
        still = (F.col("change") >= TOLERANCE) if turn < MOST_ROUNDS - 1 else F.lit(False)
        over = step.filter(~still)
        done = over if done is None else done.unionByName(over)
        open_rows = step.filter(still).select(*keys, "points", "penalty")
        if open_rows.isEmpty():
            break

    def deviance(p: Column) -> Column:
        mu, miss = _expected(p["eta"]), p["n"] - p["s"]
        hit = F.when(p["s"] > 0, p["s"] * F.ln(p["s"] / (p["n"] * mu))).otherwise(0.0)
        return hit + F.when(miss > 0, miss * F.ln(miss / (p["n"] * (1 - mu)))).otherwise(0.0)

    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + deviance(p))
    done = done.withColumn("criterion", (2 * total + 2 * F.col("free")) / F.size("points"))
    best = done.groupBy(*keys).agg(F.min_by("points", F.struct("criterion", "penalty")).alias("points"))
    rates = best.select(*keys, F.explode("points").alias("p")).select(*keys, F.col("p.row").alias("_row"), _expected(F.col("p.eta")).alias(name))
    same = [rows[k].eqNullSafe(rates[k]) for k in keys]
    out = rows.join(rates, [*same, rows["_row"] == rates["_row"]], "left")
    return out.select(*[rows[c] for c in df.columns], rates[name])


def survival_features(
    counts: DataFrame, asof_year: int, keys: str | Iterable[str] = KEYS
) -> DataFrame:
    """Smoothed log survival of one- and two-year-old returns by return year.

    ``counts`` has year, juv_count, ocean1_count, ocean2_count.  The last year's
    two-year-old count is incomplete and left out of its smooth.
    """
    keys = as_list(keys)
    rows = counts.filter(F.col("year") != F.lit(asof_year))
    last = F.max("year").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_last", last).withColumn(
        "ocean2_count", F.when(F.col("year") < F.col("_last"), F.col("ocean2_count"))
    )
    one = binomial_smooth(rows.drop("_last"), "ocean1_count", "juv_count", "year", keys, "sar1")
    two = binomial_smooth(one, "ocean2_count", "juv_count", "year", keys, "sar2")
    order = Window.partitionBy(*keys).orderBy("year")
    out = two.withColumns(
        {"lag1_log_sar": F.ln("sar1"), "lag2_log_sar": F.lag(F.ln("sar2")).over(order)}
    )
    return shift_year(out, 2).select(*keys, "year", "sar1", "sar2", "lag1_log_sar", "lag2_log_sar")
