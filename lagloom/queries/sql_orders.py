"""SQL of regressions with error orders: elimination written out, one table per pivot."""

from __future__ import annotations

from lagloom.operators.error_orders import CRITICAL
from lagloom.operators.fit_linear import Z50, Z95


def regression(name: str, source: str, xs: list[str], guard: list[str], part: str, order: str) -> str:
    """Tables up to ``name``: the fit of ``z`` on ``xs`` over earlier rows, as n, a, b_x, rss and the mean ``mu`` at the row."""
    vs, w = [*xs, "z"], f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    good = " AND ".join(f"{g} IS NOT NULL" for g in guard)
    pairs = [(a, b) for i, a in enumerate(vs) for b in vs[i:]]
    sums = [f"count(CASE WHEN {good} THEN 1 END) OVER {w} AS n"]
    sums += [f"sum(CASE WHEN {good} THEN {v} END) OVER {w} AS s_{v}" for v in vs]
    sums += [f"sum(CASE WHEN {good} THEN {a} * {b} END) OVER {w} AS q_{a}_{b}" for a, b in pairs]
    out = [f"{name}_s AS (SELECT *, {', '.join(sums)} FROM {source})"]
    first = ", ".join(f"q_{a}_{b} - s_{a} * s_{b} / nullif(n, 0) AS c0_{a}_{b}" for a, b in pairs)
    out.append(f"{name}_0 AS (SELECT *, {first} FROM {name}_s)")
    for j, x in enumerate(xs):
        later = vs[j + 1 :]
        pivot = f"CASE WHEN c{j}_{x}_{x} > 0 AND c{j}_{x}_{x} > 1e-10 * c0_{x}_{x} THEN c{j}_{x}_{x} END"
        cells = [f"c{j}_{a}_{b} - c{j}_{x}_{a} * c{j}_{x}_{b} / ({pivot}) AS c{j + 1}_{a}_{b}" for i, a in enumerate(later) for b in later[i:]]
        out.append(f"{name}_{j + 1} AS (SELECT *, {', '.join(cells)} FROM {name}_{j})")
    last = f"{name}_{len(xs)}"
    for j in range(len(xs) - 1, -1, -1):
        x = xs[j]
        rest = "".join(f" - c{j}_{x}_{v} * b_{v}" for v in xs[j + 1 :])
        out.append(f"{name}_b{j} AS (SELECT *, (c{j}_{x}_z{rest}) / nullif(c{j}_{x}_{x}, 0) AS b_{x} FROM {last})")
        last = f"{name}_b{j}"
    constant = f"(s_z{''.join(f' - b_{x} * s_{x}' for x in xs)}) / nullif(n, 0)"
    out.append(f"{name}_a AS (SELECT *, {constant} AS a, c{len(xs)}_z_z AS rss FROM {last})")
    out.append(f"{name} AS (SELECT *, a{''.join(f' + b_{x} * {x}' for x in xs)} AS mu FROM {name}_a)")
    return ",\n".join(out)


def orders(
    tag: str, source: str, keys: str, ws: list[str], models: dict[int, list[str]], max_p: int, max_q: int, seasonal: int, long: int,
    part: str = "series_id", order: str = "t",
) -> str:
    """Tables up to ``{tag}_every``: each model and order of the rows ``source (keys, z, ws)``, with coefficients by name."""
    lags = max(max_p, long if max_q else 0, seasonal)
    frame = f"(PARTITION BY {part} ORDER BY {order})"
    lagged = "".join(f", lag(z, {j}) OVER {frame} AS z{j}" for j in range(1, lags + 1))
    out = [f"{tag}_lag AS (SELECT {keys}, z{''.join(f', {w}' for w in ws)}{lagged} FROM {source})"]
    pool, table = [*ws, *[f"z{j}" for j in range(1, max_p + 1)]], f"{tag}_lag"
    if max_q:
        first = [*ws, *[f"z{j}" for j in range(1, long + 1)]]
        out.append(regression(f"{tag}_long", table, first, [*first, "z"], part, order))
        kept = f"{keys}, z{''.join(f', {c}' for c in [*ws, *[f'z{j}' for j in range(1, lags + 1)]])}"
        out.append(f"{tag}_err AS (SELECT {kept}, CASE WHEN n > {len(first) + 2} THEN z - mu END AS e FROM {tag}_long)")
        errors = "".join(f", lag(e, {j}) OVER {frame} AS e{j}" for j in range(1, max_q + 1))
        out.append(f"{tag}_pool AS (SELECT *{errors} FROM {tag}_err)")
        pool, table = [*pool, *[f"e{j}" for j in range(1, max_q + 1)]], f"{tag}_pool"
    if seasonal:
        pool = [*pool, f"z{seasonal}"]
    # a lag that is also the seasonal one is a regressor once
    pool = list(dict.fromkeys(pool))
    parts = []
    for model, own in models.items():
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                for s in range(2 if seasonal else 1):
                    xs = [*own, *[f"z{j}" for j in range(1, p + 1)], *[f"e{j}" for j in range(1, q + 1)], *[f"z{seasonal}"] * s]
                    name, params = f"{tag}_{model}_{p}{q}{s}", len(xs) + 2
                    out.append(regression(name, table, xs, [*pool, "z"], part, order))
                    coefs = "".join(f", {f'b_{v}' if v in xs else '0.0'} AS b_{v}, {v}" for v in pool)
                    parts.append(
                        f"SELECT {keys}, {model} AS model, {p} AS p, {q} AS q, {s} AS sp, n, a, mu, rss / (n - {len(xs) + 1}) AS sigma2, "
                        f"n * (ln(2 * pi() * rss / n) + 1) + {2 * params} + {2.0 * params * (params + 1)} / (n - {params + 1}) AS aicc{coefs} "
                        f"FROM {name} WHERE n > {params + 1} AND mu IS NOT NULL AND rss > 1e-12 * c0_z_z"
                    )
    out.append(f"{tag}_every AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(out)


def best(name: str, source: str, by: str) -> str:
    return (
        f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by}, model ORDER BY aicc, p + q + sp, p, q) = 1)"
    )


def bounds(mu: str, variance: str, digits: int = 5) -> str:
    return ", ".join(
        [f"round(exp({mu}), {digits}) AS predicted_abundance"]
        + [f"round(exp({mu} {sign} {z} * sqrt({variance})), {digits}) AS {name}" for name, sign, z in (("lo_50", "-", Z50), ("hi_50", "+", Z50), ("lo_95", "-", Z95), ("hi_95", "+", Z95))]
    )


def statistic(name: str, source: str, column: str, part: str = "series_id", order: str = "t") -> str:
    """The level-stationarity statistic of the earlier values by its definition: every row with all rows before it."""
    lags = range(1, 9)
    own = f"PARTITION BY {part}, mark"
    weighted = "".join(
        f" + CASE WHEN {j} <= max(l) THEN 2 * (1 - {j}.0 / (max(l) + 1)) * coalesce(sum(e{j} * e), 0) ELSE 0 END" for j in lags
    )
    return f"""{name}_pairs AS (
  SELECT r.{part}, r.{order} AS mark, b.{order} AS bt, b.{column} AS y FROM {source} r
  JOIN {source} b ON b.{part} = r.{part} AND b.{order} < r.{order} AND b.{column} IS NOT NULL),
{name}_centred AS (SELECT *, y - avg(y) OVER ({own}) AS e, count(*) OVER ({own}) AS n FROM {name}_pairs),
{name}_sums AS (
  SELECT *, sum(e) OVER ({own} ORDER BY bt) AS s, floor(3 * sqrt(n) / 13) AS l, {', '.join(f'lag(e, {j}) OVER ({own} ORDER BY bt) AS e{j}' for j in lags)}
  FROM {name}_centred),
{name} AS (
  SELECT {part}, mark AS {order}, sum(s * s) / max(n) / nullif(greatest(sum(e * e){weighted}, 0), 0) AS stat FROM {name}_sums GROUP BY 1, 2)"""


def chosen(name: str, source: str, statistics: list[str], keys: str = "series_id, t") -> str:
    """``source`` with d, the first difference whose statistic is not above the critical value."""
    cases = " ".join(f"WHEN coalesce({s}.stat, 0) <= {CRITICAL} THEN {i}" for i, s in enumerate(statistics))
    joins = " ".join(f"LEFT JOIN {s} USING ({keys})" for s in statistics)
    return f"{name} AS (SELECT {source}.*, {statistics[0]}.stat, CASE {cases} ELSE {len(statistics)} END AS d FROM {source} {joins})"
