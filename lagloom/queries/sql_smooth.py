"""SQL of the penalised binomial smooth for series of one length, elimination and substitution written out."""

from __future__ import annotations

from lagloom.operators.smooth import GRID, RIDGE


def smooth(source: str, years: range, rounds: int = 25, name: str = "smooth") -> str:
    """Tables up to ``name (series_id, year, rate)`` of ``source (series_id, year, trials, success)``, one row a year."""
    k = len(years)
    rows, width = range(k), (k - 1) / max(k - 2, 1)
    meets = []
    for t in rows:
        at = min(int(t / width + 1e-12), max(k - 2, 1) - 1)
        v = t / width - at
        meets.append({at: (1 - v) ** 2 / 2, at + 1: 0.5 + v - v * v, at + 2: v * v / 2})
    wide = ", ".join(f"max(success) FILTER (year = {y})::DOUBLE AS s{i}, max(trials) FILTER (year = {y})::DOUBLE AS n{i}" for i, y in enumerate(years))
    first = ", ".join(f"ln(((s{i} + 0.5) / (n{i} + 1)) / (1 - (s{i} + 0.5) / (n{i} + 1))) AS e{i}" for i in rows)
    kept = "series_id, pen, it, " + ", ".join(f"s{i}, n{i}" for i in rows)

    def product(i: int, j: int) -> str:
        both = [f"{m[i] * m[j]!r} * w{t}" for t, m in enumerate(meets) if i in m and j in m]
        return " + ".join(both) or "0.0"

    def penalty(i: int) -> int:
        return 1 if i in (0, k - 1) else 2

    layers = [f"SELECT {kept}, {', '.join(f'e{i}, 1 / (1 + exp(-e{i})) AS m{i}' for i in rows)} FROM {name}_irls WHERE it < {rounds}"]
    layers.append("SELECT *, " + ", ".join(f"greatest(n{i} * m{i} * (1 - m{i}), 1e-10) AS w{i}" for i in rows))
    layers.append("SELECT *, " + ", ".join(f"e{i} + (s{i} - n{i} * m{i}) / w{i} AS z{i}" for i in rows))
    bands = []
    for i in rows:
        bands.append(f"{product(i, i)} + exp(pen) * {penalty(i)} + {RIDGE} AS a{i}")
        bands.append(f"{product(i, i + 1)} - exp(pen) AS b{i}")
        bands.append(f"{product(i, i + 2)} AS c{i}")
        right = " + ".join(f"{m[i]!r} * w{t} * z{t}" for t, m in enumerate(meets) if i in m) or "0.0"
        bands.append(f"{right} AS r{i}")
    layers.append("SELECT *, " + ", ".join(bands))
    for i in rows:
        far = f"c{i - 2} / d{i - 2}" if i > 1 else "0.0"
        layers.append(f"SELECT *, {far} AS u{i}")
        near = f"(b{i - 1}{f' - u{i} * d{i - 2} * l{i - 1}' if i > 1 else ''}) / d{i - 1}" if i else "0.0"
        layers.append(f"SELECT *, {near} AS l{i}")
        less = (f" - l{i} * l{i} * d{i - 1}" if i else "") + (f" - u{i} * u{i} * d{i - 2}" if i > 1 else "")
        back = (f" - l{i} * y{i - 1}" if i else "") + (f" - u{i} * y{i - 2}" if i > 1 else "")
        layers.append(f"SELECT *, a{i}{less} AS d{i}, r{i}{back} AS y{i}")

    def take(name: str, i: int, j: int) -> str:
        """The band of the inverse; nothing lies beyond the last coefficient."""
        return f"{name}{min(i, j)}_{max(i, j)}"

    for i in reversed(rows):
        terms = [(f"l{i + 1}", i + 1)] * (i + 1 < k) + [(f"u{i + 2}", i + 2)] * (i + 2 < k)
        layers.append(f"SELECT *, y{i} / d{i}{''.join(f' - {f} * g{j}' for f, j in terms)} AS g{i}")
        for j in (i + 2, i + 1):
            if j < k:
                layers.append(f"SELECT *, 0.0{''.join(f' - {f} * {take('v', h, j)}' for f, h in terms)} AS v{i}_{j}")
        layers.append(f"SELECT *, 1 / d{i}{''.join(f' - {f} * v{i}_{j}' for f, j in terms)} AS v{i}_{i}")
    trace = " + ".join(f"{penalty(i)} * v{i}_{i}" for i in rows) + "".join(f" - 2 * v{i}_{i + 1}" for i in range(k - 1))
    eta = ", ".join(f"greatest(-30, least(30, {' + '.join(f'{x!r} * g{j}' for j, x in m.items())})) AS e{i}" for i, m in enumerate(meets))
    step = layers[0]
    for layer in layers[1:]:
        step = f"{layer} FROM ({step})"
    columns = kept.replace("it", "it + 1", 1)
    step = f"SELECT {columns}, {eta}, {k} - exp(pen) * ({trace}) AS free FROM ({step})"
    deviance = " + ".join(
        f"CASE WHEN s{i} > 0 THEN s{i} * ln(s{i} / (n{i} / (1 + exp(-e{i})))) ELSE 0 END + "
        f"CASE WHEN n{i} > s{i} THEN (n{i} - s{i}) * ln((n{i} - s{i}) / (n{i} * (1 - 1 / (1 + exp(-e{i}))))) ELSE 0 END"
        for i in rows
    )
    grid = ", ".join(f"({g})" for g in GRID)
    fitted = " UNION ALL ".join(f"SELECT series_id, {y} AS year, 1 / (1 + exp(-e{i})) AS rate FROM {name}_best" for i, y in enumerate(years))
    return f"""{name}_wide AS (SELECT series_id, {wide} FROM {source} GROUP BY 1),
{name}_irls AS (
  SELECT {kept.replace("pen, it", "pen::DOUBLE AS pen, 0 AS it")}, {first}, 0::DOUBLE AS free FROM {name}_wide, (VALUES {grid}) g(pen)
  UNION ALL {step}),
{name}_scored AS (SELECT *, (2 * ({deviance}) + 2 * free) / {k} AS criterion FROM {name}_irls WHERE it = {rounds}),
{name}_best AS (SELECT * FROM {name}_scored QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY criterion, pen) = 1),
{name} AS ({fitted})"""
