"""The binomial smooth against dense penalised least squares, series by series."""

import numpy as np
import pytest

from lagloom.operators import smooth as sm


def basis(t, size):
    """B-splines of degree two by the recursion over knots."""
    intervals = max(size - 2, 1)
    width = max((t.max() - t.min()) / intervals, 1e-9)
    knots = t.min() + width * (np.arange(size + 3) - 2)
    b = np.array([[1.0 if knots[i] <= x < knots[i + 1] else 0.0 for i in range(size + 2)] for x in t])
    b[t >= t.max()] = 0
    b[t >= t.max(), intervals + 1] = 1
    for degree in (1, 2):
        n = b.shape[1] - 1
        b = np.array([
            [(x - knots[i]) / (degree * width) * row[i] + (knots[i + degree + 1] - x) / (degree * width) * row[i + 1] for i in range(n)]
            for x, row in zip(t, b)
        ])
    return b


def plain(t, s, n):
    x, best = basis(t, len(t)), None
    penalty = np.diff(np.eye(len(t)), axis=0)
    penalty = penalty.T @ penalty
    for g in sm.GRID:
        rate = (s + 0.5) / (n + 1)
        eta = np.log(rate / (1 - rate))
        for _ in range(sm.MOST_ROUNDS):
            mu = 1 / (1 + np.exp(-eta))
            w = np.maximum(n * mu * (1 - mu), 1e-10)
            gram = x.T @ (w[:, None] * x)
            lhs = gram + np.exp(g) * penalty + sm.RIDGE * np.eye(len(t))
            new = x @ np.linalg.solve(lhs, x.T @ (w * (eta + (s - n * mu) / w)))
            change, eta = np.abs(new - eta).max(), np.clip(new, -30, 30)
            if change < sm.TOLERANCE:
                break
        mu, miss = 1 / (1 + np.exp(-eta)), n - s
        terms = [a * np.log(a / (k * m)) if a > 0 else 0.0 for a, k, m in (*zip(s, n, mu), *zip(miss, n, 1 - mu))]
        score = (2 * sum(terms) + 2 * np.trace(np.linalg.solve(lhs, gram))) / len(t)
        if best is None or score < best[0] - 1e-12:
            best = score, mu
    return best[1]


def test_equals_dense_fits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, size in (("a", 3), ("b", 7), ("c", 12)):
        for i in range(size):
            n = int(rng.integers(50, 500))
            rows.append((name, 2000 + i + (i > 8), n, int(rng.binomial(n, 0.3 + 0.2 * np.sin(i / 3)))))
    gaps = [("c", 2040, 10, None), ("c", 2041, 0, 0), ("d", 1, 5, 2), ("d", 2, 5, 2), (None, 1, None, None)]
    df = spark.createDataFrame(rows + gaps, "series_id string, year int, trials int, success int")
    out = sm.binomial_smooth(df, "success", "trials")
    assert out.columns == [*df.columns, "rate"]
    got = {(r.series_id, r.year): r.rate for r in out.collect()}
    assert len(got) == len(rows) + len(gaps) and all(got[g[0], g[1]] is None for g in gaps)
    for name in "abc":
        own = [r for r in rows if r[0] == name]
        want = plain(*(np.array([r[i] for r in own], float) for i in (1, 3, 2)))
        assert [got[name, r[1]] for r in own] == pytest.approx(want.tolist(), abs=1e-9)
    assert sm.binomial_smooth(df.limit(0), "success", "trials").count() == 0
