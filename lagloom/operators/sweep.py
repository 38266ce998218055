"""Small linear systems: expanding Gram matrices as Columns, and the sweep operator.

A Gram matrix holds the centred cross products of the regressors and, last, the
response.  Sweeping it on the regressors of a model leaves their coefficients in
the last column and the residual sum of squares in the corner.  ``swept`` takes
a step or two of one row as a Column; whole systems are ``eliminated`` in batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: A pivot below this share of its first value counts as zero.
TOLERANCE = 1e-10


def whole(columns: Sequence[Column]) -> Column:
    """Whether none of the values is missing."""
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def gram(columns: Sequence[Column], over: WindowSpec) -> dict[str, Column]:
    """``_n``, sums ``_s`` and cross products ``_q`` (upper triangle) of the rows of a window without missing values."""
    good = whole(columns)
    values = [F.when(good, c) for c in columns]
    k = len(values)
    return {
        "_n": F.count(values[0]).over(over),
        "_s": F.array(*[F.sum(v).over(over) for v in values]),
        "_q": F.array(*[F.sum(values[i] * values[j]).over(over) for i in range(k) for j in range(i, k)]),
    }


def swept(matrix: Column, pivots: Column, width: Column) -> Column:
    """``matrix`` after sweeping on each pivot in turn; NULL where one is (almost) dependent on those before."""

    def step(a: Column, j: Column) -> Column:
        d = F.get(a, j * width + j)

        def cell(v: Column, i: Column) -> Column:
            r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
            left, up = F.get(a, r * width + j), F.get(a, j * width + c)
            return (
                F.when((r == j) & (c == j), 1 / d)
                .when(r == j, up / d)
                .when(c == j, -left / d)
                .otherwise(v - left * up / d)
            )

        solid = (d > 0) & (d > TOLERANCE * F.get(matrix, j * width + j))
        return F.when(solid, F.transform(a, cell))

    return F.aggregate(pivots, matrix, step)


def eliminated(a: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """``swept`` for a batch of matrices ``[row, i, j]`` on their first variables, and whether none of these was dependent."""
    first, solid = np.einsum("bii->bi", a).copy(), np.ones(len(a), bool)
    with np.errstate(all="ignore"):
        for j in range(pivots):
            d, left, up = a[:, j, j].copy(), a[:, :, j].copy(), a[:, j, :].copy()
            solid &= (d > 0) & (d > TOLERANCE * first[:, j])
            a = a - left[:, :, None] * up[:, None, :] / d[:, None, None]
            a[:, j, :], a[:, :, j] = up / d[:, None], -left / d[:, None]
            a[:, j, j] = 1 / d
    return a, solid


def corner(matrix: Column) -> Column:
    return F.element_at(matrix, -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
