from itertools import combinations
from math import comb

import pytest

from lagloom.operators.candidates import Candidates


@pytest.mark.parametrize("n, low, high", [(4, 0, 1), (4, 1, 3), (5, 2, 4), (6, 0, 6), (3, 3, 3)])
def test_numbering_equals_enumeration(spark, n, low, high):
    names = [f"x{i}" for i in range(n)]
    expected = [c for k in range(max(low, 1), high + 1) for c in combinations(names, k)]
    made = Candidates(names, low, high)
    rows = made.table(spark).orderBy("model").collect()
    assert [tuple(r.covariates) for r in rows] == expected
    assert [r.model for r in rows] == list(range(1, len(expected) + 1))
    assert made.count == sum(comb(n, k) for k in range(max(low, 1), high + 1))
    assert rows[0].formula == "abundance ~ " + " + ".join(expected[0])


def test_null_model(spark):
    default = Candidates(("a", "b"), 0, 1).table(spark).collect()
    assert len(default) == 2
    rows = Candidates(("a", "b"), 0, 1, include_null=True).table(spark).orderBy("model").collect()
    assert [(r.model, r.model_name) for r in rows] == [(1, "a"), (2, "b"), (3, "1")]
    only = Candidates(("a", "b"), 0, 0).table(spark).collect()
    assert [(r.model, r.formula) for r in only] == [(1, "abundance ~ 1")]
    with pytest.raises(ValueError):
        Candidates(("a",), 2, 3)


def test_pairing_keeps_every_row(spark):
    df = spark.range(50)
    paired = Candidates(tuple("abcdef"), 1, 6).pair(df)
    assert paired.count() == 50 * 63
    assert "Cartesian" not in paired._jdf.queryExecution().executedPlan().toString()
