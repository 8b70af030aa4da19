"""Distribution functions against counting and integration, and the tests that use them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from tessella.functions import distributions
from tessella.operators import compare


@pytest.mark.parametrize("df", [1, 2, 5, 30, 400])
@pytest.mark.parametrize("t", [0.0, 0.3, -1.7, 4.0])
def test_t_equals_integral(df, t):
    x = np.linspace(0, abs(t), 200_001)
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    inside = 2 * np.trapezoid(np.exp(log) * (1 + x * x / df) ** (-(df + 1) / 2), x)
    assert distributions.t_two_sided(t, df) == pytest.approx(1 - inside, abs=1e-8)


def test_signed_ranks_equal_counting():
    for n in range(1, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for plus in range(n * (n + 1) // 2 + 1):
            tail = min(sum(x <= plus for x in sums), sum(x >= plus for x in sums))
            assert distributions.signed_rank_two_sided(plus, n, 0, 0) == pytest.approx(min(1, 2 * tail / 2**n))
    assert distributions.signed_rank_two_sided(0, 0, 0, 4) is None


def test_paired_tests(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20, 80) / 10, rng.integers(0, 20, 80) / 10
    d = np.round(a - b, 9)
    size = np.abs(d[d != 0])
    ranks = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    r = compare.signed_ranks(frame).first()
    ties = sum(int(k) ** 3 - int(k) for k in np.unique(size, return_counts=True)[1])
    assert (r["n"], r["plus"], r["minus"], r["ties"], r["zeros"]) == (len(size), ranks[d[d != 0] > 0].sum(), ranks[d[d != 0] < 0].sum(), ties, (d == 0).sum())
    p = compare.paired_tests(frame).first()
    assert 0 < p["p_t"] < 1 and p["p_w"] == pytest.approx(distributions.signed_rank_two_sided(r["plus"], r["n"], ties, 1))
    same = compare.paired_tests(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")).first()
    assert same["p_t"] is None and same["p_w"] is None
    none = compare.paired_tests(frame.limit(0)).first()
    assert none["n"] == 0 and none["p_t"] is None and none["p_w"] is None
