"""Two-sided p-values of the paired tests, in plain numbers: they are computed once per comparison, not per row."""

from __future__ import annotations

import math
from functools import lru_cache

#: Pairs up to which the signed-rank distribution is counted exactly, if there are no ties and no zeros.
EXACT_PAIRS = 50


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or tiny), 1 + k / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(64)
def _rank_sums(n: int) -> tuple[int, ...]:
    """How many of the 2**n subsets of the ranks 1 to n have each sum."""
    counts = [1]
    for rank in range(1, n + 1):
        counts = [(counts[s] if s < len(counts) else 0) + (counts[s - rank] if s >= rank else 0) for s in range(len(counts) + rank)]
    return tuple(counts)


def signed_rank_two_sided(plus: float, n: int, ties: float, zeros: int) -> float | None:
    """plus: rank sum of the positive differences among n that are not zero; ties: sum of t**3 - t over tied groups.

    Exact up to ``EXACT_PAIRS`` without ties and zeros, else the normal approximation corrected for ties; None without
    a difference.
    """
    if not n:
        return None
    if n <= EXACT_PAIRS and not ties and not zeros:
        counts, at = _rank_sums(n), round(plus)
        tail = min(sum(counts[: at + 1]), sum(counts[at:]))
        return min(1.0, 2 * tail / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return normal_two_sided((plus - n * (n + 1) / 4) / spread) if spread else 1.0
