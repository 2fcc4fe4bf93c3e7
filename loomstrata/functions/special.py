"""Distribution functions from their published definitions, in numpy; and the same per row where a query needs them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + n / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: int) -> float:
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    """By bisection on t_cdf."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, to, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[to]


def wilcoxon_p(d: np.ndarray) -> float | None:
    """Two-sided signed-rank p of differences; see signed_rank_p()."""
    kept = d[d != 0]
    ranks = average_ranks(np.abs(kept))
    _, ties = np.unique(np.abs(kept), return_counts=True)
    return signed_rank_p(len(kept), min(ranks[kept > 0].sum(), ranks[kept < 0].sum()), float((ties**3 - ties).sum()), len(kept) == len(d))


def signed_rank_p(n: int, low: float, tie_sum: float, no_zeros: bool) -> float | None:
    """Two-sided p of n non-zero differences, low being the smaller rank sum. Exact without zeros and ties up to 50
    differences, else normal without a continuity correction. None where there is no difference."""
    if not n:
        return None
    if n <= 50 and no_zeros and not tie_sum:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy() if r < len(ways) else ways[r:]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    return float(min(1.0, 2 * normal_cdf((low - n * (n + 1) / 4) / math.sqrt(var)))) if var > 0 else 1.0


def mann_whitney_p(u: float, n1: int, n2: int, tie_sum: float) -> float | None:
    """Two-sided normal p of U with the tie correction (tie_sum: the sum of t**3 - t over groups of equal values)."""
    n = n1 + n2
    if not n1 or not n2:
        return None
    var = n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))
