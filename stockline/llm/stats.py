"""Binomial and beta tails without further libraries."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """P(Beta(a, b) <= x): the regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * value)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 1.0
    return 1.0 - beta_cdf(p, k + 1, n - k) if k >= 0 else 0.0
