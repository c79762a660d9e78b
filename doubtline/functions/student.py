"""Student-t quantiles for the handful of class sizes a fit produces."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 5000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-16:
            break
    return total


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _cornish_fisher(z: float, df: float) -> float:
    return (
        z
        + (z**3 + z) / (4 * df)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    )


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t with ``df`` degrees of freedom; NaN when df < 1."""
    if df < 1 or not 0.0 < p < 1.0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    if p == 0.5:
        return 0.0
    if df > 1e5:
        return _cornish_fisher(_normal_quantile(p), df)
    tail = 1.0 - p
    low, high = 0.0, 1.0
    while t_upper_tail(high, df) > tail:
        low, high = high, high * 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        low, high = (middle, high) if t_upper_tail(middle, df) > tail else (low, middle)
    return 0.5 * (low + high)


def t_interval_factor(level: float, df: float) -> float:
    """Half-width of a two-sided interval of the given level, in standard errors."""
    return t_quantile(0.5 + level / 2.0, df)
