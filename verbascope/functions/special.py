"""Tail probabilities of Student's t and of F, by the regularised incomplete beta function."""

from __future__ import annotations

import math


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b), by a continued fraction on the side where it converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (value - 1.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / (df + t * t), df / 2, 0.5)


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    """1 - cdf without its loss of digits."""
    return beta_regularised(d2 / (d1 * f + d2), d2 / 2, d1 / 2) if f > 0 else 1.0


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs; none where there is no correlation."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
