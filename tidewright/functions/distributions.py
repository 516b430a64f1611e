"""Tail probabilities of Student's t and F, for results already reduced to a few numbers on the driver."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for even in (True, False):
            if even:
                term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_upper(t: float, dof: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_cdf(dof / 2, 0.5, dof / (dof + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f); 1 for a negative f."""
    return 1.0 if f <= 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
