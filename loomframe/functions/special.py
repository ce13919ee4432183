"""Incomplete gamma and beta functions, and the distributions that tests need; driver-side, standard library only."""

from __future__ import annotations

import math

_EPS, _TINY, _STEPS = 1e-16, 1e-300, 100_000


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if a <= 0 or x < 0:
        raise ValueError("needs a > 0 and x >= 0")
    if x == 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(_STEPS):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return total * scale
    # Lentz's method for the continued fraction of the upper function.
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 <= x <= 1:
        raise ValueError("x lies between 0 and 1")
    if x in (0, 1):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _STEPS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """The chance of a Student t at least as far from 0."""
    if math.isinf(t):
        return 0.0
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """The chance of an F at least as large."""
    if f <= 0:
        return 1.0
    return 0.0 if math.isinf(f) else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    """The chance of a chi-squared at least as large."""
    return 1.0 if x <= 0 else 1 - gamma_p(df / 2, x / 2)
