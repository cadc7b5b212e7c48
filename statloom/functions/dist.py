"""Distribution functions for p-values, on the driver: they finish aggregates of a few rows."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    # continued fraction from the tail, by backward evaluation with growing depth
    last = None
    for depth in (64, 128, 256, 512, 1024):
        f = 0.0
        for i in range(depth, 0, -1):
            f = i * (i - a) / (x + 2 * i + 1 - a - f)
        value = front / (x + 1 - a - f)
        if last is not None and abs(value - last) <= 1e-16 * abs(value):
            break
        last = value
    return value


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated backward."""
    last = None
    for depth in (50, 100, 200, 400, 800, 1600):
        f = 1.0
        for m in range(depth, 0, -1):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            f = 1 + even / (1 + odd / f)
        value = 1 - (a + b) * x / (a + 1) / f
        if last is not None and abs(value - last) <= 1e-15 * abs(value):
            break
        last = value
    return 1 / value


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_i(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_cdf(t: float, df: float) -> float:
    tail = t_sf2(t, df) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1000.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        if t_cdf(middle, df) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def format_p(p: float | None) -> str:
    if p is None or math.isnan(p):
        return "-"
    return "<0.0001" if p < 1e-4 else f"{p:.4f}"
