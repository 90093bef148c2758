"""Special functions in plain numpy: gamma and beta tails, normal, chi-square and F probabilities, Matern's kernel."""

from __future__ import annotations

import math

import numpy as np


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(log_front)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, df1: float, df2: float) -> float:
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def matern(z: np.ndarray, nu: float) -> np.ndarray:
    """Matern correlation at scaled distances: z^nu K_nu(z) 2^(1 - nu) / gamma(nu), by the trapezoid rule on
    K_nu(z) = integral of exp(-z cosh u) cosh(nu u)."""
    z = np.asarray(z, dtype=float)
    u = np.arange(0.0, 30.0, 0.02)
    safe = np.where(z > 0, z, 1.0)
    with np.errstate(over="ignore"):
        logs = -safe[..., None] * np.cosh(u) + np.logaddexp(nu * u, -nu * u) - math.log(2)
    weights = np.full(len(u), 0.02)
    weights[0] = 0.01
    k = (np.exp(logs) * weights).sum(axis=-1)
    return np.where(z > 0, np.exp(nu * np.log(safe) + (1 - nu) * math.log(2) - math.lgamma(nu)) * k, 1.0)
