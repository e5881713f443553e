"""Beta-binomial likelihoods and bounded minimisers on numpy arrays.

The container's Python has no scipy and Spark no lgamma, so the logarithm of
the gamma function is Lanczos' series (g = 7, n = 9).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Lanczos coefficients for g = 7, fixed values.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
RHO_MIN = 1e-10
GOLDEN = (math.sqrt(5) - 1) / 2
TOLERANCE = 1e-6


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers; small arguments by the recurrence."""
    x = np.asarray(x, float)
    low = x < 0.5
    z = np.where(low, x, x - 1)
    series = np.full_like(z, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series += c / (z + i)
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)
    return np.where(low, out - np.log(np.where(low, x, 1.0)), out)


def clamp_rho(rho):
    return np.clip(rho, RHO_MIN, 1 - RHO_MIN)


def expit(x):
    x = np.asarray(x, float)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def log_pmf(k, n, mu, rho) -> np.ndarray:
    """Log-probability of k of n, with mean mu and dispersion rho; -inf where mu is 0 or 1."""
    rho = clamp_rho(rho)
    a, b = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
    bad = (a <= 0) | (b <= 0)
    a, b = np.where(bad, 1.0, a), np.where(bad, 1.0, b)
    choose = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)
    up = lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b)
    down = lgamma(a) + lgamma(b) - lgamma(a + b)
    return np.where(bad, -np.inf, choose + up - down)


def golden_section(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, size: int = 1) -> np.ndarray:
    """Minima of `size` functions at once on low..high; f maps one point each to values.

    The better of the two last inner points is returned, so all brackets shrink in step.
    """
    a = np.full(size, low)
    h = high - low
    c, d = a + (1 - GOLDEN) * h, a + GOLDEN * h
    fc, fd = f(c), f(d)
    while h > TOLERANCE:
        left = fc < fd
        a = np.where(left, a, c)
        h *= GOLDEN
        new = np.where(left, a + (1 - GOLDEN) * h, a + GOLDEN * h)
        value = f(new)
        c, d = np.where(left, new, d), np.where(left, c, new)
        fc, fd = np.where(left, value, fd), np.where(left, fc, value)
    return np.where(fc < fd, c, d)


def simplex_2d(f: Callable[[np.ndarray], float], start: tuple[float, float], most: int = 1000) -> tuple[np.ndarray, float]:
    """Nelder and Mead's search from `start` with unit steps; ends when the best and worst points are TOLERANCE apart."""
    points = [np.array(start, float) + step for step in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))]
    ranked = [(f(p), i, p) for i, p in enumerate(points)]
    for turn in range(most):
        ranked.sort(key=lambda x: x[0])
        (f0, _, best), (f1, _, second), (f2, _, worst) = ranked
        if math.dist(best, worst) < TOLERANCE:
            break
        middle = (best + second) / 2
        mirrored = 2 * middle - worst
        value = f(mirrored)
        if value < f0:
            further = 2 * mirrored - middle
            far = f(further)
            ranked[2] = (far, turn, further) if far < value else (value, turn, mirrored)
        elif value < f1:
            ranked[2] = (value, turn, mirrored)
        else:
            nearer = (middle + (mirrored if value < f2 else worst)) / 2
            near = f(nearer)
            if near < f2:
                ranked[2] = (near, turn, nearer)
            else:
                shrunk = [(best + p) / 2 for p in (second, worst)]
                ranked[1:] = [(f(p), turn, p) for p in shrunk]
    value, _, point = min(ranked, key=lambda x: x[0])
    return point, value


def chi2_sf(lrt: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    return np.array([math.erfc(math.sqrt(max(x, 0.0) / 2)) for x in np.asarray(lrt, float).ravel()])


def binomial_two_sided(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact two-sided binomial test at one half: outcomes no likelier than the observed one. By symmetry a doubled tail."""
    out = np.ones(len(n))
    for i, (x, m) in enumerate(zip(np.asarray(k).tolist(), np.asarray(n).tolist(), strict=True)):
        low = min(x, m - x)
        if m and 2 * low < m:
            j = np.arange(low + 1.0)
            logs = lgamma(m + 1.0) - lgamma(j + 1) - lgamma(m - j + 1) - m * math.log(2)
            top = logs.max()
            out[i] = min(1.0, 2 * math.exp(top) * np.exp(logs - top).sum())
    return out
