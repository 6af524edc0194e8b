"""Bessel functions of the first kind and Hankel transforms, in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Below, the power series; above, the asymptotic expansion.
TURN = 12.0
TERMS = 40
#: Radii whose integrals are summed at a time, so that what is in use stays in a core's cache.
BLOCK = 64


def _series(x: np.ndarray, order: int) -> np.ndarray:
    q = -(x * x) / 4
    term = np.ones_like(x) if order == 0 else x / 2
    total = term.copy()
    for k in range(1, TERMS):
        term = term * q / (k * (k + order))
        total += term
    return total


def _asymptotic(x: np.ndarray, order: int) -> np.ndarray:
    mu = 4.0 * order * order
    p, q, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, 13):
        term = term * (mu - (2 * k - 1) ** 2) / (k * 8 * x)
        if k % 2:
            q += term * (1 if k % 4 == 1 else -1)
        else:
            p += term * (-1 if k % 4 == 2 else 1)
    phase = x - order * math.pi / 2 - math.pi / 4
    return np.sqrt(2 / (math.pi * x)) * (p * np.cos(phase) - q * np.sin(phase))


def _bessel(x, order: int) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    a = np.abs(x)
    out = np.empty_like(a)
    near = a <= TURN
    out[near] = _series(a[near], order)
    out[~near] = _asymptotic(a[~near], order)
    return out if order == 0 else np.sign(x) * out


def j0(x) -> np.ndarray:
    return _bessel(x, 0)


def j1(x) -> np.ndarray:
    return _bessel(x, 1)


def hankel(values: np.ndarray, at: np.ndarray, width: np.ndarray, to: np.ndarray) -> np.ndarray:
    """2 pi sum of r f(r) J0(2 pi r rho) dr for each rho; its own inverse."""
    return 2 * np.pi * (j0(2 * np.pi * np.outer(to, at)) @ (at * values * width))


def gaussian(rho: np.ndarray, sigma: float) -> np.ndarray:
    """The transform of a circular normal distribution."""
    return np.exp(-2 * (np.pi * rho * sigma) ** 2)


def cdf(transform: np.ndarray, rho: np.ndarray, width: np.ndarray, r) -> np.ndarray:
    """Share inside radius r: 2 pi r sum of F(rho) J1(2 pi r rho) d rho.

    Where F d rho is below 1e-20 of its largest, its terms are lost in the rounding of the sum and are not computed.
    """
    r = np.atleast_1d(np.asarray(r, dtype=float))
    weight = transform * width
    felt = ~(np.abs(weight) < 1e-20 * np.abs(weight).max())
    weight, at = weight[felt], 2 * np.pi * rho[felt]
    sums = [j1(np.outer(r[i : i + BLOCK], at)) @ weight for i in range(0, len(r), BLOCK)]
    return 2 * np.pi * r * np.concatenate([np.empty(0), *sums])


def radius(transform: np.ndarray, rho: np.ndarray, width: np.ndarray, share: float, most: float, steps: int = 40) -> float:
    """The radius that holds a share, by bisection."""
    low, high = 0.0, most
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(transform, rho, width, middle)[0] < share else (low, middle)
    return (low + high) / 2
