"""How far a blend moves the centre that profile fitting finds, on a grid of fluxes and separations.

Distances are in units of the profile's width. Fitting one normal profile to two gives the
centre at which its overlap with both is greatest: the maximum of
exp(-x^2 / 4) + f exp(-(x - r)^2 / 4), found by Newton's steps from the flux-weighted mean
or, where that is a saddle, from the brighter source. A polynomial in r for each flux is
chosen by its misfit and its number of terms.

Near the source a shift is flux-weighted; beyond a cut, where that fails, its dependence on
the distance is a scaled skew-normal distribution, whose parameters are polynomials in the
flux, one below and one above the middle of three fluxes. ``parameter_table`` makes the
table of their coefficients, and ``table_shift`` gives shifts from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.optimise import minimised

ORDERS = range(4, 25)
#: Share of a shift by which the flux-weighted one may fail.
NEAR = 0.01
_ERF = np.frompyfunc(math.erf, 1, 1)


def shift(f: np.ndarray, r: np.ndarray, turns: int = 60) -> np.ndarray:
    """The fitted centre for blends of relative flux f at distance r."""
    f, r = np.broadcast_arrays(np.asarray(f, float), np.asarray(r, float))

    def slopes(x):
        a, b = np.exp(-(x**2) / 4), f * np.exp(-((x - r) ** 2) / 4)
        return -x / 2 * a - (x - r) / 2 * b, (x**2 / 4 - 0.5) * a + ((x - r) ** 2 / 4 - 0.5) * b

    x = f * r / (1 + f)
    x = np.where(slopes(x)[1] < 0, x, 0.0)
    for _ in range(turns):
        first, second = slopes(x)
        step = np.where(second < 0, -first / np.minimum(second, -1e-12), np.sign(first) * 0.1)
        x = np.clip(x + np.clip(step, -0.5, 0.5), np.minimum(0, r), np.maximum(0, r))
    return x


def shift_grid(spark: SparkSession, fluxes: np.ndarray, distances: np.ndarray) -> DataFrame:
    """(flux, r, shift) of all pairs."""
    n = len(distances)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            k = part["id"].to_numpy()
            f, r = fluxes[k // n], distances[k % n]
            yield pd.DataFrame({"flux": f, "r": r, "shift": shift(f, r)})

    return spark.range(len(fluxes) * n).mapInPandas(run, "flux double, r double, shift double")


def fitted_polynomial(r: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    """Coefficients, highest first, of the order with the least chi-squared plus twice its terms."""
    best, value = np.zeros(1), np.inf
    for order in ORDERS:
        if order + 1 >= len(r):
            break
        fit = np.polynomial.Polynomial.fit(r, y, order)
        now = float((((fit(r) - y) / sigma) ** 2).sum()) + 2 * (order + 1)
        if now < value:
            best, value = fit.convert().coef[::-1], now
    return best


def shift_polynomials(grid: DataFrame, sigma: float = 1e-4) -> DataFrame:
    """(flux, coefficients); a flux has as many rows as there are distances."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        return pd.DataFrame({"flux": [part["flux"].iloc[0]], "coefficients": [fitted_polynomial(part["r"].to_numpy(), part["shift"].to_numpy(), sigma).tolist()]})

    return grid.groupBy("flux").applyInPandas(run, "flux double, coefficients array<double>").withColumn("order", F.size("coefficients") - 1)


def skew(p: np.ndarray, x: np.ndarray, flux: np.ndarray) -> np.ndarray:
    """Scaled skew-normal shift at distance x for parameters (width, middle, shape, amplitude)."""
    c, u, a, t = p
    z = (x - u) / c
    cdf = 0.5 * (1 + _ERF(a * z / math.sqrt(2)).astype(float))
    return 2 * t / c * flux * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * cdf


def fitted_tail(flux: float, r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(width, middle, shape, amplitude, cut) of one flux: least squares beyond the cut, from several starts, with its beginning weighed most.

    Where the flux-weighted shift never fails, the amplitude is zero and the cut is beyond all distances.
    """
    seen = y > 0
    off = np.flatnonzero(seen & (np.abs(y - r * flux / (1 + flux)) > NEAR * np.where(seen, y, 1)))
    if not len(off):
        return np.array([1.0, 0.0, 0.0, 0.0, r[-1] + 0.1])
    x, v = r[off[0] :], y[off[0] :] / flux
    w = np.ones_like(x)
    w[:10] = 100
    value = lambda p: float((w * (skew(p, x, 1.0) - v) ** 2).sum())

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        step = 1e-5 * np.eye(4)
        return value(p), np.array([(value(p + s) - value(p - s)) / 2e-5 for s in step])

    starts = [(c, u, a, 1.0) for c in (1.0, 2.0) for u in (0.5, 1.5) for a in (-1.0, 0.5, 2.0)]
    found = [minimised(loss, np.array(p), lower=np.array([0.05, -5.0, -20.0, 0.0]), turns=80) for p in starts]
    return np.append(min(found, key=value), r[off[0]])


def skew_tails(grid: DataFrame) -> DataFrame:
    """(flux, tail) of the rows of ``shift_grid``, a fit for each flux."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        flux = float(part["flux"].iloc[0])
        return pd.DataFrame({"flux": [flux], "tail": [fitted_tail(flux, part["r"].to_numpy(), part["shift"].to_numpy()).tolist()]})

    return grid.groupBy("flux").applyInPandas(run, "flux double, tail array<double>")


def parameter_table(fluxes: np.ndarray, tails: np.ndarray, l_cut: tuple[float, float, float], order: int = 5) -> np.ndarray:
    """(5, order + 1, 2): coefficients in the flux, lowest first, of each parameter, below and above the middle of ``l_cut``."""
    out = np.zeros((5, order + 1, 2))
    for half, at in enumerate((fluxes <= l_cut[1], fluxes >= l_cut[1])):
        for k in range(5):
            n = min(order, at.sum() - 1)
            out[k, : n + 1, half] = np.polynomial.Polynomial.fit(fluxes[at], tails[at, k], n).convert().coef if n > 0 else tails[at, k]
    return out


def table_shift(table: np.ndarray, l_cut: tuple[float, float, float], x: np.ndarray, y: np.ndarray, flux: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifts in both directions of blends of relative flux at (x, y), in units of the profile's width.

    Bright blends shift by their share of the flux, faint ones by their overlap with the profile.
    """
    half = (flux >= l_cut[1]).astype(int)
    powers = flux[:, None] ** np.arange(table.shape[1])
    p = np.einsum("fk,pkf->pf", powers, table[:, :, half])
    weighted, faint = flux / (1 + flux), flux * np.exp(-(x * x + y * y) / 4)

    def one(v: np.ndarray) -> np.ndarray:
        d = np.abs(v)
        with np.errstate(all="ignore"):
            tail = np.nan_to_num(skew(p[:4], d, flux)) / np.maximum(d, 1e-12)
        between = np.where(d < p[4], weighted, tail)
        return v * np.where(flux >= l_cut[2], weighted, np.where(flux < l_cut[0], faint, between))

    return one(x), one(y)
