"""Simulated proper motions and galaxy counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.optimise import minimised

#: Rotation curve: speed at the Sun and its slope, and the Sun's own motion (km/s); fixed values.
ROTATION, SLOPE, SUN_MOTION = 233.6, -1.34, (11.1, 12.24, 7.25)
R_SUN = 8.09
#: km/s at one kpc in arcseconds a year.
PER_KPC = 0.2108e-3
#: Radius (kpc) at which dispersions were measured, scale lengths of the discs (kpc), and Oort's constants; fixed values.
R_MEASURED, LENGTHS, OORT = 8.5, {"thin": 2.6, "thick": 3.6}, (15.3, -11.9)
#: Variances (km2/s2) of the thin disc in radius and height, how they rise in the first kpc of height, and the share of their
#: difference that tilts the ellipsoid; dispersions (km/s) of the thick disc in radius, rotation and height inside and outside
#: of R_MEASURED, and of the halo; lags behind the rotation (km/s); fixed values.
THIN, THIN_RISE, TILT = (715.93, 243.71), (1236.97, 306.84), 0.6
THICK = ((60.2, 44.7, 37.2), (55.8, 45.2, 36.3))
HALO = (140.0, 105.0, 95.0)
LAG = {"thin": 0.0, "thick": 39.0, "halo": 230.0}
COMPONENTS = tuple(LAG)
#: Counts that differ in shape by less, which is near their rounding, do not tell their factors apart.
SAME_SHAPE = 1e-11


def variances(r: np.ndarray, z: np.ndarray, component: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variances of velocity in radius, rotation and height, and the covariance of radius and height, at places in the Galaxy (kpc).

    Discs' radial variances go as R^2 exp(-2 R / h), vertical ones as exp(-R / h). The thin
    disc's rise with height up to one kpc, and its ellipsoid is tilted.
    """
    if component == "halo":
        rr, pp, zz = (np.full(r.shape, s * s) for s in HALO)
        return rr, pp, zz, np.zeros(r.shape)
    h, x = LENGTHS[component], r / R_MEASURED
    plane, up = x * x * np.exp(-2 * (r - R_MEASURED) / h), np.exp(-(r - R_MEASURED) / h)
    if component == "thick":
        inner, outer = (np.array(s) ** 2 for s in THICK)
        rr, pp, zz = (np.where(r < R_MEASURED, inner[k], outer[k]) * f for k, f in enumerate((plane, plane, up)))
        return rr, pp, zz, np.zeros(r.shape)
    rr0, zz0 = THIN[0] * plane, THIN[1] * up
    high = np.minimum(1, np.abs(z))
    rr, zz = rr0 + high * THIN_RISE[0], zz0 + high * THIN_RISE[1]
    most = np.sqrt(rr * zz)
    rz = z * TILT * (rr0 - zz0) / r
    return rr, -OORT[1] / (OORT[0] - OORT[1]) * rr, zz, np.where(np.abs(rz) > most, 0.99 * np.sign(rz) * most, rz)


def normals(ids: np.ndarray, lane: str, draws: int) -> np.ndarray:
    """(ids, draws, 3) normal numbers that follow from id, lane and place alone: counters are hashed, not drawn in turn."""
    place = np.arange(6 * draws, dtype=np.uint64)
    x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(zlib.crc32(lane.encode()) << 20)) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    u = u.reshape(len(ids), draws, 3, 2)
    return np.sqrt(-2 * np.log1p(-u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


def proper_motions(l_deg: np.ndarray, b_deg: np.ndarray, dist: np.ndarray, component: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mu_l cos b, mu_b) in arcseconds a year for sources at ``dist`` kpc, from normal numbers (sources, draws, 3)."""
    l, b = np.radians(l_deg), np.radians(b_deg)
    x, y, z = R_SUN - dist * np.cos(b) * np.cos(l), dist * np.cos(b) * np.sin(l), dist * np.sin(b)
    r, phi = np.maximum(np.hypot(x, y), 1e-6), np.arctan2(y, x)
    rr, pp, zz, rz = variances(r, z, component)
    wide = lambda v: v[:, None]
    v_r = wide(np.sqrt(rr)) * draws[..., 0]
    v_z = wide(rz / np.sqrt(rr)) * draws[..., 0] + wide(np.sqrt(zz - rz * rz / rr)) * draws[..., 2]
    v_p = wide(np.sqrt(pp)) * draws[..., 1] + wide(ROTATION + SLOPE * (r - R_SUN) - LAG[component])
    sin, cos = wide(np.sin(phi)), wide(np.cos(phi))
    u = -v_r * cos + v_p * sin - SUN_MOTION[0]  # to the Galactic centre, with rotation, and up
    s = v_r * sin + v_p * cos - ROTATION - SUN_MOTION[1]
    w = v_z - SUN_MOTION[2]
    l, b, scale = wide(l), wide(b), wide(PER_KPC / dist)
    return (-np.sin(l) * u + np.cos(l) * s) * scale, (-np.sin(b) * (np.cos(l) * u + np.sin(l) * s) + np.cos(b) * w) * scale


def simulated_motions(sources: DataFrame, draws: int = 10) -> DataFrame:
    """(id, component, draw, mu_l, mu_b) for sources (id, l, b, dist); numbers follow from the id, so results do not depend on partitions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, l, b, d = (part[c].to_numpy() for c in ("id", "l", "b", "dist"))
            for name in COMPONENTS:
                east, north = proper_motions(l, b, d, name, normals(ids, name, draws))
                yield pd.DataFrame({"id": np.repeat(ids, draws), "component": name, "draw": np.tile(np.arange(draws, dtype=np.int32), len(ids)), "mu_l": east.ravel(), "mu_b": north.ravel()})

    return sources.mapInPandas(run, "id bigint, component string, draw int, mu_l double, mu_b double")


def galaxy_counts(mags: np.ndarray, z_edges: np.ndarray, kcorr: dict[str, np.ndarray], schechter: dict[str, tuple[float, float, float, float, float]], h0: float = 67.7, om: float = 0.31, extinctions: tuple[float, ...] = (0.0,), offset: float = 0.0) -> np.ndarray:
    """Galaxies a magnitude and square degree: shells of redshift, each type with its own luminosity function and k-corrections.

    Counts are averaged over the extinctions of several sightlines; ``offset`` is the zero point of the magnitudes.
    """
    z = (z_edges[1:] + z_edges[:-1]) / 2
    grid = np.linspace(0, z_edges[-1], 2000)
    rate = 299792.458 / h0 / np.sqrt(om * (1 + grid) ** 3 + 1 - om)
    comoving = np.append(0, np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid)))
    at = lambda x: np.interp(x, grid, comoving)
    volume = (at(z_edges[1:]) ** 3 - at(z_edges[:-1]) ** 3) / 3 * math.radians(1) ** 2
    total = np.zeros(len(mags))
    for kind, (phi0, m0, alpha, p, q) in schechter.items():
        for i, zi in enumerate(z):
            modulus = 5 * math.log10(at(zi) * (1 + zi)) + 25 + kcorr[kind][i]
            lum = 10 ** (-0.4 * (mags[:, None] + offset - np.array(extinctions) - modulus - (m0 - q * zi)))
            total += volume[i] * 0.4 * math.log(10) * phi0 * 10 ** (0.4 * p * zi) * (lum ** (alpha + 1) * np.exp(-lum)).mean(axis=1)
    return total


def rescaled_counts(log_data: np.ndarray, stars: np.ndarray, galaxies: np.ndarray) -> tuple[float, float, bool]:
    """Factors of star and galaxy counts that fit the logarithm of the data's counts best, at least a hundredth, and whether no others do.

    Counts of the same shape leave only the factors' sum determined. Of shapes that are nearly the
    same the descent knows the sum alone; steps of least squares, which do not square the small
    difference, then find the factors.
    """
    least = 0.01

    def residuals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = p[0] * stars + p[1] * galaxies
        return np.log10(model) - log_data, np.stack([stars, galaxies], axis=1) / (model * math.log(10))[:, None]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        off, slopes = residuals(p)
        return float(off @ off), 2 * off @ slopes

    def step(free: list[int], off: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        size, out = np.linalg.norm(slopes[:, free], axis=0), np.zeros(2)
        out[free] = np.linalg.lstsq(slopes[:, free] / size, -off, rcond=SAME_SHAPE)[0] / size
        return out

    p = minimised(loss, np.array([1.0, 1.0]), lower=np.array([least, least]))
    for _ in range(100):
        off, slopes = residuals(p)
        steps = [step(free, off, slopes) for free in ([0, 1], [0], [1])]  # one alone where the other is at its least
        tries = (np.maximum(p + one / 2**i, least) for one in steps for i in range(40))
        if (better := next((t for t in tries if loss(t)[0] < off @ off), None)) is None:
            break
        p = better
    slopes = residuals(p)[1]
    return float(p[0]), float(p[1]), bool(np.linalg.matrix_rank(slopes / np.linalg.norm(slopes, axis=0), tol=SAME_SHAPE) == 2)
