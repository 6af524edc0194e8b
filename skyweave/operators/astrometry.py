"""Calibration of quoted uncertainties by the separations of matches.

Separations are a mixture of true matches, whose offsets are normal with the corrected
uncertainty (times the transform of blends, if there is one), and of chance neighbours. For
each magnitude slice the share of chance matches is found on a grid; the correction
sigma' = sqrt((m sigma)^2 + n^2) is fitted to all slices of a sightline together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bessel import gaussian, hankel
from ..functions.optimise import minimised
from ..functions.sky import rescaled_sigma
from .spatial import nearest_point
from .statistics import quantiles

SHARES = np.linspace(0, 1, 101)


def log_factorial(k: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x + 1) for x in np.atleast_1d(k)])


def separation_models(edges: np.ndarray, sigma: float, density: float, blend: np.ndarray | None = None, rho: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Densities of separations at the middles of bins: of chance neighbours, and of the nearest of a true match and chance.

    ``density`` is of chance neighbours, a square arcsecond.
    """
    r, width = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    chance = 2 * np.pi * r * density * np.exp(-np.pi * r**2 * density)
    if blend is None:
        true = r / sigma**2 * np.exp(-(r**2) / (2 * sigma**2))
    else:
        true = 2 * np.pi * r * hankel(blend * gaussian(rho, sigma), rho, np.gradient(rho), r)
    inside = np.cumsum(true * width) - true * width / 2
    return chance, true * np.exp(-np.pi * r**2 * density) + chance * (1 - inside)


def slice_likelihood(counts: np.ndarray, edges: np.ndarray, sigma: float, density: float, blend=None, rho=None) -> tuple[float, float]:
    """Negative log-likelihood of counts by bin, and the share of chance matches that makes it least."""
    chance, match = separation_models(edges, sigma, density, blend, rho)
    width, total = np.diff(edges), counts.sum()
    mean = np.maximum(1e-10, (SHARES[:, None] * chance + (1 - SHARES[:, None]) * match) * width * total)
    value = (mean - counts * np.log(mean)).sum(axis=1) + log_factorial(counts).sum()
    best = int(value.argmin())
    return float(value[best]), float(SHARES[best])


def fitted_correction(slices: list[tuple], edges: np.ndarray, density: float, rho: np.ndarray | None = None) -> tuple[float, float]:
    """(m, n) for slices of (quoted sigma, counts by bin) or (quoted sigma, counts, transform of blends at ``rho``)."""
    if not slices:
        return 1.0, 0.0
    typical = float(np.mean([s[0] for s in slices]))

    def value(p: np.ndarray) -> float:
        m, n = p[0], p[1] * typical
        return sum(slice_likelihood(c, edges, max(1e-6, math.hypot(m * s, n)), density, *([blend[0], rho] if blend and blend[0] is not None else []))[0] for s, c, *blend in slices)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        here, step = value(p), 1e-4
        return here, np.array([(value(p + step * e) - value(p - step * e)) / (2 * step) for e in np.eye(2)])

    starts = [(m, n) for m in (0.7, 1.0, 1.5, 2.0, 3.0) for n in (0.05, 0.5, 1.5)]
    best = min(starts, key=lambda p: value(np.array(p)))
    m, n = minimised(loss, np.array(best), lower=np.array([0.01, 0.0]), turns=60)
    return float(m), float(n * typical)


def cut_slices(matches: DataFrame, by: list[str], sig_half: float, density_share: float = 0.5, sigmas: float = 20.0) -> DataFrame:
    """``matches`` (by, slice, sig, sep, density) near the medians of their slice and sightline.

    Kept are quoted uncertainties within ``sig_half`` of the slice's median, local densities
    within a share of the sightline's median, and separations up to ``sigmas`` of the former.
    """
    median = lambda of, c: quantiles(matches, of, c, (0.5,)).select(*of, F.col("q")[0].alias(f"__{c}"))
    typical, dense = median([*by, "slice"], "sig"), median(list(by), "density")  # a row for each slice, and for each sightline
    near = matches.join(typical, [*by, "slice"]).join(dense, by)
    keep = (F.abs(F.col("sig") - F.col("__sig")) <= sig_half) & (F.abs(F.col("density") - F.col("__density")) <= density_share * F.col("__density")) & (F.col("sep") <= sigmas * F.col("__sig"))
    return near.where(keep).drop("__sig", "__density")


def slice_statistics(matches: DataFrame, by: list[str], least: int = 100) -> DataFrame:
    """(by, slice, n, sig and sep at percentiles 16, 50 and 84) of slices with enough matches."""
    k = [*by, "slice"]
    counts = matches.groupBy(*k).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    at = lambda c: quantiles(matches, k, c, (0.16, 0.5, 0.84)).select(*k, F.col("q").alias(c))
    return counts.join(at("sig"), k).join(at("sep"), k)


def corrections(matches: DataFrame, density: float | None, by: list[str], r_max: float = 3.0, bins: int = 60, least: int = 100, blends: DataFrame | None = None, rho: np.ndarray | None = None, enough: int = 1) -> DataFrame:
    """(by, m, n, slices) from nearest matches (by, slice, sig, sep); counted by bin before they are gathered for the fit.

    Slices with fewer than ``least`` matches are left out, or with fewer than three quarters
    or half of that where fewer than ``enough`` slices are left. Chance neighbours have
    ``density`` a square arcsecond, or that in the column ``density``, a square degree.
    ``blends`` (by, slice, fourier) are transforms of simulated offsets at ``rho``.
    """
    edges = np.linspace(0, r_max, bins + 1)
    k = F.floor(F.col("sep") / (r_max / bins))
    dense = F.lit(float(density)) if density is not None else F.avg("density") / 3600**2
    counts = matches.where(F.col("sep") < r_max).groupBy(*by, "slice", k.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("sig").alias("s"), dense.alias("d"))
    counts = counts.join(blends.select(*by, "slice", "fourier"), [*by, "slice"], "left") if blends is not None else counts.withColumn("fourier", F.lit(None).cast("array<double>"))
    types = dict(matches.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in part.groupby("slice"):
            c = np.zeros(bins)
            c[rows["bin"]] = rows["n"]
            blend = rows["fourier"].iloc[0]
            found.append((float(rows["s"].sum() / rows["n"].sum()), c, None if blend is None else np.asarray(blend)))
        used: list = []
        for share in (1.0, 0.75, 0.5):
            used = used if len(used) >= enough else [f for f in found if f[1].sum() >= share * least]
        here = float((part["d"] * part["n"]).sum() / part["n"].sum())
        m, n = fitted_correction(used if len(used) >= enough else [], edges, here, rho)
        return pd.DataFrame([{**{b: part[b].iloc[0] for b in by}, "m": m, "n": n, "slices": len(used)}])

    return counts.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {types[b]}" for b in by) + ", m double, n double, slices int")


def corrected(cat: DataFrame, table: list[tuple[float, float, float, float]]) -> DataFrame:
    """``cat`` with uncertainties corrected by the terms (lon, lat, m, n) of the nearest of a few sightlines."""
    near = nearest_point(cat, [(i, lon, lat) for i, (lon, lat, _, _) in enumerate(table)])
    term = lambda k: F.element_at(F.array(*(F.lit(float(row[k])) for row in table)), F.col("pt") + 1)
    return near.withColumn("sig", rescaled_sigma("sig", term(2), term(3))).select(*cat.columns)
