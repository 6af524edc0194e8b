"""Astrometric uncertainty with unseen blended sources, simulated for each cell of density and magnitude."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bessel import hankel, j0, j1
from .psf import table_shift


@dataclass(frozen=True)
class Blends:
    """Simulation of one filter. Radii in arcseconds; ``cuts`` are magnitude differences of contaminants that are counted."""

    fwhm: float
    trials: int = 10_000
    cuts: tuple[float, ...] = (2.5, 5.0)
    r_max: float = 5.0
    r_bins: int = 200
    rho_max: float = 4.0
    rho_bins: int = 100
    #: ``fw`` (flux-weighted), ``psf`` (fitted profile) or ``both``, mixed by signal-to-noise.
    algorithm: str = "fw"
    #: Of the psf algorithm: fluxes between which shifts are tabulated, and the polynomials of the table.
    l_cut: tuple[float, float, float] | None = None
    shift: tuple | None = field(default=None)
    #: Or the table of skew-normal tails instead of the polynomials: nested tuples (5, terms, 2).
    table: tuple | None = None

    @property
    def radius(self) -> float:
        return 1.185 * self.fwhm

    @property
    def sigma(self) -> float:
        return self.fwhm / (2 * math.sqrt(2 * math.log(2)))


def expected(density: np.ndarray, width: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """Mean number of blends in each model bin: density a magnitude and square degree, within a circle."""
    return density * width * math.pi * (radius / 3600) ** 2 * scale


def simulated(lam: np.ndarray, dm: np.ndarray, ddm: np.ndarray, how: Blends, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and contaminating fluxes of all trials, and the share of trials with a blend brighter than each cut.

    All trials are drawn at once: the number of blends of each, which is Poisson of the bins'
    sum, then a bin for each blend, by the bins' shares.
    """
    total_lam = float(lam.sum())
    trial = np.repeat(np.arange(how.trials), rng.poisson(total_lam, size=how.trials))
    bin_ = np.minimum(np.searchsorted(np.cumsum(lam), rng.random(len(trial)) * total_lam, side="right"), max(0, len(lam) - 1))
    bright, faint = 10 ** (-(dm - ddm / 2) / 2.5), 10 ** (-(dm + ddm / 2) / 2.5)
    flux = faint[bin_] + rng.random(len(bin_)) * (bright - faint)[bin_]
    turn, r = 2 * math.pi * rng.random(len(bin_)), how.radius * np.sqrt(rng.random(len(bin_)))
    x, y = r * np.sin(turn), r * np.cos(turn)
    total = lambda w: np.bincount(trial, weights=w, minlength=how.trials)
    if how.algorithm == "fw":
        light = total(flux)
        offset, contam = np.hypot(total(x * flux), total(y * flux)) / (1 + light), light
    else:
        if how.table:
            dx, dy = (d * how.sigma for d in table_shift(np.array(how.table), how.l_cut, x / how.sigma, y / how.sigma, flux))
        else:
            weight = shifts(r, flux, how)
            dx, dy = x * weight, y * weight
        cx, cy = total(dx), total(dy)
        offset = np.hypot(cx, cy)
        seen = total(flux * np.exp(-0.25 * ((x - cx[trial]) ** 2 + (y - cy[trial]) ** 2) / how.sigma**2))
        contam = np.maximum(0, np.exp(-0.25 * offset**2 / how.sigma**2) - 1 + seen)
    share = np.array([(np.bincount(trial[dm[bin_] < cut], minlength=how.trials) > 0).mean() for cut in how.cuts])
    return offset, contam, share


def shifts(r: np.ndarray, flux: np.ndarray, how: Blends) -> np.ndarray:
    """By how much of its offset a blend moves the fitted centre: flux-weighted if bright, matched to the profile if faint."""
    bright = how.l_cut[2] if how.l_cut else 0.9
    faint = flux * np.exp(-(r**2) / (4 * how.sigma**2))
    between = (np.polyval(how.shift, r / how.sigma) if how.shift else 1.0) * faint / (1 + flux)
    low = how.l_cut[0] if how.l_cut else 0.01
    return np.where(flux >= bright, flux / (1 + flux), np.where(flux < low, faint, between))


def cell_auf(scale: float, mag: float, model: pd.DataFrame, how: Blends, key: str, depth: float | None = None, weight: float = 1.0) -> dict:
    """One cell: the transform of the offsets, the share of contaminated trials and the mean flux. The seed follows from the key.

    Blends are down to ``depth`` magnitudes fainter than the source, or as faint as the model.
    With the algorithm ``both`` the flux-weighted simulation counts with ``weight`` and the
    profile's with the rest.
    """
    if how.algorithm == "both":
        one, two = (cell_auf(scale, mag, model, replace(how, algorithm=kind), f"{key}:{kind}", depth) for kind in ("fw", "psf"))
        return {k: (weight * np.asarray(one[k]) + (1 - weight) * np.asarray(two[k])).tolist() for k in one}
    rng = np.random.Generator(np.random.Philox(zlib.crc32(key.encode())))
    far = np.inf if depth is None or np.isnan(depth) else mag + depth
    bins = model[(model["mag"] >= mag) & (model["mag"] <= far)].sort_values("mag")
    lam = expected(bins["density"].to_numpy(), bins["width"].to_numpy(), scale, how.radius)
    offset, contam, share = simulated(lam, bins["mag"].to_numpy() - mag, bins["width"].to_numpy(), how, rng)
    edges = np.linspace(0, how.r_max, how.r_bins + 1)
    hist, _ = np.histogram(offset, edges)
    ring = math.pi * (edges[1:] ** 2 - edges[:-1] ** 2)
    density = hist / (ring * max(1, hist.sum()))
    middle = (edges[1:] + edges[:-1]) / 2
    rho = (np.arange(how.rho_bins) + 0.5) * how.rho_max / how.rho_bins
    return {"fourier": hankel(density, middle, ring / (2 * math.pi * middle), rho).tolist(), "frac": share.tolist(), "flux": float(contam.mean()), "cumulative": np.cumsum(density * ring).tolist()}


AUF_SCHEMA = "fourier array<double>, frac array<double>, flux double, cumulative array<double>"


PAIR_SCHEMA = "cdf double, g double, contam_a array<double>, contam_b array<double>, flux_a double, flux_b double"


def pair_terms(sep: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray, blends_a: np.ndarray, blends_b: np.ndarray, rho: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
    """CDF and densities of separations (arcseconds) with blends on both sides, the first, the second and neither.

    Rows are pairs; the blends' transforms have a column for each rho.
    """
    both = np.exp(-2 * np.pi**2 * (sig_a**2 + sig_b**2)[:, None] * rho**2)
    turn = 2 * np.pi * sep[:, None] * rho
    bessel0 = 2 * np.pi * rho * width * j0(turn)
    cdf = 2 * np.pi * sep * (j1(turn) * both * blends_a * blends_b * width).sum(axis=1)
    return cdf, *((bessel0 * both * x).sum(axis=1) for x in (blends_a * blends_b, blends_a, blends_b, 1.0))


def with_blends(pairs: DataFrame, aufs_a: DataFrame, aufs_b: DataFrame, how: Blends) -> DataFrame:
    """``pairs`` (sep, sig_a, sig_b, nm_a, nm_b and others) with the columns of PAIR_SCHEMA.

    ``aufs`` are what ``blending.simulated_cells`` gives; they are joined by cell, and the integrals
    are sums over a batch of pairs. A density below zero is numeric noise and becomes 1e-30.
    """
    named = lambda aufs, side: aufs.select(F.col("nm").alias(f"nm_{side}"), F.col("fourier").alias(f"__f{side}"), F.col("frac").alias(f"__p{side}"), F.col("flux").alias(f"flux_{side}"))
    joined = pairs.join(named(aufs_a, "a"), "nm_a").join(named(aufs_b, "b"), "nm_b")
    keep = [c for c in pairs.columns]
    types = dict(pairs.dtypes)
    rho = (np.arange(how.rho_bins) + 0.5) * how.rho_max / how.rho_bins

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 2000):
                part = whole.iloc[at : at + 2000].reset_index(drop=True)
                fa, fb, pa, pb = (np.stack(part[c]) for c in ("__fa", "__fb", "__pa", "__pb"))
                cdf, cc, cn, nc, nn = pair_terms(part["sep"].to_numpy(), part["sig_a"].to_numpy(), part["sig_b"].to_numpy(), fa, fb, rho, how.rho_max / how.rho_bins)
                bad = cc < 0
                cc, cn, nc, nn = (np.where(bad, 1e-30, x)[:, None] for x in (cc, cn, nc, nn))
                total = pa * pb * cc + pa * (1 - pb) * cn + (1 - pa) * pb * nc + (1 - pa) * (1 - pb) * nn
                share = lambda top, total=total: np.clip(top / total, 0, 1)
                out = part[keep].copy()
                out["cdf"], out["g"] = cdf, cc[:, 0] * 3600.0**2
                out["contam_a"], out["contam_b"] = list(share(pa * pb * cc + pa * (1 - pb) * cn)), list(share(pa * pb * cc + (1 - pa) * pb * nc))
                out["flux_a"], out["flux_b"] = part["flux_a"], part["flux_b"]
                yield out

    return joined.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", " + PAIR_SCHEMA)
