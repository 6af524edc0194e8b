"""Calibration sightline by sightline: cutouts of equal area, matches by visit, blends by slice, fits and how good they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import rescaled_sigma
from ..plans.storage import written
from .astrometry import corrections, cut_slices, separation_models, slice_likelihood
from .auf import Blends, cell_auf
from .density import local_densities
from .regions import hulls, interior_points
from .spatial import large_join, mutual_nn
from .statistics import quantiles


@dataclass(frozen=True)
class Box:
    """A sightline's cutout: ``half`` of its width in longitude, which may lie across zero."""

    pt: int
    lon: float
    half: float
    low: float
    high: float

    @property
    def area(self) -> float:
        """Square degrees."""
        return 2 * self.half * math.degrees(math.sin(math.radians(self.high)) - math.sin(math.radians(self.low)))


def boxes(points: list[tuple[int, float, float]], area: float, height: float) -> list[Box]:
    """Cutouts of one height and, as far as the sphere allows, one area: the nearer to a pole, the wider."""
    out = []
    for pt, lon, lat in points:
        low, high = max(-90.0, lat - height / 2), min(90.0, lat + height / 2)
        across = math.degrees(math.sin(math.radians(high)) - math.sin(math.radians(low)))
        out.append(Box(pt, lon % 360, min(180.0, area / across / 2), low, high))
    return out


def sightlines(cat: DataFrame, least: int) -> list[tuple[int, float, float]]:
    """(pt, lon, lat) of at least so many points of a regular grid inside a catalogue's hull."""
    (hull,) = hulls(cat, ()).collect()  # corners of one hull
    return [(i, (x - hull["shift"]) % 360, y) for i, (x, y) in enumerate(interior_points([(c["x"], c["y"]) for c in hull["corners"]], least))]


def cutouts(cat: DataFrame, some: list[Box]) -> DataFrame:
    """``cat`` with ``pt``, once for each of a few boxes that a source is in."""
    each = F.array(*(F.struct(F.lit(b.pt).alias("pt"), F.lit(b.lon).alias("lon"), F.lit(b.half).alias("half"), F.lit(b.low).alias("low"), F.lit(b.high).alias("high")) for b in some))
    off = lambda b: F.abs(F.pmod(F.col("lon") - b["lon"] + 180, F.lit(360.0)) - 180)
    inside = F.filter(each, lambda b: (F.col("lat") >= b["low"]) & (F.col("lat") <= b["high"]) & (off(b) <= b["half"]))
    return cat.withColumn("pt", F.explode(F.transform(inside, lambda b: b["pt"])))


def separations(cat: DataFrame, reference: DataFrame, some: list[Box], radius: float, r_max: float, mag: str, step: float, visit: str | None = None) -> DataFrame:
    """(pt, slice, id, visit, sig, sep, density) of mutual neighbours within ``r_max`` arcseconds, in each cutout.

    Of repeated visits each is matched on its own, so the detections of one source do not
    take its counterpart from each other. Chance neighbours have the reference's density
    within ``radius`` degrees.
    """
    seen = F.col(visit).cast("string") if visit else F.lit("")
    own = cutouts(cat.select("id", "lon", "lat", "sig", F.col(mag).alias("mag"), seen.alias("visit")).where("mag is not null and visit is not null"), some)
    other = cutouts(reference.select("id", "lon", "lat"), some)
    density = local_densities(own.withColumnRenamed("id", "__id").withColumn("id", F.struct("__id", "visit")), other.withColumn("id", F.struct(F.col("id").alias("__id"), F.lit("").alias("visit"))), radius, ("pt",), hulls(other, ("pt",)), ("pt",))
    density = density.select("pt", "id.__id", "id.visit", "density").toDF("pt", "id", "visit", "density")
    visits = own.select("pt", "visit").distinct()  # a row for each sightline's visit
    pairs = mutual_nn(own, other.join(visits, "pt"), r_max / 3600, ("pt", "visit")).withColumnRenamed("a", "id")
    rows = large_join(own.withColumn("slice", F.floor(F.col("mag") / step).cast("int")), density, ["pt", "id", "visit"])
    return large_join(pairs, rows, ["pt", "id", "visit"]).select("pt", "slice", "id", "visit", "sig", "sep", "density")


def slice_blends(matches: DataFrame, model: DataFrame, limit: float, step: float, how: Blends, fwhm: float) -> DataFrame:
    """(pt, slice, fourier): simulated blends of each sightline's slices, at their median density and middle magnitude.

    ``model`` (pt, mag, density, width) has simulated counts a magnitude and square degree;
    densities are of sources brighter than ``limit``.
    """
    typical = quantiles(matches, ["pt", "slice"], "density", (0.5,)).select("pt", "slice", F.col("q")[0].alias("local"))
    counts = model.groupBy("pt").agg(F.sum(F.when(F.col("mag") <= limit, F.col("density") * F.col("width"))).alias("to"), F.array_sort(F.collect_list(F.struct("mag", "density", "width"))).alias("m"))  # the model's own bins
    rows = typical.join(counts, "pt").select("pt", "slice", (F.col("local") / F.greatest("to", F.lit(1e-9))).alias("scale"), ((F.col("slice") + 0.5) * step).alias("mag"), *(F.col(f"m.{c}").alias(c) for c in ("density", "width")), F.col("m.mag").alias("mags"))
    one = replace(how, fwhm=fwhm)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [cell_auf(r.scale, r.mag, pd.DataFrame({"mag": r.mags, "density": r.density, "width": r.width}), one, f"{r.pt}:{r.slice}")["fourier"] for r in part.itertuples(index=False)]
            yield pd.DataFrame({"pt": part["pt"], "slice": part["slice"], "fourier": found})

    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "pt", "slice").mapInPandas(run, "pt int, slice int, fourier array<double>")


def fitted_slices(matches: DataFrame, fits: DataFrame) -> DataFrame:
    """(pt, slice, n, sig, fit_sig): median quoted uncertainties of the slices, and what the joint fit (pt, m, n) of their sightline makes of them."""
    typical = quantiles(matches, ["pt", "slice"], "sig", (0.5,)).select("pt", "slice", F.col("n").alias("count"), F.col("q")[0].alias("sig"))
    return typical.join(fits, "pt").select("pt", "slice", F.col("count").alias("n"), "sig", rescaled_sigma("sig", "m", "n").alias("fit_sig"))


def fit_quality(matches: DataFrame, slices: DataFrame, r_max: float, bins: int, blends: DataFrame | None = None, rho: np.ndarray | None = None) -> DataFrame:
    """(pt, slice, share, r, data, model, distance): cumulative shares of separations and of the fitted mixture, and the largest distance between them.

    ``slices`` is from ``fitted_slices``; separations are counted by bin, and a slice's bins are one small group.
    """
    edges = np.linspace(0, r_max, bins + 1)
    counts = matches.where(F.col("sep") < r_max).groupBy("pt", "slice", F.floor(F.col("sep") / (r_max / bins)).cast("int").alias("bin")).agg(F.count("*").alias("c"), F.avg("density").alias("d"))
    rows = counts.join(slices.select("pt", "slice", "fit_sig"), ["pt", "slice"])
    rows = rows.join(blends, ["pt", "slice"], "left") if blends is not None else rows.withColumn("fourier", F.lit(None).cast("array<double>"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(bins)
        c[part["bin"]] = part["c"]
        dense = float((part["d"] * part["c"]).sum() / part["c"].sum()) / 3600**2
        blend = part["fourier"].iloc[0]
        more = (np.asarray(blend), rho) if blend is not None else ()
        sigma = float(part["fit_sig"].iloc[0])
        share = slice_likelihood(c, edges, sigma, dense, *more)[1]
        chance, match = separation_models(edges, sigma, dense, *more)
        model, data = np.cumsum((share * chance + (1 - share) * match) * np.diff(edges)), np.cumsum(c) / c.sum()
        return pd.DataFrame({"pt": part["pt"].iloc[0], "slice": part["slice"].iloc[0], "share": share, "r": edges[1:], "data": data, "model": model, "distance": np.abs(data - model).max()})

    return rows.groupBy("pt", "slice").applyInPandas(run, "pt int, slice int, share double, r double, data double, model double, distance double")


def calibrate(cat: DataFrame, reference: DataFrame, some: list[Box], radius: float, r_max: float, mag: str, step: float = 0.5, sig_half: float = 0.1, least: int = 100, visit: str | None = None, model: DataFrame | None = None, limit: float = math.inf, how: Blends | None = None, fwhm: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pt, m, n, slices), ``fitted_slices`` and ``fit_quality`` of all sightlines, with blends where a model of counts is given."""
    matches = written(cut_slices(separations(cat, reference, some, radius, r_max, mag, step, visit), ["pt"], sig_half), "separations")
    blends = rho = None
    if model is not None:
        blends = written(slice_blends(matches, model, limit, step, how, fwhm), "blends")
        rho = (np.arange(how.rho_bins) + 0.5) * how.rho_max / how.rho_bins
    fits = written(corrections(matches, None, ["pt"], r_max, least=least, blends=blends, rho=rho), "fits")
    slices = written(fitted_slices(matches, fits), "slices")
    return fits, slices, fit_quality(matches, slices, r_max, 60, blends, rho)
