"""Simulated counts of stars and galaxies, scaled until their sum fits a catalogue's own counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .population import galaxy_counts, rescaled_counts


def observed(detections: DataFrame, areas: DataFrame, keys: tuple[str, ...], limits: DataFrame, step: float, saturation: tuple[float, ...] = ()) -> DataFrame:
    """(keys, band, mag, density): detections (keys, band, mag) a magnitude and square degree, between saturation and the ``limits`` of completeness."""
    k = list(keys)
    bright = F.element_at(F.array(*map(F.lit, saturation)), F.col("band") + 1) if saturation else F.lit(-math.inf)
    inside = detections.join(limits, [*k, "band"]).where((F.col("mag") <= F.col("limit")) & (F.col("mag") > bright))
    bins = inside.groupBy(*k, "band", F.floor(F.col("mag") / step + 1e-9).alias("i")).agg(F.count("*").alias("n"))
    bins = bins.join(areas, k) if k else bins.crossJoin(areas)  # a row for each chunk
    return bins.select(*k, "band", ((F.col("i") + 0.5) * step).alias("mag"), (F.col("n") / (F.col("area") * step)).alias("density"))


def with_galaxies(model: DataFrame, galaxies: tuple[dict, ...]) -> DataFrame:
    """``model`` (band, mag and others) with ``galaxies``, their counts a magnitude and square degree.

    ``galaxies`` has for each band ``z`` (edges of shells), ``kcorr`` and ``schechter`` by type, and
    perhaps ``extinctions`` (of several sightlines, over which counts are averaged) and ``offset``.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = np.zeros(len(part))
            for band in part["band"].unique():
                g = galaxies[int(band)]
                at = (part["band"] == band).to_numpy()
                out[at] = galaxy_counts(part["mag"].to_numpy()[at], np.asarray(g["z"]), {k: np.asarray(v) for k, v in g["kcorr"].items()}, g["schechter"], extinctions=tuple(g.get("extinctions", (0.0,))), offset=g.get("offset", 0.0))
            yield part.assign(galaxies=out)

    return model.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in model.dtypes)}, galaxies double")


def fitted_factors(data: DataFrame, model: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, band, stars, galaxies, residual, n, determined): the factors by which the logarithm of the data's counts is fitted best.

    ``data`` (keys, band, mag, density) and ``model`` (keys, band, mag, density, galaxies) have
    a row for each bin of magnitude, so a chunk and band is a small group; the model's
    logarithms are interpolated to the data's bins. Residuals are root mean squares in dex.
    Groups in which fewer than two bins have data and both counts keep factors of 1 and have no residual.
    Where stars and galaxies have the same shape, other factors fit as well: only their sum is ``determined``.
    """
    k = [*keys, "band"]
    kind = dict(model.dtypes)
    rows = data.select(*k, "mag", "density", F.lit(None).cast("double").alias("galaxies"), F.lit(True).alias("seen")).unionByName(model.select(*k, "mag", "density", "galaxies", F.lit(False).alias("seen")))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mag")
        seen, sim = part[part["seen"] & (part["density"] > 0)], part[~part["seen"]]
        at = seen["mag"].to_numpy()
        logs = []
        for column in ("density", "galaxies"):
            some = sim[sim[column] > 0]
            logs.append(np.interp(at, some["mag"], np.log10(some[column]), left=np.nan, right=np.nan) if len(some) else np.full(len(at), np.nan))
        fine = np.isfinite(logs[0]) & np.isfinite(logs[1])
        stars, more, residual, determined = 1.0, 1.0, None, False
        if fine.sum() > 1:
            y, s, g = np.log10(seen["density"].to_numpy()[fine]), 10 ** logs[0][fine], 10 ** logs[1][fine]
            stars, more, determined = rescaled_counts(y, s, g)
            residual = float(np.sqrt(np.mean((np.log10(stars * s + more * g) - y) ** 2)))
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in k}, "stars": stars, "galaxies": more, "residual": residual, "n": int(fine.sum()), "determined": determined}])

    return rows.groupBy(*k).applyInPandas(fit, ", ".join(f"{c} {kind[c]}" for c in k) + ", stars double, galaxies double, residual double, n int, determined boolean")


def rescaled(model: DataFrame, data: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``model`` (keys, band, mag, density, width, galaxies) with stars and galaxies, each times its factor, in ``density``."""
    k = [*keys, "band"]
    factors = fitted_factors(data, model, keys).select(*k, "stars", F.col("galaxies").alias("more"))
    return model.join(factors, k).withColumn("density", F.col("stars") * F.col("density") + F.col("more") * F.col("galaxies")).drop("stars", "more", "galaxies")
