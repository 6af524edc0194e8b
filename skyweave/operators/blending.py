"""From a catalogue to simulated blends: local densities, cells of density and magnitude, and a simulation for each."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sky import blend_weight
from ..plans.storage import written
from .auf import AUF_SCHEMA, Blends, cell_auf
from .density import local_densities
from .regions import hulls
from .spatial import large_join, small_join
from .statistics import quantiles

#: Steps of the cells in the logarithm of density and in magnitude.
LOG_STEP, MAG_STEP = 0.2, 0.25
#: Blends matter down to this share of a source's noise, and until so few trials have none.
NOISE, EMPTY = 0.05, 0.01
#: How many of the lowest signal-to-noise ratios tell the weakest.
WEAKEST = 1000


def complete_to(detections: DataFrame, by: list[str], step: float = 0.1) -> DataFrame:
    """(by, limit): the faint end of the fullest magnitude bin, up to which a catalogue is taken as complete."""
    bins = detections.groupBy(*by, F.floor(F.col("mag") / step + 1e-9).alias("i")).agg(F.count("*").alias("n"))
    return bins.groupBy(*by).agg(((F.max(F.struct("n", "i"))["i"] + 1) * step).alias("limit"))


def by_band(cat: DataFrame, bands: tuple[str, ...], keys: tuple[str, ...], snrs: str | None) -> DataFrame:
    """(keys, id, lon, lat, band, mag, snr) of the detections; without signal-to-noise ratios snr is null."""
    values = F.arrays_zip(F.array(*bands).alias("mag"), (F.col(snrs) if snrs else F.array().cast("array<double>")).alias("snr"))
    return cat.select(*keys, "id", "lon", "lat", F.posexplode(values).alias("band", "v")).select(*keys, "id", "lon", "lat", "band", "v.mag", "v.snr").where("mag is not null")


def snr_curves(detections: DataFrame, by: list[str]) -> DataFrame:
    """(by, __m, snr, weakest): the median signal-to-noise ratio of each bin of magnitude, and that of the WEAKEST lowest of all."""
    good = detections.where((F.col("snr") > 0) & (F.col("snr") < float("inf")))
    curve = quantiles(good.withColumn("__m", F.floor(F.col("mag") / MAG_STEP)), [*by, "__m"], "snr", (0.5,))
    lowest = good.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("snr"))).where(F.col("r") <= WEAKEST)
    return curve.select(*by, "__m", F.col("q")[0].alias("snr")).join(lowest.groupBy(*by).agg(F.percentile("snr", F.lit(0.5)).alias("weakest")), by)  # WEAKEST values a group at most


def faintest_blend(mag: Column, scale: Column, snr: Column, model: Column, fwhm: Column) -> Column:
    """How many magnitudes fainter than a source its blends are simulated.

    Down to a share NOISE of the source's noise, or, if that is fainter, until at most EMPTY of the trials
    have no blend: the expected number of blends, summed up from the source's magnitude, reaches -ln(EMPTY).
    """
    fainter = F.filter(model, lambda b: b["mag"] >= mag)
    rate = lambda b: b["density"] * b["width"] * scale * math.pi * F.pow(1.185 * fwhm / 3600, F.lit(2.0))
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, b: Column) -> Column:
        total = s["sum"] + rate(b)
        return F.struct(total.alias("sum"), F.coalesce(s["at"], F.when(total >= -math.log(EMPTY), b["mag"])).alias("at"))

    last = F.try_element_at(fainter, F.lit(-1))["mag"]
    crowded = F.coalesce(F.aggregate(fainter, begin, step, lambda s: F.coalesce(s["at"], last)) - mag, F.lit(0.0))
    return F.greatest(-2.5 * F.log10(NOISE / snr), crowded)


def with_cells(cat: DataFrame, bands: tuple[str, ...], model: DataFrame, radius: float, keys: tuple[str, ...] = (), snrs: str | None = None, fwhms: tuple[float, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``cat`` with ``nm``, the cell of each source's best band, and the occupied cells (nm, band, ln_n, mag_bin, scale, mag, mags, densities, widths, snr, weight, depth).

    ``model`` (keys, band, mag, density, width) has simulated counts a magnitude and square
    degree. A cell's scale is the measured density of sources to the limit of completeness
    over the model's. Sources without a magnitude in their best band have the cell of no blends, 0.
    ``snrs`` is the column with an array of the bands' signal-to-noise ratios; a cell has its
    magnitude's median, which says how faint its blends are (``depth``) and how much the
    flux-weighted simulation counts (``weight``). Without a ratio, all fainter blends count, by that simulation.
    """
    k = list(keys)
    long = by_band(cat, bands, keys, snrs)
    limits = complete_to(long, [*k, "band"])  # a row for each chunk and band
    seen = small_join(long, limits, [*k, "band"]).where("mag <= limit")
    counts = model.join(limits, [*k, "band"]).groupBy(*k, "band").agg(
        F.sum(F.when(F.col("mag") <= F.col("limit"), F.col("density") * F.col("width"))).alias("to_limit"), F.array_sort(F.collect_list(F.struct("mag", "density", "width"))).alias("model")
    )  # the model's own bins
    own = cat.withColumns({"band": F.col("best"), "mag": F.element_at(F.array(*bands), F.col("best") + 1)})
    local = local_densities(own.where("mag is not null"), seen, radius, (*k, "band"), hulls(cat, keys), keys)
    own = large_join(own, local.select(*k, "band", "id", "density"), [*k, "band", "id"], "left")
    own = own.withColumns({"__n": F.floor(F.log("density") / LOG_STEP), "__m": F.floor(F.col("mag") / MAG_STEP)})
    own = own.withColumn("nm", F.when(F.col("__n").isNull() | F.col("__m").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*k, "band", "__n", "__m")))
    own = written(own.drop("mag", "density"), "marked")  # for the sources and for their cells
    cells = own.where("nm <> 0").select(*k, "nm", "band", "__n", "__m").distinct().join(counts, [*k, "band"])
    if snrs:
        cells = cells.join(snr_curves(long, [*k, "band"]), [*k, "band", "__m"], "left")
    else:
        cells = cells.withColumns({"snr": F.lit(None).cast("double"), "weakest": F.lit(None).cast("double")})
    cells = cells.withColumns({"scale": F.exp((F.col("__n") + 0.5) * LOG_STEP) / F.greatest("to_limit", F.lit(1e-9)), "mag": (F.col("__m") + 0.5) * MAG_STEP})
    fwhm = F.element_at(F.array(*map(F.lit, fwhms)), F.col("band") + 1) if fwhms else F.lit(None).cast("double")
    depth = F.when(F.col("snr").isNotNull(), faintest_blend(F.col("mag"), F.col("scale"), F.col("snr"), F.col("model"), fwhm))
    weight = F.coalesce(blend_weight("snr", "weakest"), F.lit(1.0))
    arrays = [F.col(f"model.{c}").alias(name) for c, name in (("mag", "mags"), ("density", "densities"), ("width", "widths"))]
    names = [F.col("__n").alias("ln_n"), F.col("__m").alias("mag_bin")]
    return own.drop("band", "__n", "__m"), cells.select("nm", "band", *names, "scale", "mag", *arrays, "snr", weight.alias("weight"), depth.alias("depth"))


def simulated_cells(cells: DataFrame, how: Blends, fwhms: tuple[float, ...]) -> DataFrame:
    """(nm and AUF_SCHEMA) of cells, many to a batch, and of the cell 0, in which nothing is blended."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.nm == 0:
                    out.append({"nm": 0, "fourier": [1.0] * how.rho_bins, "frac": [0.0] * len(how.cuts), "flux": 0.0, "cumulative": [1.0] * how.r_bins})
                    continue
                model = pd.DataFrame({"mag": r.mags, "density": r.densities, "width": r.widths})
                out.append({"nm": r.nm, **cell_auf(r.scale, r.mag, model, replace(how, fwhm=fwhms[r.band]), str(r.nm), r.depth, r.weight)})
            yield pd.DataFrame(out, columns=["nm", "fourier", "frac", "flux", "cumulative"])

    zero = cells.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("nm"), F.lit(0).alias("band"), *(F.lit(None).cast("bigint").alias(c) for c in ("ln_n", "mag_bin")), F.lit(0.0).alias("scale"), F.lit(0.0).alias("mag"), *(F.array().cast("array<double>").alias(c) for c in ("mags", "densities", "widths")), *(F.lit(x).cast("double").alias(c) for c, x in (("snr", None), ("weight", 1.0), ("depth", None))))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.unionByName(zero).repartition(parts, "nm").mapInPandas(run, "nm bigint, " + AUF_SCHEMA)
