"""Random catalogues with planted counterparts; a row depends on its number and the seed alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, what: str, key: Column | None = None) -> Column:
    """A number from 0 to 1 from the hash of a row's key."""
    return (F.shiftrightunsigned(F.xxhash64(F.col("id") if key is None else key, F.lit(seed), F.lit(what)), 11) + 0.5) / float(1 << 53)


def catalogues(spark: SparkSession, n_a: int, n_b: int, common: int, extent: tuple[float, float, float, float], sig_a: float, sig_b: float, bands_a: int = 3, bands_b: int = 4, shape: str = "rectangle", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Catalogues (id, lon, lat, sig, mags, best) in a rectangle or circle; the first ``common`` ids are the same sources in both.

    Both positions of a source are shifted from its true one by a Rayleigh distance of the
    catalogue's uncertainty; magnitudes of counterparts agree.
    """
    lon1, lon2, lat1, lat2 = extent

    def place(key: Column) -> tuple[Column, Column]:
        u, v = uniform(seed, "u", key), uniform(seed, "v", key)
        if shape == "rectangle":
            return lon1 + u * (lon2 - lon1), lat1 + v * (lat2 - lat1)
        r, t = F.sqrt(u) * (lat2 - lat1) / 2, 2 * math.pi * v
        return (lon1 + lon2) / 2 + r * F.cos(t), (lat1 + lat2) / 2 + r * F.sin(t)

    def side(n: int, sig: float, bands: int, name: str) -> DataFrame:
        own = F.when(F.col("id") < common, F.concat(F.lit("c"), F.col("id"))).otherwise(F.concat(F.lit(name), F.col("id")))
        lon, lat = place(own)
        r, t = sig / 3600 * F.sqrt(-2 * F.log(uniform(seed, f"r{name}"))), 2 * math.pi * uniform(seed, f"t{name}")
        mags = F.array(*(0.9 + 3.2 * uniform(seed, f"m{min(i, 2)}", own) for i in range(bands)))
        return spark.range(n).select("id", (lon + r * F.cos(t)).alias("lon"), (lat + r * F.sin(t)).alias("lat"), F.lit(float(sig)).alias("sig"), mags.alias("mags"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bands)).cast("int").alias("best"))

    return side(n_a, sig_a, bands_a, "a"), side(n_b, sig_b, bands_b, "b")
