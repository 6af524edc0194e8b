"""Spherical joins by cells: range join, nearest point, mutual neighbours, local density.

The sphere is cut into bands of latitude as high as the radius, each band into cells at
least that wide. One side keeps its cell, the other is repeated in the cells that its
circle can touch, so the join is an equality on (band, cell) and needs no region of its own
for the poles or the wrap. A source is repeated a handful of times whatever the data's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import haversine


def large_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the catalogues: sorted and merged, so neither side is gathered on the driver.

    Spark takes a derived table to be as large as the files it is read from, whatever is
    computed or repeated by row, and would broadcast what is many times the threshold.
    """
    return left.join(right.hint("merge"), on, how)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of a row for each chunk, cell, band or bin, without keys with all its rows: that table is broadcast, never the catalogue.

    Spark takes an aggregate to be as large as what it is made of, and where its rows are wider, or
    the catalogue is a file of a few megabytes, it would broadcast the catalogue.
    """
    return left.join(F.broadcast(right), on, how) if on else left.crossJoin(F.broadcast(right))


def _cells(band: Column, radius: float) -> Column:
    """The number of cells of a band: wide enough where the band is narrowest."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * radius - 90), F.abs((band + 1) * radius - 90)))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(360 * F.cos(F.radians(far)) / radius))


def _own_cell(lon: Column, lat: Column, radius: float) -> tuple[Column, Column]:
    band = F.floor((lat + 90) / radius)
    n = _cells(band, radius)
    return band, F.least(n - 1, F.floor(F.pmod(lon, F.lit(360.0)) * n / 360))


def own_cells(df: DataFrame, radius: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with the band and cell of each position, for ranges up to ``radius`` degrees."""
    band, cell = _own_cell(F.col(lon), F.col(lat), _slack(radius))
    return df.withColumn("__band", band).withColumn("__cell", cell)


def reach_cells(df: DataFrame, radius: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` once for each band and cell that a circle of ``radius`` degrees around a position can touch."""
    slack = _slack(radius)
    own = F.floor((F.col(lat) + 90) / slack)
    df = df.withColumn("__band", F.explode(F.sequence(own - 1, own + 1)))
    n = _cells(F.col("__band"), slack)
    ratio = F.sin(F.radians(F.lit(slack))) / F.cos(F.radians(F.col(lat)))
    reach = F.when((F.abs(F.col(lat)) + slack >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))))
    low = F.floor((F.pmod(F.col(lon), F.lit(360.0)) - reach) * n / 360)
    high = F.floor((F.pmod(F.col(lon), F.lit(360.0)) + reach) * n / 360)
    return df.withColumn("__cell", F.explode(F.transform(F.sequence(low, F.least(high, low + n - 1)), lambda c: F.pmod(c, n))))


def _slack(radius: float) -> float:
    return radius * (1 + 1e-9) + 1e-12


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within ``radius`` degrees of what ``own_cells`` and ``reach_cells`` give for tables with columns a_* and b_*."""
    pairs = large_join(left, right, [*keys, "__band", "__cell"]).drop("__band", "__cell")
    sep = haversine("a_lon", "b_lon", "a_lat", "b_lat")
    return pairs.withColumn("sep", sep * 3600).where(F.col("sep") <= radius * 3600)


def sided(df: DataFrame, side: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``side`` before the names of all columns but ``keys``."""
    return df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys))


def radius_join(a: DataFrame, b: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within ``radius`` degrees of tables with id, lon, lat: columns a_*, b_*, ``keys`` and sep (arcseconds)."""
    return near_pairs(own_cells(sided(a, "a", keys), radius, "a_lon", "a_lat"), reach_cells(sided(b, "b", keys), radius, "b_lon", "b_lat"), radius, keys)


def local_density(cat: DataFrame, radius: float, mag: str | None = None, between: tuple[float, float] = (-math.inf, math.inf), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, n, density): sources of the same catalogue, itself too, within a circle, a square degree."""
    others = cat if mag is None else cat.where((F.col(mag) >= between[0]) & (F.col(mag) <= between[1]))
    pairs = radius_join(cat.select(*keys, "id", "lon", "lat"), others.select(*keys, "id", "lon", "lat"), radius, keys)
    counts = pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.count("*").alias("n"))
    area = 2 * math.pi * (1 - math.cos(math.radians(radius))) * math.degrees(1) ** 2
    out = large_join(cat.select(*keys, "id"), counts, [*keys, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("density", F.col("n") / area)


def nearest_point(sources: DataFrame, points: list[tuple[int, float, float]]) -> DataFrame:
    """``sources`` with the nearest of a few points (pt, lon, lat), which are constants of the plan; ties go to the first."""
    options = [F.struct(haversine("lon", F.lit(lon), "lat", F.lit(lat)).alias("dist"), F.lit(place).alias("place"), F.lit(pt).alias("pt")) for place, (pt, lon, lat) in enumerate(points)]
    best = F.array_min(F.array(*options))
    return sources.withColumn("pt", best["pt"]).withColumn("pt_dist", best["dist"])


def mutual_nn(a: DataFrame, b: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, sep): pairs of which each is the other's nearest, within ``radius`` degrees."""
    pairs = radius_join(a.select(*keys, "id", "lon", "lat"), b.select(*keys, "id", "lon", "lat"), radius, keys).select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sep")
    best_b = pairs.groupBy(*keys, "a").agg(F.min(F.struct("sep", "b")).alias("m")).select(*keys, "a", F.col("m.b").alias("b"), F.col("m.sep").alias("sep"))
    best_a = pairs.groupBy(*keys, "b").agg(F.min(F.struct("sep", "a")).alias("m")).select(*keys, F.col("m.a").alias("a"), "b")
    return large_join(best_b, best_a, [*keys, "a", "b"])


def nearest_cell(sources: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Each source (id, logn, mag) with the simulation cell (nm, cell_logn, cell_mag) of its group nearest in both; ties go to the least nm.

    A group's cells are one array in order of density, and a source looks at those whose density
    alone is not farther than the nearest that a first look, at the cells around its place, has found.
    """
    rows = F.array_sort(F.collect_list(F.struct("cell_logn", "cell_mag", "nm")))
    arrays = cells.groupBy(*by).agg(rows.alias("__cells"), F.array_sort(F.collect_list("cell_logn")).alias("__logs"))  # the few cells of a group
    far = lambda c: (F.col("logn") - c["cell_logn"]) * (F.col("logn") - c["cell_logn"]) + (F.col("mag") - c["cell_mag"]) * (F.col("mag") - c["cell_mag"])
    least = lambda some: F.array_min(F.transform(some, lambda c: F.struct(far(c).alias("d"), c["nm"].alias("nm"))))
    at = sources.join(arrays, by).withColumn("__at", F.size(F.filter("__logs", lambda x: x < F.col("logn"))))
    first = least(F.slice("__cells", F.greatest(F.lit(1), F.col("__at") - 2), F.lit(6)))["d"]
    near = lambda d: F.filter("__cells", lambda c: (F.col("logn") - c["cell_logn"]) * (F.col("logn") - c["cell_logn"]) <= d)
    best = at.withColumn("__best", F.transform(F.array(first), lambda d: least(near(d)))[0])  # the first look is evaluated once, not for each cell
    return best.select(*by, "id", F.col("__best.nm").alias("nm"), F.col("__best.d").alias("d"))
