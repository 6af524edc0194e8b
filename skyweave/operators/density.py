"""Local densities of sources with the area that was really observed.

A source's density is the number of sources in a circle around it over the circle's area
inside the hull of its chunk: empty sky inside counts as area, sky outside does not. Where
the surroundings are sparse the circle is counted exactly, by a range join; where they are
dense, sources are first counted in small cells, and the cells around a cell are added up,
so the work follows the occupied cells and never the pairs of sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .regions import inside, shifted
from .spatial import large_join, radius_join, small_join

#: Cells of a radius, and sources in the nine cells of a radius around a source from which on they are counted by cell.
GRID = 8
DENSE = 500
#: No cell is wider than if it were this near to a pole (the cosine of its latitude).
POLE = 1e-3


def circle_inside(lon: Column, lat: Column, radius: float, corners: Column) -> Column:
    """The share of a small circle that is inside a convex hull (anticlockwise ``corners`` x, y), by a sum over the hull's edges.

    Each edge and the centre make a triangle; what it has in common with the circle is a
    triangle where the edge is inside and a sector where it is outside, both signed.
    """
    flat = F.greatest(F.cos(F.radians(lat)), F.lit(POLE))
    place = lambda c: F.struct(((c["x"] - lon) * flat / radius).alias("x"), ((c["y"] - lat) / radius).alias("y"))
    cross = lambda p, q: p["x"] * q["y"] - p["y"] * q["x"]
    dot = lambda p, q: p["x"] * q["x"] + p["y"] * q["y"]
    sector = lambda p, q: F.atan2(cross(p, q), dot(p, q)) / 2
    along = lambda e, t: F.struct((e["p"]["x"] + t * e["d"]["x"]).alias("x"), (e["p"]["y"] + t * e["d"]["y"]).alias("y"))

    def edge(p: Column, q: Column) -> Column:
        d = F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y"))
        return F.struct(p.alias("p"), q.alias("q"), d.alias("d"))

    def crossing(e: Column) -> Column:
        """Where along the edge the circle is entered and left: roots of a t^2 + 2 b t + c."""
        a, b, c = dot(e["d"], e["d"]), dot(e["p"], e["d"]), dot(e["p"], e["p"]) - 1
        return F.struct(e["p"].alias("p"), e["q"].alias("q"), e["d"].alias("d"), a.alias("a"), b.alias("b"), (b * b - a * c).alias("r"))

    def met(e: Column) -> Column:
        root = F.sqrt(F.greatest(e["r"], F.lit(0.0)))
        first, last = F.greatest(F.lit(0.0), (-e["b"] - root) / e["a"]), F.least(F.lit(1.0), (-e["b"] + root) / e["a"])
        hit = (e["a"] > 0) & (e["r"] > 0) & (first < last)
        return F.struct(e["p"].alias("p"), e["q"].alias("q"), hit.alias("hit"), along(e, first).alias("u"), along(e, last).alias("v"))

    def part(e: Column) -> Column:
        return F.when(e["hit"], sector(e["p"], e["u"]) + cross(e["u"], e["v"]) / 2 + sector(e["v"], e["q"])).otherwise(sector(e["p"], e["q"]))

    def measured(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
        steps = F.transform(F.transform(F.zip_with(ring, after, edge), crossing), met)
        return F.aggregate(steps, F.lit(0.0), lambda s, e: s + part(e)) / math.pi

    total = F.transform(F.array(F.transform(corners, place)), measured)[0]  # each step evaluated once
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def share_inside(lon: Column, lat: Column, radius: float, shift: Column, corners: Column, core: Column) -> Column:
    """The same for a hull of ``regions.hulls``: whole circles, whose square is inside, are not measured; without a hull all are whole."""
    x = shifted(lon, shift)
    dx = radius / F.greatest(F.cos(F.radians(lat)), F.lit(POLE))
    whole = [inside(x + sx * dx, lat + sy * radius, corners, core) for sx, sy in ((-1, -1), (-1, 1), (1, -1), (1, 1))]
    return F.when(corners.isNull() | (whole[0] & whole[1] & whole[2] & whole[3]), F.lit(1.0)).otherwise(circle_inside(x, lat, radius, corners))


def circle_area(radius: float) -> float:
    """Square degrees of a circle on the sphere."""
    return 2 * math.pi * (1 - math.cos(math.radians(radius))) * math.degrees(1) ** 2


def celled(sources: DataFrame, size: float) -> DataFrame:
    """``sources`` (lon, lat) with the row and col of their cell of ``size`` degrees; a whole number of cells go around."""
    row = F.floor((F.col("lat") + 90) / size)
    return sources.withColumn("row", row).withColumn("col", F.least(_around(F.col("row"), size) - 1, F.floor(F.pmod("lon", F.lit(360.0)) / 360 * _around(F.col("row"), size))))


def _middle(row: Column, size: float) -> Column:
    return (row + 0.5) * size - 90


def _around(row: Column, size: float) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(360 * F.cos(F.radians(_middle(row, size))) / size))


def neighbours(cells: DataFrame, size: float, radius: float) -> DataFrame:
    """``cells`` (row, col and others) once for each cell (near_row, near_col, x, y) of whose middle is within ``radius`` of theirs, empty or not."""
    reach = math.ceil(radius / size)
    near = cells.withColumn("near_row", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)))
    near = near.withColumn("y", _middle(F.col("near_row"), size)).where(F.abs("y") < 90)
    up = F.col("y") - _middle(F.col("row"), size)
    chord = F.sqrt(F.greatest(F.lit(radius**2) - up * up, F.lit(0.0))) / F.greatest(F.cos(F.radians("y")), F.lit(POLE))
    around, middle = _around(F.col("near_row"), size), (F.col("col") + 0.5) * 360 / _around(F.col("row"), size)
    first = F.ceil((middle - chord) * around / 360 - 0.5)
    last = F.least(F.floor((middle + chord) * around / 360 - 0.5), first + around - 1)
    near = near.where(F.abs(up) <= radius).withColumns({"__a": around, "__i": first, "__j": last}).where("__i <= __j").withColumn("__c", F.explode(F.sequence("__i", "__j")))
    return near.withColumns({"near_col": F.pmod("__c", "__a"), "x": (F.col("__c") + 0.5) * 360 / F.col("__a"), "width": F.lit(360.0) / F.col("__a")}).drop("__a", "__i", "__j", "__c")


def local_densities(points: DataFrame, others: DataFrame, radius: float, by: tuple[str, ...] = (), hulls: DataFrame | None = None, hull_by: tuple[str, ...] = (), dense: int = DENSE, grid: int = GRID) -> DataFrame:
    """(by, id, n, density): ``others`` within ``radius`` degrees of each of ``points`` (by, id, lon, lat), a square degree of hull.

    ``hulls`` (hull_by, shift, corners) has a row for each chunk; without, all sky counts. In
    dense surroundings ``n`` is that of the cells whose middle is within the radius of the
    middle of the source's cell. Sources whose circle has no sky in the hull have no density.
    """
    k = list(by)
    others = others.select(*k, "id", "lon", "lat")
    coarse = celled(others, radius).groupBy(*k, "row", "col").agg(F.count("*").alias("n"))
    mine = celled(points.select(*k, "id", "lon", "lat"), radius)
    beside = neighbours(mine.select(*k, "row", "col").distinct(), radius, 1.6 * radius).drop("x", "y", "width")
    near = coarse.select(*k, F.col("row").alias("near_row"), F.col("col").alias("near_col"), "n")
    counts = large_join(beside, near, [*k, "near_row", "near_col"]).groupBy(*k, "row", "col").agg(F.sum("n").alias("__around"))
    marked = large_join(mine, counts, [*k, "row", "col"], "left").withColumn("__dense", F.coalesce(F.col("__around") > dense, F.lit(False))).drop("row", "col", "__around")
    marked = written(marked, "surroundings")

    with_hull = lambda df: small_join(df, hulls.select(*hull_by, "shift", "corners", "core"), list(hull_by), "left") if hulls is not None else df.withColumns({"shift": F.lit(0.0), "corners": F.lit(None).cast("array<struct<x:double,y:double>>"), "core": F.lit(None).cast("struct<low:double,step:double,lo:array<double>,hi:array<double>>")})
    sparse = marked.where("not __dense").drop("__dense")
    pairs = radius_join(sparse, others, radius, by).groupBy(*k, F.col("a_id").alias("id")).agg(F.count("*").alias("n"))
    exact = with_hull(large_join(sparse, pairs, [*k, "id"], "left")).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    exact = exact.withColumn("__area", circle_area(radius) * share_inside(F.col("lon"), F.col("lat"), radius, F.col("shift"), F.col("corners"), F.col("core"))).select(*k, "id", "n", "__area")

    size = radius / grid
    fine = celled(marked.where("__dense").drop("__dense"), size)
    small = celled(others, size).groupBy(*k, F.col("row").alias("near_row"), F.col("col").alias("near_col")).agg(F.count("*").alias("__n"))
    middle = (F.col("col") + 0.5) * 360 / _around(F.col("row"), size)
    rim = share_inside(middle, _middle(F.col("row"), size), radius + size, F.col("shift"), F.col("corners"), F.col("core"))
    at_rim = lambda c: F.when(F.col("__rim") != 1, F.col(c)).alias(c)  # noqa: E731  other cells do not take the hull along
    spread = neighbours(with_hull(fine.select(*k, "row", "col").distinct()).withColumn("__rim", rim).select(*k, "row", "col", "__rim", "shift", at_rim("corners"), at_rim("core")), size, radius)
    quarter = [inside(shifted(F.pmod(F.col("x") + sx * F.col("width") / 4, F.lit(360.0)), F.col("shift")), F.col("y") + sy * size / 4, F.col("corners"), F.col("core")).cast("double") for sx in (-1, 1) for sy in (-1, 1)]
    spread = spread.withColumn("__share", F.when(F.col("__rim") == 1, F.lit(1.0)).otherwise((quarter[0] + quarter[1] + quarter[2] + quarter[3]) / 4))
    spread = spread.withColumn("__area", F.col("__share") * F.col("width") * size * F.cos(F.radians("y")))
    summed = large_join(spread, small, [*k, "near_row", "near_col"], "left").groupBy(*k, "row", "col").agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n"), F.sum("__area").alias("__area"))
    by_cell = large_join(fine, summed, [*k, "row", "col"]).select(*k, "id", "n", "__area")
    return exact.unionByName(by_cell).withColumn("density", F.when(F.col("__area") > 0, F.col("n") / F.col("__area"))).drop("__area")
