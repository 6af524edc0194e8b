"""The queries that the repository answers, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..operators import islands as isl
from ..operators import regions, spatial
from ..sources import catalog
from ..sources.fixtures import CAT_SQL, EDGE_SQL, FIELD_SQL, HAV, ISLAND_SQL, NORTH_SQL, cat_a, cat_b, north, with_sql
from .match import CrossMatch, core_matches, core_nonmatches
from .storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

RADIUS, MOST = 2.92, 0.999
#: Constants of the plan: a hull, reference points and a slice.
HULL = [(130.95, -0.06), (131.05, -0.07), (131.09, 0.0), (131.06, 0.08), (130.94, 0.05)]
POINTS = [(0, 130.97, -0.03), (1, 131.03, -0.03), (2, 130.97, 0.03), (3, 131.03, 0.03)]
SLICE = (130.96, 131.02, -0.02, 0.04, 0.005)
SIX = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, SIX).alias(name)


def match_of(spark: SparkSession, sf_dir: str) -> CrossMatch:
    return CrossMatch(cat_a(spark, sf_dir), cat_b(spark, sf_dir), RADIUS, MOST)


def north_of(spark: SparkSession, sf_dir: str) -> CrossMatch:
    """The same at latitude 60, across longitude zero."""
    return CrossMatch(north(cat_a(spark, sf_dir)), north(cat_b(spark, sf_dir)), RADIUS, MOST)


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isl.overlap_pairs(cat_a(spark, sf_dir), cat_b(spark, sf_dir), RADIUS, MOST)


# Sources and functions of one row ---------------------------------------------------------


@query(with_sql("SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, sig, round(CASE WHEN best = 0 THEN mag1 ELSE mag2 END, 6) AS mag, halo FROM cat_a"))
def scan_catalogue(spark, sf_dir):
    """A catalogue as text files and back, with the magnitude of its best band."""
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    cat_a(spark, sf_dir).select("id", "lon", "lat", "sig", "mag1", "mag2", "best", "halo").write.csv(path)
    back = catalog.read_csv(spark, path, catalog.Layout((1, 2, 3), (4, 5), 6, 7, id=0))
    return back.select("id", r6("lon", "lon"), r6("lat", "lat"), "sig", r6(F.element_at("mags", F.col("best") + 1), "mag"), "halo")


@query(with_sql(f"SELECT x.id, round({HAV}, 6) AS dist FROM cat_a x JOIN cat_b y ON x.id = y.id"))
def haversine(spark, sf_dir):
    a, b = cat_a(spark, sf_dir).select("id", "lon", "lat"), cat_b(spark, sf_dir).select("id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return spatial.large_join(a, b, "id").select("id", r6(sky.haversine("lon", "lon2", "lat", "lat2"), "dist"))


@query(with_sql(f"""SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM cat_a x WHERE
  (((lon + {180 - (SLICE[0] + SLICE[1]) / 2}) % 360 <= {(SLICE[1] + 180 - (SLICE[0] + SLICE[1]) / 2) % 360} + 1e-6) OR (SELECT {HAV} FROM (SELECT {SLICE[1]}::DOUBLE AS lon, x.lat AS lat) y) <= {SLICE[4]})
  AND (((lon + {180 - (SLICE[0] + SLICE[1]) / 2}) % 360 >= {(SLICE[0] + 180 - (SLICE[0] + SLICE[1]) / 2) % 360} - 1e-6) OR (SELECT {HAV} FROM (SELECT {SLICE[0]}::DOUBLE AS lon, x.lat AS lat) y) <= {SLICE[4]})
  AND lat <= {SLICE[3]} + {SLICE[4]} + 1e-6 AND lat >= {SLICE[2]} - {SLICE[4]} - 1e-6"""))
def rect_slice(spark, sf_dir):
    return cat_a(spark, sf_dir).where(sky.rect_slice("lon", "lat", *SLICE)).select("id", r6("lon", "lon"), r6("lat", "lat"))


def _winding_sql(x: str, y: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(HULL, HULL[1:] + HULL[:1], strict=True):
        a, b, c, d = f"({x1} - {x})", f"({y1} - {y})", f"({x2} - {x})", f"({y2} - {y})"
        parts.append(f"atan2({a} * {d} - {b} * {c}, {a} * {c} + {b} * {d})")
    return " + ".join(parts)


@query(with_sql(f"SELECT id, abs({_winding_sql('lon', 'lat')}) >= pi() AS inside FROM cat_b"))
def in_hull(spark, sf_dir):
    return cat_b(spark, sf_dir).select("id", sky.in_hull("lon", "lat", HULL).alias("inside"))


_UNIT = "cos(radians({b})) * cos(radians({l})) AS x, cos(radians({b})) * sin(radians({l})) AS y, sin(radians({b})) AS z"


def _rotated_sql(matrix) -> str:
    row = lambda r: " + ".join(f"({m!r}) * {v}" for m, v in zip(r, "xyz", strict=True))
    return f"SELECT id, round((degrees(atan2({row(matrix[1])}, {row(matrix[0])})) + 360) % 360, 6) AS lon, round(degrees(asin(greatest(-1, least(1, {row(matrix[2])})))), 6) AS lat FROM (SELECT id, {_UNIT.format(l='lon', b='lat')} FROM cat_a)"


@query(with_sql(_rotated_sql(sky.TO_GALACTIC)))
def eq_to_gal(spark, sf_dir):
    lon, lat = sky.eq_to_gal("lon", "lat")
    return cat_a(spark, sf_dir).select("id", r6(lon, "lon"), r6(lat, "lat"))


@query(with_sql(_rotated_sql(tuple(zip(*sky.TO_GALACTIC, strict=True)))))
def gal_to_eq(spark, sf_dir):
    lon, lat = sky.gal_to_eq("lon", "lat")
    return cat_a(spark, sf_dir).select("id", r6(lon, "lon"), r6(lat, "lat"))


@query(with_sql("""SELECT id, round((degrees(atan2(my, mx)) + 360) % 360, 6) AS lon, round(degrees(asin(mz / sqrt(mx * mx + my * my + mz * mz))), 6) AS lat FROM (
  SELECT id, cos(b) * cos(l) + e * -sin(l) + n * -sin(b) * cos(l) AS mx, cos(b) * sin(l) + e * cos(l) + n * -sin(b) * sin(l) AS my, sin(b) + n * cos(b) AS mz FROM (
    SELECT id, radians(lon) AS l, radians(lat) AS b, radians((id % 11 - 5) * 2.5::DOUBLE / 3600) AS e, radians((id % 7 - 3) * 2.5::DOUBLE / 3600) AS n FROM cat_a))"""))
def apply_pm(spark, sf_dir):
    lon, lat = sky.apply_pm("lon", "lat", F.col("id") % 11 - 5, F.col("id") % 7 - 3, 2.5)
    return cat_a(spark, sf_dir).select("id", r6(lon, "lon"), r6(lat, "lat"))


_GAL = f"SELECT id, 1 + id % 9 AS d, {_UNIT.format(l='lon', b='(lat * 100)')} FROM cat_a"
_CYL = f"SELECT id, sqrt(power(d * x - {sky.SUN_RADIUS_KPC}, 2) + power(d * y, 2)) AS r, d * z AS zz FROM ({_GAL})"


@query(with_sql(f"SELECT id, round(r, 6) AS r_kpc, round(zz, 6) AS z_kpc FROM ({_CYL})"))
def galactocentric(spark, sf_dir):
    r, z = sky.galactocentric("lon", F.col("lat") * 100, 1 + F.col("id") % 9)
    return cat_a(spark, sf_dir).select("id", r6(r, "r_kpc"), r6(z, "z_kpc"))


_HALO = f"{sky.HALO_SHARE} * power(sqrt(r * r + power(zz / {sky.HALO_FLATTENING}, 2)) / {sky.SUN_RADIUS_KPC}, -{sky.HALO_POWER})"


@query(with_sql(f"""SELECT id, round(thin / (thin + thick + halo), 6) AS thin, round(thick / (thin + thick + halo), 6) AS thick, round(halo / (thin + thick + halo), 6) AS halo FROM (
  SELECT id, exp(({sky.SUN_RADIUS_KPC} - r) / 2.6 - abs(zz + 0.025) / 0.3) AS thin, 0.13 * exp(({sky.SUN_RADIUS_KPC} - r) / 3.6 - abs(zz + 0.025) / 0.9) AS thick,
    CASE WHEN r < {sky.SUN_RADIUS_KPC} THEN first_value({_HALO}) OVER (ORDER BY abs(r - {sky.SUN_RADIUS_KPC}), id) ELSE {_HALO} END AS halo FROM ({_CYL}))"""))
def density_fractions(spark, sf_dir):
    """Shares of the Galaxy's components; the halo inside the Sun's circle is that of the source nearest to it."""
    r, z = sky.galactocentric("lon", F.col("lat") * 100, 1 + F.col("id") % 9)
    rows = cat_a(spark, sf_dir).select("id", r.alias("r"), z.alias("z")).withColumn("h", sky.halo("r", "z"))
    at_sun = rows.agg(F.min(F.struct(F.abs(F.col("r") - sky.SUN_RADIUS_KPC).alias("d"), "id", "h")).alias("m")).select(F.col("m.h").alias("h_sun"))  # one row
    rows = rows.join(F.broadcast(at_sun)).withColumn("halo", F.when(F.col("r") < sky.SUN_RADIUS_KPC, F.col("h_sun")).otherwise(F.col("h")))
    rows = rows.withColumn("thin", sky.disc("r", "z", *sky.THIN)).withColumn("thick", sky.THICK_SHARE * sky.disc("r", "z", *sky.THICK))
    total = F.col("thin") + F.col("thick") + F.col("halo")
    return rows.select("id", *(r6(F.col(c) / total, c) for c in ("thin", "thick", "halo")))


@query(with_sql("""SELECT id, round(1.94553 * c + 11.33138, 6) AS oort_a, round(-2.63360 * c - 13.60611, 6) AS oort_b FROM (
  SELECT id, CASE WHEN t < 10000 THEN 5.07836 * exp(-0.27083 * t / 1000) - 0.40739 ELSE 0.69012 * exp(-0.08179 * t / 1000) - 0.35093 END AS c FROM (SELECT id, 3000 + (id * 37) % 17000 AS t FROM cat_a))"""))
def oort(spark, sf_dir):
    a, b = sky.oort(3000 + F.col("id") * 37 % 17000)
    return cat_a(spark, sf_dir).select("id", r6(a, "oort_a"), r6(b, "oort_b"))


@query(with_sql("""SELECT id, round(ln(0.4 * ln(10) * 0.0094 * power(10, 0.4 * 0.5 * z) * power(10, -0.4 * (m + 20.7 + 0.9 * z) * (-0.7 + 1)) * exp(-power(10, -0.4 * (m + 20.7 + 0.9 * z)))), 6) AS ln_phi
  FROM (SELECT id, -24 + (id % 90) / 10.0::DOUBLE AS m, (id % 8) / 4.0::DOUBLE AS z FROM cat_a)"""))
def schechter(spark, sf_dir):
    mag, z = -24 + F.col("id") % 90 / 10.0, F.col("id") % 8 / 4.0
    return cat_a(spark, sf_dir).select("id", r6(F.log(sky.schechter(mag, z, 0.0094, -20.7, -0.7, 0.5, 0.9)), "ln_phi"))


@query(with_sql("SELECT id, round(1 - sqrt(1 - power(least(1, (5 + id % 300) / 250.0::DOUBLE), 2)), 6) AS h FROM cat_a"))
def blend_weight(spark, sf_dir):
    return cat_a(spark, sf_dir).select("id", r6(sky.blend_weight((5 + F.col("id") % 300).cast("double"), 250.0), "h"))


@query(with_sql("SELECT id, pt, round(sqrt(power(m * sig, 2) + n * n), 6) AS sig FROM (SELECT id, sig, pt, 1 + 0.1 * pt AS m, 0.01 * pt AS n FROM (SELECT x.id, x.sig, y.pt, row_number() OVER (PARTITION BY x.id ORDER BY "
    + f"{HAV}, y.pt) AS r FROM cat_a x, (VALUES {', '.join(f'({p}, {lon}::DOUBLE, {lat}::DOUBLE)' for p, lon, lat in POINTS)}) y(pt, lon, lat)) WHERE r = 1)"))
def rescale_sigma(spark, sf_dir):
    """Uncertainties corrected by the terms of the nearest reference point."""
    near = spatial.nearest_point(cat_a(spark, sf_dir), POINTS)
    return near.select("id", F.col("pt").cast("int").alias("pt"), r6(sky.rescaled_sigma("sig", 1 + 0.1 * F.col("pt"), 0.01 * F.col("pt")), "sig"))


@query(with_sql("SELECT round(lo + i * ((hi - lo) / 4), 6) AS lon, round(la + j * ((lb - la) / 4), 6) AS lat FROM (SELECT min(lon) AS lo, max(lon) AS hi, min(lat) AS la, max(lat) AS lb FROM cat_a), range(0, 5) t(i), range(0, 5) u(j)"))
def region_grid(spark, sf_dir):
    """Points of a regular grid over the rectangle that a catalogue covers."""
    from ..sources.catalog import region_points

    lon1, lon2, lat1, lat2 = cat_a(spark, sf_dir).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).head()
    return region_points(spark, "rectangle", [lon1, lon2, 5, lat1, lat2, 5]).select(r6("lon", "lon"), r6("lat", "lat"))


# Joins ------------------------------------------------------------------------------------

@query(with_sql(f"SELECT a, b, round(sep, 6) AS sep FROM pair WHERE sep <= {RADIUS}", EDGE_SQL))
def stored_join(spark, sf_dir):
    """The radius join of catalogues that are stored in the order of the sky."""
    from ..sources.skystore import stored

    a, b = (stored(cat.select("id", "lon", "lat"), RADIUS / 3600, buckets=8) for cat in (cat_a(spark, sf_dir), cat_b(spark, sf_dir)))
    return a.join(b).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), r6("sep", "sep"))


@query(with_sql("SELECT id FROM cat_b WHERE lon BETWEEN 130.96 AND 131.02 AND lat BETWEEN -0.02 AND 0.04"))
def stored_slice(spark, sf_dir):
    """A rectangle of a catalogue that is stored in the order of the sky."""
    from ..sources.skystore import stored

    return stored(cat_b(spark, sf_dir), RADIUS / 3600, buckets=8).slice(130.96, 131.02, -0.02, 0.04).select("id")


@query(with_sql(f"SELECT a, b, round(sep, 6) AS sep FROM pair WHERE sep <= {RADIUS}", EDGE_SQL))
def radius_join(spark, sf_dir):
    pairs = spatial.radius_join(cat_a(spark, sf_dir).select("id", "lon", "lat"), cat_b(spark, sf_dir).select("id", "lon", "lat"), RADIUS / 3600)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), r6("sep", "sep"))


@query(with_sql("SELECT a, b, round(sep, 6) AS sep, round(cdf, 6) AS cdf FROM edge", EDGE_SQL))
def overlap_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("a", "b", r6("sep", "sep"), r6("cdf", "cdf"))


@query(with_sql("SELECT a, b, round(exp(-sep * sep / 0.68) / (pi() * 0.68) * 3600 * 3600, 3) AS g FROM edge", EDGE_SQL))
def pair_density(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("a", "b", F.round(sky.pair_density("sep", "sig_a", "sig_b"), 3).alias("g"))


@query(with_sql("SELECT id, round(1 - exp(-power(0.1 * (id % 40), 2) / (2 * 0.34)), 6) AS cdf FROM cat_a"))
def auf_cdf(spark, sf_dir):
    return cat_a(spark, sf_dir).select("id", r6(sky.auf_cdf(0.1 * (F.col("id") % 40), "sig", 0.5), "cdf"))


@query(with_sql("SELECT id, round(sqrt(-2 * 0.34 * ln(1 - 0.63)), 6) AS r63, round(sqrt(-2 * 0.34 * ln(1 - 0.9)), 6) AS r90 FROM cat_a"))
def auf_radius(spark, sf_dir):
    return cat_a(spark, sf_dir).select("id", r6(sky.auf_radius(0.63, "sig", 0.5), "r63"), r6(sky.auf_radius(0.9, "sig", 0.5), "r90"))


@query(with_sql("SELECT id, n FROM (SELECT x.id, count(e.a) AS n FROM cat_a x LEFT JOIN edge e ON e.a = x.id GROUP BY x.id)", EDGE_SQL))
def overlap_counts(spark, sf_dir):
    return isl.overlap_counts(cat_a(spark, sf_dir), pairs_of(spark, sf_dir), "a")


@query(with_sql("SELECT id, round(coalesce(pi() * power(r, 2), 0) * 1e6, 6) AS area FROM (SELECT x.id, avg(CASE WHEN e.a IS NOT NULL THEN sqrt(-2 * ln(1 - 0.9) * 0.34) / 3600 END) AS r FROM cat_a x LEFT JOIN edge e ON e.a = x.id GROUP BY x.id)", EDGE_SQL))
def integral_area(spark, sf_dir):
    """In millionths of a square degree."""
    return isl.integral_area(cat_a(spark, sf_dir), pairs_of(spark, sf_dir), "a", 0.9).select("id", r6(F.col("area") * 1e6, "area"))


@query(with_sql(f"SELECT id, pt, round(d, 6) AS dist FROM (SELECT x.id, y.pt, {HAV} AS d, row_number() OVER (PARTITION BY x.id ORDER BY {HAV}, y.pt) AS r FROM cat_b x, (VALUES {', '.join(f'({p}, {lon}::DOUBLE, {lat}::DOUBLE)' for p, lon, lat in POINTS)}) y(pt, lon, lat)) WHERE r = 1"))
def nearest_point(spark, sf_dir):
    return spatial.nearest_point(cat_b(spark, sf_dir), POINTS).select("id", F.col("pt").cast("int").alias("pt"), r6("pt_dist", "dist"))


@query(with_sql(f"SELECT p.a, p.b, round(p.sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sep, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY sep, a) AS rb FROM pair WHERE sep <= {RADIUS}) p WHERE ra = 1 AND rb = 1", EDGE_SQL))
def mutual_nn(spark, sf_dir):
    return spatial.mutual_nn(cat_a(spark, sf_dir), cat_b(spark, sf_dir), RADIUS / 3600).select("a", "b", r6("sep", "sep"))


@query(with_sql(f"SELECT x.id, count(*) AS n, round(count(*) / (2 * pi() * (1 - cos(radians(0.01))) * power(degrees(1), 2)), 3) AS density FROM cat_b x JOIN cat_b y ON y.lat BETWEEN x.lat - 0.0101 AND x.lat + 0.0101 AND abs(y.lon - x.lon) < 0.0102 WHERE {HAV} <= 0.01 GROUP BY x.id"))
def local_density(spark, sf_dir):
    out = spatial.local_density(cat_b(spark, sf_dir), 0.01)
    return out.select("id", "n", F.round("density", 3).alias("density"))


_CELLS = "SELECT CAST(i AS BIGINT) AS nm, i % 2 AS filt, 7 + 0.5::DOUBLE * (i % 8) AS cell_logn, 10 + 0.6::DOUBLE * (i // 8) AS cell_mag FROM range(0, 64) t(i)"


@query(with_sql(f"SELECT id, arg_min(nm, (dist, nm)) AS nm, round(min(dist), 6) AS d FROM (SELECT x.id, c.nm, power(8 + (x.id % 30) / 10.0::DOUBLE - c.cell_logn, 2) + power(x.mag2 - c.cell_mag, 2) AS dist FROM cat_a x JOIN ({_CELLS}) c ON c.filt = x.best) GROUP BY id"))
def nearest_sim_cell(spark, sf_dir):
    """The simulation cell nearest in density and magnitude, in the same filter."""
    i = F.col("id")
    cells = spark.range(64).select(i.alias("nm"), (i % 2).cast("int").alias("filt"), (7 + 0.5 * (i % 8)).alias("cell_logn"), (10 + 0.6 * F.floor(i / 8)).alias("cell_mag"))
    sources = cat_a(spark, sf_dir).select("id", F.col("best").alias("filt"), (8 + i % 30 / 10.0).alias("logn"), F.col("mag2").alias("mag"))
    return spatial.nearest_cell(sources, cells, ["filt"]).select("id", "nm", r6("d", "d"))


# Islands ----------------------------------------------------------------------------------

MEMBER_SQL = """
mem AS (SELECT 'a' AS side, id, coalesce(island, 2 * id) AS island FROM cat_a LEFT JOIN comp ON v = 2 * id UNION ALL SELECT 'b', id, coalesce(island, 2 * id + 1) FROM cat_b LEFT JOIN comp ON v = 2 * id + 1),
sz AS (SELECT island, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM mem GROUP BY island)"""
ISLANDS = (EDGE_SQL, ISLAND_SQL, MEMBER_SQL)


@query(with_sql("SELECT v AS vertex, island FROM comp", EDGE_SQL, ISLAND_SQL))
def islands(spark, sf_dir):
    return match_of(spark, sf_dir).components


@query(with_sql("SELECT island, n_a, n_b FROM sz", *ISLANDS))
def island_sizes(spark, sf_dir):
    return isl.island_sizes(match_of(spark, sf_dir).all_members)


@query(with_sql("SELECT n_a, n_b, 1 + n_a * n_b + n_a * (n_a - 1) / 2 * n_b * (n_b - 1) AS ways, greatest(n_a, n_b) <= 20 AS keep, count(*) AS islands FROM sz GROUP BY n_a, n_b", *ISLANDS))
def island_size_gate(spark, sf_dir):
    out = isl.size_gate(isl.island_sizes(match_of(spark, sf_dir).all_members)).groupBy("n_a", "n_b", "keep").agg(F.count("*").alias("islands"))
    return out.select("n_a", "n_b", F.when(F.least("n_a", "n_b") == 0, F.lit(1.0)).otherwise(sky.matchings("n_a", "n_b")).alias("ways"), "keep", "islands")


#: Sources of whose circle, larger by a constant of the plan, no more than 0.9 is in the hull of their own catalogue, of a hundred points of a sunflower.
_EDGE_R = RADIUS / 3600 * regions.inflation()
EDGE_REJECT_SQL = f"""
flower AS (SELECT i, {_EDGE_R!r} * sqrt((i - 0.5) / 99.5) * cos(2 * pi() * i / power((1 + sqrt(5)) / 2, 2)) AS dx, {_EDGE_R!r} * sqrt((i - 0.5) / 99.5) * sin(2 * pi() * i / power((1 + sqrt(5)) / 2, 2)) AS dy FROM range(1, 101) t(i)),
rimmed AS (SELECT p.side, p.id, p.x, p.y FROM pts p WHERE EXISTS (SELECT 1 FROM edg e WHERE e.side = p.side AND ((e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1)) / sqrt(power(e.x2 - e.x1, 2) + power(e.y2 - e.y1, 2)) < 0.01)),
lost AS (SELECT side, id FROM (SELECT r.side, r.id, i, bool_and((e.x2 - e.x1) * (r.y + dy - e.y1) - (e.y2 - e.y1) * (r.x + dx / cos(radians(r.y)) - e.x1) >= -1e-12) AS inside FROM rimmed r, flower JOIN edg e ON e.side = r.side GROUP BY r.side, r.id, i) GROUP BY side, id HAVING count(*) FILTER (inside) <= 90)"""


def _edge_reject_sql(cats: str = CAT_SQL) -> str:
    return with_sql("SELECT side, id, island FROM mem WHERE island NOT IN (SELECT island FROM mem JOIN lost USING (side, id))", *ISLANDS, FIELD_SQL, EDGE_REJECT_SQL, cats=cats)


def _away_from_edges(m: CrossMatch) -> DataFrame:
    near = [regions.near_edge(cat, RADIUS, ()).select(F.lit(side).alias("side"), "id") for side, cat in (("a", m.a), ("b", m.b))]
    return isl.edge_reject(m.all_members, near[0].unionByName(near[1]))[0].select("side", "id", "island")


@query(_edge_reject_sql())
def edge_reject(spark, sf_dir):
    """Islands without a source whose circle leaves its catalogue's hull."""
    return _away_from_edges(match_of(spark, sf_dir))


@query(_edge_reject_sql(NORTH_SQL))
def edge_reject_north(spark, sf_dir):
    return _away_from_edges(north_of(spark, sf_dir))


# Matches ----------------------------------------------------------------------------------

MATCH_SQL = """
pa AS (SELECT x.best, x.d - least(x.d, y.d) / 2 + 1e-10 AS n FROM da x JOIN db y ON y.best = 0),
pb AS (SELECT x.best, x.d - least(x.d, y.d) / 2 + 1e-10 AS n FROM db x JOIN da y ON y.best = 0),
pc AS (SELECT x.best AS ba, y.best AS bb, least(x.d, y.d) / 2 + 1e-100 AS nc FROM da x, db y),
grid AS (SELECT ma.island, x.id AS a, y.id AS b, HAV * 3600 AS sep, pa.n AS fa, pb.n AS fb, pc.nc AS nc FROM mem ma JOIN cat_a x ON ma.side = 'a' AND ma.id = x.id JOIN mem mb ON mb.side = 'b' AND mb.island = ma.island JOIN cat_b y ON mb.id = y.id
  JOIN pa ON pa.best = x.best JOIN pb ON pb.best = y.best JOIN pc ON pc.ba = x.best AND pc.bb = y.best),
g2 AS (SELECT *, exp(-sep * sep / 0.68) / (pi() * 0.68) * 3600 * 3600 AS g FROM grid),
g3 AS (SELECT *, nc * g * power(1 - 1e-10, 2) / (fa * fb) AS ratio, log10(nc * g / (fa * fb)) AS xi, log10(power(1 - 1e-10, 2)) AS eta FROM g2),
base AS (SELECT s.island, exp((SELECT sum(ln(fa)) FROM (SELECT DISTINCT a, fa FROM g3 WHERE g3.island = s.island)) + (SELECT sum(ln(fb)) FROM (SELECT DISTINCT b, fb FROM g3 WHERE g3.island = s.island))) AS s FROM sz s WHERE n_a > 0 AND n_b > 0),
hyp AS (SELECT island, s + 1e-10 AS prob, CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS b1, CAST(NULL AS BIGINT) AS a2, CAST(NULL AS BIGINT) AS b2 FROM base UNION ALL SELECT island, s * ratio, a, b, NULL, NULL FROM base JOIN g3 USING (island)
  UNION ALL SELECT x.island, s * x.ratio * y.ratio, x.a, x.b, y.a, y.b FROM base JOIN g3 x USING (island) JOIN g3 y ON y.island = x.island AND x.a < y.a AND x.b <> y.b),
won AS (SELECT island, max(prob) / sum(prob) AS p, arg_max({'a1': a1, 'b1': b1, 'a2': a2, 'b2': b2}, prob) AS h FROM hyp GROUP BY island),
hit AS (SELECT island, h.a1 AS a, h.b1 AS b, p FROM won WHERE h.a1 IS NOT NULL UNION ALL SELECT island, h.a2, h.b2, p FROM won WHERE h.a2 IS NOT NULL),
res AS (SELECT hit.island, hit.a, hit.b, p AS match_p, sep, eta, xi FROM hit JOIN g3 USING (island, a, b)),
free AS (SELECT * FROM mem m WHERE NOT EXISTS (SELECT 1 FROM hit WHERE (m.side = 'a' AND hit.a = m.id) OR (m.side = 'b' AND hit.b = m.id))),
openp AS (SELECT g3.* FROM g3 JOIN free fa_ ON fa_.side = 'a' AND fa_.id = a JOIN free fb_ ON fb_.side = 'b' AND fb_.id = b),
nm AS (SELECT f.side, f.id, f.island, coalesce(won.p, 1) AS match_p, o.sep AS nnm_sep, o.eta AS nnm_eta, o.xi AS nnm_xi FROM free f LEFT JOIN won USING (island)
  LEFT JOIN (SELECT 'a' AS side, a AS id, arg_min({'sep': sep, 'eta': eta, 'xi': xi}, (sep, b)) AS o FROM openp GROUP BY a UNION ALL SELECT 'b', b, arg_min({'sep': sep, 'eta': eta, 'xi': xi}, (sep, a)) FROM openp GROUP BY b) n ON n.side = f.side AND n.id = f.id,
  LATERAL (SELECT n.o.sep AS sep, n.o.eta AS eta, n.o.xi AS xi) o)""".replace("HAV", HAV)
MATCHES = (*ISLANDS, FIELD_SQL, MATCH_SQL)


@query(with_sql("SELECT a, b, round(match_p, 6) AS match_p, round(sep, 6) AS separation, round(eta, 6) AS eta, round(xi, 6) AS xi FROM res", *MATCHES))
def match_output(spark, sf_dir):
    """The matches, with posterior, separation and likelihood ratios."""
    return match_of(spark, sf_dir).matches.select("a", "b", r6("match_p", "match_p"), r6("sep", "separation"), r6("eta", "eta"), r6("xi", "xi"))


@query(with_sql("SELECT a, b, round(match_p, 6) AS match_p, round(sep, 6) AS separation, round(eta, 6) AS eta, round(xi, 6) AS xi FROM res", *MATCHES, cats=NORTH_SQL))
def match_output_north(spark, sf_dir):
    """The matches of a field at latitude 60, across longitude zero."""
    return north_of(spark, sf_dir).matches.select("a", "b", r6("match_p", "match_p"), r6("sep", "separation"), r6("eta", "eta"), r6("xi", "xi"))


@query(with_sql("SELECT round(ar, 9) AS area, (SELECT count(*) FROM joint WHERE side = 'a') AS n_a, (SELECT count(*) FROM joint WHERE side = 'b') AS n_b FROM area", FIELD_SQL, cats=NORTH_SQL))
def joint_area_north(spark, sf_dir):
    """What both catalogues' hulls have in common, in square degrees, and the sources there."""
    m = north_of(spark, sf_dir)
    area = m.cells.select(F.round("area", 9).alias("area"))
    return functools.reduce(lambda x, y: x.join(F.broadcast(y)), [area, *(m.counted(c).agg(F.count("*").alias(n)) for c, n in ((m.a, "n_a"), (m.b, "n_b")))])  # one row each


@query(with_sql("SELECT side, id, round(match_p, 6) AS match_p, round(nnm_sep, 6) AS nnm_separation, round(nnm_xi, 6) AS nnm_xi FROM nm", *MATCHES))
def nonmatch_output(spark, sf_dir):
    return match_of(spark, sf_dir).nonmatches.select("side", "id", r6("match_p", "match_p"), r6("nnm_sep", "nnm_separation"), r6("nnm_xi", "nnm_xi"))


@query(with_sql("SELECT n_a, n_b, count(*) AS islands, count(*) FILTER (matched) AS matched, round(avg(p), 6) AS mean_p FROM (SELECT sz.n_a, sz.n_b, won.p, won.h.a1 IS NOT NULL AS matched FROM won JOIN sz USING (island)) GROUP BY n_a, n_b", *MATCHES))
def island_pair(spark, sf_dir):
    """Islands by size: how many have a match, and the mean posterior."""
    m = match_of(spark, sf_dir)
    found, evidence = m.decided
    out = spatial.large_join(spatial.large_join(evidence, m.sizes, "island"), found.select("island").distinct().withColumn("hit", F.lit(True)), "island", "left")
    return out.groupBy("n_a", "n_b").agg(F.count("*").alias("islands"), F.count("hit").alias("matched"), r6(F.avg("p"), "mean_p"))


@query(with_sql("SELECT res.a, res.b FROM res JOIN cat_a x ON x.id = res.a JOIN cat_b y ON y.id = res.b WHERE NOT x.halo OR NOT y.halo", *MATCHES))
def core_match(spark, sf_dir):
    return core_matches(match_of(spark, sf_dir).matches, cat_a(spark, sf_dir), cat_b(spark, sf_dir)).select("a", "b")


@query(with_sql("SELECT nm.side, nm.id FROM nm JOIN (SELECT 'a' AS side, id, halo FROM cat_a UNION ALL SELECT 'b', id, halo FROM cat_b) c USING (side, id) WHERE NOT halo", *MATCHES))
def core_nonmatch(spark, sf_dir):
    return core_nonmatches(match_of(spark, sf_dir).nonmatches, cat_a(spark, sf_dir), cat_b(spark, sf_dir))[0].select("side", "id")


@query(with_sql("SELECT nm.side, nm.id, 'halo' AS reason FROM nm JOIN (SELECT 'a' AS side, id, halo FROM cat_a UNION ALL SELECT 'b', id, halo FROM cat_b) c USING (side, id) WHERE halo", *MATCHES))
def rejects(spark, sf_dir):
    m = match_of(spark, sf_dir)
    halo = core_nonmatches(m.nonmatches, cat_a(spark, sf_dir), cat_b(spark, sf_dir))[1]
    return halo.unionByName(m.too_large.select("side", "id", F.lit("island size").alias("reason")))


@query(with_sql("SELECT (SELECT count(*) FROM cat_a) AS n_a, (SELECT count(*) FROM cat_b) AS n_b, (SELECT count(*) FROM res) AS matches, (SELECT count(*) FROM nm WHERE side = 'a') AS field_a, (SELECT count(*) FROM nm WHERE side = 'b') AS field_b, CAST(0 AS BIGINT) AS rejected", *MATCHES))
def accounting(spark, sf_dir):
    """Every source is in a match, in the field or rejected, once."""
    m = match_of(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    field = m.nonmatches.agg(*(F.count_if(F.col("side") == side).alias(f"field_{side}") for side in "ab"))  # both sides in one go
    parts = [count(m.a, "n_a"), count(m.b, "n_b"), count(m.matches, "matches"), field, count(m.too_large, "rejected")]
    return functools.reduce(lambda x, y: x.join(F.broadcast(y)), parts)  # one row each


@query(with_sql("SELECT round((SELECT count(*) FROM res) / (SELECT count(*) FROM cat_a)::DOUBLE, 6) AS share_a, round((SELECT count(*) FROM res) / (SELECT count(*) FROM cat_b)::DOUBLE, 6) AS share_b", *MATCHES))
def match_fraction(spark, sf_dir):
    return accounting(spark, sf_dir).select(r6(F.col("matches") / F.col("n_a"), "share_a"), r6(F.col("matches") / F.col("n_b"), "share_b"))
