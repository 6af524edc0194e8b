"""Two catalogues with planted counterparts, derived from the customer and part tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the field in degrees for each root of a source.
SIDE = 0.004


def _mod(key: Column, factor: int, plus: int, modulus: int) -> Column:
    return (key * factor + plus) % modulus


def _size(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def cat_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = _size(spark, sf_dir) ** 0.5 * SIDE
    key = F.col("c_custkey").cast("bigint")
    twin = key % 10 == 9
    place, off = F.when(twin, key - 1).otherwise(key), F.when(twin, 1).otherwise(0)
    shift = lambda factor: off * (_mod(key, factor, 0, 1000) / 1000.0 - 0.5) * 1.6 / 3600
    base = _mod(key, 31337, 0, 5000) / 1000.0
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("id"),
        (131 + F.lit(side) * (_mod(place, 7919, 13, 100003) / 100003.0 - 0.5) + shift(389)).alias("lon"),
        (F.lit(side) * (_mod(place, 104729, 71, 99991) / 99991.0 - 0.5) + shift(571)).alias("lat"),
        F.lit(0.3).alias("sig"),
        F.when(key % 17 != 3, 10 + base).alias("mag1"),
        (10.2 + base).alias("mag2"),
        (key % 2).cast("int").alias("best"),
        (key % 11 == 0).alias("halo"),
    )


def cat_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    side, planted = n**0.5 * SIDE, int(n * 0.8)
    key = F.col("p_partkey").cast("bigint")
    hit = key < planted
    lon_hit = 131 + F.lit(side) * (_mod(key, 7919, 13, 100003) / 100003.0 - 0.5) + (_mod(key, 613, 0, 1000) / 1000.0 - 0.5) * 1.2 / 3600
    lat_hit = F.lit(side) * (_mod(key, 104729, 71, 99991) / 99991.0 - 0.5) + (_mod(key, 911, 0, 1000) / 1000.0 - 0.5) * 1.2 / 3600
    base = _mod(key, 31337, 0, 5000) / 1000.0
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("id"),
        F.when(hit, lon_hit).otherwise(131 + F.lit(side) * (_mod(key, 15485863, 5, 100019) / 100019.0 - 0.5)).alias("lon"),
        F.when(hit, lat_hit).otherwise(F.lit(side) * (_mod(key, 32452843, 3, 99989) / 99989.0 - 0.5)).alias("lat"),
        F.lit(0.5).alias("sig"),
        F.when(key % 19 != 5, 10 + base + (_mod(key, 97, 0, 100) / 100.0 - 0.5) * 0.2).alias("mag1"),
        (10.5 + base).alias("mag2"),
        (key % 2).cast("int").alias("best"),
        (key % 13 == 0).alias("halo"),
    )


def north(cat: DataFrame) -> DataFrame:
    """A catalogue of the fixture at latitude 60, across longitude zero, with longitudes twice as wide."""
    return cat.withColumns({"lon": ((F.col("lon") - 131) * 2 + 360) % 360, "lat": F.col("lat") + 60})


#: The same catalogues in SQL.
CAT_SQL = """
cat_n AS (SELECT CAST(sqrt(count(*)) AS DOUBLE) AS s, CAST(floor(count(*) * 0.8) AS BIGINT) AS m FROM customer),
cat_ka AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS BIGINT) AS p, CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END AS dup FROM customer),
cat_a AS (SELECT id,
  131 + s * 0.004::DOUBLE * (((p * 7919 + 13) % 100003) / 100003.0::DOUBLE - 0.5::DOUBLE) + dup * (((id * 389) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 1.6::DOUBLE / 3600 AS lon,
  s * 0.004::DOUBLE * (((p * 104729 + 71) % 99991) / 99991.0::DOUBLE - 0.5::DOUBLE) + dup * (((id * 571) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 1.6::DOUBLE / 3600 AS lat,
  CAST(0.3 AS DOUBLE) AS sig, CASE WHEN id % 17 = 3 THEN NULL ELSE 10 + ((id * 31337) % 5000) / 1000.0::DOUBLE END AS mag1,
  10.2::DOUBLE + ((id * 31337) % 5000) / 1000.0::DOUBLE AS mag2, CAST(id % 2 AS INT) AS best, (id % 11 = 0) AS halo FROM cat_ka, cat_n),
cat_kb AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey < m AS hit, s FROM part, cat_n),
cat_b AS (SELECT id,
  CASE WHEN hit THEN 131 + s * 0.004::DOUBLE * (((id * 7919 + 13) % 100003) / 100003.0::DOUBLE - 0.5::DOUBLE) + (((id * 613) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 1.2::DOUBLE / 3600
    ELSE 131 + s * 0.004::DOUBLE * (((id * 15485863 + 5) % 100019) / 100019.0::DOUBLE - 0.5::DOUBLE) END AS lon,
  CASE WHEN hit THEN s * 0.004::DOUBLE * (((id * 104729 + 71) % 99991) / 99991.0::DOUBLE - 0.5::DOUBLE) + (((id * 911) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 1.2::DOUBLE / 3600
    ELSE s * 0.004::DOUBLE * (((id * 32452843 + 3) % 99989) / 99989.0::DOUBLE - 0.5::DOUBLE) END AS lat,
  CAST(0.5 AS DOUBLE) AS sig, CASE WHEN id % 19 = 5 THEN NULL ELSE 10 + ((id * 31337) % 5000) / 1000.0::DOUBLE + (((id * 97) % 100) / 100.0::DOUBLE - 0.5::DOUBLE) * 0.2::DOUBLE END AS mag1,
  10.5::DOUBLE + ((id * 31337) % 5000) / 1000.0::DOUBLE AS mag2, CAST(id % 2 AS INT) AS best, (id % 13 = 0) AS halo FROM cat_kb)"""

#: Great-circle distance in degrees between aliases x and y.
HAV = "degrees(2 * asin(least(1, sqrt(power(sin(radians((y.lat - x.lat) / 2)), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians((y.lon - x.lon) / 2)), 2)))))"
#: All pairs of the two catalogues within the search radius that their uncertainties allow.
EDGE_SQL = f"""
pair AS (SELECT x.id AS a, y.id AS b, {HAV} * 3600 AS sep, x.sig AS sa, y.sig AS sb FROM cat_a x JOIN cat_b y ON y.lat BETWEEN x.lat - 0.00082 AND x.lat + 0.00082 AND abs((y.lon - x.lon + 540) % 360 - 180) < 0.0017),
edge AS (SELECT a, b, sep, 1 - exp(-sep * sep / (2 * (sa * sa + sb * sb))) AS cdf FROM pair WHERE sep <= 2.92 AND 1 - exp(-sep * sep / (2 * (sa * sa + sb * sb))) < 0.999)"""
#: Connected components; a vertex is twice the id, plus one for the second catalogue.
ISLAND_SQL = """
reach(v, r) AS (SELECT 2 * a, 2 * a FROM edge UNION SELECT 2 * b + 1, 2 * b + 1 FROM edge UNION
  SELECT CASE WHEN e.side = 0 THEN 2 * e.b + 1 ELSE 2 * e.a END, reach.r FROM reach JOIN (SELECT a, b, 0 AS side FROM edge UNION ALL SELECT a, b, 1 AS side FROM edge) e
  ON (e.side = 0 AND reach.v = 2 * e.a) OR (e.side = 1 AND reach.v = 2 * e.b + 1)),
comp AS (SELECT v, min(r) AS island FROM reach GROUP BY v)"""


#: Both catalogues' hulls, walked around point by point; the area that is in both, slab by slab between the latitudes
#: of corners and crossings; and how many detections of each band are inside of both hulls.
FIELD_SQL = """
src AS (SELECT 'a' AS side, id, lon, lat, mag1, mag2 FROM cat_a UNION ALL SELECT 'b', id, lon, lat, mag1, mag2 FROM cat_b),
lim AS (SELECT side, min(lon) AS lo, max(lon) AS hi, min(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) AS wlo, max(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) AS whi, bool_or(abs(lon - 180) < 1) AS far FROM src GROUP BY side),
mid AS (SELECT side, CASE WHEN lo <= 1 AND hi >= 359 AND far THEN 180 WHEN lo <= 1 AND hi >= 359 THEN (wlo + whi) / 2 ELSE (lo + hi) / 2 END AS m FROM lim),
shf AS (SELECT side, CASE WHEN 180 - m > 180 THEN -180 - m ELSE 180 - m END AS shift FROM mid),
pts AS (SELECT side, id, mag1, mag2, CASE WHEN lon + shift > 360 THEN lon + shift - 360 WHEN lon + shift < 0 THEN lon + shift + 360 ELSE lon + shift END AS x, lat AS y FROM src JOIN shf USING (side)),
walk(side, n, x, y, th, sx, sy) AS (SELECT side, 0, s.x, s.y, 0::DOUBLE, s.x, s.y FROM (SELECT side, arg_min({'x': x, 'y': y}, (y, x)) AS s FROM pts GROUP BY side) UNION ALL
  SELECT side, n, x, y, th, sx, sy FROM (SELECT w.side, w.n + 1 AS n, p.x, p.y, atan2(p.y - w.y, p.x - w.x) AS th, w.sx, w.sy FROM walk w JOIN pts p ON p.side = w.side AND (p.x <> w.x OR p.y <> w.y) WHERE w.n < 500
    QUALIFY row_number() OVER (PARTITION BY w.side ORDER BY (atan2(p.y - w.y, p.x - w.x) - w.th + 4 * pi()) % (2 * pi()), -(power(p.y - w.y, 2) + power(p.x - w.x, 2))) = 1) WHERE x <> sx OR y <> sy),
edg AS (SELECT side, n, x AS x1, y AS y1, coalesce(lead(x) OVER w, sx) AS x2, coalesce(lead(y) OVER w, sy) AS y2 FROM walk WINDOW w AS (PARTITION BY side ORDER BY n)),
one AS (SELECT edg.* REPLACE ((x1 - shift + 540) % 360 - 180 AS x1, (x2 - shift + 540) % 360 - 180 AS x2) FROM edg JOIN shf USING (side)),
crs AS (SELECT e.y1 + (e.y2 - e.y1) * ((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1)) / d AS y, ((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1)) / d AS t, ((f.x1 - e.x1) * (e.y2 - e.y1) - (f.y1 - e.y1) * (e.x2 - e.x1)) / d AS u
  FROM (SELECT e, f, (e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1) AS d FROM one e, one f WHERE e.side = 'a' AND f.side = 'b') WHERE d <> 0),
brk AS (SELECT DISTINCT y FROM (SELECT y1 AS y FROM one UNION ALL SELECT y FROM crs WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)),
slb AS (SELECT y AS ya, lead(y) OVER (ORDER BY y) AS yb FROM brk),
rim AS (SELECT ya, yb, side, arg_min({'m': xm, 'a': xa, 'b': xb}, xm) AS l, arg_max({'m': xm, 'a': xa, 'b': xb}, xm) AS r FROM (SELECT ya, yb, side, x1 + ((ya + yb) / 2 - y1) * k AS xm, x1 + (ya - y1) * k AS xa, x1 + (yb - y1) * k AS xb
  FROM (SELECT *, (x2 - x1) / (y2 - y1) AS k FROM slb JOIN one ON least(y1, y2) <= (ya + yb) / 2 AND greatest(y1, y2) >= (ya + yb) / 2 WHERE y1 <> y2)) GROUP BY ya, yb, side HAVING count(*) > 1),
wid AS (SELECT ya, yb, r.m - l.m AS m, r.a - l.a AS wa, r.b - l.b AS wb FROM (SELECT ya, yb, arg_max(l, l.m) AS l, arg_min(r, r.m) AS r FROM rim GROUP BY ya, yb HAVING count(*) = 2)),
area AS (SELECT sum(m * cos(radians(y)) * 2 * sin(radians(h)) * 180 / pi() - (wb - wa) / (2 * h) * sin(radians(y)) * 2 * (sin(radians(h)) * power(180 / pi(), 2) - h * cos(radians(h)) * 180 / pi())) AS ar FROM (SELECT *, (ya + yb) / 2 AS y, (yb - ya) / 2 AS h FROM wid WHERE m > 0)),
joint AS (SELECT s.* FROM src s WHERE NOT EXISTS (SELECT 1 FROM shf JOIN edg USING (side) WHERE (x2 - x1) * (s.lat - y1) - (y2 - y1) * (CASE WHEN s.lon + shift > 360 THEN s.lon + shift - 360 WHEN s.lon + shift < 0 THEN s.lon + shift + 360 ELSE s.lon + shift END - x1) < -1e-12)),
da AS (SELECT 0 AS best, count(mag1) / max(ar) AS d FROM joint, area WHERE side = 'a' UNION ALL SELECT 1, count(mag2) / max(ar) FROM joint, area WHERE side = 'a'),
db AS (SELECT 0 AS best, count(mag1) / max(ar) AS d FROM joint, area WHERE side = 'b' UNION ALL SELECT 1, count(mag2) / max(ar) FROM joint, area WHERE side = 'b')"""
#: The catalogues moved to latitude 60, across longitude zero.
NORTH_SQL = CAT_SQL.replace("cat_a AS (SELECT id,", "cat_a AS (SELECT * REPLACE (((lon - 131) * 2 + 360) % 360 AS lon, lat + 60 AS lat) FROM (SELECT id,").replace("FROM cat_ka, cat_n),", "FROM cat_ka, cat_n)),").replace("cat_b AS (SELECT id,", "cat_b AS (SELECT * REPLACE (((lon - 131) * 2 + 360) % 360 AS lon, lat + 60 AS lat) FROM (SELECT id,").replace("FROM cat_kb)", "FROM cat_kb))")


def with_sql(body: str, *parts: str, cats: str = CAT_SQL) -> str:
    return f"WITH RECURSIVE {', '.join(p.strip() for p in (cats, *parts))} {body}"
