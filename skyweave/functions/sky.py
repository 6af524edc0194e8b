"""Sky geometry, astrometry and photometry as Column expressions. Angles are in degrees."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial (J2000) to Galactic rotation; fixed values.
TO_GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)
SUN_RADIUS_KPC = 8.09
EDGE = 1e-6


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lon1, lon2, lat1, lat2) -> Column:
    """Great-circle distance."""
    lon1, lon2, lat1, lat2 = map(col, (lon1, lon2, lat1, lat2))
    a, b = F.sin(F.radians((lat2 - lat1) / 2)), F.sin(F.radians((lon2 - lon1) / 2))
    h = F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), h)))


def wrapped(lon: Column, shift: float | Column) -> Column:
    """Longitude shifted and brought into 0 to 360."""
    return F.pmod(lon + shift, F.lit(360.0))


def rect_slice(lon, lat, lon1: float, lon2: float, lat1: float, lat2: float, padding: float) -> Column:
    """Whether a position is in a rectangle, or within ``padding`` of it."""
    lon, lat = col(lon), col(lat)
    shift = 180 - (lon1 + lon2) / 2
    at, lo, hi = wrapped(lon, shift), (lon1 + shift) % 360, (lon2 + shift) % 360
    beside = lambda edge: haversine(lon, F.lit(edge), lat, lat) <= padding if padding > 0 else F.lit(False)
    east = (at <= hi + EDGE) | beside(lon2)
    west = (at >= lo - EDGE) | beside(lon1)
    return east & west & (lat <= lat2 + padding + EDGE) & (lat >= lat1 - padding - EDGE)


def winding(x: Column, y: Column, hull: list[tuple[float, float]]) -> Column:
    """Sum of the signed angles under which a point sees the edges of a polygon."""
    total = F.lit(0.0)
    for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1], strict=True):
        ax, ay, bx, by = F.lit(x1) - x, F.lit(y1) - y, F.lit(x2) - x, F.lit(y2) - y
        total = total + F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    return total


def in_hull(x, y, hull: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a convex polygon."""
    return F.abs(winding(col(x), col(y), hull)) >= math.pi


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    c = F.cos(F.radians(lat))
    return c * F.cos(F.radians(lon)), c * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def _angles(v: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    return F.pmod(F.degrees(F.atan2(v[1], v[0])), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2]))))


def rotated(lon, lat, matrix) -> tuple[Column, Column]:
    v = unit_vector(col(lon), col(lat))
    return _angles(tuple(reduce(lambda a, b: a + b, (F.lit(m) * x for m, x in zip(row, v, strict=True))) for row in matrix))


def eq_to_gal(lon, lat) -> tuple[Column, Column]:
    return rotated(lon, lat, TO_GALACTIC)


def gal_to_eq(lon, lat) -> tuple[Column, Column]:
    return rotated(lon, lat, tuple(zip(*TO_GALACTIC, strict=True)))


def epoch_years(text) -> Column:
    """The year of a number, a Julian epoch such as J2015.5, or a date such as 2016-07-02; null for anything else."""
    text = F.trim(col(text).cast("string"))
    date = F.try_to_date(text, "yyyy-MM-dd")
    days = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    number = F.when(text.startswith("J"), F.substr(text, F.lit(2))).otherwise(text).try_cast("double")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.year(date) + (F.dayofyear(date) - 1) / days).otherwise(number)


def apply_pm(lon, lat, pm_lon, pm_lat, years) -> tuple[Column, Column]:
    """Position after ``years`` of straight motion (arcseconds a year along great circles, in any frame); rows without motion or time stay."""
    lon, lat, pm_lon, pm_lat, years = map(col, (lon, lat, pm_lon, pm_lat, years))
    p = unit_vector(lon, lat)
    sl, cl, sb, cb = F.sin(F.radians(lon)), F.cos(F.radians(lon)), F.sin(F.radians(lat)), F.cos(F.radians(lat))
    along = (F.radians(pm_lon * years / 3600), F.radians(pm_lat * years / 3600))
    east, north = (-sl, cl, F.lit(0.0)), (-sb * cl, -sb * sl, cb)
    moved = tuple(a + along[0] * e + along[1] * n for a, e, n in zip(p, east, north, strict=True))
    size = F.sqrt(moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2])
    new_lon, new_lat = _angles(tuple(m / size for m in moved))
    none = pm_lon.isNull() | pm_lat.isNull() | F.isnan(pm_lon) | F.isnan(pm_lat) | years.isNull()
    return F.when(none, lon).otherwise(new_lon), F.when(none, lat).otherwise(new_lat)


def galactocentric(l_deg, b_deg, dist_kpc, r_sun: float = SUN_RADIUS_KPC) -> tuple[Column, Column]:
    """Cylindrical radius and height."""
    v = unit_vector(col(l_deg), col(b_deg))
    d = col(dist_kpc)
    x, y = d * v[0] - r_sun, d * v[1]
    return F.sqrt(x * x + y * y), d * v[2]


def auf_cdf(sep_arcsec, sig_a, sig_b) -> Column:
    """Probability that two observations of one source are no further apart than this."""
    s, a, b = map(col, (sep_arcsec, sig_a, sig_b))
    return 1 - F.exp(-s * s / (2 * (a * a + b * b)))


def auf_radius(fraction: float, sig_a, sig_b) -> Column:
    """The separation in arcseconds within which that fraction is found."""
    a, b = col(sig_a), col(sig_b)
    return F.sqrt(F.lit(-2 * math.log(1 - fraction)) * (a * a + b * b))


def pair_density(sep_arcsec, sig_a, sig_b) -> Column:
    """Density of separations a square degree; a positive floor where it vanishes."""
    s, a, b = map(col, (sep_arcsec, sig_a, sig_b))
    v = a * a + b * b
    g = F.exp(-s * s / (2 * v)) / (F.lit(2 * math.pi) * v) * 3600.0**2
    return F.when(g < 0, F.lit(1e-30)).otherwise(g)


def contam_prob(frac_a, frac_b, gcc, gcn, gnc, gnn) -> tuple[Column, Column]:
    """Probability that each source of a pair is blended, marginalised over the other."""
    fa, fb, cc, cn, nc, nn = map(col, (frac_a, frac_b, gcc, gcn, gnc, gnn))
    total = fa * fb * cc + fa * (1 - fb) * cn + (1 - fa) * fb * nc + (1 - fa) * (1 - fb) * nn
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return clip((fa * fb * cc + fa * (1 - fb) * cn) / total), clip((fa * fb * cc + (1 - fa) * fb * nc) / total)


def log_ratio(top: Column, bottom: Column) -> Column:
    """log10 of a likelihood ratio, 30 and -30 where a side vanishes."""
    return F.when(F.abs(bottom) < 1e-30, F.lit(30.0)).when(F.abs(top) < 1e-30, F.lit(-30.0)).otherwise(F.log10(top / bottom))


def eta(c, fa, fb) -> Column:
    """Photometric log likelihood ratio."""
    return log_ratio(col(c), col(fa) * col(fb))


def xi(nc, g, nfa, nfb) -> Column:
    """Astrometric log likelihood ratio."""
    return log_ratio(col(nc) * col(g), col(nfa) * col(nfb))


def falling_factorial(n, k) -> Column:
    """n (n - 1) ... (n - k + 1)."""
    n, k = col(n).cast("bigint"), col(k).cast("bigint")
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1).cast("bigint"), lambda total, i: total * (n - i))


def matchings(n_a, n_b) -> Column:
    """How many partial matchings two sides have: the sum over k of C(n_a, k) P(n_b, k)."""
    a, b = col(n_a).cast("bigint"), col(n_b).cast("bigint")
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * (a - k + 1) * (b - k + 1) / k
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.least(a, b))), begin, step)["total"]


def blend_weight(snr, snr_max) -> Column:
    """Weight between the two ways in which blends shift positions."""
    r = F.least(F.lit(1.0), col(snr) / col(snr_max))
    return 1 - F.sqrt(1 - r * r)


def rescaled_sigma(sig, m, n) -> Column:
    return F.sqrt((col(m) * col(sig)) * (col(m) * col(sig)) + col(n) * col(n))


def schechter(mag, z, phi0, m0, alpha, p_evo, q_evo) -> Column:
    """Galaxy density a magnitude: characteristic magnitude and density move with redshift."""
    m_star = col(m0) - col(q_evo) * col(z)
    phi = col(phi0) * F.pow(F.lit(10.0), 0.4 * col(p_evo) * col(z))
    lum = F.pow(F.lit(10.0), -0.4 * (col(mag) - m_star))
    return F.lit(0.4 * math.log(10)) * phi * F.pow(lum, col(alpha) + 1) * F.exp(-lum)


#: Model of the Galaxy: solar height, disc scale lengths and heights (kpc), and relative densities; fixed values.
SUN_HEIGHT_KPC = 0.025
THIN, THICK, THICK_SHARE = (2.6, 0.3), (3.6, 0.9), 0.13
HALO_SHARE, HALO_FLATTENING, HALO_POWER = 0.0051, 0.64, 2.77


def disc(r, z, length: float, height: float) -> Column:
    """Density of an exponential disc, relative to the Sun's place in the plane."""
    return F.exp((SUN_RADIUS_KPC - col(r)) / length - F.abs(col(z) + SUN_HEIGHT_KPC) / height)


def halo(r, z) -> Column:
    flat = F.sqrt(col(r) * col(r) + (col(z) / HALO_FLATTENING) * (col(z) / HALO_FLATTENING))
    return HALO_SHARE * F.pow(flat / SUN_RADIUS_KPC, F.lit(-HALO_POWER))


def oort(teff) -> tuple[Column, Column]:
    """Oort's A and B from effective temperature, by way of intrinsic colour."""
    t = col(teff)
    colour = F.when(t < 10000, 5.07836 * F.exp(-0.27083 * t / 1000) - 0.40739).otherwise(0.69012 * F.exp(-0.08179 * t / 1000) - 0.35093)
    return 1.94553 * colour + 11.33138, -2.63360 * colour - 13.60611
