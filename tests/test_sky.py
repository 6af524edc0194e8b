import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import bessel, sky
from skyweave.functions.optimise import minimised
from skyweave.operators import photometry as phot
from skyweave.operators import regions


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


@pytest.mark.parametrize(("a", "b", "dist"), [((0, 0), (10, 0), 10), ((50, -10), (50, 20), 30), ((0, -45), (180, 45), 180), ((359.5, 0), (0.5, 0), 1)])
def test_haversine(spark, a, b, dist):
    assert one(spark, sky.haversine(a[0], b[0], a[1], b[1]).alias("d")).d == pytest.approx(dist)


def test_proper_motion_crosses_the_pole_and_keeps_unknown(spark):
    rows = spark.createDataFrame([(180.0, 85.0, 0.0, 3600.0 * 10), (10.0, 0.0, None, 1.0)], "lon double, lat double, pl double, pb double")
    moved = [tuple(r) for r in rows.select(*sky.apply_pm("lon", "lat", "pl", "pb", 1.0)).collect()]
    assert moved[0][0] % 360 == pytest.approx(0 if moved[0][1] > 90 else moved[0][0] % 360) and moved[0][1] == pytest.approx(85 + math.degrees(math.atan(math.radians(10))), abs=10.1)
    assert moved[1] == (10.0, 0.0)


def test_galactic_round_trip(spark):
    lon, lat = sky.eq_to_gal(F.lit(131.0), F.lit(-1.0))
    back = spark.range(1).select(lon.alias("l"), lat.alias("b")).select(*(c.alias(n) for c, n in zip(sky.gal_to_eq("l", "b"), ("lon", "lat"), strict=True))).head()
    assert back.lon == pytest.approx(131) and back.lat == pytest.approx(-1)
    pole = one(spark, sky.eq_to_gal(F.lit(192.85948), F.lit(27.12825))[1].alias("b"))
    assert pole.b == pytest.approx(90, abs=1e-3)


def test_rect_slice_wraps(spark):
    rows = spark.createDataFrame([(359.2, 0.0), (0.5, 0.0), (1.6, 0.0), (1.04, 0.0), (180.0, 0.0), (0.0, 1.2)], "lon double, lat double")
    assert [r.lon for r in rows.where(sky.rect_slice("lon", "lat", -1, 1, -1, 1, 0.0)).collect()] == [359.2, 0.5]
    assert [r.lon for r in rows.where(sky.rect_slice("lon", "lat", -1, 1, -1, 1, 0.05)).collect()] == [359.2, 0.5, 1.04]


def test_matchings(spark):
    for a, b in [(1, 1), (2, 3), (7, 6), (10, 10), (5, 21)]:
        got = one(spark, sky.matchings(F.lit(a), F.lit(b)).alias("n")).n
        assert got == sum(math.comb(a, k) * math.perm(b, k) for k in range(min(a, b) + 1))
    assert one(spark, sky.falling_factorial(F.lit(5), F.lit(0)).alias("n")).n == 1


def test_bessel_and_hankel():
    theta = (np.arange(4000) + 0.5) * math.pi / 4000
    x = np.linspace(-50, 50, 401)
    for n, f in ((0, bessel.j0), (1, bessel.j1)):
        assert np.allclose(np.cos(n * theta - np.outer(x, np.sin(theta))).mean(axis=1), f(x), atol=1e-9)
    rho = (np.arange(4000) + 0.5) * 0.0025
    width = np.full(4000, 0.0025)
    r = np.linspace(0.05, 2, 20)
    assert np.allclose(bessel.cdf(bessel.gaussian(rho, 0.5), rho, width, r), 1 - np.exp(-(r**2) / 0.5), rtol=1e-3, atol=1e-4)
    assert bessel.radius(bessel.gaussian(rho, 0.5), rho, width, 0.9, 5.0) == pytest.approx(math.sqrt(-0.5 * math.log(0.1)), rel=1e-3)
    density = bessel.hankel(bessel.gaussian(rho, 0.5), rho, width, np.array([0.3]))[0]
    assert density == pytest.approx(math.exp(-0.09 / 0.5) / (2 * math.pi * 0.25), rel=1e-3)


def test_shares_of_many_radii_are_summed_in_blocks_of_what_counts(monkeypatch):
    """All radii at once were a matrix for each step of the series, most of it of points where the transform is nothing."""
    rho, width = (np.arange(4000) + 0.5) * 0.0025, np.full(4000, 0.0025)
    r, transform = np.linspace(0, 2.9, 1000), bessel.gaussian(rho, 0.58)
    plain = 2 * np.pi * r * (bessel.j1(2 * np.pi * np.outer(r, rho)) @ (transform * width))
    sizes = []
    monkeypatch.setattr(bessel, "j1", lambda x, j1=bessel.j1: (sizes.append(x.size), j1(x))[1])
    assert np.allclose(bessel.cdf(transform, rho, width, r), plain, rtol=0, atol=1e-13)
    assert max(sizes) < 100_000 and sum(sizes) < 1_500_000
    assert len(bessel.cdf(transform, rho, width, [])) == 0
    assert np.isnan(bessel.cdf(bessel.gaussian(rho, np.nan), rho, width, 1.0)).all()


def test_minimised_respects_bounds():
    def loss(x):
        return (x[0] - 3) ** 2 + 10 * (x[1] + 2) ** 2 + x[0] * x[1], np.array([2 * (x[0] - 3) + x[1], 20 * (x[1] + 2) + x[0]])

    assert np.allclose(minimised(loss, np.array([1.0, 1.0]), lower=np.zeros(2)), [3, 0], atol=1e-6)


def test_planted_densities_are_recovered():
    fractions = np.array([0.63, 0.9])
    areas = np.array([np.full(10, 1e-6), np.full(10, 3e-6)]).T * np.linspace(0.5, 1.5, 10)[:, None]
    true = np.array([3000.0, 5000.0, 8000.0])
    pa, _, pb, _ = phot.density_model(true, fractions, areas, areas * 1.3)
    assert np.allclose(phot.fitted_densities(pa, pb, np.sqrt(pa + 1), np.sqrt(pb + 1), fractions, areas, areas * 1.3), true, rtol=1e-3)
    assert "no counterparts" in phot.contradiction(0, (0, 5))
    assert phot.contradiction(0.001, (100, 200)) is None and phot.floored(0.001, (100, 200)) == (1.0, 100, 200)


@pytest.mark.parametrize(("step", "width"), [(0.1 / 251, 0.1), (0.1 / 2500, 0.1), (0.1 / 249, 0.2), (0.1 / 124, 0.3)])
def test_adaptive_bins(spark, step, width):
    mags = spark.range(int(5 / step)).select((10.00001 + F.col("id") * step).alias("m"))
    bins = phot.adaptive_bins(mags, "m").orderBy("bin").collect()
    assert all(b.hi - b.lo == pytest.approx(width) for b in bins[:-1])
    assert sum(b.n for b in bins) == int(5 / step)


def test_hull_and_circle(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame(rng.uniform(-1, 1, size=(5000, 2)).tolist(), "lon double, lat double").repartition(5)
    corners = regions.hull(points).collect()
    assert corners[0].area == pytest.approx(4, rel=0.02) and len(corners) < 100
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    share = lambda x, y: one(spark, regions.circle_share(F.lit(x), F.lit(y), 0.1, square).alias("s")).s
    assert share(0.0, 0.0) == 1 and share(1.0, 0.0) == pytest.approx(0.5, abs=0.03) and share(1.0, 1.0) == pytest.approx(0.25, abs=0.04) and share(3.0, 0.0) == 0


def test_refined_cell_areas(spark):
    square = [(-0.337, -0.251), (0.411, -0.251), (0.411, 0.333), (-0.337, 0.333)]
    got = {r.pt: r.area for r in regions.cell_areas(spark, (-1, 1), (-1, 1), 0.1, square, [(0, -0.5, 0.0), (1, 0.5, 0.0)], refine=2).collect()}
    assert got[0] == pytest.approx(0.337 * 0.584, rel=2e-3) and got[1] == pytest.approx(0.411 * 0.584, rel=2e-3)


def test_simulated_motions():
    from skyweave.operators.population import normals, proper_motions

    at = lambda *x: [np.array([float(v)]) for v in x]
    near = proper_motions(*at(90, 0, 0.5), "thin", normals(np.array([1]), "thin", 4000))[1].mean()
    assert near == pytest.approx(-7.25 * 0.2108e-3 / 0.5, abs=6e-4)
    thin, halo = (np.stack(proper_motions(*at(0, 30, 2.0), c, normals(np.array([1]), c, 4000))) for c in ("thin", "halo"))
    assert halo.std() > 2 * thin.std() and halo[0].mean() < thin[0].mean() - 0.01


def test_motions_have_the_moments_of_their_component(spark):
    """Toward the anticentre, latitude motion is vertical and longitude motion is rotation; moments follow from the variances."""
    from skyweave.operators import population as pop

    sources = spark.createDataFrame([(i, 180.0, 0.0, 2.0) for i in range(300)] + [(1000 + i, 180.0, 60.0, 1.0) for i in range(300)], "id bigint, l double, b double, dist double")
    rows = pop.simulated_motions(sources, 100).toPandas()
    r = np.array([pop.R_SUN + 2.0])
    for name in pop.COMPONENTS:
        rr, pp, zz, _ = (float(v[0]) for v in pop.variances(r, np.zeros(1), name))
        at = rows[(rows.component == name) & (rows.id < 1000)]
        speed = pop.PER_KPC / 2
        assert at.mu_b.std() == pytest.approx(math.sqrt(zz) * speed, rel=0.03) and at.mu_b.mean() == pytest.approx(-pop.SUN_MOTION[2] * speed, abs=4 * math.sqrt(zz / 3e4) * speed)
        assert at.mu_l.std() == pytest.approx(math.sqrt(pp) * speed, rel=0.03)
    again = pop.simulated_motions(sources.repartition(7), 100).toPandas()
    assert np.allclose(*(x.sort_values(["id", "component", "draw"]).mu_l for x in (rows, again)))
    rr, _, zz, rz = pop.variances(np.array([6.0, 6.0]), np.array([0.8, -0.8]), "thin")
    assert rz[0] == -rz[1] > 0 and (np.abs(rz) < np.sqrt(rr * zz)).all()


def test_galaxy_counts_average_over_extinctions():
    from skyweave.operators.population import galaxy_counts

    mags, edges = np.arange(14, 22, 0.5), np.linspace(0.001, 2, 31)
    args = (mags, edges, {"blue": 0.5 * edges[1:]}, {"blue": (0.0094, -20.7, -0.7, 0.5, 0.9)})
    none, one = galaxy_counts(*args), galaxy_counts(mags - 0.5, *args[1:])
    assert np.allclose(galaxy_counts(*args, extinctions=(0.0, 0.5)), (none + one) / 2) and np.allclose(galaxy_counts(*args, offset=-0.5), one)
