import itertools
import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import islands as isl
from skyweave.operators import pairing, spatial
from skyweave.operators.astrometry import corrections
from skyweave.operators.auf import Blends, cell_auf, simulated
from skyweave.plans.engine import Engine
from skyweave.plans.match import CrossMatch
from skyweave.sources import catalog, config, simulations
from skyweave.streaming.detections import overlaps


def cat(spark, rows):
    return spark.createDataFrame([(i, float(lon), float(lat)) for i, lon, lat in rows], "id bigint, lon double, lat double")


@pytest.mark.parametrize(("lon", "lat"), [(131, 0), (0, 0), (0, 70), (40, 89.999), (10, -89.9995)])
def test_radius_join_everywhere(spark, lon, lat):
    rng = np.random.default_rng(1)
    place = lambda n: [(i, (lon + rng.uniform(-0.01, 0.01) / max(0.001, math.cos(math.radians(lat)))) % 360, max(-90, min(90, lat + rng.uniform(-0.01, 0.01)))) for i in range(n)]
    a, b = place(120), place(150)
    radius = 0.002
    vector = lambda p: np.array([math.cos(math.radians(p[2])) * math.cos(math.radians(p[1])), math.cos(math.radians(p[2])) * math.sin(math.radians(p[1])), math.sin(math.radians(p[2]))])
    true = {(x[0], y[0]) for x in a for y in b if 2 * math.asin(min(1, np.linalg.norm(vector(x) - vector(y)) / 2)) <= math.radians(radius)}
    got = [(r.a_id, r.b_id) for r in spatial.radius_join(cat(spark, a), cat(spark, b), radius).collect()]
    assert len(got) == len(set(got)) and set(got) == true and true


def test_islands_and_gate(spark):
    edges = [(0, 0), (0, 1), (1, 1), (2, 3), (3, 3), (3, 4), (4, 4), (9, 9)] + [(20 + i, 20 + i + d) for i in range(40) for d in (0, 1)]
    pairs = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.vertex: r.island for r in isl.islands(pairs).collect()}
    assert {got[2 * a] == got[2 * b + 1] for a, b in edges} == {True}
    assert got[0] == got[3] == 0 and got[4] == got[9] == 4 and got[18] == 18 and {got[2 * (20 + i)] for i in range(40)} == {40}
    sizes = spark.createDataFrame([(0, 21, 5), (1, 10, 10), (2, 7, 6), (3, 1, 0)], "island bigint, n_a bigint, n_b bigint")
    assert {r.island: r.keep for r in isl.size_gate(sizes).collect()} == {0: False, 1: False, 2: True, 3: True}


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (3, 2), (2, 4), (4, 4), (5, 3)])
def test_best_matching_is_the_best_of_all(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    fa, fb, cw = rng.uniform(0.5, 2, shape[0]), rng.uniform(0.5, 2, shape[1]), rng.uniform(0, 4, shape)
    values = []
    for m in pairing.enumerated(*shape):
        used_a, used_b = {i for i, _ in m}, {j for _, j in m}
        value = math.prod(cw[i, j] for i, j in m) * math.prod(f for i, f in enumerate(fa) if i not in used_a) * math.prod(f for j, f in enumerate(fb) if j not in used_b)
        values.append((value + (0 if m else 1e-10), m))
    pick, p = pairing.best_matching(cw, fa, fb)
    best = max(values, key=lambda v: v[0])
    assert pick == best[1] and p == pytest.approx(best[0] / sum(v for v, _ in values))


def test_the_largest_island_that_the_gate_allows_is_quick():
    rng = np.random.default_rng(2)
    for n, m in ((8, 8), (20, 5)):
        fa, fb, cw = rng.uniform(0.5, 2, n), rng.uniform(0.5, 2, m), rng.uniform(0, 4, (n, m))
        cw[3, 2] = 1e12
        pick, p = pairing.best_matching(cw, fa, fb)
        assert (3, 2) in pick and 0 < p <= 1


def test_closed_forms_agree_with_enumeration(spark):
    rng = np.random.default_rng(3)
    rows, sizes, true = [], [], {}
    for island, (n, m) in enumerate(itertools.product((1, 2, 3), repeat=2)):
        fa, fb, cw = rng.uniform(0.5, 2, n), rng.uniform(0.5, 2, m), rng.uniform(0, 3, (n, m))
        rows += [(island, i, j, 1.0, 1.0, float(cw[i, j]), float(fa[i]), float(fb[j]), 0.0, 0.0) for i in range(n) for j in range(m)]
        sizes.append((island, n, m))
        true[island] = pairing.best_matching(cw, fa, fb)
    grid = spark.createDataFrame(rows, "island bigint, a bigint, b bigint, sep double, g double, cw double, fa double, fb double, eta double, xi double")
    found, evidence = pairing.island_matches(grid, spark.createDataFrame(sizes, "island bigint, n_a bigint, n_b bigint"))
    got = {}
    for r in found.collect():
        got.setdefault(r.island, []).append((r.a, r.b))
    assert {k: sorted(got.get(k, [])) for k in true} == {k: sorted(v[0]) for k, v in true.items()}
    assert {r.island: round(r.p, 9) for r in evidence.collect()} == {k: round(v[1], 9) for k, v in true.items()}


def planted(lon, n_a=60, n_b=80, common=50):
    rng = np.random.default_rng(9)
    lons, lats = lon + rng.uniform(-0.05, 0.05, n_a + n_b), rng.uniform(-0.05, 0.05, n_a + n_b)
    a = [(i, lons[i] % 360, lats[i]) for i in range(n_a)]
    b = [(i, (lons[i] + rng.normal(0, 0.2) / 3600) % 360, lats[i] + rng.normal(0, 0.2) / 3600) for i in range(common)]
    return a, b + [(i, lons[n_a + i] % 360, lats[n_a + i]) for i in range(common, n_b)]


@pytest.mark.parametrize("lon", [131, 0])
def test_planted_pairs_are_found(spark, lon):
    a, b = (cat(spark, rows).withColumns({"sig": F.lit(0.3), "mag1": F.lit(12.0), "mag2": F.lit(13.0), "best": F.lit(0), "halo": F.lit(False)}) for rows in planted(lon))
    m = CrossMatch(a, b, area=0.01)
    assert {(r.a, r.b) for r in m.matches.collect()} == {(i, i) for i in range(50)}
    rest = m.nonmatches.collect()
    assert len(rest) == 10 + 30 and all(r.match_p == 1 or r.nnm_sep is not None for r in rest)


def settings_of(folder, chunks=(1, 2)):
    side = lambda name: {
        "cat_name": name, "cat_csv_file_path": f"{folder}/{name}_{{}}.csv", "filt_names": ["x", "y"], "pos_and_err_indices": [1, 2, 3], "mag_indices": [4, 5], "best_mag_index_col": 6, "chunk_overlap_col": 7, "csv_has_header": False,
        "chunk_id_list": list(chunks), "auf_region_frame": "equatorial", "correct_astrometry": False, "apply_proper_motion": False, "id_col": 0,
    }
    joint = {
        "pos_corr_dist": 2.92, "int_fracs": [0.63, 0.9, 0.999], "chunk_id_list": list(chunks), "output_save_folder": f"{folder}/out", "include_perturb_auf": False, "include_phot_like": False, "use_phot_priors": False,
        "cf_region_type": "rectangle", "cf_region_frame": "equatorial", "cf_region_points_per_chunk": [[131, 132, 2, -1, 1, 2]] * len(chunks), "make_output_csv": False,
    }
    return joint, side("a"), side("b")


def test_engine_writes_resumes_and_drops_halo(spark, tmp_path):
    for k, lon in ((1, 131), (2, 0)):
        for name, rows in zip("ab", planted(lon), strict=True):
            (tmp_path / f"{name}_{k}.csv").write_text("".join(f"{i},{x!r},{y!r},0.3,12.0,,0,{int(i == 0)}\n" for i, x, y in ((i, float(x), float(y)) for i, x, y in rows)))
    found = config.settings(*settings_of(tmp_path))
    out = Engine(spark, found).run()
    got = spark.read.parquet(out["matches"])
    assert {(r.chunk_id, r.a, r.b) for r in got.collect()} == {(k, i, i) for k in (1, 2) for i in range(1, 50)}
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    Engine(spark, found).run()
    assert stamp == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}


def test_engine_with_corrections_edges_and_photometry(spark, tmp_path):
    rng = np.random.default_rng(12)
    for name, rows in zip("ab", planted(131, 700, 800, 600), strict=True):
        (tmp_path / f"{name}_1.csv").write_text("".join(f"{i},{float(x)!r},{float(y)!r},0.15,{10 + i % 50 / 10 + rng.normal(0, 0.05)},,{0 if i else 1},0\n" for i, x, y in rows))
    joint, a, b = settings_of(tmp_path, (1,))
    joint |= {"include_phot_like": True, "use_phot_priors": True, "reject_edges": True}
    a["correct_astrometry"] = True
    with pytest.raises(ValueError, match="corrections"):
        Engine(spark, config.settings(joint, a, b)).run()
    out = Engine(spark, config.settings(joint, a, b), {"a": [(131.0, 0.0, 2.0, 0.0), (10.0, 0.0, 9.0, 0.0)]}).run()
    got = spark.read.parquet(out["matches"])
    pairs = {(r.a, r.b) for r in got.collect()}
    assert len(pairs & {(i, i) for i in range(600)}) > 560 and len(pairs) < 620
    reasons = {r.reason: r.n for r in spark.read.parquet(out["rejects"]).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons["no bin"] == 2 and reasons["edge"] > 5
    assert spark.read.parquet(out["matches_without_photometry"]).count() > 560


@pytest.mark.parametrize(
    ("where", "key", "value", "message"),
    [(0, "pos_corr_dist", "x", "number"), (0, "pos_corr_dist", -1, "above zero"), (0, "int_fracs", [0.5], "three shares"), (0, "cf_region_frame", "galactic", "same"), (1, "mag_indices", [4], "length"), (1, "mag_indices", ["a", 1], "integers"), (1, "pos_and_err_indices", [1], "three places"), (2, "chunk_id_list", [1], "chunk_id_list"), (2, "cat_name", None, "missing"), (2, "apply_proper_motion", True, "pm_indices")],
)
def test_settings_are_checked(tmp_path, where, key, value, message):
    parts = settings_of(tmp_path)
    if value is None:
        del parts[where][key]
    else:
        parts[where][key] = value
    with pytest.raises(ValueError, match=message):
        config.settings(*parts)


def test_settings_from_file_and_epochs(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": 1}))
    assert config.loaded(str(tmp_path / "s.json")) == {"a": 1}
    assert config.epoch("J2015.5") == 2015.5 and config.epoch("2016-07-02") == pytest.approx(2016.5, abs=0.01) and config.epoch(2000) == 2000


def test_csv_blanks_are_null(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1.0,2.0,0.1,NaN,12.5,1,0\n3.0,4.0,0.2,,11.5,0,1\n")
    rows = catalog.read_csv(spark, str(tmp_path / "c.csv"), catalog.Layout((0, 1, 2), (3, 4), 5, 6)).orderBy("lon").collect()
    assert [r.mags for r in rows] == [[None, 12.5], [None, 11.5]] and [r.halo for r in rows] == [False, True] and [r.id for r in rows] == [0, 1]


def test_simulation_file(spark, tmp_path):
    (tmp_path / "s.dat").write_text("#area = 0.5 sq deg\n#Av at infinity = 0.25\n#mag Av\n" + "".join(f"{10 + i % 20 / 10} 0.1\n" for i in range(400)))
    rows, area, av = simulations.read_simulation(spark, str(tmp_path / "s.dat"))
    assert (area, av) == (0.5, 0.25) and rows.count() == 400 and rows.columns == ["mag", "Av"]


def test_simulations_of_all_chunks_in_one_scan(spark, tmp_path):
    """Columns in different places; a bright simulation over more sky, which ends at its fullest bin."""
    faint = [10.05 + k / 10 for k in range(40) for _ in range(5 + 5 * k)]
    (tmp_path / "c_1.dat").write_text("#area = 0.5 sq deg\n#Av at infinity = 0.25\n#x Av y\n" + "".join(f"{m:.2f} 0.1 {m + 1:.2f}\n" for m in faint))
    (tmp_path / "c_2.dat").write_text("#area = 2 sq deg\n#Av at infinity = 0.5\n# y x\n" + "".join(f" {m + 2:.2f} {m:.2f}\n" for m in faint))
    bright = [10.05 + k / 10 for k in range(10) for _ in range(100 + 100 * k)] + [11.15] * 50
    for c in "12":
        (tmp_path / f"b_{c}.dat").write_text("#area = 10 sq deg\n#x y\n" + "".join(f"{m:.2f} {m + 1:.2f}\n" for m in bright))
    read = lambda name: simulations.read_simulations(spark, f"{tmp_path}/{name}_{{}}.dat", (1, 2), ("x", "y"))
    rows, areas = read("c")
    assert {(r.chunk_id, r.area, r.av) for r in areas.collect()} == {("1", 0.5, 0.25), ("2", 2.0, 0.5)}
    assert {(r.chunk_id, r.filt): r.m for r in rows.groupBy("chunk_id", "filt").agg(F.min("mag").alias("m")).collect()} == {("1", 0): 10.05, ("1", 1): 11.05, ("2", 0): 10.05, ("2", 1): 12.05}
    alone = {(r.chunk_id, r.band, round(r.mag, 2)): r.density for r in simulations.merged_cube((rows, areas), None, 0.1).collect()}
    assert len(alone) == 160 and alone["1", 0, 10.05] == pytest.approx(5 / 0.05) and alone["2", 1, 15.95] == pytest.approx(200 / 0.2)
    both = {(r.chunk_id, r.band, round(r.mag, 2)): r.density for r in simulations.merged_cube((rows, areas), read("b"), 0.1).collect()}
    for k in range(12):
        n, m = 5 + 5 * k, 100 + 100 * k
        weights = (0.05**2 / n, 1.0 / m) if k < 10 else (1, 0)
        assert both["1", 0, round(10.05 + k / 10, 2)] == pytest.approx((n / 0.05 * weights[0] + m * weights[1]) / sum(weights))


def test_stars_and_galaxies_are_scaled_to_the_data(spark):
    from skyweave.operators import counts

    mags = (np.arange(12, 22, 0.5) + 0.25).tolist()
    rows = [(c, b, float(m), float(10 ** (0.2 * m - 1)), 0.5, float(10 ** (0.55 * m - 9 + b))) for c in ("1", "2") for b in (0, 1) for m in mags]
    model = spark.createDataFrame(rows, "chunk_id string, band int, mag double, density double, width double, galaxies double")
    true = {("1", 0): (0.5, 3.0), ("1", 1): (1.7, 0.6), ("2", 0): (4.0, 0.05), ("2", 1): (1.0, 1.0)}
    data = spark.createDataFrame([(c, b, m, true[c, b][0] * s + true[c, b][1] * g) for c, b, m, s, _, g in rows if m > 13 or c == "1"], "chunk_id string, band int, mag double, density double")
    for r in counts.fitted_factors(data, model, ("chunk_id",)).collect():
        assert (r.stars, r.galaxies) == pytest.approx(true[r.chunk_id, r.band], rel=0.01) and r.residual < 1e-3 and r.n >= 18
    none = counts.fitted_factors(data.limit(0), model, ("chunk_id",)).collect()
    assert {(r.stars, r.galaxies, r.residual) for r in none} == {(1.0, 1.0, None)}
    seen = spark.createDataFrame([("1", 0, 12.0 + i % 40 / 10) for i in range(4000)], "chunk_id string, band int, mag double")
    areas, limits = spark.createDataFrame([("1", 2.0)], "chunk_id string, area double"), spark.createDataFrame([("1", 0, 15.0)], "chunk_id string, band int, limit double")
    out = counts.observed(seen, areas, ("chunk_id",), limits, 0.5, (12.9,)).orderBy("mag").collect()
    assert [(r.mag, r.density) for r in out] == [(12.75, pytest.approx(0.0)), *((m, pytest.approx(500.0)) for m in (13.25, 13.75, 14.25, 14.75)), (15.25, pytest.approx(100.0))][1 if out[0].mag > 13 else 0 :]


def test_blends_are_as_faint_and_mixed_as_signal_to_noise_asks(spark):
    """Depths against their definition, the planted mix of both simulations, and the model's weights."""
    import pandas as pd

    from skyweave.operators import blending

    model = [(m, 10 ** (0.3 * m - 2), 0.5) for m in (np.arange(10, 22, 0.5) + 0.25).tolist()]
    cases = [(12.0, 1.0, 400.0), (12.0, 30.0, 5.0), (18.0, 5.0, 60.0), (21.9, 1.0, 10.0), (11.0, 1e-6, 2.0)]
    df = spark.createDataFrame([(*c, [dict(zip(("mag", "density", "width"), m, strict=True)) for m in model]) for c in cases], "mag double, scale double, snr double, model array<struct<mag:double,density:double,width:double>>")
    got = df.select("mag", "scale", "snr", blending.faintest_blend(F.col("mag"), F.col("scale"), F.col("snr"), F.col("model"), F.lit(6.1)).alias("d")).collect()
    for r in got:
        lam, at = 0.0, None
        for m, density, width in model:
            if m >= r.mag:
                lam += density * width * r.scale * math.pi * (1.185 * 6.1 / 3600) ** 2
                at = m if at is None and lam >= -math.log(0.01) else at
        crowded = (at if at is not None else max(m for m, *_ in model)) - r.mag if any(m >= r.mag for m, *_ in model) else 0
        assert r.d == pytest.approx(max(-2.5 * math.log10(0.05 / r.snr), crowded))
    frame = pd.DataFrame(model, columns=["mag", "density", "width"])
    how = Blends(fwhm=6.1, trials=4000)
    one, two = (cell_auf(5.0, 12.0, frame, replace(how, algorithm=a), f"k:{a}", 4.0) for a in ("fw", "psf"))
    mixed = cell_auf(5.0, 12.0, frame, replace(how, algorithm="both"), "k", 4.0, 0.3)
    for c in ("fourier", "frac", "flux", "cumulative"):
        assert np.allclose(mixed[c], 0.3 * np.asarray(one[c]) + 0.7 * np.asarray(two[c]))
    assert cell_auf(5.0, 12.0, frame, how, "k", 1.0)["flux"] < cell_auf(5.0, 12.0, frame, how, "k")["flux"] and cell_auf(5.0, 12.0, frame, how, "k", 0.1)["flux"] == 0
    sources = spark.createDataFrame([(i, 0, 12.0 + i % 8 / 10, float(5 + i % 300)) for i in range(3000)], "id long, band int, mag double, snr double")
    curve = {r["__m"]: (r.snr, r.weakest) for r in blending.snr_curves(sources, ["band"]).collect()}
    rows = sources.toPandas()
    want = rows.groupby((rows.mag / 0.25 + 1e-12).astype(int)).snr.median()
    assert curve == {m: (v, float(np.median(np.sort(rows.snr)[:1000]))) for m, v in want.items()}


def test_stream_gives_the_same_pairs(spark, tmp_path):
    a, b = (cat(spark, rows).withColumn("sig", F.lit(0.3)) for rows in planted(131))
    b.write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "b"))
    query = overlaps(stream, a, 2.92, 0.999).writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    keys = lambda df: {(r.a, r.b) for r in df.collect()}
    assert keys(spark.table("seen")) == keys(isl.overlap_pairs(a, b, 2.92, 0.999)) != set()


def test_blends_follow_poisson():
    import pandas as pd

    how = Blends(fwhm=6.1, trials=100_000)
    rng = np.random.Generator(np.random.Philox(5))
    offset, contam, share = simulated(np.array([0.08]), np.array([1.0]), np.array([0.1]), how, rng)
    assert share[0] == pytest.approx(1 - math.exp(-0.08), abs=0.004) and (offset[contam == 0] == 0).all()
    assert contam.mean() == pytest.approx(0.08 * 10**-0.4, rel=0.03)
    model = pd.DataFrame({"mag": [11.0], "density": [1000.0], "width": [0.1]})
    one, two = (cell_auf(1.0, 10.0, model, how, "k") for _ in range(2))
    assert one == two and one["fourier"][0] == pytest.approx(1, abs=0.05) and one["cumulative"][-1] == pytest.approx(1)


def test_planted_uncertainty_correction(spark):
    """Offsets at twice the quoted uncertainty."""
    rng = np.random.default_rng(7)
    rows = [(0, s, 0.05 * (s + 1), float(r)) for s in range(4) for r in rng.rayleigh(2 * 0.05 * (s + 1), 1500)]
    df = spark.createDataFrame(rows, "pt int, slice int, sig double, sep double")
    got = corrections(df, 1e-4, ["pt"], r_max=2.0, bins=80).head()
    assert got.m == pytest.approx(2, rel=0.08) and got.n < 0.05 and got.slices == 4


def test_generated_catalogues_match(spark):
    from skyweave.sources.generated import catalogues

    for shape in ("rectangle", "circle"):
        a, b = (c.withColumns({f"mag{i + 1}": F.get("mags", F.lit(i)) for i in range(4)}) for c in catalogues(spark, 40, 50, 35, (130.5, 131.5, -0.5, 0.5), 0.1, 0.1, shape=shape, seed=9999))
        m = CrossMatch(a, b, 2.0, 0.999, area=1.0, bands=("mag1", "mag2", "mag3", "mag4"))
        assert {(r.a, r.b) for r in m.matches.collect()} >= {(i, i) for i in range(34)}


def test_shift_of_blended_profiles():
    from skyweave.operators.psf import fitted_polynomial, shift

    r = np.linspace(0.01, 6, 200)
    assert np.allclose(shift(0.001, r), 0.001 * r * np.exp(-(r**2) / 4), atol=2e-5)
    assert np.allclose(shift(0.5, 0.01), 0.5 * 0.01 / 1.5, rtol=1e-3) and shift(0.5, 6.0) < 0.01
    assert len(fitted_polynomial(r, 1 + 2 * r**3, 1e-3)) == 5


def test_interior_points():
    from skyweave.operators.regions import interior_points

    points = interior_points([(0, 0), (2, 0), (1, 3)])
    assert len(points) >= 30 and all(0 < y < 3 * min(x, 2 - x) for x, y in points)


def test_pairs_with_blends_agree_with_the_closed_form(spark):
    """Where no source is blended, transforms are one everywhere."""
    from skyweave.operators.auf import with_blends

    how = Blends(fwhm=1.0, rho_max=6.0, rho_bins=1200)
    aufs = spark.createDataFrame([(1, [1.0] * 1200, [0.0, 0.0], 0.0), (2, [1.0] * 1200, [0.5, 0.9], 0.1)], "nm int, fourier array<double>, frac array<double>, flux double")
    rows = spark.createDataFrame([(s / 10, 0.3, 0.5, 1, 1 + s % 2) for s in range(1, 15)], "sep double, sig_a double, sig_b double, nm_a int, nm_b int")
    for r in with_blends(rows, aufs, aufs, how).collect():
        assert r.cdf == pytest.approx(1 - math.exp(-(r.sep**2) / 0.68), abs=1e-3)
        assert r.g == pytest.approx(math.exp(-(r.sep**2) / 0.68) / (math.pi * 0.68) * 3600**2, rel=1e-2)
        assert r.contam_a == [0, 0] and r.contam_b == pytest.approx([0.5, 0.9] if r.nm_b == 2 else [0, 0])


def test_ids_are_in_file_order_however_files_are_split(spark, tmp_path):
    lines = [f"{131 + i / 1e5},{i % 90},0.1,12.5,11.0,0,0" for i in range(40_000)]
    for name in "xy":
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = catalog.read_csv(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")], catalog.Layout((0, 1, 2), (3, 4), 5, 6), ("file_path",))
        assert rows.rdd.getNumPartitions() > 5
        got = rows.where(F.round((F.col("lon") - 131) * 1e5) == F.col("id")).groupBy("file_path").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["count"] for r in got] == [40_000, 40_000]


def star_counts(path):
    rng = np.random.default_rng(5)
    mags = 18 - rng.exponential(1.4, 6000)
    path.write_text("#area = 0.02 sq deg\n#Av at infinity = 0.1\n#x y\n" + "".join(f"{m:.3f} {m + 0.2:.3f}\n" for m in mags))


@pytest.mark.parametrize(("blends", "photometry"), [(True, False), (True, True), (False, True)])
def test_engine_with_all_switches(spark, tmp_path, blends, photometry):
    """Two chunks, one of them across longitude zero, each with two sky cells; CSV in, CSV out."""
    rng = np.random.default_rng(12)
    for k, lon in ((1, 131), (2, 0)):
        star_counts(tmp_path / f"counts_{k}.dat")
        for name, rows in zip("ab", planted(lon, 700, 800, 600), strict=True):
            (tmp_path / f"{name}_{k}.csv").write_text("".join(f"{i},{float(x)!r},{float(y)!r},0.15,{10 + i % 50 / 10 + rng.normal(0, 0.05)},{11 + i % 40 / 10},{i % 2},0\n" for i, x, y in rows))
    joint, a, b = settings_of(tmp_path)
    joint |= {"include_perturb_auf": blends, "include_phot_like": photometry, "use_phot_priors": photometry, "num_trials": 500, "d_mag": 0.5, "make_output_csv": True}
    joint["cf_region_points_per_chunk"] = [[130.9, 131.1, 2, 0, 0, 1], [-0.1, 0.1, 2, 0, 0, 1]]
    for side in (a, b):
        side |= {"psf_fwhms": [0.5, 0.6], "tri_filt_names": ["x", "y"], "auf_file_path": f"{tmp_path}/counts_{{}}.dat", "dens_dist": 0.02}
    out = Engine(spark, config.settings(joint, a, b)).run()
    got = {(str(p).split("chunk_id=")[1][0], *line.split(",")) for p in (tmp_path / "out" / "matches").rglob("*.csv") for line in p.read_text().splitlines()}
    found = {(g[0], int(g[1]), int(g[2])) for g in got}
    true = {(k, i, i) for k in "12" for i in range(600)}
    assert len(found & true) > 1130 and len(found - true) < 40
    one = next(g for g in got if g[1] == g[2] == "7" and g[0] == "1")
    line = next(x for x in (tmp_path / "a_1.csv").read_text().splitlines() if x.startswith("7,")).split(",")
    assert line[1] in one and line[4] in one
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.csv")}
    Engine(spark, config.settings(joint, a, b)).run()
    assert stamp == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.csv")}


GALAXIES = {"z": [0.0, 0.2, 0.5, 1.0], "kcorr": {"blue": [0.1, 0.3, 0.8]}, "schechter": {"blue": [0.005, -20.5, -1.2, 0.2, 1.0]}, "extinctions": [0.0, 0.2]}


def test_engine_with_galaxies_bright_counts_and_both_simulations(spark, tmp_path):
    rng = np.random.default_rng(12)
    star_counts(tmp_path / "counts_1.dat")
    star_counts(tmp_path / "bright_1.dat")
    np.save(tmp_path / "dd_params.npy", np.full((5, 3, 2), 0.1))
    np.save(tmp_path / "l_cut.npy", np.array([0.01, 0.1, 0.9]))
    for name, rows in zip("ab", planted(131, 700, 800, 600), strict=True):
        (tmp_path / f"{name}_1.csv").write_text("".join(f"{i},{float(x)!r},{float(y)!r},0.15,{10 + i % 50 / 10 + rng.normal(0, 0.05)},{11 + i % 40 / 10},{i % 2},0,{5 + i % 90},{8 + i % 50}\n" for i, x, y in rows))
    joint, a, b = settings_of(tmp_path, (1,))
    joint |= {"include_perturb_auf": True, "num_trials": 300, "d_mag": 0.5, "psf_params_path": str(tmp_path)}
    for side in (a, b):
        side |= {"psf_fwhms": [0.5, 0.6], "tri_filt_names": ["x", "y"], "auf_file_path": f"{tmp_path}/counts_{{}}.dat", "auf_bright_file_path": f"{tmp_path}/bright_{{}}.dat", "dens_dist": 0.02, "snr_indices": [8, 9]}
        side |= {"fit_gal_flag": True, "gal_parameters": [GALAXIES, GALAXIES], "saturation_magnitudes": [10.5, 10.5], "run_fw_auf": True, "run_psf_auf": True}
    out = Engine(spark, config.settings(joint, a, b)).run()
    pairs = {(r.a, r.b) for r in spark.read.parquet(out["matches"]).collect()}
    assert len(pairs & {(i, i) for i in range(600)}) > 560 and len(pairs) < 625
    del b["snr_indices"]
    with pytest.raises(ValueError, match="snr_indices"):
        config.settings(joint, a, b)


def test_a_chunk_that_fails_does_so_alone(spark, tmp_path):
    """Of three chunks the second has counterparts that are all of one side and next to none of the other."""
    rng = np.random.default_rng(12)
    few, many = 25, 6000
    for k in (1, 2, 3):
        a, b = planted(131, 400, 400, 350)
        if k == 2:
            b = [(i, 131 + x, y) for i, (x, y) in enumerate(rng.uniform(-0.2, 0.2, (many, 2)))]
            a = [(i, x + 1e-6, y) for i, x, y in b[:few]]
            a += [(few + i, 131 + x, y) for i, (x, y) in enumerate([(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2)])]
            b += [(many + i, x, y) for i, (_, x, y) in enumerate(a[few:])]
        for name, rows in (("a", a), ("b", b)):
            (tmp_path / f"{name}_{k}.csv").write_text("".join(f"{i},{float(x)!r},{float(y)!r},{0.02 if k == 2 else 0.15},{10 + i % 50 / 10},,0,0\n" for i, x, y in rows))
    joint, a, b = settings_of(tmp_path, (1, 2, 3))
    joint |= {"include_phot_like": True, "use_phot_priors": True, "int_fracs": [0.63, 0.9, 0.999], "chunks_per_batch": 2}
    out = Engine(spark, config.settings(joint, a, b)).run()
    done = {p.name for p in (tmp_path / "out" / "_done").iterdir() if not p.name.startswith(".")}
    assert done == {"1", "3"}
    got = {r.chunk_id: r.n for r in spark.read.parquet(out["matches"]).groupBy("chunk_id").agg(F.count("*").alias("n")).collect()}
    assert got.keys() == {1, 3} and min(got.values()) > 300
    bad = spark.read.parquet(out["rejects"]).where("chunk_id = 2")
    assert bad.where("reason LIKE 'cell %: counterparts are all of one side%'").count() == bad.count() == few + 4 + many + 4
    said = [json.loads(p.read_text()) for p in (tmp_path / "out" / "_manifest").glob("*.json")]
    assert sorted(c for x in said for c in x["done"]) == ["1", "3"] and [list(x["failed"]) for x in said if x["failed"]] == [["2"]]
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet") if "chunk_id=2" not in str(p)}
    Engine(spark, config.settings(joint, a, b)).run()
    assert stamp == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet") if "chunk_id=2" not in str(p)}


def test_contradictions_and_floors():
    from skyweave.operators.photometry import contradiction, floored

    assert contradiction(1.0, (1.0, float("nan"))) and contradiction(0.0, (0.0, 1.0)) and contradiction(1.0, (0.001, 1000.0)) and contradiction(1.0, (1000.0, 0.0))
    assert contradiction(1.0, (0.001, 50.0)) is None and contradiction(0.0, (1.0, 1.0)) is None and contradiction(1.0, (0.0, 0.0)) is None
    assert floored(0.0, (1.0, 2.0)) == (0.01, 1.0, 2.0) and floored(1.0, (0.0, 0.5)) == (1.0, 0.01, 0.5) and floored(0.0, (0.0, 2.0))[0] == 0.0


@pytest.mark.parametrize(("where", "key", "value", "message"), [(1, "psf_fwhms", None, "psf_fwhms"), (1, "fit_gal_flag", True, "gal_parameters"), (2, "run_psf_auf", True, "run_psf_auf"), (0, "num_trials", None, "num_trials"), (2, "dens_dist", "x", "number"), (1, "psf_fwhms", [0.5], "each filter")])
def test_settings_of_blends_are_checked(tmp_path, where, key, value, message):
    parts = settings_of(tmp_path)
    parts[0].update({"include_perturb_auf": True, "num_trials": 10, "d_mag": 0.1})
    for side in parts[1:]:
        side.update({"psf_fwhms": [0.5, 0.6], "tri_filt_names": ["x", "y"], "auf_file_path": "c_{}.dat", "dens_dist": 0.02})
    parts[where][key] = value
    if value is None:
        del parts[where][key]
    with pytest.raises(ValueError, match=message):
        config.settings(*parts)


def test_a_chunk_without_matches_is_done(spark, tmp_path):
    for name, lat in (("a", 0.0), ("b", 1.0)):
        (tmp_path / f"{name}_1.csv").write_text("".join(f"{i},{131 + i * 0.01},{lat + i % 3 * 0.01},0.3,12.0,,0,0\n" for i in range(20)))
    found = config.settings(*settings_of(tmp_path, (1,)))
    out = Engine(spark, found).run()
    assert spark.read.parquet(out["nonmatches_a"]).count() == spark.read.parquet(out["nonmatches_b"]).count() == 20
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    Engine(spark, found).run()
    assert stamp == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}


def test_cells_have_priors_of_their_own(spark):
    """Twice as many of the second catalogue's sources on one side: its density doubles there and nowhere else."""
    rng = np.random.default_rng(4)
    rows = [(i, 10 + x, y) for i, (x, y) in enumerate(rng.uniform(0, 1, (3000, 2)))]
    more = [(10_000 + i, 10 + x / 2, y) for i, (x, y) in enumerate(rng.uniform(0, 1, (1500, 2)))]
    a, b = (cat(spark, r).withColumns({"sig": F.lit(0.1), "mag1": F.lit(12.0), "best": F.lit(0)}) for r in (rows, [*rows, *more]))
    points = spark.createDataFrame([(0, 10.25, 0.5), (1, 10.75, 0.5)], "pt int, lon double, lat double")
    m = CrossMatch(a, b, bands=("mag1",), points=points)
    field = {r.cell: r for r in m.field.collect()}
    assert field[0].area == pytest.approx(0.5, rel=0.02) == field[1].area and field[0].nb[0] / field[1].nb[0] == pytest.approx(2, rel=0.15)
    pairs = m.matches.count()
    assert pairs > 2900


def test_grouped_quantiles_are_exact(spark):
    from skyweave.operators.statistics import quantiles

    rng = np.random.default_rng(5)
    values = {"hot": rng.normal(size=4000), "same": np.full(500, 3.25), "one": np.array([7.0]), "two": np.array([-1.0, 4.0]), "wide": 10.0 ** rng.uniform(-300, 300, 301), "ties": rng.integers(0, 4, 777).astype(float)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = (0.0, 0.05, 0.16, 0.5, 0.84, 0.999, 1.0)
    out = {r.g: r for r in quantiles(df, ["g"], "x", shares).collect()}
    assert out.keys() == values.keys()
    for g, vs in values.items():
        assert out[g].n == len(vs) and out[g].q == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-12)
    (whole,) = quantiles(df.where("g <> 'wide'"), [], "x", (0.25, 0.5)).collect()
    assert whole.q == pytest.approx(np.quantile(np.concatenate([v for g, v in values.items() if g != "wide"]), (0.25, 0.5)).tolist())
    assert quantiles(df.limit(0), ["g"], "x", shares).collect() == []


@pytest.mark.parametrize(("n", "radius", "lon", "lat"), [(100, 0.3, 40, 0), (1000, 0.1, 0, 60), (5000, 0.1, 359.9, -30)])
def test_local_densities_have_their_true_area(spark, n, radius, lon, lat):
    """Against circles measured by points: edges and corners of the hull, empty sky inside of it, and counts by cell."""
    from skyweave.operators import density, regions

    rng = np.random.default_rng(6)
    flat = math.cos(math.radians(lat))
    xy = rng.uniform(-1, 1, (n, 2))
    df = cat(spark, [(i, (lon + x / flat) % 360, lat + y) for i, (x, y) in enumerate(xy)])
    ring = regions.hulls(df, ()).collect()
    hull = spark.createDataFrame(ring, "shift double, corners array<struct<x:double,y:double>>")
    out = {how: density.local_densities(df, df, radius, hulls=hull, dense=how).toPandas().set_index("id").sort_index() for how in (10**9, 0)}
    corners = np.array([(c.x, c.y) for c in ring[0].corners])
    some = np.concatenate([np.argsort(-np.abs(xy).max(axis=1))[:15], np.argsort(-np.abs(xy).min(axis=1))[:15], np.arange(15)])  # edges, corners, all
    r, t = radius * np.sqrt((np.arange(4000) + 0.5) / 4000), np.arange(4000) * 2.399963
    for i in some.tolist():
        x0, y0 = (lon + xy[i, 0] / flat + ring[0].shift) % 360, lat + xy[i, 1]
        px, py = x0 + r * np.cos(t) / math.cos(math.radians(y0)), y0 + r * np.sin(t)
        turn = np.array([(qx - ax) * (py - ay) - (qy - ay) * (px - ax) for (ax, ay), (qx, qy) in zip(corners, np.roll(corners, -1, axis=0), strict=True)])
        area = (turn >= 0).all(axis=0).mean() * density.circle_area(radius)
        assert out[10**9].density[i] == pytest.approx(out[10**9].n[i] / area, rel=0.02)
    deep = (np.abs(xy) < 1 - 1.5 * radius).all(axis=1)
    assert out[0].density[deep].mean() == pytest.approx(out[10**9].density[deep].mean(), rel=0.05)
    rim = (np.abs(xy) > 1 - radius).any(axis=1)
    assert out[0].density[rim].mean() == pytest.approx(out[10**9].density[rim].mean(), rel=0.05)
    mixed = density.local_densities(df, df, radius, hulls=hull, dense=int(np.median(out[10**9].n) * 2.6)).toPandas()
    assert mixed.density.mean() == pytest.approx(out[10**9].density.mean(), rel=0.05) and len(mixed) == n


@pytest.mark.parametrize(("lon", "lat"), [(131, 0), (0, 60), (359.9, -70)])
def test_areas_and_edges_everywhere(spark, lon, lat):
    from skyweave.operators import regions

    rng = np.random.default_rng(8)
    rows = [(i, (lon + x) % 360, lat + y) for i, (x, y) in enumerate(rng.uniform(-0.5, 0.5, (4000, 2)))]
    df = cat(spark, rows)
    true = math.degrees(math.sin(math.radians(lat + 0.5)) - math.sin(math.radians(lat - 0.5)))
    other = cat(spark, [(i, (x + 0.5) % 360, y) for i, x, y in rows])
    (joint,) = regions.joint_region(df, other, ()).collect()
    assert joint.cells[0].area == pytest.approx(true / 2, rel=0.03)
    assert regions.hull(df).head().area == pytest.approx(true, rel=0.03)
    near = {r.id for r in regions.near_edge(df, 0.01 * 3600, ()).collect()}
    depth = {i: min(0.5 - abs((x - lon + 180) % 360 - 180), 0.5 - abs(y - lat)) for i, x, y in rows}
    wide = {i: min((0.5 - abs((x - lon + 180) % 360 - 180)) * math.cos(math.radians(lat)), 0.5 - abs(y - lat)) for i, x, y in rows}
    assert all(wide[i] < 0.025 for i in near) and all(i in near for i in wide if depth[i] < 0.0005)


def test_the_inflation_of_a_circle():
    from skyweave.operators.regions import inflation

    x = 1 / inflation(0.1)
    assert (math.acos(x) - x * math.sqrt(1 - x * x)) / math.pi == pytest.approx(0.1, abs=1e-3)


def test_planted_corrections_by_sightline(spark):
    """Two sightlines, one across longitude zero, two visits, offsets at twice the quoted uncertainty, and simulated blends on top."""
    from skyweave.operators import auf
    from skyweave.operators import calibration as cal

    rng = np.random.default_rng(17)
    some = cal.boxes([(0, 0.0, 0.0), (1, 40.0, 60.0)], 0.64, 0.8)
    assert [b.area for b in some] == pytest.approx([0.64, 0.64]) and some[1].half > 1.9 * some[0].half
    n, how = 4000, Blends(fwhm=1.0, trials=5000, rho_max=4.0, rho_bins=200)
    model = [(11.0, n / 0.64 / 0.5, 0.5), *((13.25 + k, 2e5 * 2.0**k, 0.5) for k in range(5))]
    a, b = [], []
    for box in some:
        flat = math.cos(math.radians((box.low + box.high) / 2))
        x, y = box.lon + rng.uniform(-box.half, box.half, n), rng.uniform(box.low, box.high, n)
        b += [(box.pt * 10_000 + i, float(x[i] % 360), float(y[i])) for i in range(n)]
        for visit, k in itertools.product((0, 1), range(4)):
            sig, middle, ids = 0.08 + 0.04 * k, 12.5 + k, np.arange(k, n, 4)
            fainter = np.array([m for m in model if m[0] >= middle])
            off = auf.simulated(auf.expected(fainter[:, 1], fainter[:, 2], 1.0, how.radius), fainter[:, 0] - middle, fainter[:, 2], replace(how, trials=len(ids)), rng)[0]
            turn = rng.uniform(0, 2 * math.pi, len(ids))
            dx, dy = rng.normal(0, 2 * sig, (2, len(ids))) + off * np.array([np.cos(turn), np.sin(turn)])
            a += [(int(box.pt * 10_000 + i), float((x[i] + u / 3600 / flat) % 360), float(y[i] + v / 3600), sig, middle, visit) for i, u, v in zip(ids, dx, dy, strict=True)]
    cat_ = spark.createDataFrame(a, "id bigint, lon double, lat double, sig double, m double, visit int")
    counts = spark.createDataFrame([(pt, *m) for pt in (0, 1) for m in model], "pt int, mag double, density double, width double")
    fits, slices, quality = cal.calibrate(cat_, cat(spark, b), some, 0.2, 2.0, "m", step=1.0, visit="visit", model=counts, limit=12.0, how=how, fwhm=1.0)
    found = fits.collect()
    assert {r.pt for r in found} == {0, 1} and all(r.slices == 4 and r.m == pytest.approx(2, rel=0.05) and r.n < 0.08 for r in found)
    each = slices.collect()
    assert len(each) == 8 and all(r.fit_sig == pytest.approx(2 * r.sig, rel=0.08) and 1800 < r.n <= 2000 for r in each)
    shown = quality.toPandas()
    assert len(shown) == 8 * 60 and shown.distance.max() < 0.05 and (shown.share < 0.1).all()


def test_tails_of_shifts(spark, tmp_path):
    """The table gives the fitted centres that it was made from."""
    from skyweave.operators import psf

    fluxes, r, cuts = np.linspace(0.05, 0.9, 35), np.linspace(0, 6, 121), (0.04, 0.5, 0.95)
    rows = psf.skew_tails(psf.shift_grid(spark, fluxes, r)).orderBy("flux").collect()
    tails = np.array([x.tail for x in rows])
    for x in rows[::6]:
        far = r > x.tail[4]
        assert np.abs(psf.skew(np.array(x.tail[:4]), r[far], x.flux) - psf.shift(x.flux, r[far])).max() < 0.05
    table = psf.parameter_table(fluxes, tails, cuts)
    at = np.linspace(0.1, 5.5, 60)
    for f in (0.1, 0.3, 0.7):
        dx, dy = psf.table_shift(table, cuts, at, np.zeros(60), np.full(60, f))
        assert np.abs(dx - psf.shift(f, at)).max() < 0.1 and (dy == 0).all()
        assert np.allclose(psf.table_shift(table, cuts, -at, np.zeros(60), np.full(60, f))[0], -dx)
    np.save(tmp_path / "dd_params.npy", table)
    np.save(tmp_path / "l_cut.npy", np.array(cuts))
    back, found = config.psf_parameters(str(tmp_path))
    assert (back == table).all() and found == cuts
    how = Blends(fwhm=3.0, trials=4000, algorithm="psf", table=tuple(tuple(map(tuple, x)) for x in table.tolist()), l_cut=cuts)
    offset, contam, share = simulated(np.array([0.5]), np.array([1.0]), np.array([0.5]), how, np.random.default_rng(1))
    assert share[0] == pytest.approx(1 - math.exp(-0.5), abs=0.03) and 0 < offset.max() < how.radius and (offset[contam == 0] == 0).all()
    np.save(tmp_path / "l_cut.npy", np.zeros(2))
    with pytest.raises(ValueError, match="three fluxes"):
        config.psf_parameters(str(tmp_path))


def test_region_points_as_rows(spark):
    for kind, points in (("rectangle", [131, 134, 4, -1, 1, 3]), ("rectangle", [5, 5, 1, 2, 3, 2]), ("points", [[1, 2], [3, 4]])):
        rows = [(r.pt, round(r.lon, 9), round(r.lat, 9)) for r in catalog.region_points(spark, kind, points).collect()]
        assert sorted(rows) == [(i, round(x, 9), round(y, 9)) for i, x, y in catalog.region_rows(kind, points)]


def test_outputs_have_contamination_fitted_uncertainties_and_extras(spark, tmp_path):
    """Of a match with blends, corrections, epochs of rows and columns taken along; one side in galactic coordinates like the other."""
    rng = np.random.default_rng(12)
    star_counts(tmp_path / "counts_1.dat")
    a, b = planted(131, 300, 350, 250)
    years = ["J2015.5", "2010-01-01", "2000"]
    moved = lambda i: (2020 - (2015.5, 2010, 2000)[i % 3]) * 0.3 / 3600  # noqa: E731  each row stands where it was at its epoch
    (tmp_path / "a_1.csv").write_text("".join(f"{i},{float(x)!r},{float(y - moved(i))!r},0.15,{12 + i % 30 / 10},{13.5},{i % 2},0,0.0,0.3,{years[i % 3]},tag{i}\n" for i, x, y in a))
    (tmp_path / "b_1.csv").write_text("".join(f"{i},{float(x)!r},{float(y)!r},0.15,{12 + i % 30 / 10 + rng.normal(0, 0.05)},{13.5},{i % 2},0\n" for i, x, y in b))
    joint, one, two = settings_of(tmp_path, (1,))
    for part, key in ((joint, "cf_region_frame"), (one, "auf_region_frame"), (two, "auf_region_frame")):
        part[key] = "galactic"
    joint |= {"include_perturb_auf": True, "num_trials": 300, "d_mag": 0.5}
    for side in (one, two):
        side |= {"psf_fwhms": [2.0, 2.0], "tri_filt_names": ["x", "y"], "auf_file_path": f"{tmp_path}/counts_{{}}.dat", "dens_dist": 0.02}
    one |= {"apply_proper_motion": True, "pm_indices": [8, 9], "ref_epoch_or_index": 10, "move_to_epoch": "J2020", "extra_col_nums": [11], "extra_col_names": ["name"], "correct_astrometry": True}
    out = Engine(spark, config.settings(joint, one, two), {"a": [(131.0, 0.0, 1.2, 0.1)]}).run()
    rows = spark.read.parquet(out["matches"]).collect()
    assert len({(r.a, r.b) for r in rows} & {(i, i) for i in range(250)}) > 230 and len(rows) < 260
    assert all(r.a_name == f"tag{r.a}" and r.a_sig == 0.15 and r.a_FIT_SIG == pytest.approx(math.hypot(0.18, 0.1)) for r in rows) and "b_FIT_SIG" not in rows[0]
    assert all(0 <= r.a_CONT_F10 <= r.a_CONT_F1 + 1e-9 <= 1 + 2e-9 and r.b_AVG_CONT >= 0 for r in rows) and sum(r.a_AVG_CONT for r in rows) > 0
    left = spark.read.parquet(out["nonmatches_a"]).collect()
    assert all(r.a_name == f"tag{r.id}" and r.a_AVG_CONT is not None and r.a_FIT_SIG > 0.2 for r in left) and {r.id for r in left} >= set(range(255, 300))


def test_engine_computes_corrections_from_its_settings(spark, tmp_path):
    """Quoted uncertainties are half of the true ones; a better catalogue says so."""
    rng = np.random.default_rng(21)
    n = 3000
    x, y = 131 + rng.uniform(-0.3, 0.3, n), rng.uniform(-0.3, 0.3, n)
    sig = 0.08 + 0.04 * (np.arange(n) % 3)
    off = lambda s: rng.normal(0, s / 3600, n)
    lines = lambda lon, lat, s: "".join(f"{i},{float(lon[i])!r},{float(lat[i])!r},{s[i]:.3f},{12 + i % 3 + 0.2},,0,0\n" for i in range(n))
    (tmp_path / "a_1.csv").write_text(lines(x + off(2 * sig), y + off(2 * sig), sig))
    (tmp_path / "b_1.csv").write_text(lines(x + off(0.05), y + off(0.05), np.full(n, 0.05)))
    (tmp_path / "best.csv").write_text("".join(f"{float(u)!r},x,{float(v)!r}\n" for u, v in zip(x, y, strict=True)))
    joint, a, b = settings_of(tmp_path, (1,))
    a |= {"correct_astrometry": True, "correct_astro_csv_file_path": str(tmp_path / "best.csv"), "correct_astro_pos_indices": [0, 2], "correct_astro_sightlines": [[131.0, 0.0]], "correct_astro_area": 0.25, "correct_astro_height": 0.5, "correct_astro_dens_dist": 0.1, "correct_astro_nn_radius": 2.0, "correct_astro_mag_step": 1.0}
    engine = Engine(spark, config.settings(joint, a, b))
    rows = spark.read.parquet(engine.run()["matches"]).select("a_sig", "a_FIT_SIG").collect()
    ((lon, lat, m, n_),) = engine.corrections["a"]
    assert (lon, lat) == (131.0, 0.0) and m == pytest.approx(2, rel=0.08) and n_ < 0.08
    assert len(rows) > 2700 and all(r.a_FIT_SIG == pytest.approx(2 * r.a_sig, rel=0.1) for r in rows)
    del a["correct_astro_area"]
    with pytest.raises(ValueError, match="correct_astro_area"):
        config.settings(joint, a, b)


def test_stored_catalogues_meet_without_a_shuffle(spark):
    from skyweave.operators.spatial import radius_join
    from skyweave.sources import skystore

    rng = np.random.default_rng(3)
    a, b = (cat(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(zip((rng.uniform(-1, 1, 3000) + 0.5) % 360, rng.uniform(-3, 3, 3000), strict=True))]) for _ in range(2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one, two = (skystore.stored(x, 0.02, buckets=4) for x in (a, b))
        joined = one.join(two)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        keys = lambda df: {(r.a_id, r.b_id, round(r.sep, 6)) for r in df.collect()}
        assert keys(joined) == keys(radius_join(a, b, 0.02)) != set()
        part = one.slice(-0.2, 0.3, 0.2, 0.7)
        files = lambda df: {r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()}
        seen = {r.id for r in part.select("id").collect()}
        assert seen == {r.id for r in a.where("(lon >= 359.8 OR lon <= 0.3) AND lat BETWEEN 0.2 AND 0.7").collect()} != set()
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(__stripe" in plan
        assert len(files(one.own.where("__stripe BETWEEN 90 AND 90"))) < len(files(one.own)) / 4
        with pytest.raises(ValueError, match="same radius"):
            one.join(skystore.stored(b, 0.03, buckets=4))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in (one, two):
            t.drop()


def test_shares_of_cells_by_a_quadtree():
    from skyweave.operators.regions import cell_shares

    ring = np.array([(10.0, -1.0), (12.0, -1.0), (12.0, 1.0), (10.0, 1.0)])
    assert cell_shares(ring, np.array([(10.5, 0.0), (11.5, 0.0)])) == pytest.approx([0.5, 0.5], abs=1e-3)
    assert cell_shares(ring, np.array([(10.5, 0.0), (12.5, 0.0)])) == pytest.approx([0.75, 0.25], abs=1e-3)
    assert cell_shares(ring, np.array([(11.0, 0.0), (40.0, 0.0)])) == pytest.approx([1.0, 0.0])
    triangle, points = np.array([(0.0, 0.0), (3.0, 0.2), (0.7, 2.0)]), np.array([(0.5, 0.4), (1.5, 0.5), (1.0, 1.4)])
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 3, (400_000, 2))
    turn = [(q[0] - p[0]) * (xy[:, 1] - p[1]) - (q[1] - p[1]) * (xy[:, 0] - p[0]) for p, q in zip(triangle, np.roll(triangle, -1, axis=0), strict=True)]
    inside = xy[(np.array(turn) >= 0).all(axis=0)]
    nearest = ((inside[:, None, :] - points) ** 2).sum(axis=2).argmin(axis=1)
    assert cell_shares(triangle, points) == pytest.approx((np.bincount(nearest) / len(nearest)).tolist(), abs=0.005)


@pytest.mark.parametrize("keys", [24_000, 400_000])
def test_counts_of_the_same_or_nearly_the_same_shape_are_rescaled(spark, tmp_path, keys):
    """Whole periods of the keys, where only the sum of both factors is determined; and bins that differ by one part in 2800, where each is."""
    from skyweave.operators import counts
    from skyweave.plans import queries_more

    spark.range(keys).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    out = queries_more.count_rescale(spark, str(tmp_path)).collect()
    assert len({r.bin for r in out}) == len(out) == 16 and all(r.near_stars and r.near_galaxies and r.fits for r in out)
    k = np.arange(keys)
    of = lambda pt: np.bincount((k[k % 3 == pt] * 7919 % 8000) // 500).tolist()
    rows = [(0, 0.5 * i, float(s), float(g)) for i, (s, g) in enumerate(zip(of(0), of(1), strict=True))]
    model = spark.createDataFrame(rows, "band int, mag double, density double, galaxies double")
    fit = counts.fitted_factors(model.selectExpr("band", "mag", "2 * density + 0.5 * galaxies as density"), model, ()).head()
    assert fit.determined == (keys == 400_000) and fit.stars + fit.galaxies == pytest.approx(2.5) and fit.residual < 1e-9
    assert not fit.determined or (fit.stars, fit.galaxies) == (pytest.approx(2), pytest.approx(0.5))


def test_combinations_are_of_islands_of_any_size(spark, tmp_path):
    """31 customers at one place, more than the match enumerates, and other islands."""
    from skyweave.plans import queries, queries_more

    same = 10 * 100003 * 99991  # keys that differ by this have the same place
    crowd = [10 + i * same for i in range(31)]
    spark.createDataFrame([(k,) for k in sorted({*range(100), *crowd})], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(90).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in queries_more.combinations(spark, str(tmp_path)).collect()]
    islands = {}
    for r in queries.islands(spark, str(tmp_path)).where("vertex % 2 = 0").collect():
        islands.setdefault(r.island, []).append(r.vertex // 2)
    assert set(itertools.combinations(crowd, 2)) < set(got)
    assert sorted(got) == sorted(p for ids in islands.values() for p in itertools.combinations(sorted(ids), 2))
