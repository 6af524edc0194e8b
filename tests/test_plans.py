"""What the plans must not do, and what must reach the scans."""

import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import blending, density
from skyweave.operators import islands as isl
from skyweave.operators import photometry as phot
from skyweave.operators import regions, spatial
from skyweave.plans import match
from skyweave.plans import queries as core
from skyweave.plans import queries_more as more
from skyweave.sources import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cats")
    for name in "ab":
        rows = spark.range(200).selectExpr("id", "131 + id / 1000.0D as lon", "id % 7 / 1000.0D as lat", "0.3D as sig", "10 + id % 50 / 10.0D as mag1", "10.5D as mag2", "0 as best", "false as halo", "'long' as remark")
        rows.write.parquet(str(folder / name))
    return [spark.read.parquet(str(folder / name)) for name in "ab"]


def test_no_cross_product_in_spatial_joins(stored):
    a, b = stored
    pairs = isl.overlap_pairs(a, b, 2.92, 0.999)
    for df in (pairs, spatial.mutual_nn(a, b, 0.001), spatial.local_density(b, 0.01), phot.brightest(a, "mag1", pairs, b, "mag1", 0.9)):
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan(df))


def test_scans_read_what_is_needed(stored):
    a, b = stored
    text = plan(isl.overlap_pairs(a, b, 2.92, 0.999))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(set(re.findall(r"(\w+):", s)) == {"id", "lon", "lat", "sig"} for s in schemas)


def test_slices_are_pushed_to_the_scan(stored):
    text = plan(catalog.sliced(stored[0], 131, 131.05, 0, 0.003))
    assert "GreaterThanOrEqual(lat" in text and "LessThanOrEqual(lat" in text


def test_no_python_in_the_match_up_to_its_kernel(stored):
    a, b = stored
    pairs = isl.overlap_pairs(a, b, 2.92, 0.999)
    for df in (pairs, isl.integral_area(a, pairs, "a", 0.9), phot.field_mask(a, "mag1", pairs, "a", b, "mag1", (0.63, 0.9)), phot.adaptive_bins(a, "mag1")):
        assert not re.search("Python|Arrow|Pandas", plan(df))


def test_joins_of_catalogues_gather_neither_side(stored):
    """Tables of a few rows, which Spark would broadcast: what it takes for small is what is read, not what is repeated by cell."""
    a, b = stored
    pairs = isl.overlap_pairs(a, b, 2.92, 0.999)
    members = isl.membership(a, b, pairs.selectExpr("2 * a as vertex", "2 * a as island"))
    plans = [
        pairs, spatial.mutual_nn(a, b, 0.001), spatial.local_density(b, 0.01), isl.overlap_counts(a, pairs, "a"), isl.integral_area(a, pairs, "a", 0.9), members,
        isl.edge_reject(members, a.selectExpr("'a' as side", "id"))[0], phot.field_mask(a, "mag1", pairs, "a", b, "mag1", (0.63, 0.9)), phot.brightest(a, "mag1", pairs, b, "mag1", 0.9),
        match.core_matches(pairs, a, b), match.core_nonmatches(members, a, b)[0],
    ]
    for df in plans:
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)


@pytest.mark.parametrize("name", ["integral_area", "local_density", "contam_prob", "eta_xi", "brightest_mag", "field_mask"])
def test_queries_of_pairs_gather_no_catalogue(spark, tmp_path, name):
    """Tables of a few rows, which Spark would broadcast."""
    spark.range(300).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    text = plan(core.QUERIES[name](spark, str(tmp_path)))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def bins_by_cell(cat):
    return phot.adaptive_bins(cat.selectExpr("0 as cell", "best as band", "mag1 as mag"), "mag", ("cell", "band"))


def densities_by_cell(cat):
    return density.local_densities(cat, cat, 0.01, hulls=regions.hulls(cat, ()), dense=0)


def at_edges(cat):
    return regions.near_edge(cat, 2.92, ())


@pytest.mark.parametrize("found", [bins_by_cell, densities_by_cell, at_edges])
def test_of_a_catalogue_and_a_few_rows_the_few_rows_are_broadcast(stored, found):
    """Spark takes an aggregate to be as large as what it is made of, and broadcast the catalogue where it was narrower."""
    text = plan(found(stored[0]))
    assert "BuildRight" in text and "BuildLeft" not in text


def test_local_densities_are_joined_once_for_sources_and_their_cells(spark, stored):
    """Sources and cells each went through the range joins of the densities again."""
    model = spark.range(20).selectExpr("0 as band", "id + 0.5D as mag", "10.0D as density", "1.0D as width")
    marked, cells = blending.with_cells(stored[0], ("mag1",), model, 0.01)
    assert "Join" not in plan(marked) and "near_row" not in plan(cells)
    assert marked.count() == 200 and marked.where("nm <> 0").select("nm").distinct().count() == cells.count() > 0


def test_the_recurrence_joins_the_catalogues_once(spark, tmp_path):
    """Pairs in a bin and pairs in any were counted by a range join each."""
    spark.range(300).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert "__band" not in plan(more.c_recurrence(spark, str(tmp_path)))


def test_accounting_goes_through_what_is_left_over_once(spark, monkeypatch):
    """Each side's count had a plan of its own for the sources without a match."""
    left = spark.range(9).selectExpr("if(id < 4, 'a', 'b') as side", "id as left_over")
    m = SimpleNamespace(a=spark.range(7), b=spark.range(8), matches=spark.range(3), nonmatches=left, too_large=spark.range(0))
    monkeypatch.setattr(core, "match_of", lambda spark, sf_dir: m)
    out = core.accounting(spark, "")
    assert out._jdf.queryExecution().analyzed().toString().count("left_over") == 1
    assert out.columns == ["n_a", "n_b", "matches", "field_a", "field_b", "rejected"] and tuple(out.head()) == (7, 8, 3, 4, 5, 0)


def test_integrals_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """Pairs are few bytes: they went to as few tasks as there are cores, whatever the work for each."""
    spark.range(300).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(more, "INTEGRALS", 20)
    out = more.hankel(spark, str(tmp_path))
    assert "Join" not in plan(out) and "Broadcast" not in plan(out)
    assert out.rdd.getNumPartitions() == 1 + out.count() // 20 > 8


def test_first_look_at_cells_is_evaluated_once_a_source(spark):
    """It was repeated for each cell that was compared with it."""
    sources = spark.range(50).selectExpr("id", "0 as filt", "id / 7.0D as logn", "id % 9 / 2.0D as mag")
    cells = spark.range(80).selectExpr("id as nm", "0 as filt", "id % 10 / 1.1D as cell_logn", "id / 20.0D as cell_mag")
    out = spatial.nearest_cell(sources, cells, ["filt"])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(slice(" in text and not re.search(r"<= array_min\(transform\(slice\(", text)
    every = [(r.nm, r.cell_logn, r.cell_mag) for r in cells.collect()]
    for r in out.join(sources.drop("filt"), "id").collect():
        assert r.nm == min(((r.logn - x) ** 2 + (r.mag - y) ** 2, nm) for nm, x, y in every)[1]


def test_points_in_the_core_of_a_hull_are_not_tested_against_its_edges(spark):
    rng = np.random.default_rng(5)
    turn, far = rng.random(3000) * 2 * np.pi, np.sqrt(rng.random(3000))
    cat = spark.createDataFrame([(float(20 + 2 * r * np.cos(t)), float(r * np.sin(t))) for t, r in zip(turn, far, strict=True)], "lon double, lat double")
    hull = regions.hulls(cat, ())
    points = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform(-1.2, 1.2, (4000, 2)) * [2, 1] + [180, 0]], "x double, y double").crossJoin(hull)
    at = F.col("x"), F.col("y")
    rows = points.select(regions.inside(*at, F.col("corners"), F.col("core")).alias("fast"), regions.inside(*at, F.col("corners")).alias("edges"), regions.inside(*at, F.transform("corners", lambda c: F.struct((c["x"] + 90).alias("x"), c["y"].alias("y"))), F.col("core")).alias("core")).collect()
    assert all(r.fast == r.edges for r in rows)
    assert sum(r.core for r in rows) > 0.9 * sum(r.edges for r in rows) > 1000  # with wrong edges
    assert not any(r.core and not r.edges for r in rows)


def test_hulls_of_many_points_are_those_of_all():
    rng = np.random.default_rng(6)
    for points in (rng.random((5000, 2)), np.round(rng.random((5000, 2)), 1), np.column_stack([rng.random(500), np.full(500, 2.0)])):
        outer = regions.outermost(points)
        assert {tuple(c) for c in regions.convex_hull(points)} <= {tuple(p) for p in outer}
        assert (regions.convex_hull(points) == regions.convex_hull(outer)).all()
    assert len(regions.outermost(rng.random((5000, 2)))) < 1000


def test_leftovers_of_the_engine_are_computed_once(spark, monkeypatch):
    """They are read for rejects and for either side."""
    import __spark_entry__
    from skyweave.plans import engine

    seen = []
    unmatched = engine.unmatched
    monkeypatch.setattr(engine, "unmatched", lambda rest, *a: (seen.append(plan(rest)), unmatched(rest, *a))[1])
    __spark_entry__.queries()["match_file"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("Join" in text or "Exchange" in text for text in seen)
