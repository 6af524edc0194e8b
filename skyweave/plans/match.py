"""The cross-match of two catalogues as one plan over all chunks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import haversine
from ..operators import islands as isl
from ..operators import pairing
from ..operators import photometry as phot
from ..operators import regions
from ..operators.auf import Blends, with_blends
from ..operators.spatial import large_join, radius_join, small_join
from .storage import written

#: Keeps priors and likelihoods from vanishing.
TINY_C, TINY_F = 1e-100, 1e-10


@dataclass
class CrossMatch:
    """Astrometric match with one-sided density priors; each stage is a lazy DataFrame, written where it is used often.

    ``radius`` in arcseconds, ``most`` the CDF above which pairs do not overlap, ``area`` in
    square degrees (that in both catalogues' hulls, if it is not given). ``points`` (keys, pt,
    lon, lat) are the middles of sky cells, which have priors of their own.
    """

    a: DataFrame
    b: DataFrame
    radius: float = 2.92
    most: float = 0.999
    area: float | None = None
    bands: tuple[str, ...] = ("mag1", "mag2")
    keys: tuple[str, ...] = ()
    #: Columns of chunks at whose edges islands are rejected; none are where it is empty.
    edge_keys: tuple[str, ...] = ()
    points: DataFrame | None = None

    @cached_property
    def pairs(self) -> DataFrame:
        return written(isl.overlap_pairs(self.a, self.b, self.radius, self.most, self.keys), "pairs")

    @cached_property
    def components(self) -> DataFrame:
        return isl.islands(self.pairs, self.keys)

    @cached_property
    def all_members(self) -> DataFrame:
        return written(isl.membership(self.a, self.b, self.components, self.keys), "members")

    @cached_property
    def sizes(self) -> DataFrame:
        return isl.size_gate(isl.island_sizes(self.all_members, self.keys))

    @cached_property
    def members(self) -> DataFrame:
        """Members of islands that are small enough and, if asked for, away from the edges."""
        small = large_join(self.all_members, self.sizes.where("not keep").select(*self.keys, "island"), [*self.keys, "island"], "left_anti")
        return large_join(small, self.at_edge.select(*self.keys, "island").distinct(), [*self.keys, "island"], "left_anti") if self.edge_keys else small

    @cached_property
    def at_edge(self) -> DataFrame:
        """Members of islands with a source whose circle leaves its catalogue's region."""
        near = [regions.near_edge(cat, self.radius, self.edge_keys).select(*self.keys, F.lit(side).alias("side"), "id") for side, cat in (("a", self.a), ("b", self.b))]
        return written(isl.edge_reject(self.all_members, near[0].unionByName(near[1]), self.keys)[1], "edge")

    @cached_property
    def too_large(self) -> DataFrame:
        return large_join(self.all_members, self.sizes.where("not keep").select(*self.keys, "island"), [*self.keys, "island"], "left_semi")

    @cached_property
    def region(self) -> DataFrame:
        """A row for each chunk: the hulls of both sides, and the area that is in both, by cell."""
        return written(regions.joint_region(self.a, self.b, self.keys, self.points), "region")

    def celled(self, cat: DataFrame) -> DataFrame:
        """``cat`` with the nearest of its chunk's points as ``cell``; of equally near ones the first."""
        if self.points is None:
            return cat.withColumn("cell", F.lit(0))
        k = list(self.keys)
        some = self.points.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("pt", "lon", "lat"))).alias("points"))  # the settings' own
        at = small_join(cat, some, k, "left")
        near = F.array_min(F.transform("points", lambda p: F.struct(haversine(F.col("lon"), p["lon"], F.col("lat"), p["lat"]).alias("d"), p["pt"].alias("pt"))))
        return at.withColumn("cell", near["pt"]).drop("points")

    def counted(self, cat: DataFrame) -> DataFrame:
        """The sources that densities are made of: those in both catalogues' hulls."""
        if self.area:
            return self.celled(cat)
        k = list(self.keys)
        hulls = self.region.select(*k, "hull_a", "hull_b")  # a row for each chunk
        both = small_join(self.celled(cat), hulls, k)
        return both.where(regions.in_joint(F.col("lon"), F.col("lat"))).drop("hull_a", "hull_b")

    @cached_property
    def cells(self) -> DataFrame:
        """(keys, cell, area): of the hulls' common area what is nearest to each point; a circle of the search radius at least."""
        least = F.lit(math.pi * (self.radius / 3600) ** 2)
        if not self.area:
            found = self.region.select(*self.keys, F.explode("cells").alias("c")).select(*self.keys, "c.cell", "c.area")
        elif self.points is not None:
            raise ValueError("cells need the area of the hulls; give either points or an area")
        else:
            found = self.a.select(*self.keys).unionByName(self.b.select(*self.keys)).distinct() if self.keys else self.a.sparkSession.range(1)
            found = found.select(*self.keys, F.lit(0).alias("cell"), F.lit(float(self.area)).alias("area"))
        return found.withColumn("area", F.greatest("area", least))

    @cached_property
    def field(self) -> DataFrame:
        """(keys, cell, area, na, nb): detected sources a square degree in each band of either side, by chunk and cell."""
        k = [*self.keys, "cell"]
        count = lambda cat, name: self.counted(cat).groupBy(*k).agg(F.array(*(F.count(m).cast("double") for m in self.bands)).alias(name))
        both = self.cells.join(count(self.a, "na"), k, "left").join(count(self.b, "nb"), k, "left")
        none = F.array_repeat(F.lit(0.0), len(self.bands))
        return both.select(*k, "area", *(F.transform(F.coalesce(n, none), lambda x: x / F.col("area")).alias(n) for n in ("na", "nb")))

    def sources(self) -> tuple[DataFrame, DataFrame]:
        """Both sides with their priors and likelihoods where photometry is not used; a pair's are those of the second source's cell."""
        field = written(self.field, "field")  # a row for each chunk and cell
        with_field = lambda cat: small_join(self.celled(cat), field, [*self.keys, "cell"])
        counterpart = lambda x, y: F.least(x, y) / 2
        own = lambda n: F.element_at(n, F.col("best") + 1)
        like = F.lit(1 - 1e-10 + TINY_F)
        a = with_field(self.a).withColumn("n", own(F.col("na")) - counterpart(own(F.col("na")), F.col("nb")[0]) + TINY_F).withColumn("f", like).withColumn("slot", F.col("best"))
        b = with_field(self.b).withColumn("n", own(F.col("nb")) - counterpart(own(F.col("nb")), F.col("na")[0]) + TINY_F).withColumn("f", like)
        b = b.withColumn("nc", F.transform("na", lambda n: counterpart(n, own(F.col("nb"))) + TINY_C))
        return a, b.withColumn("c", F.array_repeat(F.lit((1 - 1e-10) ** 2 + TINY_C), len(self.bands)))

    @cached_property
    def grid(self) -> DataFrame:
        a, b = self.sources()
        return written(self.gridded(a, b), "grid")

    def gridded(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return pairing.pair_grid(self.members, a, b, self.keys)

    @cached_property
    def decided(self) -> tuple[DataFrame, DataFrame]:
        found, evidence = pairing.island_matches(self.grid, self.sizes, self.keys)
        return written(found, "matches"), written(evidence, "evidence")

    @cached_property
    def matches(self) -> DataFrame:
        return pairing.match_table(self.grid, *self.decided, self.keys)

    @cached_property
    def nonmatches(self) -> DataFrame:
        return pairing.nonmatch_table(self.members, self.grid, *self.decided, self.keys)


@dataclass
class BlendedMatch(CrossMatch):
    """The match with simulated blends: catalogues have ``nm``, the cell of each source, and ``aufs`` the cells of each side."""

    aufs_a: DataFrame | None = None
    aufs_b: DataFrame | None = None
    how: Blends | None = None

    def blended(self, pairs: DataFrame) -> DataFrame:
        return with_blends(pairs, self.aufs_a, self.aufs_b, self.how)

    @cached_property
    def pairs(self) -> DataFrame:
        cols = [*self.keys, "id", "lon", "lat", "sig", "nm"]
        near = radius_join(self.a.select(cols), self.b.select(cols), self.radius / 3600, self.keys)
        near = near.select(*self.keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sep", *(F.col(f"{w}_{c}").alias(f"{c}_{w}") for c in ("sig", "nm") for w in ("a", "b")))
        return written(self.blended(near).where(F.col("cdf") < self.most), "pairs")

    def gridded(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return pairing.pair_grid(self.members, a, b, self.keys, ("nm",), self.blended)


@dataclass
class PhotometricMatch(CrossMatch):
    """The match with magnitudes: densities, field and counterpart likelihoods by bin, from the catalogues themselves.

    Sources without a magnitude in their best band have no bin; they are ``unbinned``. Without
    ``use_likelihood`` only the densities come from photometry.
    """

    use_likelihood: bool = True

    def __post_init__(self):
        mag = F.element_at(F.array(*self.bands), F.col("best") + 1)
        self.unbinned = self.a.where(mag.isNull()).select(*self.keys, F.lit("a").alias("side"), "id").unionByName(self.b.where(mag.isNull()).select(*self.keys, F.lit("b").alias("side"), "id")).withColumn("reason", F.lit("no bin"))
        self.a, self.b = self.a.where(mag.isNotNull()), self.b.where(mag.isNotNull())

    @cached_property
    def likelihoods(self) -> DataFrame:
        """``photometry.likelihood_table`` of all chunks, cells and pairs of bands."""
        return written(phot.likelihood_table(self.counted(self.a), self.counted(self.b), self.bands, self.pairs, self.cells, self.keys), "likelihoods")

    @cached_property
    def failed(self) -> DataFrame:
        """(keys, reason) of chunks of which some densities contradict each other; the others are matched without them."""
        bad = self.likelihoods.where("error is not null")
        reason = F.format_string("cell %d, bands %d and %d: %s", "cell", "ba", "bb", "error")
        return bad.groupBy(*self.keys).agg(F.min(reason).alias("reason")).where("reason is not null")

    def sources(self) -> tuple[DataFrame, DataFrame]:
        k, found = [*self.keys, "cell"], self.likelihoods
        if self.keys:
            found = found.join(self.failed, list(self.keys), "left_anti")
        elif bad := self.failed.head():
            raise ValueError(bad.reason)
        width = found.agg(F.max(F.size("a_bins"))).head()[0] or 0  # slots of a band; a pair of bands has a slot for each of its bins at most
        like = (lambda f: f + TINY_F) if self.use_likelihood else (lambda f: F.lit(1 - 1e-10 + TINY_F))
        a = found.where("bb = 0").select(*k, F.col("ba").alias("band"), (F.col("nfa") + TINY_F).alias("n"), F.posexplode("a_bins").alias("bin", "x"))
        a = a.select(*k, "band", "n", "x.lo", "x.hi", like(F.col("x.f")).alias("f"), (F.col("band") * width + F.col("bin")).alias("slot"))
        flat = found.select(*k, "bb", "ba", "nc", "nfb", F.posexplode("b_bins").alias("bin", "x"), "c")
        pair = F.transform("c", lambda row: (F.get(row, F.col("bin")) if self.use_likelihood else F.lit((1 - 1e-10) ** 2)) + TINY_C)
        padded = F.slice(F.concat(pair, F.array_repeat(F.lit(TINY_C), width)), 1, width)
        flat = flat.select(*k, F.col("bb").alias("band"), "bin", "x.lo", "x.hi", "x.f", "ba", "nfb", padded.alias("c"), F.array_repeat(F.col("nc") + TINY_C, width).alias("nc"))
        each = flat.groupBy(*k, "band", "bin").agg(F.min(F.struct("ba", "lo", "hi", "f", "nfb")).alias("x"), F.array_sort(F.collect_list(F.struct("ba", "c", "nc"))).alias("by"))  # a row for each band
        b = each.select(*k, "band", "x.lo", "x.hi", like(F.col("x.f")).alias("f"), (F.col("x.nfb") + TINY_F).alias("n"), F.flatten("by.c").alias("c"), F.flatten("by.nc").alias("nc"))
        mag = F.element_at(F.array(*self.bands), F.col("best") + 1)
        own = lambda cat, t: small_join(self.celled(cat).withColumns({"band": F.col("best"), "__mag": mag}), t, [*k, "band"]).where("__mag >= lo and __mag < hi").drop("band", "__mag", "lo", "hi")
        return own(self.a, written(a, "bins")), own(self.b, written(b, "bins"))


@dataclass
class BlendedPhotometricMatch(PhotometricMatch, BlendedMatch):
    """The match with simulated blends and magnitudes."""


def core_matches(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches of which at least one side is in the core of its chunk."""
    both = large_join(large_join(matches, a.select(F.col("id").alias("a"), F.col("halo").alias("a_halo")), "a"), b.select(F.col("id").alias("b"), F.col("halo").alias("b_halo")), "b")
    return both.where(~F.col("a_halo") | ~F.col("b_halo"))


def core_nonmatches(nonmatches: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without a match in the core, and those in the halo, which are rejects."""
    halo = a.select(F.lit("a").alias("side"), "id", "halo").unionByName(b.select(F.lit("b").alias("side"), "id", "halo"))
    both = large_join(nonmatches, halo, ["side", "id"])
    return both.where("not halo").drop("halo"), both.where("halo").select("side", "id", F.lit("halo").alias("reason"))
