"""A match from settings to files: scan, shift, match, take halo duplicates out, write; chunks already written are skipped."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import apply_pm, epoch_years
from ..operators.astrometry import corrected
from ..operators.auf import Blends
from ..operators.blending import by_band, complete_to, simulated_cells, with_cells
from ..operators.calibration import boxes, calibrate
from ..operators.counts import observed, rescaled, with_galaxies
from ..operators.regions import hull_areas, hulls
from ..operators.spatial import large_join
from ..sources.catalog import chunk_of, read_csv, region_rows, write_output
from ..sources.config import Settings, SideSettings, psf_parameters
from ..sources.simulations import merged_cube, read_simulations
from .match import BlendedMatch, BlendedPhotometricMatch, CrossMatch, PhotometricMatch
from .outputs import Side, matched, unmatched
from .storage import written


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def done_chunks(spark: SparkSession, folder: str) -> set:
    """Chunks that are marked as done, also those without any match."""
    path, files = _files(spark, f"{folder}/_done")
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def mark_done(spark: SparkSession, folder: str, chunks: tuple) -> None:
    """An empty file for each chunk, after all of its outputs."""
    for chunk in chunks:
        path, files = _files(spark, f"{folder}/_done/{chunk}")
        files.create(path, True).close()


def write_manifest(spark: SparkSession, folder: str, batch: tuple, failed: dict[str, str]) -> None:
    """A JSON file for a batch of chunks: those that are done, and why the others are not."""
    said = {"done": [str(c) for c in batch if str(c) not in failed], "failed": failed}
    path, files = _files(spark, f"{folder}/_manifest/{uuid.uuid4().hex}.json")
    stream = files.create(path, True)
    stream.write(bytearray(json.dumps(said).encode()))
    stream.close()


def scan(spark: SparkSession, side: SideSettings, chunks: tuple) -> DataFrame:
    """The catalogue of all chunks in one scan, with chunk_id, from the path, and a column for each filter; positions are moved to the epoch asked for."""
    cat = read_csv(spark, [side.path.format(c) for c in chunks], side.layout, ("file_path",))
    cat = cat.withColumn("chunk_id", chunk_of(side.path, "file_path")).drop("file_path")
    if side.layout.halo is None:
        cat = cat.withColumn("halo", F.lit(False))
    if side.motion:
        begin = epoch_years("epoch") if side.layout.epoch is not None else F.lit(side.reference_epoch)
        lon, lat = apply_pm("lon", "lat", "pm_lon", "pm_lat", side.move_to_epoch - begin)
        cat = cat.withColumns({"lon": lon, "lat": lat})
    return cat.withColumns({f"mag{i + 1}": F.col("mags")[i] for i in range(len(side.filters))})


def with_columns(matches: DataFrame, a: DataFrame, b: DataFrame, bands: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Matches with both catalogues' columns, without those of which both sources are in the halo of their chunk."""
    tag = lambda cat, which: cat.select(*keys, F.col("id").alias(which), F.col("halo").alias(f"{which}_halo"), *(F.col(c).alias(f"{which}_{c}") for c in ("lon", "lat", "sig", *bands, "best")))
    both = large_join(large_join(matches, tag(a, "a"), [*keys, "a"]), tag(b, "b"), [*keys, "b"])
    return both.where(~F.col("a_halo") | ~F.col("b_halo")).drop("a_halo", "b_halo")


class Engine:
    """All chunks of a match in one plan, with blends, photometry and sky cells as the settings ask for.

    ``corrections`` are terms (lon, lat, m, n) by side, "a" or "b", for sides whose settings ask for
    them and do not say what they are computed from.
    """

    def __init__(self, spark: SparkSession, settings: Settings, corrections: dict[str, list[tuple[float, float, float, float]]] | None = None):
        self.spark, self.settings, self.corrections = spark, settings, dict(corrections or {})
        s = settings
        self.bands = tuple(f"mag{i + 1}" for i in range(max(len(s.a.filters), len(s.b.filters))))
        self.how = Blends(fwhm=1.0, trials=s.trials) if s.blends else None
        if s.psf_folder:
            table, cuts = psf_parameters(s.psf_folder)
            self.how = replace(self.how, algorithm="both" if s.both else "psf", table=tuple(tuple(map(tuple, row)) for row in table.tolist()), l_cut=cuts)

    def catalogue(self, which: str, chunks: tuple) -> DataFrame:
        side = getattr(self.settings, which)
        cat = scan(self.spark, side, chunks).withColumn("quoted", F.col("sig"))
        if side.correct:
            cat = corrected(cat, self.corrections[which] if which in self.corrections else self.calibrated(which))
        return cat.withColumns({m: F.lit(None).cast("double") for m in self.bands if m not in cat.columns})

    def calibrated(self, which: str) -> list[tuple[float, float, float, float]]:
        """Terms (lon, lat, m, n) of the settings' sightlines, from all chunks of the side's catalogue; computed once."""
        side = getattr(self.settings, which)
        if (how := side.calibration) is None:
            raise ValueError(f"the settings of side {which} ask for corrections, and none are given")
        place = lambda i: F.expr(f"try_cast(_c{i} AS double)")
        better = self.spark.read.csv(how.path).select(F.monotonically_increasing_id().alias("id"), place(how.columns[0]).alias("lon"), place(how.columns[1]).alias("lat")).where("lon is not null and lat is not null")
        cat = scan(self.spark, side, self.settings.chunks).where("not halo").withColumn("id", F.xxhash64("chunk_id", "id"))
        points = [(i, lon, lat) for i, (lon, lat) in enumerate(how.sightlines)]
        fits, _, _ = calibrate(cat, written(better, "better"), boxes(points, how.area, how.height), how.radius, how.reach, f"mag{how.filter + 1}", step=how.step, least=how.least)
        terms = {r.pt: (r.m, r.n) for r in fits.collect()}  # a row for each sightline
        self.corrections[which] = [(lon, lat, *terms[pt]) for pt, lon, lat in points if pt in terms]
        if not self.corrections[which]:
            raise ValueError(f"no sightline of side {which} has matches to compute corrections from")
        return self.corrections[which]

    def points(self, chunks: tuple) -> DataFrame:
        """(chunk_id, pt, lon, lat): the middles of each chunk's sky cells."""
        return self.spark.createDataFrame([(str(c), *row) for c in chunks for row in region_rows(*self.settings.regions[c])], "chunk_id string, pt int, lon double, lat double")

    def blended(self, which: str, cat: DataFrame, chunks: tuple) -> tuple[DataFrame, DataFrame]:
        """A catalogue with the cell of each source's blends, and the simulated cells."""
        side = getattr(self.settings, which).blends
        read = lambda path: read_simulations(self.spark, path, chunks, side.columns) if path else None
        model = merged_cube(read(side.path), read(side.bright), self.settings.mag_step)
        snrs = "snrs" if "snrs" in cat.columns else None
        if side.galaxies:
            key = ("chunk_id",)
            seen = by_band(cat, self.bands, key, None)
            data = observed(seen, hull_areas(hulls(cat, key), key), key, complete_to(seen, ["chunk_id", "band"]), self.settings.mag_step, side.saturation)
            model = rescaled(written(with_galaxies(model, side.galaxies), "galaxies"), data, key)
        marked, cells = with_cells(cat, self.bands, written(model, "counts"), side.radius, ("chunk_id",), snrs, side.fwhms)
        return marked, written(simulated_cells(written(cells, "cells"), self.how, side.fwhms), "aufs")

    def sides(self, chunks: tuple) -> dict:
        """Both catalogues and, with blends, their simulated cells."""
        a, b = (self.catalogue(w, chunks) for w in "ab")
        if not self.settings.blends:
            return {"a": a, "b": b}
        (a, aufs_a), (b, aufs_b) = self.blended("a", a, chunks), self.blended("b", b, chunks)
        return {"a": a, "b": b, "aufs_a": aufs_a, "aufs_b": aufs_b, "how": self.how}

    def match(self, sides: dict, chunks: tuple, photometry: bool) -> CrossMatch:
        s = self.settings
        more = {"use_likelihood": s.photometry} if photometry else {}
        kind = {(False, False): CrossMatch, (True, False): BlendedMatch, (False, True): PhotometricMatch, (True, True): BlendedPhotometricMatch}[s.blends, photometry]
        return kind(**sides, radius=s.radius, most=s.fractions[2], bands=self.bands, keys=("chunk_id",), edge_keys=("chunk_id",) if s.edges else (), points=self.points(chunks), **more)

    def run(self) -> dict[str, str]:
        """Writes matches, nonmatches of either side and rejects by chunk, with the columns of ``outputs``; gives their folders. With photometry, matches by position alone too.

        Batches of chunks (``settings.batch``, or all at once) are written and marked one
        after another, and each leaves a manifest of what was done and what failed, and why. A
        chunk whose densities contradict each other fails alone: its sources are rejects, and
        the next run tries it again. A batch that breaks off is tried again by the next run,
        the others are done first.
        """
        s = self.settings
        done = done_chunks(self.spark, s.output)
        todo = tuple(c for c in s.chunks if str(c) not in done)
        kinds = ("", "_without_photometry") if s.photometry or s.priors else ("",)
        names = ["rejects", *(f"{name}{kind}{side}" for kind in kinds for name, side in (("matches", ""), ("nonmatches", "_a"), ("nonmatches", "_b")))]
        out = {name: f"{s.output}/{name}" for name in names}
        size = s.batch or max(1, len(todo))
        broken: list[Exception] = []
        for begin in range(0, len(todo), size):
            batch = todo[begin : begin + size]
            try:
                failed = self._run(batch, out)
                mark_done(self.spark, s.output, tuple(c for c in batch if str(c) not in failed))
            except Exception as error:  # the other batches first
                broken.append(error)
                failed = {str(c): f"{type(error).__name__}: {error}"[:1000] for c in batch}
            write_manifest(self.spark, s.output, batch, failed)
        if broken:
            raise broken[0]
        return out

    def _run(self, batch: tuple, out: dict[str, str]) -> dict[str, str]:
        """Writes a batch of chunks; gives those that failed, with the reason."""
        s = self.settings
        for folder in out.values():  # what a run that broke off has left
            for chunk in batch:
                path, files = _files(self.spark, f"{folder}/chunk_id={chunk}")
                files.delete(path, True)
        photometry = s.photometry or s.priors
        sides = self.sides(batch)
        m = self.match(sides, batch, photometry)
        failed = {r.chunk_id: r.reason for r in m.failed.collect()} if photometry else {}  # a row for each such chunk
        if photometry:
            self._write(self.match(sides, batch, False), out, "_without_photometry", failed)
        self._write(m, out, "", failed)
        return failed

    def _write(self, m: CrossMatch, out: dict[str, str], kind: str, failed: dict[str, str]) -> None:
        fine = lambda df: df.where(~F.col("chunk_id").isin(*failed)) if failed else df
        key = ("chunk_id",)
        both = tuple(Side(w, x.name, tuple(f"mag{i + 1}" for i in range(len(x.filters))), x.layout.extra_names, x.correct) for w, x in (("a", self.settings.a), ("b", self.settings.b)))
        own = lambda cat, which: cat.select("chunk_id", F.lit(which).alias("side"), "id", "halo")
        rest = written(large_join(m.nonmatches, own(m.a, "a").unionByName(own(m.b, "b")), ["chunk_id", "side", "id"]), "rest")  # read for rejects and for either side
        form = "csv" if self.settings.csv else "parquet"
        if not kind:
            why = [(rest.where("halo"), "halo"), (m.too_large, "island size")] + ([(m.at_edge, "edge")] if m.edge_keys else [])
            rejects = reduce(DataFrame.unionByName, [df.select("chunk_id", "side", "id", F.lit(reason).alias("reason")) for df, reason in why])
            if isinstance(m, PhotometricMatch):
                rejects = rejects.unionByName(m.unbinned.select("chunk_id", "side", "id", "reason"))
            rejects = fine(rejects)
            if failed:
                why = self.spark.createDataFrame(list(failed.items()), "chunk_id string, reason string")
                every = own(m.a, "a").unionByName(own(m.b, "b")).select("chunk_id", "side", "id")
                rejects = rejects.unionByName(every.join(F.broadcast(why), "chunk_id").select("chunk_id", "side", "id", "reason"))  # chunks of a batch
            write_output(rejects, out["rejects"], form, ("chunk_id",))
        for side, cat in zip(both, (m.a, m.b), strict=True):
            left = unmatched(rest.drop("halo"), cat, side, getattr(m, f"aufs_{side.which}", None), key)
            write_output(fine(left), out[f"nonmatches{kind}_{side.which}"], form, key)
        write_output(fine(matched(m.matches, m.a, m.b, both, key)), out[f"matches{kind}"], form, key)
