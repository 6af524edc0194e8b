"""Simulated star counts in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import chunk_of


def read_simulation(spark: SparkSession, path: str) -> tuple[DataFrame, float, float]:
    """(columns by name, area in square degrees, extinction at infinity) of a file whose first lines carry both as ``#area = ...`` and ``#Av at infinity = ...``."""
    lines = spark.read.text(path)
    number = r"=\s*([0-9.eE+-]+)"
    facts = lines.where(F.col("value").startswith("#")).agg(
        F.max(F.when(F.lower("value").contains("area"), F.regexp_extract("value", number, 1))).alias("area"), F.max(F.when(F.lower("value").contains("av at infinity"), F.regexp_extract("value", number, 1))).alias("av"),
        F.max(F.when(~F.col("value").contains("="), F.col("value"))).alias("names"),
    ).head()
    names = facts.names.lstrip("#").split()
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*(parts[i].cast("double").alias(n) for i, n in enumerate(names))), float(facts.area), float(facts.av or 0)


def read_simulations(spark: SparkSession, pattern: str, chunks: tuple, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, filt, mag) of the simulated sources of all chunks' files, in one scan, and (chunk_id, area, av), a row for each file.

    ``columns`` are the filters' names in the files; files may have them in different places.
    """
    lines = spark.read.text([pattern.format(c) for c in chunks]).select("value", F.col("_metadata.file_path").alias("file_path"))
    lines = lines.withColumn("chunk_id", chunk_of(pattern, "file_path")).drop("file_path")
    number = r"=\s*([0-9.eE+-]+)"
    said = lambda what: F.max(F.when(F.lower("value").contains(what), F.regexp_extract("value", number, 1))).cast("double")
    names = F.split(F.trim(F.regexp_replace(F.max(F.when(~F.col("value").contains("="), F.col("value"))), "^#+", "")), r"\s+")
    head = lines.where(F.col("value").startswith("#")).groupBy("chunk_id").agg(said("area").alias("area"), F.coalesce(said("av at infinity"), F.lit(0.0)).alias("av"), names.alias("names"))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(head, "chunk_id")
    parts = F.split(F.trim("value"), r"\s+")
    mags = F.array(*(F.try_element_at(parts, F.array_position("names", c).cast("int")).cast("double") for c in columns))
    rows = rows.select("chunk_id", F.posexplode(mags).alias("filt", "mag")).where(F.col("mag").isNotNull() & ~F.isnan("mag"))
    return rows, head.select("chunk_id", "area", "av")


def merged_cube(faint: tuple[DataFrame, DataFrame], bright: tuple[DataFrame, DataFrame] | None, step: float, least: int = 3) -> DataFrame:
    """(chunk_id, band, mag, density, width) from what ``read_simulations`` gives, a magnitude and square degree.

    A simulation of bright sources covers more sky; it counts up to its fullest bin, where it
    ends. Where both have sources, densities are weighted by their inverse variances. Bins of
    which no simulation has more than ``least`` sources are left out.
    """

    def counted(simulation: tuple[DataFrame, DataFrame], ends: bool) -> DataFrame:
        rows, areas = simulation
        bins = rows.groupBy("chunk_id", "filt", F.floor(F.col("mag") / step + 1e-9).alias("bin")).agg(F.count("*").alias("n"))
        if ends:
            last = bins.groupBy("chunk_id", "filt").agg(F.max(F.struct("n", -F.col("bin")))["col2"].alias("last"))
            bins = bins.join(last, ["chunk_id", "filt"]).where(F.col("bin") <= -F.col("last")).drop("last")
        return bins.join(areas.select("chunk_id", "area"), "chunk_id")

    both = counted(faint, False) if bright is None else counted(faint, False).unionByName(counted(bright, True))
    size = F.col("area") * step
    weight = size * size / F.col("n")  # of a density n / size, whose variance is n / size^2
    sums = both.groupBy("chunk_id", "filt", "bin").agg(F.sum(F.col("n") / size * weight).alias("top"), F.sum(weight).alias("weight"), F.max("n").alias("most"))
    return sums.where(F.col("most") > least).select("chunk_id", F.col("filt").alias("band"), ((F.col("bin") + 0.5) * step).alias("mag"), (F.col("top") / F.col("weight")).alias("density"), F.lit(step).alias("width"))


def count_cube(sims: DataFrame, areas: DataFrame, step: float) -> DataFrame:
    """(pt, filt, bin, density, mag_left, width) from simulated sources (pt, filt, mag) and the areas (pt, area) of their fields."""
    counts = sims.groupBy("pt", "filt", F.floor(F.col("mag") / step + 1e-9).alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(areas, "pt").select("pt", "filt", "bin", (F.col("n") / (F.col("area") * step)).alias("density"), (F.col("bin") * step).alias("mag_left"), F.lit(step).alias("width"))
