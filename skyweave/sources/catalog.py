"""Catalogues in CSV and Parquet: declared columns, row numbers, missing values, outputs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sky import EDGE, rect_slice


@dataclass(frozen=True)
class Layout:
    """Places of a CSV file's columns, from 0; ``id`` None numbers the rows of each file in its order."""

    astro: tuple[int, int, int]
    mags: tuple[int, ...]
    best: int
    halo: int | None = None
    snrs: tuple[int, ...] = ()
    motion: tuple[int, ...] = ()
    id: int | None = None
    header: bool = False
    #: Where each row says its own epoch, if it does, and columns that are taken along to the outputs with their names.
    epoch: int | None = None
    extras: tuple[int, ...] = ()
    extra_names: tuple[str, ...] = ()


def read_csv(spark: SparkSession, path: str | list[str], layout: Layout, more: tuple[str, ...] = ()) -> DataFrame:
    """A catalogue with id, lon, lat, sig, mags, best and, where declared, halo, snrs and motion; NaN and blanks are null.

    ``more`` are fields of the file metadata, such as ``file_path``, that are kept.
    """
    last = max([*layout.astro, *layout.mags, layout.best, *(x for x in (layout.halo, layout.id, layout.epoch) if x is not None), *layout.snrs, *layout.motion, *layout.extras])
    raw = spark.read.csv(path, schema=T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(last + 1)]), header=layout.header, enforceSchema=True)
    raw = raw.select("*", *(F.col(f"_metadata.{m}").alias(m) for m in more)) if layout.id is not None else numbered(raw)
    number = lambda i: F.nanvl(F.expr(f"try_cast(_{i} AS double)"), F.lit(None).cast("double"))
    columns = [F.col("row_number").alias("id") if layout.id is None else F.col(f"_{layout.id}").cast("bigint").alias("id")]
    columns += [number(i).alias(n) for i, n in zip(layout.astro, ("lon", "lat", "sig"), strict=True)]
    columns += [F.array(*map(number, layout.mags)).alias("mags"), number(layout.best).cast("int").alias("best")]
    if layout.halo is not None:
        columns.append(F.lower(f"_{layout.halo}").isin("1", "1.0", "true").alias("halo"))
    if layout.snrs:
        columns.append(F.array(*map(number, layout.snrs)).alias("snrs"))
    if layout.motion:
        columns += [number(i).alias(n) for i, n in zip(layout.motion, ("pm_lon", "pm_lat"), strict=True)]
    if layout.epoch is not None:
        columns.append(F.trim(f"_{layout.epoch}").alias("epoch"))
    columns += [F.col(f"_{i}").alias(f"extra_{n}") for i, n in zip(layout.extras, layout.extra_names, strict=True)]
    return raw.select(*columns, *more)


def chunk_of(pattern: str, path: str) -> Column:
    """The chunk of a file, from the folder or file of ``pattern`` whose name says it with braces."""
    before, _, after = next(p for p in pattern.split("/") if "{}" in p).partition("{}")
    literal = lambda text: re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", text)
    return F.regexp_extract(path, f"/{literal(before)}([^/]+?){literal(after)}(?:/|$)", 1)


def numbered(raw: DataFrame) -> DataFrame:
    """Rows of text files with ``file_path`` and ``row_number``, from 0 in the order of each file, however it is split.

    Rows are counted by split; a row's number is its place in its split after the rows of the
    splits before it.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    by = ["file_path", "__split"]
    splits = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("file_path").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select(*by, "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return rows.join(splits, by).withColumn("row_number", F.col("__before") + F.col("__at") - F.col("__first")).drop("__split", "__at", "__first", "__before")


def region_points(spark: SparkSession, kind: str, points: list) -> DataFrame:
    """(pt, lon, lat) of a rectangle's grid (lon1, lon2, n, lat1, lat2, n), or of the points given."""
    if kind == "points":
        return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "pt int, lon double, lat double")
    lon1, lon2, n, lat1, lat2, m = points
    step = lambda a, b, k, i: F.lit(float(a)) + i * F.lit((b - a) / max(1, k - 1))
    return spark.range(int(n) * int(m)).select(F.col("id").cast("int").alias("pt"), step(lon1, lon2, n, F.floor(F.col("id") / int(m))).alias("lon"), step(lat1, lat2, m, F.col("id") % int(m)).alias("lat"))


def region_rows(kind: str, points: list) -> list[tuple[int, float, float]]:
    """The same as rows, of settings that name a few points."""
    if kind == "points":
        return [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    lon1, lon2, n, lat1, lat2, m = points
    at = lambda a, b, k, i: float(a) + i * (float(b) - float(a)) / max(1, int(k) - 1)
    return [(i * int(m) + j, at(lon1, lon2, n, i), at(lat1, lat2, m, j)) for i in range(int(n)) for j in range(int(m))]


def write_output(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Parquet, or CSV without header; partitions that are written again replace what was there."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy(*by) if by else writer
    writer.format(form).save(path)


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are not done, the largest first."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti").orderBy(F.desc("size"), "chunk_id")


def sliced(cat: DataFrame, lon1: float, lon2: float, lat1: float, lat2: float, padding: float = 0.0) -> DataFrame:
    """The part of a catalogue in a rectangle; of Parquet, latitudes prune row groups."""
    return cat.where(F.col("lat").between(lat1 - padding - EDGE, lat2 + padding + EDGE) & rect_slice("lon", "lat", lon1, lon2, lat1, lat2, padding))
