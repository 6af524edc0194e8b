"""Overlaps of uncertain positions, and the islands that they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import auf_cdf, auf_radius, matchings
from ..plans.storage import dropped, written
from .spatial import large_join, radius_join

MAX_MEMBERS = 20
MAX_MATCHINGS = 5_000_000


def overlap_pairs(a: DataFrame, b: DataFrame, radius_arcsec: float, most: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, sep, cdf, sig_a, sig_b): pairs within the radius of which the joint uncertainty's CDF is below ``most``."""
    cols = [*keys, "id", "lon", "lat", "sig"]
    pairs = radius_join(a.select(cols), b.select(cols), radius_arcsec / 3600, keys)
    pairs = pairs.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sep", F.col("a_sig").alias("sig_a"), F.col("b_sig").alias("sig_b"))
    return pairs.withColumn("cdf", auf_cdf("sep", "sig_a", "sig_b")).where(F.col("cdf") < most)


def overlap_counts(cat: DataFrame, pairs: DataFrame, side: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, n): how many overlaps each source has, none included."""
    counts = pairs.groupBy(*keys, F.col(side).alias("id")).agg(F.count("*").alias("n"))
    return large_join(cat.select(*keys, "id"), counts, [*keys, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def integral_areas(cat: DataFrame, pairs: DataFrame, side: str, fractions: tuple[float, ...], keys: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, more, area0, area1...): circles of the mean radii that hold each fraction, in square degrees; 0 without overlaps. One aggregate for all."""
    r = pairs.groupBy(*keys, F.col(side).alias("id")).agg(*(F.avg(auf_radius(f, "sig_a", "sig_b") / 3600).alias(f"__r{i}") for i, f in enumerate(fractions)))
    joined = large_join(cat.select(*keys, "id", *more), r, [*keys, "id"], "left")
    return joined.select(*keys, "id", *more, *(F.coalesce(F.pi() * F.col(f"__r{i}") * F.col(f"__r{i}"), F.lit(0.0)).alias(f"area{i}") for i in range(len(fractions))))


def integral_area(cat: DataFrame, pairs: DataFrame, side: str, fraction: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, area) of one fraction."""
    return integral_areas(cat, pairs, side, (fraction,), keys).withColumnRenamed("area0", "area")


def islands(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, vertex, island): connected components of the overlaps.

    A vertex is twice the id, plus one on the second side; an island is named by its least
    vertex. Links are contracted to stars in a logarithmic number of rounds, each written.
    """
    edges = pairs.select(*keys, (F.col("a") * 2).alias("u"), (F.col("b") * 2 + 1).alias("v"))
    k = list(keys)
    links = written(_down(edges, k), "overlaps")
    before = _sums(links, k)
    while before[0]:
        both = links.select(*k, "u", "v").unionByName(links.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*k, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _down(large_join(both.where("v > u"), least, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")), k)
        low = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large_join(large, low, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*k, "u", F.col("m").alias("v")))
        after = written(_down(small, k), "overlaps")
        now = _sums(after, k)
        dropped(links)
        links = after
        if before == now:
            break
        before = now
    named = links.select(*k, F.col("u").alias("vertex"), F.col("v").alias("island"))
    return named.unionByName(links.select(*k, F.col("v").alias("vertex"), F.col("v").alias("island")).distinct())


def _down(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sums(links: DataFrame, keys: list[str]) -> tuple:
    """Number and checksum of links, to tell whether a round changed them."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).head())


def membership(a: DataFrame, b: DataFrame, found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, side, id, island): every source, also those alone in their island."""
    k = list(keys)
    alone = a.select(*k, (F.col("id") * 2).alias("vertex")).unionByName(b.select(*k, (F.col("id") * 2 + 1).alias("vertex")))
    whole = large_join(alone, found, [*k, "vertex"], "left").withColumn("island", F.coalesce("island", "vertex"))
    return whole.select(*k, F.when(F.col("vertex") % 2 == 0, "a").otherwise("b").alias("side"), F.shiftright("vertex", 1).alias("id"), "island")


def island_sizes(members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, island, n_a, n_b)."""
    return members.groupBy(*keys, "island").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))


def size_gate(sizes: DataFrame, members: int = MAX_MEMBERS, most: int = MAX_MATCHINGS) -> DataFrame:
    """``sizes`` with whether an island is small enough to enumerate."""
    return sizes.withColumn("keep", (F.greatest("n_a", "n_b") <= members) & (F.when(F.greatest("n_a", "n_b") <= members, matchings("n_a", "n_b")).otherwise(F.lit(float(most) + 1)) <= most))


def edge_reject(members: DataFrame, near_edge: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Members of islands without, and with, a source (side, id) too near the region's edge."""
    gone = large_join(members, near_edge.select(*keys, "side", "id"), [*keys, "side", "id"], "left_semi").select(*keys, "island").distinct()
    return large_join(members, gone, [*keys, "island"], "left_anti"), large_join(members, gone, [*keys, "island"], "left_semi")
