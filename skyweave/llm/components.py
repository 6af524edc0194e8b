"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the least node that it reaches.

    Each round joins all neighbours of a node to the least of them, alternately the greater
    and the lesser ones, so the links become stars in a logarithmic number of rounds. Minima are
    aggregated before they are joined. Each round is written, which cuts the lineage.
    """
    edges = written(_directed(links.where("a <> b").select("a", "b").distinct()), "links")
    before = _sums(edges)
    while before[0]:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(_directed(large).distinct(), "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _directed(small.unionByName(down.withColumnRenamed("m", "b")).where("a <> b"))
        after = written(small.distinct(), "links")
        now = _sums(after)
        dropped(large)
        dropped(edges)
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _directed(links: DataFrame) -> DataFrame:
    """Links from the greater to the lesser node."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _sums(links: DataFrame) -> tuple:
    """Number and checksum of links, to tell whether a round changed them."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
