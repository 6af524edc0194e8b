"""Catalogues stored in the order of the sky: range joins without a shuffle, slices that leave files unread."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sky import EDGE, rect_slice
from ..operators.spatial import near_pairs, own_cells, reach_cells
from ..plans.storage import shared_dir

#: Degrees of latitude of a stripe, the folders of a stored catalogue.
STRIPE = 1.0
CELLS = ("__band", "__cell")


@dataclass(frozen=True)
class SkyTable:
    """A catalogue in two bucketed tables: each source in its own cell, and in all cells that its circle touches."""

    spark: SparkSession
    name: str
    radius: float

    @property
    def own(self) -> DataFrame:
        return self.spark.table(f"{self.name}_own")

    @property
    def reach(self) -> DataFrame:
        return self.spark.table(f"{self.name}_reach")

    def join(self, other: SkyTable) -> DataFrame:
        """Pairs with ``other`` within the radius that both are stored for, as ``spatial.radius_join`` gives them; buckets meet without a shuffle."""
        if self.radius != other.radius:
            raise ValueError("both catalogues should be stored for the same radius")
        left, right = (t.drop("__stripe") for t in (self.own, other.reach))
        side = lambda df, s: df.select(*CELLS, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in CELLS))
        return near_pairs(side(left, "a"), side(right, "b"), self.radius)

    def slice(self, lon1: float, lon2: float, lat1: float, lat2: float, padding: float = 0.0) -> DataFrame:
        """The sources in a rectangle; stripes beyond its latitudes are not read."""
        low, high = (int((lat + 90) // STRIPE) for lat in (lat1 - padding - EDGE, lat2 + padding + EDGE))
        rows = self.own.where(F.col("__stripe").between(low, high))
        return rows.where(rect_slice("lon", "lat", lon1, lon2, lat1, lat2, padding)).drop(*CELLS, "__stripe")

    def drop(self) -> None:
        for part in ("own", "reach"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")


def stored(cat: DataFrame, radius: float, name: str | None = None, buckets: int = 200) -> SkyTable:
    """``cat`` (id, lon, lat and others) written for range joins up to ``radius`` degrees; catalogues to be joined need as many buckets."""
    spark = cat.sparkSession
    table = SkyTable(spark, name or f"sky_{uuid.uuid4().hex}", radius)
    stripe = F.floor((F.col("lat") + 90) / STRIPE).cast("int")
    for part, cells in (("own", own_cells), ("reach", reach_cells)):
        rows = cells(cat, radius).withColumn("__stripe", stripe)
        rows = rows.repartition(buckets, *CELLS)  # a file for each bucket and stripe
        rows.write.partitionBy("__stripe").bucketBy(buckets, *CELLS).sortBy(*CELLS).option("path", f"{shared_dir(spark)}/{table.name}_{part}").mode("overwrite").saveAsTable(f"{table.name}_{part}")
    return table
