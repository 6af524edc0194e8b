"""Detections that arrive as a stream, matched to a catalogue that is at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import auf_cdf
from ..operators.spatial import radius_join


def overlaps(detections: DataFrame, catalogue: DataFrame, radius_arcsec: float, most: float) -> DataFrame:
    """(a, b, sep, cdf) for each micro-batch: the same plan as for tables, a join of stream and table without state."""
    cols = ["id", "lon", "lat", "sig"]
    pairs = radius_join(catalogue.select(cols), detections.select(cols), radius_arcsec / 3600)
    return pairs.withColumn("cdf", auf_cdf("sep", "a_sig", "b_sig")).where(F.col("cdf") < most).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sep", "cdf")
