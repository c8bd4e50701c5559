"""Abundances of grid neighbourhoods over a stream of cells, as an extension: counts by neighbourhood, community and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import grid_label


def windowed_counts(cells: DataFrame, time: str, size: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, spot_id, se, n) of a stream (time, x, y, se); cells later than ``late`` are left out. Append mode."""
    marked = cells.withWatermark(time, late).withColumn("spot_id", grid_label(F.col("x"), F.col("y"), size))
    counts = marked.groupBy(F.window(time, window).alias("w"), "spot_id", "se").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "spot_id", "se", "n")
