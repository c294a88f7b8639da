"""An extension to streams: points counted per tile and time window, with late points up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_windows(points: DataFrame, tile: float, window: str, late: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """start, end, i, j, n: works on streams and on tables alike. The state holds one count per open window and tile."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    at = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("long")
    counted = points.withWatermark(time, late).groupBy(span.alias("w"), at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "i", "j", "n")
