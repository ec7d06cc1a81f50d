"""Slide metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import truncate


def resolve_metadata(slides: DataFrame) -> DataFrame:
    """Fill a missing base resolution with the processing one and derive the base size."""
    base = F.coalesce("base_mpp", "proc_mpp")
    k = F.col("proc_mpp") / F.col("base_mpp")
    return (
        slides.withColumn("base_mpp", base)
        .withColumn("base_w", truncate(F.col("proc_w") * k))
        .withColumn("base_h", truncate(F.col("proc_h") * k))
    )


def at_resolution(slides: DataFrame, mpp: Column, name: str) -> DataFrame:
    """Size of each slide at another resolution, as ``<name>_w``/``<name>_h``."""
    k = F.col("proc_mpp") / mpp
    return slides.withColumn(name + "_w", truncate(F.col("proc_w") * k)).withColumn(
        name + "_h", truncate(F.col("proc_h") * k)
    )


def pick_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Pyramid level serving each requested magnification, with the rescale still needed.

    Exact level if there is one, else the smallest one above the request, else the base level is
    enlarged.  A slide has a handful of levels, so the aggregate per request is small.
    """
    joined = requests.join(levels, "slide_id")
    above = F.col("mag") >= F.col("req_mag")
    rank = F.struct(
        (~above).cast("int").alias("below"),
        F.when(above, F.col("mag")).otherwise(-F.col("mag")).alias("by"),
        F.col("level"),
        F.col("mag"),
    )
    best = joined.groupBy("slide_id", "req_mag").agg(F.min(rank).alias("b"))
    return best.select("slide_id", "req_mag", F.col("b.level").alias("level"), (F.col("req_mag") / F.col("b.mag")).alias("scale"))
