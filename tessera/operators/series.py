"""Smoothed series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered

CHUNK = 4096  # rows of a series that one window holds


def _states(rows: DataFrame, series: str, alpha: float) -> DataFrame:
    """Add ``_s`` with s_i = alpha * s_(i-1) + b_i, s_(-1) = 0, for rows ``series, _i`` (from 0, no gaps), ``_b``.

    Rows are cut into chunks and each chunk takes in the state its predecessor ends with.  Those end states
    obey the same rule with alpha^length, one row per chunk, so they come from the same function; the
    recursion ends when a chunk forgets everything before it (alpha^length < 1e-18) or there is one chunk.
    """
    forget = -math.log(alpha)
    length = max(1, min(CHUNK, int(300 / forget)))  # alpha^-length stays within a double
    place = F.col("_i") % length
    chunked = rows.withColumn("_chunk", F.floor(F.col("_i") / length)).withColumn("_g", F.col("_b") * F.exp(place * forget))
    within = Window.partitionBy(series, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.sum("_g").over(within) * F.exp(-place * forget))
    own = chunked.groupBy(series, "_chunk").agg((F.sum("_g") * math.exp(-(length - 1) * forget)).alias("_b"))
    ends = own.withColumnRenamed("_chunk", "_i")
    decay = math.exp(-length * forget)
    if decay < 1e-18:
        ends = ends.withColumn("_s", F.col("_b"))
    elif not ends.where("_i > 0").isEmpty():
        ends = _states(ends, series, decay)
    else:
        ends = ends.withColumn("_s", F.lit(0.0))
    carry = ends.select(series, (F.col("_i") + 1).alias("_chunk"), F.col("_s").alias("_carry"))
    joined = local.join(carry, [series, "_chunk"], "left")
    return joined.withColumn("_s", F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * F.exp(-(place + 1) * forget)).select(*rows.columns, "_s")


def smoothed(df: DataFrame, series: str, step: str, value: str, alpha: float = 0.95) -> DataFrame:
    """Exponential average s = alpha * s + (1 - alpha) * v for 0 < alpha < 1, starting at the first value.

    No task holds more than a chunk of a series, whatever alpha is; see ``_states``.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    ranked = numbered(df, [series], [step], "_rn").withColumn("_i", F.col("_rn") - 1)
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(1 - alpha))  # the first value enters whole
    return _states(ranked.withColumn("_b", F.col(value) * weight), series, alpha).select(*df.columns, F.col("_s").alias("smooth"))
