"""Row-interval form of sparse pixel sets.

A run ``(keys, y, x0, x1)`` is a maximal stretch of set pixels on one row.  Morphology, hole filling
and component labelling work on runs: far fewer rows than pixels, and every window is bounded by one
image row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import small_enough, stable_copy


def with_frames(rows: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``frames(keys, ...)``.

    A join that is shuffled would deal rows, and all windows behind it, by image alone, so frames are broadcast unless
    there are too many of them.
    """
    frames = stable_copy(frames)
    return rows.join(F.broadcast(frames) if small_enough(frames) else frames, keys)


def to_runs(px: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of the (distinct) pixels of each key."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        px.select(*keys, "y", "x", (F.col("x") - F.dense_rank().over(row)).alias("_g"))
        .groupBy(*keys, "y", "_g")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_g")
    )


_HELD = 200_000  # pixels that are sorted into runs at a time


def local_runs(px: DataFrame, keys: list[str]) -> DataFrame:
    """Runs ``keys, y, x0, x1`` of the pixels as they lie in their partitions, without a shuffle.

    Together they cover every pixel as often as it is listed, but a run may come in several pieces.  ``keys`` are
    integer columns without nulls.
    """
    order = [*keys, "y"]
    wanted = px.select(*order, "x")

    def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(len(order) + 1)]
        sort = np.lexsort(columns[::-1])
        *lead, x = (c[sort] for c in columns)
        fresh = np.r_[True, x[1:] != x[:-1] + 1]
        for c in lead:
            fresh[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(x)] - 1
        return pa.RecordBatch.from_arrays([pa.array(c[first]) for c in lead] + [pa.array(x[first]), pa.array(x[last])], [*order, "x0", "x1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _HELD:
                yield built(held)
                held, n = [], 0
        if held:
            yield built(held)

    fields = wanted.schema.fields
    ends = [T.StructField(c, fields[-1].dataType) for c in ("x0", "x1")]
    return wanted.mapInArrow(run, T.StructType([*fields[:-1], *ends]))


def to_pixels(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of possibly overlapping or touching intervals."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    opened = runs.select(*keys, "y", "x0", "x1", F.max("x1").over(before).alias("_reach"))
    starts = (F.col("_reach").isNull() | (F.col("x0") > F.col("_reach") + 1)).cast("int")
    return (
        opened.withColumn("_grp", F.sum(starts).over(row.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "_grp")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_grp")
    )


def gaps(runs: DataFrame, keys: list[str], x_lo: Column, x_hi: Column) -> DataFrame:
    """Unset stretches between ``x_lo`` and ``x_hi`` on rows that hold at least one run.

    The bounds may be columns of ``runs`` that are constant per key.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    extra = [c for c in runs.columns if c not in {*keys, "y", "x0", "x1"}]
    seen = runs.select(
        *keys, "y", *extra, "x0", "x1", F.lead("x0").over(row).alias("_next"), F.lag("x1").over(row).alias("_prev")
    )
    span = lambda a, b: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("x1"))
    tail = span(F.col("x1") + 1, F.coalesce(F.col("_next") - 1, x_hi))
    head = F.when(F.col("_prev").isNull(), span(x_lo, F.col("x0") - 1))
    pieces = seen.select(*keys, "y", *extra, F.explode(F.array(head, tail)).alias("_p"))
    return pieces.where("_p is not null and _p.x0 <= _p.x1").select(*keys, "y", *extra, "_p.x0", "_p.x1")


def depths(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches with the number of intervals covering them, as ``depth`` (a sweep along each row).

    Further columns of ``runs`` must be constant per (key, y) and are kept.
    """
    extra = [c for c in runs.columns if c not in {*keys, "y", "x0", "x1"}]
    edge = lambda x, d: F.struct(x.cast("int").alias("x"), F.lit(d).alias("d"))
    events = (
        runs.select(*keys, "y", *extra, F.explode(F.array(edge(F.col("x0"), 1), edge(F.col("x1") + 1, -1))).alias("e"))
        .groupBy(*keys, "y", *extra, F.col("e.x").alias("x"))
        .agg(F.sum("e.d").alias("d"))
    )
    row = Window.partitionBy(*keys, "y").orderBy("x")
    swept = events.select(
        *keys,
        "y",
        *extra,
        F.col("x").alias("x0"),
        (F.lead("x").over(row) - 1).alias("x1"),
        F.sum("d").over(row.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
    )
    return swept.where("x1 is not null and depth > 0")


def covered_by_all(runs: DataFrame, keys: list[str], needed: Column) -> DataFrame:
    """Stretches covered by at least ``needed`` intervals; ``needed`` is constant per (key, y)."""
    return merge_runs(depths(runs, keys).where(F.col("depth") >= needed).select(*keys, "y", "x0", "x1"), keys)
