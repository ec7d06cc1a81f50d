"""Distance of background pixels to their two nearest instances.

An exact Euclidean distance transform, block by block.  An instance reaches the pixels of its box grown by a margin;
it is sent to every 512 x 512 block that this box meets, as row runs, and of a row only the runs that are nearest to some
column of the block.  In a block the transform is separable: the distance to a row's runs along x first, then the
lower envelope of the rows' parabolas along y.  Runs come in the order of their distance from the block and a run that cannot
bring anything nearer is passed over, so a block holds its own pixels and one portion of runs, however large
an instance is.  Instances are folded into the two smallest distances of every pixel one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK, block_of, portions, sorted_by_block
from tessera.operators.runs import to_runs
from tessera.session import small_enough, stable_copy

# Fixed value: distance standing for "no instance in reach"
FAR = 1000.0

_NONE = np.iinfo("int64").max
_AT_ONCE = 300_000  # distances held at a time when every run meets every pixel
_PORTION = 512  # runs that become an envelope at a time


def _envelope(best: np.ndarray, ys: np.ndarray, rows: np.ndarray, flat: np.ndarray) -> None:
    """Lower ``best`` to the envelope of the parabolas (y - rows)^2 + flat, all columns at a time; rows ascend."""
    columns = np.arange(flat.shape[1])
    height = flat + (rows * rows)[:, None]
    kept = np.zeros(flat.shape, np.int64)  # parabolas of the envelope, from the top
    begin = np.full((len(rows) + 1, len(columns)), np.inf)  # where each takes over
    begin[0] = -np.inf
    top = np.zeros(len(columns), np.int64)
    for r in range(1, len(rows)):
        left = columns
        meet = np.empty(len(columns))
        while len(left):
            under = kept[top[left], left]
            meet[left] = (height[r, left] - height[under, left]) / (2.0 * (rows[r] - rows[under]))
            left = left[meet[left] <= begin[top[left], left]]
            top[left] -= 1
        top += 1
        kept[top, columns], begin[top, columns] = r, meet
        begin[top + 1, columns] = np.inf
    at = np.zeros(len(columns), np.int64)
    for k, y in enumerate(ys):
        left = columns
        while len(left):
            left = left[begin[at[left] + 1, left] < y]
            at[left] += 1
        nearest = kept[at, columns]
        np.minimum(best[k], (y - rows[nearest]) ** 2 + flat[nearest, columns], out=best[k])


def lower(best: np.ndarray, xs: np.ndarray, ys: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> None:
    """Lower squared distances ``best`` of the pixels ys x xs by runs (y, x0, x1)."""
    for start in range(0, len(y), _PORTION):
        part = slice(start, start + _PORTION)
        away = np.maximum(np.maximum(ys[0] - y[part], y[part] - ys[-1]), 0)
        near = np.flatnonzero(away * away < best.max()) + start
        if not len(near):
            continue
        near = near[np.argsort(y[near], kind="stable")]
        gap = np.maximum(np.maximum(x0[near, None] - xs, xs - x1[near, None]), 0)
        flat, rows = gap * gap, y[near]
        if len(near) * best.size <= _AT_ONCE:
            np.minimum(best, (flat[:, None, :] + ((ys[None, :] - rows[:, None]) ** 2)[:, :, None]).min(axis=0), out=best)
            continue
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        _envelope(best, ys, rows[first], np.minimum.reduceat(flat, first, axis=0))


def _two_nearest(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, instance, best, place = None, None, None, None
        d1 = d2 = None

        def fold() -> None:
            if best is not None:
                np.minimum(d2[place], np.maximum(d1[place], best), out=d2[place])
                np.minimum(d1[place], best, out=d1[place])

        def listed() -> pd.DataFrame:
            y, x = np.nonzero(d1 < _NONE)
            second = d2[y, x]
            image, by, bx = block
            return pd.DataFrame(
                {"image_id": image, "x": x + bx * size, "y": y + by * size, "d1": d1[y, x], "d2": np.where(second < _NONE, second, -1)}
            )

        for key, part in portions(batches, ["image_id", "_by", "_bx", "inst_id"]):
            if key != instance:
                fold()
                best = None
            if key[:3] != block:
                if block is not None:
                    yield listed()
                block = key[:3]
                d1 = np.full((size, size), _NONE)
                d2 = np.full((size, size), _NONE)
            if best is None:
                instance = key
                corner_y, corner_x = int(key[1]) * size, int(key[2]) * size
                ys = np.arange(max(part["gy0"][0], corner_y), min(part["gy1"][0], corner_y + size - 1) + 1, dtype="int64")
                xs = np.arange(max(part["gx0"][0], corner_x), min(part["gx1"][0], corner_x + size - 1) + 1, dtype="int64")
                place = np.s_[ys[0] - corner_y : ys[-1] - corner_y + 1, xs[0] - corner_x : xs[-1] - corner_x + 1]
                best = np.full((len(ys), len(xs)), _NONE)
            lower(best, xs, ys, *(part[c].astype("int64") for c in ("y", "x0", "x1")))
        fold()
        if block is not None:
            yield listed()

    return run


def two_nearest(px: DataFrame, frames: DataFrame, margin: int = 10, block: int = BLOCK) -> DataFrame:
    """``image_id, x, y, d1, d2``: squared distances to the nearest and second nearest instance (-1: none).

    A pixel counts for an instance if it lies in the instance's box grown by ``margin``; pixels of no box are not
    listed, and images with at most one instance are left out.
    """
    key = ["image_id", "inst_id"]
    row = Window.partitionBy(*key, "y").orderBy("x0")
    runs = stable_copy(
        to_runs(px, key).select("*", (F.lag("x1").over(row) + 1).alias("from_x"), (F.lead("x0").over(row) - 1).alias("to_x"))
    )
    boxes = runs.groupBy(*key).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    several = boxes.groupBy("image_id").agg((F.count("*") > 1).alias("several")).where("several").select("image_id")
    sized = frames.select("image_id", "w", "h").join(several, "image_id")
    sized = F.broadcast(sized) if small_enough(sized) else sized
    grown = boxes.join(sized, "image_id").select(
        *key,
        F.greatest(F.col("bx0") - margin, F.lit(0)).alias("gx0"),
        F.least(F.col("bx1") + margin, F.col("w") - 1).alias("gx1"),
        F.greatest(F.col("by0") - margin, F.lit(0)).alias("gy0"),
        F.least(F.col("by1") + margin, F.col("h") - 1).alias("gy1"),
    )
    # a run is nearest in its row from behind the run before it to ahead of the run after it
    blocks = lambda lo, hi: F.sequence(block_of(lo, block), block_of(hi, block))
    sent = (
        runs.join(grown, key)
        .withColumn("_bx", F.explode(blocks(F.coalesce("from_x", "gx0"), F.coalesce("to_x", "gx1"))))
        .withColumn("_by", F.explode(blocks(F.col("gy0"), F.col("gy1"))))
        .withColumn("_away", F.abs(F.col("y") - F.col("_by") * block - block // 2))
        .drop("from_x", "to_x")
    )
    placed = sorted_by_block(sent, ["image_id", "_by", "_bx"], ["inst_id", "_away"])  # all instances of a block meet in its task
    return placed.mapInPandas(_two_nearest(block), "image_id int, x int, y int, d1 bigint, d2 bigint")


def separation_weights(
    px: DataFrame, frames: DataFrame, w0: float = 10.0, sigma: float = 3.0, margin: int = 10
) -> DataFrame:
    """w0 * exp(-((d1 + d2) / sigma)^2 / 2) for pixels between instances, 0 inside them.

    Images with at most one instance get no weight; pixels no instance reaches are not listed.
    """
    two = two_nearest(px, frames, margin)
    d1 = F.sqrt(F.col("d1").cast("double"))
    d2 = F.when(F.col("d2") >= 0, F.sqrt(F.col("d2").cast("double"))).otherwise(F.lit(FAR))
    z = (d1 + d2) / F.lit(sigma)
    weight = F.when(F.col("d1") == 0, F.lit(0.0)).otherwise(F.lit(w0) * F.exp(-(z * z) / 2))
    return two.select("image_id", "x", "y", weight.alias("weight"))
