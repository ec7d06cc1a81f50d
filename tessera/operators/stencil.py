"""Windows over the pixels of a raster, block by block.

Every pixel goes to its 256 x 256 block and, near a border, to the neighbours that need it as halo; a task lays a block,
or many small ones below each other, out as arrays and applies a kernel to all of it.  One shuffle, however large the window, and a pixel that is
missing is a hole in the array, it does not move the pixels next to it.  A row of the input is a pixel; other
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.blocks import block_of, many_groups, sorted_by_block
from tessera.session import small_enough

SIZE = 256
_AT_ONCE = 2_000_000  # window values held at a time
_ROWS = 100_000  # rows of small blocks that are worked on together
_CELLS = 1_000_000  # and the cells of the array they are laid out in

# (channels of a block with its halo, which pixels are there, radius) -> results for the block's own pixels
Kernel = Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]


def _strips(cell: dict[str, np.ndarray], starts: np.ndarray, radius: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks that are laid below each other in one array: (block of each row, its own pixels, top, left, high, wide, blocks).

    A strip holds a block's own pixels and its halo.  Strips of similar width go together, up to ``_CELLS`` cells.
    """
    block = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell["x"])]))
    y, x = cell["y"].astype(np.int64), cell["x"].astype(np.int64)
    own = (y // size == cell["_by"]) & (x // size == cell["_bx"])
    far = np.iinfo(np.int64).max
    low = lambda v: np.minimum.reduceat(np.where(own, v, far), starts)
    high_of = lambda v: np.maximum.reduceat(np.where(own, v, -far), starts)
    some = np.logical_or.reduceat(own, starts)
    top, left = np.where(some, low(y), 0) - radius, np.where(some, low(x), 0) - radius
    high = np.where(some, high_of(y), 0) + radius + 1 - top
    wide = np.where(some, high_of(x), 0) + radius + 1 - left
    kind = np.ceil(np.log2(wide)).astype(np.int64)
    for k in np.unique(kind[some]):
        these = np.flatnonzero(some & (kind == k))
        part = np.cumsum(high[these] * wide[these]) // _CELLS
        for p in np.unique(part):
            yield block, own, top, left, high, wide, these[part == p]


def _run(channels: list[str], radius: int, kernel: Kernel, made: list[str], replicate: bool, size: int):
    def done(cell: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for block, own, top, left, high, wide, chosen in _strips(cell, starts, radius, size):
            below = np.cumsum(high[chosen]) - high[chosen]  # first line of each strip
            shape = int(high[chosen].sum()), int(wide[chosen].max())
            strip = np.full(len(starts), -1)
            strip[chosen] = np.arange(len(chosen))
            mine = np.flatnonzero(strip[block] >= 0)
            of = block[mine]
            row, column = cell["y"][mine].astype(np.int64) - top[of], cell["x"][mine].astype(np.int64) - left[of]
            near = (row >= 0) & (row < high[of]) & (column >= 0) & (column < wide[of])
            row += below[strip[of]]
            at = row[near], column[near]
            there = np.zeros(shape, bool)
            there[at] = True
            grids = []
            for c in channels:
                grid = np.zeros(shape, cell[c].dtype)
                grid[at] = cell[c][mine][near]
                grids.append(grid)
            if replicate:  # beyond the frame the nearest pixel of the frame repeats
                line = np.repeat(chosen, high[chosen])
                first = np.repeat(below, high[chosen])
                end = [cell[c][starts].astype(np.int64) for c in ("_frame_h", "_frame_w")]
                down = np.clip(np.arange(shape[0]) - first + top[line], 0, end[0][line] - 1) - top[line] + first
                across = np.clip(left[line, None] + np.minimum(np.arange(shape[1]), wide[line, None] - 1), 0, end[1][line, None] - 1) - left[line, None]
                there, grids = there[down[:, None], across], [g[down[:, None], across] for g in grids]
            results = kernel(grids, there, radius)
            kept = own[mine]
            out = {c: v[mine][kept] for c, v in cell.items() if c not in ("_by", "_bx", "_frame_w", "_frame_h")}
            at = row[kept] - radius, column[kept] - radius
            yield pd.DataFrame(out | {name: r[at] for name, r in zip(made, results, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, starts in many_groups(batches, ["image_id", "_by", "_bx"], _ROWS):
            yield from done(cell, starts)

    return run


def stencil(
    px: DataFrame,
    channels: list[str],
    radius: int,
    kernel: Kernel,
    made: list[T.StructField],
    replicate: bool = False,
    frames: DataFrame | None = None,
    size: int = SIZE,
) -> DataFrame:
    """``px`` with the columns ``made`` (those of the same name are replaced).

    ``px(image_id, x, y, channels...)`` holds a pixel once.  ``frames(image_id, w, h)`` is needed to
    ``replicate`` the border; by default an image ends with its last pixel.
    """
    names = [f.name for f in made]
    given = px
    if replicate:
        if frames is None:
            frames = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
        sized = frames.select("image_id", F.col("w").alias("_frame_w"), F.col("h").alias("_frame_h"))
        given = px.join(F.broadcast(sized) if small_enough(sized) else sized, "image_id")
    near = lambda c: F.explode(F.sequence(block_of(F.col(c) - radius, size), block_of(F.col(c) + radius, size)))
    sent = given.withColumn("_bx", near("x")).withColumn("_by", near("y"))
    kept = [f for f in px.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *made])
    placed = sorted_by_block(sent, ["image_id", "_by", "_bx"], [])
    carried = [f.name for f in kept]
    inner = _run(channels, radius, kernel, names, replicate, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in inner(batches):
            yield out[[*carried, *names]]

    return placed.mapInPandas(run, schema).select(*[c for c in px.columns], *[n for n in names if n not in px.columns])


def _shifted(grid: np.ndarray, radius: int, offsets: list[tuple[int, int]], rows: slice) -> np.ndarray:
    """The window values of some rows of the block, one layer per offset (dy, dx)."""
    wide = grid.shape[1] - 2 * radius
    return np.stack([grid[rows.start + radius + j : rows.stop + radius + j, radius + i : radius + i + wide] for j, i in offsets])


def _own(there: np.ndarray, radius: int) -> tuple[int, int]:
    return there.shape[0] - 2 * radius, there.shape[1] - 2 * radius


def _in_rows(shape: tuple[int, int], layers: int) -> Iterator[slice]:
    step = max(1, _AT_ONCE // (layers * shape[1]))
    for start in range(0, shape[0], step):
        yield slice(start, min(start + step, shape[0]))


def binomial(grids: list[np.ndarray], there: np.ndarray, radius: int) -> list[np.ndarray]:
    """Binomial (Gaussian) blur along x, then along y, rounded to whole numbers; missing pixels have no weight."""
    weights = [comb(2 * radius, k) for k in range(2 * radius + 1)]
    high, wide = _own(there, radius)

    def blurred(grid: np.ndarray) -> np.ndarray:
        across = sum(w * grid[:, k : k + wide] for k, w in enumerate(weights))
        return sum(w * across[k : k + high] for k, w in enumerate(weights))

    share = np.maximum(blurred(there.astype(np.int64)), 1)
    return [(2 * blurred(np.where(there, g, 0).astype(np.int64)) + share) // (2 * share) for g in grids]


def median(grids: list[np.ndarray], there: np.ndarray, radius: int) -> list[np.ndarray]:
    """Middle of the window's values, the lower one if their number is even."""
    span = range(-radius, radius + 1)
    offsets = [(j, i) for j in span for i in span]
    shape = _own(there, radius)
    out = [np.zeros(shape, g.dtype) for g in grids]
    for rows in _in_rows(shape, len(offsets)):
        here = _shifted(there, radius, offsets, rows)
        middle = (np.maximum(here.sum(axis=0), 1) - 1) // 2
        for grid, result in zip(grids, out):
            top = np.iinfo(grid.dtype).max if grid.dtype.kind in "iu" else np.inf
            seen = np.sort(np.where(here, _shifted(grid, radius, offsets, rows), top), axis=0)
            result[rows] = np.take_along_axis(seen, middle[None], axis=0)[0]
    return out


def entropy(grids: list[np.ndarray], there: np.ndarray, radius: int) -> list[np.ndarray]:
    """Bits of the distribution of the values in a disk: log2(n) - sum(c log2 c) / n over the value counts c."""
    span = range(-radius, radius + 1)
    offsets = [(j, i) for j in span for i in span if i * i + j * j <= radius * radius]
    shape = _own(there, radius)
    out = [np.zeros(shape) for _ in grids]
    part = np.arange(len(offsets) + 1)
    part = part * np.log2(np.maximum(part, 1))  # c log2 c
    for rows in _in_rows(shape, len(offsets)):
        here = _shifted(there, radius, offsets, rows)
        n = np.maximum(here.sum(axis=0), 1)
        for grid, result in zip(grids, out):
            # missing pixels sort behind all others and are left out of the counts
            seen = np.sort(np.where(here, _shifted(grid.astype(np.int64), radius, offsets, rows), np.iinfo(np.int64).max), axis=0)
            count, total = np.zeros(n.shape, np.int64), np.zeros(n.shape)
            for k in range(len(offsets)):
                same = (seen[k] == seen[k - 1]) if k else np.zeros(n.shape, bool)
                total += np.where(same, 0.0, part[count])
                count = np.where(k < n, np.where(same, count + 1, 1), np.where(same, count, 0))
            total += part[count]
            result[rows] = np.log2(n) - total / n
    return out


def correlation(weights: list[np.ndarray]) -> Kernel:
    """Correlation of channel k with ``weights[k]``; missing pixels are 0."""

    def kernel(grids: list[np.ndarray], there: np.ndarray, radius: int) -> list[np.ndarray]:
        high, wide = _own(there, radius)
        out = []
        for grid, weight in zip(grids, weights, strict=True):
            filled = np.where(there, grid, 0).astype(float)
            out.append(sum(w * filled[j : j + high, i : i + wide] for (j, i), w in np.ndenumerate(weight)))
        return out

    return kernel
