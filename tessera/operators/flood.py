"""Flooding a mask from markers, block by block.

A pixel belongs to the marker whose shortest path inside the mask is shortest, the smaller marker on equal length: the
least (steps, marker) over all paths.  A 512 x 512 block is flooded in one task, ring by ring, from its own markers
and from what its neighbours offer along the border.  Between rounds only border pixels travel: an offer counts
if it is less than what the pixel had, and only blocks with such an offer are flooded again.  So the number of
rounds follows the number of blocks that a shortest path crosses, not the radius of an object, and images within one block
need none.  The pixels themselves are written once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK, block_of, groups, sorted_by_block
from tessera.session import stable_copy

_FAR = np.iinfo("int64").max
_KEY = ["image_id", "_by", "_bx"]
_CELL = ["image_id", "x", "y"]


def _pack(size: int):
    """One row per block: its mask as bits, its markers by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (image, by, bx), cell in groups(batches, _KEY):
            place = (cell["y"] - by * size) * size + (cell["x"] - bx * size)
            set_ = np.zeros(size * size, bool)
            marked = cell["marked"].astype(bool)
            set_[place[~marked]] = True
            use = marked & set_[place]
            at, marker = place[use], cell["marker"][use]
            order = np.lexsort((marker, at))
            at, first = np.unique(at[order], return_index=True)
            row = {"image_id": image, "_by": by, "_bx": bx, "mask": np.packbits(set_).tobytes()}
            yield pd.DataFrame([row | {"at": at.astype("<i4").tobytes(), "marker": marker[order][first].astype("<i8").tobytes()}])

    return run


def pack(mask_px: DataFrame, marker_px: DataFrame, size: int = BLOCK) -> DataFrame:
    """``image_id, _by, _bx, mask, at, marker``: blocks that hold any of the mask, with the markers inside it."""
    both = mask_px.select(*_CELL, F.lit(0).cast("long").alias("marker"), F.lit(False).alias("marked")).unionByName(
        marker_px.select(*_CELL, F.col("marker").cast("long").alias("marker"), F.lit(True).alias("marked"))
    )
    cells = both.withColumn("_by", block_of(F.col("y"), size)).withColumn("_bx", block_of(F.col("x"), size))
    return sorted_by_block(cells, _KEY, []).mapInPandas(
        _pack(size), "image_id int, _by int, _bx int, mask binary, at binary, marker binary"
    )


def flooded(mask: np.ndarray, at: np.ndarray, steps: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least (steps, marker) of every pixel of a square mask from seeds (place, steps, marker); unreached: far, 0."""
    size = mask.shape[0]
    wide = size + 2
    open_ = np.zeros((wide, wide), bool)
    open_[1:-1, 1:-1] = mask
    open_ = open_.ravel()
    dist, label = np.full(wide * wide, _FAR), np.zeros(wide * wide, np.int64)
    order = np.lexsort((marker, steps))
    at, steps, marker = at[order], steps[order], marker[order]
    at = (at // size + 1) * wide + at % size + 1
    k, ring, owner, d = 0, np.empty(0, np.int64), np.empty(0, np.int64), 0
    while len(ring) or k < len(at):
        d = d + 1 if len(ring) else int(steps[k])
        upto = int(np.searchsorted(steps, d, "right"))
        place, whose = np.concatenate([ring, at[k:upto]]), np.concatenate([owner, marker[k:upto]])
        k = upto
        use = open_[place] & (dist[place] == _FAR)
        place, whose = place[use], whose[use]
        by_place = np.lexsort((whose, place))
        ring, first = np.unique(place[by_place], return_index=True)
        owner = whose[by_place][first]
        dist[ring], label[ring] = d, owner
        ring = np.concatenate([ring + 1, ring - 1, ring + wide, ring - wide])
        owner = np.tile(owner, 4)
        ahead = open_[ring] & (dist[ring] == _FAR)
        ring, owner = ring[ahead], owner[ahead]
    inner = np.s_[1:-1, 1:-1]
    return dist.reshape(wide, wide)[inner], label.reshape(wide, wide)[inner]


def _opened(row, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.unpackbits(np.frombuffer(row.mask, np.uint8), count=size * size).astype(bool).reshape(size, size)
    at, marker = np.frombuffer(row.at, "<i4").astype("int64"), np.frombuffer(row.marker, "<i8")
    steps = np.zeros(len(at), np.int64)
    if row.seeds is not None and len(row.seeds):
        places, far, whose = zip(*[((s["y"] - row.by * size) * size + s["x"] - row.bx * size, s["d"], s["marker"]) for s in row.seeds])
        at, steps, marker = np.r_[at, places], np.r_[steps, far], np.r_[marker, whose]
    return flooded(mask, at, steps, marker)


def _offers(size: int):
    """What a flooded block offers to the pixels just outside of it."""
    edge = np.arange(size)
    sides = [(0, edge, -1, 0), (size - 1, edge, 1, 0), (edge, 0, 0, -1), (edge, size - 1, 0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.rename(columns={"_by": "by", "_bx": "bx"}).itertuples(index=False):
                dist, label = _opened(row, size)
                parts = []
                for y, x, dy, dx in sides:
                    y, x = np.broadcast_arrays(y, x)
                    use = dist[y, x] < _FAR
                    y, x = y[use], x[use]
                    parts.append((row.bx * size + x + dx, row.by * size + y + dy, dist[y, x] + 1, label[y, x]))
                x, y, d, marker = (np.concatenate(c) for c in zip(*parts))
                yield pd.DataFrame({"image_id": row.image_id, "x": x, "y": y, "d": d, "marker": marker})

    return run


def _border(size: int):
    """Mask pixels along the border of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rim = np.ones((size, size), bool)
        rim[1:-1, 1:-1] = False
        for pdf in batches:
            for row in pdf.rename(columns={"_by": "by", "_bx": "bx"}).itertuples(index=False):
                mask = np.unpackbits(np.frombuffer(row.mask, np.uint8), count=size * size).astype(bool).reshape(size, size)
                y, x = np.nonzero(mask & rim)
                yield pd.DataFrame({"image_id": row.image_id, "x": row.bx * size + x, "y": row.by * size + y})

    return run


def _pixels(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.rename(columns={"_by": "by", "_bx": "bx"}).itertuples(index=False):
                dist, label = _opened(row, size)
                y, x = np.nonzero(dist < _FAR)
                yield pd.DataFrame({"image_id": row.image_id, "x": row.bx * size + x, "y": row.by * size + y, "marker": label[y, x]})

    return run


_SEED = "struct<x:int,y:int,d:bigint,marker:bigint>"


def _seeds(offers: DataFrame, size: int) -> DataFrame:
    """Offers by the block that gets them, at most one per border pixel."""
    placed = offers.withColumn("_by", block_of(F.col("y"), size)).withColumn("_bx", block_of(F.col("x"), size))
    return placed.groupBy(*_KEY).agg(F.collect_list(F.struct("x", "y", "d", "marker").cast(_SEED)).alias("seeds"))


def split_by_markers(mask_px: DataFrame, marker_px: DataFrame, size: int = BLOCK) -> DataFrame:
    """``image_id, x, y, marker``: every mask pixel with the marker that reaches it first inside the mask.

    Equal distances go to the smaller marker; mask parts without a marker stay unassigned; markers off the mask count for
    nothing, and of several markers on one pixel the smallest does.
    """
    blocks = stable_copy(pack(mask_px, marker_px, size))
    blank = F.lit(None).cast(f"array<{_SEED}>").alias("seeds")
    offer_schema = "image_id int, x int, y int, d bigint, marker bigint"
    border = stable_copy(blocks.mapInPandas(_border(size), "image_id int, x int, y int"))
    flooding, known = blocks.select("*", blank), None
    while True:
        offers = flooding.mapInPandas(_offers(size), offer_schema).groupBy(*_CELL).agg(F.min(F.struct("d", "marker")).alias("o"))
        offers = offers.join(border, _CELL, "left_semi")
        if known is not None:
            had = known.select(*_CELL, F.struct("d", "marker").alias("h"))
            offers = offers.join(had, _CELL, "left").where("h is null or o < h").drop("h")
        better = stable_copy(offers.select(*_CELL, "o.d", "o.marker"))
        if better.isEmpty():
            break
        merged = better if known is None else known.unionByName(better)
        least = merged.groupBy(*_CELL).agg(F.min(F.struct("d", "marker")).alias("o"))
        known = stable_copy(least.select(*_CELL, "o.d", "o.marker"))
        again = better.select(block_of(F.col("y"), size).alias("_by"), block_of(F.col("x"), size).alias("_bx"), "image_id").distinct()
        flooding = blocks.join(_seeds(known, size).join(again, _KEY, "left_semi"), _KEY)
    last = blocks.select("*", blank) if known is None else blocks.join(_seeds(known, size), _KEY, "left")
    return last.mapInPandas(_pixels(size), "image_id int, x int, y int, marker bigint")
