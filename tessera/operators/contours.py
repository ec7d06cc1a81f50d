"""Ordered outlines of pixel sets.

Every side that a set pixel turns to an unset one is a half-edge, run clockwise; which half-edge follows it can be seen
from the two pixels ahead (diagonal neighbours belong together).  Following them gives one closed ring per outer border and
per hole; the pixels that own the half-edges, in that order, are the outline.

A 512 x 512 block links its own half-edges in one task, by pointer doubling on arrays.  Rings inside a block are done
then.  What crosses blocks leaves fragments, rows of (first half-edge, first half-edge of the next fragment, points), and those
are ranked over the cluster: pointer jumping finds each ring's first half-edge, then every fragment's distance to the end
of its ring, in as many rounds as the logarithm of the blocks a ring crosses.  A row never holds more than the border
inside one block; ``outlines`` puts them together for exports that want a whole polygon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.blocks import BLOCK, block_of, many_groups, sorted_by_block
from tessera.operators.runs import to_runs
from tessera.session import stable_copy
from tessera.sources.store import POINT

# sides of a pixel: top, right, bottom, left; a half-edge is named ((y * 2**30) + x) * 4 + side
_OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])  # (y, x) of the pixel beyond the side
_ON = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])  # (y, x) in which it runs


def _linked(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, rank, closed) of every element of chains and rings given by ``after`` (-1: the chain ends).

    The first element of a ring is its smallest.
    """
    n = len(after)
    own = np.arange(n)
    before = own.copy()
    linked = np.flatnonzero(after >= 0)
    before[after[linked]] = linked
    rounds = max(n - 1, 1).bit_length()
    jump, least = before.copy(), own.copy()
    for _ in range(rounds):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    closed = before[jump] != jump
    before = np.where(closed & (least == own), own, before)
    jump, rank = before.copy(), (before != own).astype(np.int64)
    for _ in range(rounds):
        rank, jump = rank + rank[jump], jump[jump]
    return jump, rank, closed


def half_edges(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, first: np.ndarray, low: tuple[np.ndarray, np.ndarray], size: int) -> dict[str, np.ndarray]:
    """Half-edges of the pixels in the blocks from ``low`` (y, x) on, given the runs of those and of their neighbours.

    ``first`` is each block's first run; every block has a stretch of its own in one array, with an unset margin.
    ``block, y, x, side`` in the order of their names, ``after`` (place of the next one, -1 if its pixel lies beyond), and its name.
    """
    block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(y)]))
    top, left, high, wide = _extent(y, x0, x1, first)
    end = np.cumsum(high * wide)
    base = end - high * wide
    change = np.zeros(end[-1], np.int32)
    row = base[block] + (y - top[block]) * wide[block] - left[block]
    np.add.at(change, row + x0, 1)
    np.add.at(change, row + x1 + 1, -1)
    flat = change.cumsum() > 0
    pixel = np.flatnonzero(flat)
    of = np.searchsorted(end, pixel, "right")
    py, px = (pixel - base[of]) // wide[of] + top[of], (pixel - base[of]) % wide[of] + left[of]
    inside = (py >= low[0][of]) & (py < low[0][of] + size) & (px >= low[1][of]) & (px < low[1][of] + size)
    within = np.zeros(len(flat), bool)
    pixel, of, py, px = (v[inside] for v in (pixel, of, py, px))
    within[pixel] = True
    out = _OUT[:, 0] * wide[of][:, None] + _OUT[:, 1]
    k, side = np.nonzero(~flat[pixel[:, None] + out])
    at, of = pixel[k], of[k]
    ahead = at + _ON[side, 0] * wide[of] + _ON[side, 1]
    turn = ahead + out[k, side]
    follow = np.where(flat[turn], turn, np.where(flat[ahead], ahead, at))
    side_after = np.where(flat[turn], side + 3, np.where(flat[ahead], side, side + 1)) % 4
    place = np.searchsorted(at * 4 + side, follow * 4 + side_after)
    after = np.where(within[follow], place, -1)
    fy, fx = (follow - base[of]) // wide[of] + top[of], (follow - base[of]) % wide[of] + left[of]
    return {"block": of, "y": py[k], "x": px[k], "side": side, "after": after, "next": ((fy << 30) + fx) * 4 + side_after}


def _extent(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(top, left, height, width) of each block's runs with a margin of one pixel."""
    top, left = np.minimum.reduceat(y, first) - 1, np.minimum.reduceat(x0, first) - 1
    return top, left, np.maximum.reduceat(y, first) - top + 2, np.maximum.reduceat(x1, first) - left + 2


def _bends(y: np.ndarray, x: np.ndarray, heads: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which points of closed rings, one behind the other, change their ring's direction."""
    before, behind = np.arange(len(y)) - 1, np.arange(len(y)) + 1
    before[heads], behind[heads + size - 1] = heads + size - 1, heads
    dy, dx = y - y[before], x - x[before]
    return (dy != dy[behind]) | (dx != dx[behind]) | (np.repeat(size, size) <= 2)


_RUNS, _CELLS = 50_000, 8_000_000  # runs gathered, cells of one array: many small blocks, or one block, at a time


def _trace(keys: list[str], size: int, simplify: bool):
    def traced(run_: dict[str, np.ndarray], first: np.ndarray, kinds: dict) -> pa.RecordBatch | None:
        lead = [run_[k][first] for k in keys]
        low = tuple(run_[c][first].astype("int64") * size for c in ("_by", "_bx"))
        edge = half_edges(*(run_[c].astype("int64") for c in ("y", "x0", "x1")), first, low, size)
        if not len(edge["y"]):
            return None
        chain, rank, closed = _linked(edge["after"])
        order = np.lexsort((rank, chain))
        block, y, x, side, closed, next_ = (v[order] for v in (edge["block"], edge["y"], edge["x"], edge["side"], closed, edge["next"]))
        heads = np.flatnonzero(rank[order] == 0)
        ends = np.r_[heads[1:], len(y)]
        area = np.add.reduceat(np.where(side == 1, x + 1, np.where(side == 3, -x, 0)), heads)
        name = ((y << 30) + x) * 4 + side
        least = np.minimum.reduceat(name, heads)
        stay = np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])]
        stay[heads] = True
        ring = np.repeat(np.arange(len(heads)), ends - heads)
        whole = closed[heads]
        wanted = ~whole | (area > 0)  # not the border of a hole
        # points before the smallest name of an open fragment; a closed one starts with it
        nth = np.cumsum(stay)
        cut = np.zeros(len(heads), np.int64)
        lowest = np.flatnonzero(name == least[ring])
        cut[ring[lowest]] = nth[lowest] - nth[heads[ring[lowest]]]
        # a closed ring does not repeat its first point
        kept = stay & wanted[ring]
        final = np.maximum.reduceat(np.where(stay, np.arange(len(y)), -1), heads)
        again = whole & (final > heads) & (y[final] == y[heads]) & (x[final] == x[heads])
        kept[final[again]] = False
        y, x, ring = y[kept], x[kept], ring[kept]
        if simplify and len(y):
            starts = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
            bend = _bends(y, x, starts, np.diff(np.r_[starts, len(y)])) | ~whole[ring]
            y, x, ring = y[bend], x[bend], ring[bend]
        some = np.flatnonzero(wanted)
        offsets = np.r_[0, np.cumsum(np.bincount(ring, minlength=len(heads))[some])]
        points = pa.StructArray.from_arrays([pa.array(x.astype("int32")), pa.array(y.astype("int32"))], ["x", "y"])
        at, shut = heads[some], whole[some]
        columns = [pa.array(v[block[at]], kinds[k]) for k, v in zip(keys, lead)]
        columns += [pa.array(name[at]), pa.array(next_[ends[some] - 1], mask=shut), pa.array(np.where(shut, name[at], least[some]))]
        columns += [pa.array(np.where(shut, 0, cut[some]).astype("int32")), pa.array(area[some].astype("int64"))]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), points))
        return pa.RecordBatch.from_arrays(columns, [*keys, "head", "next", "low", "cut", "area", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {}

        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                kinds.update({f.name: f.type for f in batch.schema})
                yield batch.to_pandas()

        for runs, first in many_groups(frames(), [*keys, "_by", "_bx"], _RUNS):
            _, _, high, wide = _extent(*(runs[c].astype("int64") for c in ("y", "x0", "x1")), first)
            stack = np.cumsum(high * wide) // _CELLS
            for lo, hi in zip(*(lambda b: (b[:-1], b[1:]))(np.r_[np.flatnonzero(np.r_[True, stack[1:] != stack[:-1]]), len(first)])):
                a, b = first[lo], first[hi] if hi < len(first) else len(runs["y"])
                made = traced({c: v[a:b] for c, v in runs.items()}, first[lo:hi] - a, kinds)
                if made is not None:
                    yield made

    return run


def _fragments(px: DataFrame, keys: list[str], simplify: bool, size: int) -> DataFrame:
    """``keys, head, next, low, cut, area, points``: closed rings (no next) and what crosses blocks."""
    runs = to_runs(px, keys)
    near = lambda lo, hi: F.explode(F.sequence(block_of(lo - 1, size), block_of(hi + 1, size)))
    sent = runs.withColumn("_bx", near(F.col("x0"), F.col("x1"))).withColumn("_by", near(F.col("y"), F.col("y")))
    # a neighbouring block needs no more of a run than the pixels next to it
    edge = F.col("_bx") * size
    cut = sent.withColumn("x0", F.greatest("x0", edge - 1)).withColumn("x1", F.least("x1", edge + size))
    long = [T.StructField(c, T.LongType()) for c in ("head", "next", "low")] + [T.StructField("cut", T.IntegerType()), T.StructField("area", T.LongType())]
    schema = T.StructType([*px.select(*keys).schema.fields, *long, T.StructField("points", T.ArrayType(POINT))])
    return sorted_by_block(cut, [*keys, "_by", "_bx"], []).mapInArrow(_trace(keys, size, simplify), schema)


def _with_places(open_: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, head, ring, place, last``: ring (its first half-edge) and place of every fragment on outer rings."""
    node = lambda df, *cols: df.select(*keys, F.col("head").alias("jump"), *cols)
    seen = stable_copy(open_.select(*keys, "head", F.col("next").alias("jump"), "low", F.lit(True).alias("fell")))
    while True:  # the smallest name among 2, 4, 8 ... fragments from here on
        ahead = node(seen, F.col("jump").alias("_jump"), F.col("low").alias("_low"))
        seen = stable_copy(
            seen.join(ahead, [*keys, "jump"]).select(
                *keys, "head", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell")
            )
        )
        if seen.where("fell").isEmpty():
            break
    ring = seen.select(*keys, "head", F.col("low").alias("ring"))
    named = open_.select(*keys, "head", "next", "low", "area").join(ring, [*keys, "head"])
    outer = named.groupBy(*keys, "ring").agg(F.sum("area").alias("turned"), F.count("*").alias("n")).where("turned > 0")
    named = stable_copy(named.join(outer.select(*keys, "ring", "n"), [*keys, "ring"]))
    starts = named.where("low = ring").select(*keys, F.col("head").alias("next"), F.lit(True).alias("start"))
    linked = named.join(starts, [*keys, "next"], "left")
    open_end = F.when(F.col("start").isNull(), F.col("next"))
    left = stable_copy(linked.select(*keys, "head", "ring", "n", open_end.alias("jump"), F.when(F.col("start").isNull(), 1).otherwise(0).cast("long").alias("steps")))
    while not left.where("jump is not null").isEmpty():
        ahead = node(left, F.col("jump").alias("_jump"), F.col("steps").alias("_steps"))
        left = stable_copy(
            left.join(ahead, [*keys, "jump"], "left").select(
                *keys, "head", "ring", "n", F.col("_jump").alias("jump"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
            )
        )
    return left.select(*keys, "head", "ring", (F.col("n") - 1 - F.col("steps")).alias("place"), F.col("n").alias("last"))


def _bent(points: Column, before: Column, behind: Column) -> Column:
    """Points at which the direction changes, given the points around them."""
    point = lambda i: F.when(i < 0, before).when(i >= F.size(points), behind).otherwise(F.get(points, i))

    def bend(p: Column, i: Column) -> Column:
        a, b = point(i - 1), point(i + 1)
        return (p["x"] - a["x"] != b["x"] - p["x"]) | (p["y"] - a["y"] != b["y"] - p["y"])

    return F.filter(points, bend)


def outline_parts(px: DataFrame, keys: list[str], simplify: bool = False, size: int = BLOCK) -> DataFrame:
    """``keys, ring, part, points``: outer outlines in order, at most the border within one block to a row.

    ``ring`` names the first pixel of the piece in raster order, where the outline starts.  ``simplify`` keeps only the points
    at which the direction changes.
    """
    made = stable_copy(_fragments(px, keys, simplify, size))
    whole = made.where("next is null").select(*keys, F.col("head").alias("ring"), F.lit(0).cast("long").alias("part"), "points")
    open_ = made.where("next is not null")
    if open_.isEmpty():
        return whole
    placed = open_.join(_with_places(open_, keys), [*keys, "head"])
    # the fragment with the ring's first half-edge is where it starts and ends
    behind_cut = F.slice("points", F.col("cut") + 1, F.size("points"))
    pieces = F.when(
        F.col("low") == F.col("ring"),
        F.array(
            F.struct(F.lit(0).cast("long").alias("part"), behind_cut.alias("points")),
            F.struct(F.col("last").alias("part"), F.slice("points", 1, F.col("cut")).alias("points")),
        ),
    ).otherwise(F.array(F.struct(F.col("place").alias("part"), F.col("points").alias("points"))))
    parts = placed.select(*keys, "ring", F.explode(pieces).alias("p")).select(*keys, "ring", "p.*").where(F.size("points") > 0)
    if simplify:
        order = Window.partitionBy(*keys, "ring").orderBy("part")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        head, tail = F.element_at("points", 1), F.element_at("points", -1)
        parts = parts.select(
            *keys,
            "ring",
            "part",
            "points",
            F.coalesce(F.lag(tail).over(order), F.last(tail).over(every)).alias("_a"),
            F.coalesce(F.lead(head).over(order), F.first(head).over(every)).alias("_b"),
        )
        parts = parts.select(*keys, "ring", "part", _bent(F.col("points"), F.col("_a"), F.col("_b")).alias("points")).where(F.size("points") > 0)
    return whole.unionByName(parts)


def outlines(px: DataFrame, keys: list[str], simplify: bool = False, size: int = BLOCK) -> DataFrame:
    """Outer outline of each piece of each key's pixels as ``contour``, one row per piece.

    Outlines shorter than three points are kept and left to the usability filter.
    """
    parts = outline_parts(px, keys, simplify, size)
    ordered = F.array_sort(F.collect_list(F.struct("part", "points")))
    return parts.groupBy(*keys, "ring").agg(ordered.alias("_p")).select(*keys, F.flatten(F.transform("_p", lambda p: p["points"])).alias("contour"))
