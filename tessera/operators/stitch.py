"""Merge of independently detected tile results into one duplicate-free instance table.

The set-wise rules are used: the drop rules are row-local, and the eviction by crosses looks at what
the other three sets kept.  They are exact when the tile pitch exceeds four margins, which
``check_layout`` asserts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import Box
from tessera.operators.range_join import box_pairs
from tessera.session import small_enough, stable_copy


def check_layout(pitch: int, margin: int) -> None:
    if pitch <= 4 * margin:
        raise ValueError(f"tile pitch {pitch} must exceed four margins of {margin}")


def dropped_in_tile(margin: int = 64) -> Column:
    """True for detections their own tile must not keep.

    Grid and cross tiles drop boxes lying inside a margin band; strips drop boxes meeting the band of
    a flagged side, or the outermost pixel line of an unflagged one.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cross = F.col("mode") == 3
    m = margin
    inside_band = (
        (((F.col("ft") == 1) | cross) & (F.col("by1") <= m))
        | (((F.col("fb") == 1) | cross) & (F.col("by0") >= h - m))
        | (((F.col("fl") == 1) | cross) & (F.col("bx1") <= m))
        | (((F.col("fr") == 1) | cross) & (F.col("bx0") >= w - m))
    )
    depth = lambda flag: F.when(F.col(flag) == 1, F.lit(m)).otherwise(F.lit(1))
    meets_edge = (
        (F.col("by0") <= depth("ft"))
        | (F.col("by1") >= h - depth("fb"))
        | (F.col("bx0") <= depth("fl"))
        | (F.col("bx1") >= w - depth("fr"))
    )
    return F.when(F.col("mode").isin(0, 3), inside_band).otherwise(meets_edge)


# what tells detections apart
DETECTION = ["slide_id", "mode", "c", "r", "inst_id"]


def to_slide_space(detections: DataFrame) -> DataFrame:
    """Add slide coordinates to tile-local detections."""
    return detections.select(
        "*",
        (F.col("bx0") + F.col("x0")).alias("gx0"),
        (F.col("by0") + F.col("y0")).alias("gy0"),
        (F.col("bx1") + F.col("x0")).alias("gx1"),
        (F.col("by1") + F.col("y0")).alias("gy1"),
    )


def with_uid(detections: DataFrame) -> DataFrame:
    """A reproducible uid: the hash of what tells the detection apart."""
    return detections.withColumn("uid", F.sha2(F.concat_ws("|", *DETECTION), 256))


def kept_in_tile(detections: DataFrame, margin: int = 64) -> DataFrame:
    return to_slide_space(detections.where(~dropped_in_tile(margin)))


def cross_lines(tiles: DataFrame, margin: int = 64) -> DataFrame:
    """The four inner margin lines of every cross tile, as degenerate boxes in slide space."""
    m = margin
    x0, y0, x1, y1 = F.col("x0") + m, F.col("y0") + m, F.col("x1") - m, F.col("y1") - m
    line = lambda *v: F.struct(*[c.cast("int").alias(n) for c, n in zip(v, ("lx0", "ly0", "lx1", "ly1"))])
    lines = F.array(
        line(x0, y0, x1, y0), line(x0, y1, x1, y1), line(x0, y0, x0, y1), line(x1, y0, x1, y1)
    )
    return tiles.where("mode = 3").select("slide_id", F.explode(lines).alias("l")).select("slide_id", "l.*")


def evicted(kept: DataFrame, tiles: DataFrame, margin: int = 64, cell: int = 1024) -> DataFrame:
    """Keys of the kept grid and strip detections that meet a cross line.

    The grid levels of the lines follow from the widest cross there is; detections may have any size, for
    which only the few lines are repeated per level.
    """
    widest = tiles.where("mode = 3").agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1
    line_levels = list(range(max(0, math.ceil(math.log2(widest / cell))) + 1))
    pairs = box_pairs(
        kept.where("mode <> 3").select(*DETECTION, "gx0", "gy0", "gx1", "gy1"),
        cross_lines(tiles, margin),
        on=["slide_id"],
        left_box=("gx0", "gy0", "gx1", "gy1"),
        right_box=("lx0", "ly0", "lx1", "ly1"),
        keep_left=DETECTION[1:],
        keep_right=[],
        cell=cell,
        distinct_pairs=False,
        levels=(list(range(20)), line_levels),
        split_crowded=False,  # a cell holds few lines
    )
    return pairs.select("slide_id", *[F.col("l_" + k).alias(k) for k in DETECTION[1:]]).distinct()


def stitch(detections: DataFrame, tiles: DataFrame, margin: int = 64) -> DataFrame:
    """Stitch against any tile layout: drop rules, then a binned range anti join with the cross lines."""
    kept = kept_in_tile(detections, margin)
    gone = stable_copy(evicted(kept, tiles, margin))
    gone = F.broadcast(gone) if small_enough(gone) else gone.hint("merge")
    return with_uid(kept.join(gone, DETECTION, "left_anti"))


def meets_cross_line(pitch: int, margin: int) -> Column:
    """True when a slide-space box meets the margin square outline of any grid junction.

    On the regular layout the crosses sit at multiples of the pitch, so the junctions a box can meet
    follow from its own coordinates; needs ``proc_w``/``proc_h`` on the row.
    """
    p = F.lit(pitch).cast("double")

    def junctions(lo: Column, hi: Column, length: Column) -> Column:
        first = F.greatest(F.ceil((lo - margin) / p).cast("int"), F.lit(1))
        last = F.least(F.floor((hi + margin) / p).cast("int"), (F.ceil(length / p) - 1).cast("int"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    gx0, gy0, gx1, gy1 = (F.col(n) for n in ("gx0", "gy0", "gx1", "gy1"))

    def outline_hit(i: Column, j: Column) -> Column:
        jx, jy = i * pitch, j * pitch
        touches = (gx0 <= jx + margin) & (gx1 >= jx - margin) & (gy0 <= jy + margin) & (gy1 >= jy - margin)
        swallowed = (gx0 > jx - margin) & (gx1 < jx + margin) & (gy0 > jy - margin) & (gy1 < jy + margin)
        return touches & ~swallowed

    return F.exists(
        junctions(gx0, gx1, F.col("proc_w")),
        lambda i: F.exists(junctions(gy0, gy1, F.col("proc_h")), lambda j: outline_hit(i, j)),
    )


def stitch_on_grid(detections: DataFrame, pitch: int, margin: int = 64) -> DataFrame:
    """Stitch detections of the regular layout in one narrow pass: no join and no shuffle.

    The rows must carry their slide's ``proc_w`` and ``proc_h``.
    """
    check_layout(pitch, margin)
    return kept_in_tile(detections, margin).where((F.col("mode") == 3) | ~meets_cross_line(pitch, margin))
