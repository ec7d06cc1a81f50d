"""Binary morphology on row runs.

A structuring element is a list of rows ``(dy, lo, hi)``: offsets lo..hi at vertical offset dy.  A
dilation repeats every run once per element row (not once per element pixel); an erosion keeps the
stretches covered by the shrunk runs of all element rows.  All windows are bounded by one image row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, padded
from tessera.operators.components import component_boxes, label_runs
from tessera.operators.flood import split_by_markers
from tessera.operators.runs import covered_by_all, depths, gaps, merge_runs, to_pixels, to_runs, with_frames
from tessera.session import stable_copy

Element = list[tuple[int, int, int]]


def ellipse(size: int) -> Element:
    """Ellipse filling a size x size box, anchored at size // 2."""
    r = size // 2
    rows = []
    for dy in range(-r, size - r):
        half = round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
        rows.append((dy, -half, min(half, size - r - 1)))
    return rows


def disk(radius: int) -> Element:
    """Points with x^2 + y^2 <= r^2."""
    return [(dy, -math.isqrt(radius**2 - dy**2), math.isqrt(radius**2 - dy**2)) for dy in range(-radius, radius + 1)]


def _element_rows(element: Element) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dy, lo, hi in element])


def dilate(runs: DataFrame, keys: list[str], element: Element, framed: bool = False) -> DataFrame:
    """Pixels p with a set pixel at p + o for some offset o; cut to 0..w-1, 0..h-1 when ``framed``."""
    extra = ["w", "h"] if framed else []
    moved = runs.select(*keys, *extra, "y", "x0", "x1", F.explode(_element_rows(element)).alias("e")).select(
        *keys,
        *extra,
        (F.col("y") - F.col("e.dy")).alias("y"),
        (F.col("x0") - F.col("e.hi")).alias("x0"),
        (F.col("x1") - F.col("e.lo")).alias("x1"),
    )
    if framed:
        moved = moved.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("x1", F.least("x1", F.col("w") - 1))
        moved = moved.where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x0") <= F.col("x1")))
    return merge_runs(moved, keys)


def erode(runs: DataFrame, keys: list[str], element: Element, framed: bool = False) -> DataFrame:
    """Pixels p with p + o set for every offset o.

    ``framed`` counts everything outside 0..w-1, 0..h-1 as set; otherwise it counts as unset.
    """
    extra = ["w", "h"] if framed else []
    moved = runs.select(*keys, *extra, "y", "x0", "x1", F.explode(_element_rows(element)).alias("e"))
    x0, x1 = F.col("x0") - F.col("e.lo"), F.col("x1") - F.col("e.hi")
    if framed:
        x0 = F.when(F.col("x0") <= 0, F.lit(0)).otherwise(x0)
        x1 = F.when(F.col("x1") >= F.col("w") - 1, F.col("w") - 1).otherwise(x1)
    moved = moved.select(*keys, *extra, (F.col("y") - F.col("e.dy")).alias("y"), x0.alias("x0"), x1.alias("x1"))
    moved = moved.where("x0 <= x1")
    if not framed:
        return covered_by_all(moved, keys, F.lit(len(element)))
    offsets = F.array(*[F.lit(dy) for dy, _, _ in element])
    need = F.size(F.filter(offsets, lambda dy: (F.col("y") + dy >= 0) & (F.col("y") + dy < F.col("h"))))
    inside = moved.where((F.col("y") >= 0) & (F.col("y") < F.col("h")))
    return covered_by_all(inside.select(*keys, "y", "x0", "x1", need.alias("need")), keys, F.col("need"))


def boundary_pixels(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels lacking at least one of their four neighbours in the same object."""
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    hit = lambda shifted, value: F.coalesce(shifted == value, F.lit(False))
    marked = (
        px.select(*keys, "x", "y")
        .distinct()
        .withColumn("_h", hit(F.lag("x").over(across), F.col("x") - 1) & hit(F.lead("x").over(across), F.col("x") + 1))
        .withColumn("_v", hit(F.lag("y").over(down), F.col("y") - 1) & hit(F.lead("y").over(down), F.col("y") + 1))
    )
    return marked.where(~(F.col("_h") & F.col("_v"))).select(*keys, "x", "y")


def _unset_in_box(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps of each key inside its own bounding box, with the box; row breaks count as full-width gaps."""
    box = runs.groupBy(*keys).agg(
        F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")
    )
    placed = runs.select(*keys, "y", "x0", "x1").join(box, keys)
    inside = gaps(placed, keys, F.col("bx0"), F.col("bx1"))
    rows = placed.select(*keys, "y", "bx0", "bx1", "by0", "by1").distinct()
    after = F.lead("y").over(Window.partitionBy(*keys).orderBy("y"))
    breaks = rows.withColumn("_next", after).where(F.col("_next") > F.col("y") + 1)
    empty = F.explode(F.array_distinct(F.array(F.col("y") + 1, F.col("_next") - 1)))
    full = breaks.select(*keys, empty.alias("y"), "bx0", "bx1", "by0", "by1", F.col("bx0").alias("x0"), F.col("bx1").alias("x1"))
    return inside.unionByName(full)


def holes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the enclosed background of each key: unset components off the bounding-box edge."""
    unset = label_runs(_unset_in_box(runs, keys), keys, "_part")
    edge = (
        (F.col("x0") <= F.col("bx0")) | (F.col("x1") >= F.col("bx1")) | (F.col("y") <= F.col("by0")) | (F.col("y") >= F.col("by1"))
    )
    open_parts = unset.where(edge).select(*keys, "_part").distinct()
    return unset.join(open_parts, [*keys, "_part"], "left_anti").select(*keys, "y", "x0", "x1")


def fill_holes(runs: DataFrame, keys: list[str]) -> DataFrame:
    runs = stable_copy(runs.select(*keys, "y", "x0", "x1"))
    return merge_runs(runs.select(*keys, "y", "x0", "x1").unionByName(holes(runs, keys)), keys)


def fill_small_holes(runs: DataFrame, keys: list[str], frames: DataFrame, limit: int) -> DataFrame:
    """Set every unset component of the frame with fewer than ``limit`` pixels, border parts included."""
    runs = stable_copy(runs.select(*keys, "y", "x0", "x1"))
    sized = with_frames(runs, frames, keys)
    some = gaps(sized, keys, F.lit(0), F.col("w") - 1)
    rows = frames.select(*keys, "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    blank = rows.join(runs.select(*keys, "y").distinct(), [*keys, "y"], "left_anti").select(
        *keys, "y", "w", "h", F.lit(0).alias("x0"), (F.col("w") - 1).alias("x1")
    )
    unset = label_runs(some.unionByName(blank), keys)
    small = component_boxes(unset, keys).where(F.col("area") < limit).select(*keys, "comp")
    filled = unset.join(small, [*keys, "comp"], "left_semi").select(*keys, "y", "x0", "x1")
    return merge_runs(runs.select(*keys, "y", "x0", "x1").unionByName(filled), keys)


def drop_small_components(runs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    labelled = label_runs(runs.select(*keys, "y", "x0", "x1"), keys)
    big = component_boxes(labelled, keys).where(F.col("area") >= limit).select(*keys, "comp")
    return labelled.join(big, [*keys, "comp"], "left_semi").select(*keys, "y", "x0", "x1")


def refine_tissue(px: DataFrame, frames: DataFrame, radius: int = 3, limit: int = 2000) -> DataFrame:
    """Tissue-mask clean-up: erode, fill and drop small parts, dilate, fill again."""
    keys = ["image_id"]
    element = disk(radius)
    runs = erode(to_runs(px, keys), keys, element)
    runs = fill_small_holes(runs, keys, frames, limit)
    runs = drop_small_components(runs, keys, limit)
    runs = dilate(with_frames(runs, frames, keys), keys, element, framed=True)
    runs = fill_small_holes(runs, keys, frames, limit)
    return to_pixels(fill_holes(runs, keys), keys)


def grow_instances(px: DataFrame, frames: DataFrame, size: int, limit: int) -> DataFrame:
    """Foreground to instances: label, drop small parts, dilate each, fill its holes.

    Each part grows inside its padded crop (a side is padded by two element sizes only where that
    stays inside the image).  Where grown parts meet, the later label wins.
    """
    keys = ["image_id", "comp"]
    labelled = label_runs(to_runs(px, ["image_id"]), ["image_id"])
    boxes = component_boxes(labelled, ["image_id"]).where(F.col("area") >= limit)
    crop = padded(Box.of(), 2 * size, F.col("w"), F.col("h"))
    crops = with_frames(boxes, frames, ["image_id"]).select(
        *keys, crop.x0.alias("cx0"), crop.y0.alias("cy0"), crop.x1.alias("cx1"), crop.y1.alias("cy1")
    )
    grown = dilate(labelled.join(crops.select(*keys), keys, "left_semi"), keys, ellipse(size)).join(crops, keys)
    cut = grown.where((F.col("y") >= F.col("cy0")) & (F.col("y") < F.col("cy1"))).select(
        *keys, "y", F.greatest("x0", "cx0").alias("x0"), F.least("x1", F.col("cx1") - 1).alias("x1")
    )
    solid = fill_holes(cut.where("x0 <= x1"), keys)
    return to_pixels(solid, keys).groupBy("image_id", "x", "y").agg(F.max("comp").alias("comp"))


def nuclei_from_heads(scores: DataFrame, frames: DataFrame) -> DataFrame:
    """Touching nuclei apart: eroded joint foreground as mask, inner map as markers.

    ``scores(image_id, x, y, inner, ring)``.  Returns ``image_id, x, y, marker``.
    """
    keys = ["image_id"]
    fg = with_frames(to_runs(scores.where(F.col("inner") + F.col("ring") > 0.5), keys), frames, keys)
    mask = drop_small_components(erode(fg, keys, ellipse(3), framed=True), keys, 8)
    seeds = fill_holes(drop_small_components(to_runs(scores.where(F.col("inner") > 0.5), keys), keys, 4), keys)
    markers = to_pixels(label_runs(seeds, keys), ["image_id", "comp"]).withColumnRenamed("comp", "marker")
    return split_by_markers(to_pixels(mask, keys), markers)


# ---- training targets ----------------------------------------------------------------------------


def eroded_targets(px: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Inner map: pixels left after eroding each instance."""
    keys = ["image_id", "inst_id"]
    inner = erode(with_frames(to_runs(px, keys), frames, ["image_id"]), keys, ellipse(size), framed=True)
    return to_pixels(merge_runs(inner.drop("inst_id"), ["image_id"]), ["image_id"]).select("image_id", "x", "y").withColumn("value", F.lit(1))


def contour_targets(px: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Class map of each image: 1 inner, 2 ring (grown minus eroded), 3 where they overlap.

    Pixels with neither are background and not listed; ``background`` is 1 - (inner + ring).
    """
    keys = ["image_id", "inst_id"]
    runs = with_frames(to_runs(px, keys), frames, ["image_id"])
    both = erode(runs, keys, ellipse(size), framed=True).unionByName(dilate(runs, keys, ellipse(size), framed=True))
    # an instance's inner part lies in its grown part: two layers deep is inner, one is ring
    layers = depths(both, keys).select(*keys, "y", "x0", "x1", "depth")
    edge = lambda x, d: F.struct(x.alias("x"), *[(F.lit(d) * (F.col("depth") == k).cast("int")).alias(n) for n, k in (("i", 2), ("r", 1))])
    events = (
        layers.select("image_id", "y", F.explode(F.array(edge(F.col("x0"), 1), edge(F.col("x1") + 1, -1))).alias("e"))
        .groupBy("image_id", "y", F.col("e.x").alias("x"))
        .agg(F.sum("e.i").alias("i"), F.sum("e.r").alias("r"))
    )
    row = Window.partitionBy("image_id", "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    there = lambda c: (F.sum(c).over(upto) > 0).cast("int").alias(c)
    flags = events.select("image_id", "y", F.col("x").alias("x0"), (F.lead("x").over(row) - 1).alias("x1"), there("i"), there("r"))
    return to_pixels(flags.where("i + r > 0"), ["image_id", "i", "r"]).select(
        "image_id", "x", "y", (F.col("i") + 2 * F.col("r")).alias("value"), (1 - F.col("i") - F.col("r")).alias("background")
    )


# target code -> function of (pixels, frames); codes name the map and the element size
TARGETS = {
    "IP": lambda px, frames: px.select("image_id", "x", "y", F.lit(1).alias("value")),
    "IP-ERODED-3": lambda px, frames: eroded_targets(px, frames, 3),
    "IP-ERODED-11": lambda px, frames: eroded_targets(px, frames, 11),
    "IP-ERODED-CONTOUR-3": lambda px, frames: contour_targets(px, frames, 3),
    "IP-ERODED-CONTOUR-11": lambda px, frames: contour_targets(px, frames, 11),
    "NP": lambda px, frames: px.select("image_id", "x", "y", F.lit(1).alias("value")),
    "TP": lambda px, frames: px.select("image_id", "x", "y", F.col("cls").alias("value")),
    "PC": lambda px, frames: px.select("image_id", "x", "y", F.col("cls").alias("value")),
}


def target_map(code: str, px: DataFrame, frames: DataFrame) -> DataFrame:
    if code not in TARGETS:
        raise KeyError(f"unknown target code {code}; known: {sorted(TARGETS)}")
    return TARGETS[code](px, frames)


# task -> instance post-processing of a foreground pixel set
POSTPROCESS = {
    "gland": lambda px, frames: grow_instances(px, frames, 11, 1500),
    "lumen": lambda px, frames: grow_instances(px, frames, 3, 150),
    "nuclei": lambda px, frames: grow_instances(px, frames, 3, 8),
}


def postprocess(task: str, px: DataFrame, frames: DataFrame) -> DataFrame:
    if task not in POSTPROCESS:
        raise KeyError(f"unknown task {task}; known: {sorted(POSTPROCESS)}")
    return POSTPROCESS[task](px, frames)
