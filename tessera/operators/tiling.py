"""Patch and tile placement over slides.

Every generator turns one slide row into its grid with ``sequence`` + ``explode``.  Slide tables are
tiny and often sit in one partition, so the grid columns are spread over the cluster before the rows
are generated: only (slide, column) pairs are shuffled, and one huge slide is generated by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import truncate
from tessera.session import shuffle_width, small_enough


def _steps(count: Column) -> Column:
    """0 .. count-1, empty when count < 1."""
    return F.when(count >= 1, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


BAND = 16  # neighbouring columns of a grid that are made in one task, so that what overlaps is summed there


def lattice(df: DataFrame, cols: Column, rows: Column, keep: list[str]) -> DataFrame:
    """One row per (c, r) cell of a per-row lattice."""
    columns = df.select(*keep, rows.alias("_rows"), F.explode(_steps(cols)).alias("c"))
    spread = columns.repartition(shuffle_width(df.sparkSession), keep[0], F.floor(F.col("c") / F.lit(float(BAND))))
    return spread.select(*keep, "c", F.explode(_steps(F.col("_rows"))).alias("r"))


def _cells(length: Column, step: int) -> Column:
    return F.ceil(length / F.lit(step).cast("double")).cast("int")


def centred_patches(slides: DataFrame, patch_in: int = 448, patch_out: int = 144) -> DataFrame:
    """Read/write boxes at stride ``patch_out``; the read box is centred on the write box."""
    pad = (patch_in - patch_out) // 2
    grid = lattice(
        slides, _cells(F.col("proc_w"), patch_out), _cells(F.col("proc_h"), patch_out), ["slide_id", "proc_w", "proc_h"]
    )
    x0, y0 = F.col("c") * patch_out, F.col("r") * patch_out
    return grid.select(
        "slide_id",
        "c",
        "r",
        x0.alias("out_x0"),
        y0.alias("out_y0"),
        (x0 + patch_out).alias("out_x1"),
        (y0 + patch_out).alias("out_y1"),
        (x0 - pad).alias("in_x0"),
        (y0 - pad).alias("in_y0"),
        (x0 - pad + patch_in).alias("in_x1"),
        (y0 - pad + patch_in).alias("in_y1"),
    )


def mirrored_patches(images: DataFrame, patch_in: int = 448, patch_out: int = 144) -> DataFrame:
    """Patches over a mirror-padded image, in padded coordinates; each placement once."""
    pad = (patch_in - patch_out) // 2

    def last(length: Column) -> Column:
        return (F.ceil((length - patch_out) / F.lit(patch_out).cast("double")).cast("int") + 1) * patch_out

    sized = images.withColumn("last_w", last(F.col("w"))).withColumn("last_h", last(F.col("h")))
    sized = sized.withColumn("pad_w", F.col("last_w") + patch_in + pad).withColumn(
        "pad_h", F.col("last_h") + patch_in + pad
    )
    grid = lattice(
        sized,
        (F.col("last_w") / patch_out).cast("int"),
        (F.col("last_h") / patch_out).cast("int"),
        ["image_id", "pad_w", "pad_h"],
    )
    x0, y0 = F.col("c") * patch_out, F.col("r") * patch_out
    return grid.where((x0 + patch_in <= F.col("pad_w")) & (y0 + patch_in <= F.col("pad_h"))).select(
        "image_id",
        "c",
        "r",
        x0.alias("in_x0"),
        y0.alias("in_y0"),
        (x0 + patch_in).alias("in_x1"),
        (y0 + patch_in).alias("in_y1"),
        (x0 + pad).alias("out_x0"),
        (y0 + pad).alias("out_y0"),
        (x0 + pad + patch_out).alias("out_x1"),
        (y0 + pad + patch_out).alias("out_y1"),
    )


def tile_pitch(tile: int = 4096, patch_out: int = 144) -> int:
    """Tile side floored to a whole number of patch outputs."""
    return tile // patch_out * patch_out


def tile_sets(slides: DataFrame, tile: int = 4096, patch_out: int = 144, margin: int = 64) -> DataFrame:
    """The four tile sets of every slide: grid, vertical strips, horizontal strips, crosses.

    Flags say on which sides objects inside the margin give way to those of another set; they are
    cleared on the slide edge, and always set for crosses.
    """
    t, m = tile_pitch(tile, patch_out), margin
    w, h = F.col("proc_w"), F.col("proc_h")
    c, r = F.col("c"), F.col("r")
    grid = lattice(slides, _cells(w, t), _cells(h, t), ["slide_id", "proc_w", "proc_h"]).select(
        "slide_id",
        "c",
        "r",
        (c * t).alias("gx0"),
        (r * t).alias("gy0"),
        ((c + 1) * t).alias("gx1"),
        ((r + 1) * t).alias("gy1"),
        (r > 0).cast("int").alias("up"),
        ((r + 1) * t < h).cast("int").alias("down"),
        (c > 0).cast("int").alias("left"),
        ((c + 1) * t < w).cast("int").alias("right"),
    )
    gx0, gy0, gx1, gy1 = (F.col(n) for n in ("gx0", "gy0", "gx1", "gy1"))
    zero, one = F.lit(0), F.lit(1)

    def placed(mode, x0, y0, x1, y1, ft, fb, fl, fr):
        named = zip(
            ("mode", "x0", "y0", "x1", "y1", "ft", "fb", "fl", "fr"),
            (F.lit(mode), x0, y0, x1, y1, ft, fb, fl, fr),
        )
        return F.struct(*[value.cast("int").alias(name) for name, value in named])

    up, down, left, right = (F.col(n) for n in ("up", "down", "left", "right"))
    variants = F.array(
        placed(0, gx0, gy0, gx1, gy1, up, down, left, right),
        F.when(right == 1, placed(1, gx1 - m, gy0, gx1 + m, gy1, up, down, zero, zero)),
        F.when(down == 1, placed(2, gx0, gy1 - m, gx1, gy1 + m, zero, zero, left, right)),
        F.when(
            (right == 1) & (down == 1),
            placed(3, gx1 - 2 * m, gy1 - 2 * m, gx1 + 2 * m, gy1 + 2 * m, one, one, one, one),
        ),
    )
    return (
        grid.select("slide_id", "c", "r", F.explode(variants).alias("t"))
        .where(F.col("t").isNotNull())
        .select("slide_id", "c", "r", "t.*")
    )


def _view_size(slides: DataFrame) -> DataFrame:
    """Add the scale ``_k`` from processing to base resolution and the slide's size there."""
    scaled = slides.withColumn("_k", F.col("proc_mpp") / F.coalesce("base_mpp", "proc_mpp"))
    return scaled.withColumn("view_w", F.round(F.col("proc_w") * F.col("_k")).cast("int")).withColumn(
        "view_h", F.round(F.col("proc_h") * F.col("_k")).cast("int")
    )


def _span(index: Column, tile: int, view: str, proc: str) -> tuple[Column, Column, Column, Column]:
    """Viewing and processing interval of one tile index: v0, v1, p0, p1."""
    v0, v1 = index * tile, F.least((index + 1) * tile, F.col(view))
    return v0, v1, truncate(v0 / F.col("_k")), F.least(truncate(v1 / F.col("_k")), F.col(proc))


def viewing_grid(slides: DataFrame, tile: int = 1024) -> DataFrame:
    """Tiles over the slide at its base resolution, with the matching processing-space box."""
    grid = lattice(
        _view_size(slides),
        _cells(F.col("view_w"), tile),
        _cells(F.col("view_h"), tile),
        ["slide_id", "view_w", "view_h", "_k", "proc_w", "proc_h"],
    )
    across, down = _span(F.col("c"), tile, "view_w", "proc_w"), _span(F.col("r"), tile, "view_h", "proc_h")
    return grid.select(
        "slide_id",
        "c",
        "r",
        *[e.alias(n) for pair in zip(across, down, (("x0", "y0"), ("x1", "y1"), ("px0", "py0"), ("px1", "py1"))) for e, n in zip(pair[:2], pair[2])],
    ).where("px1 > px0 and py1 > py0")


def viewing_tiles_with_tissue(slides: DataFrame, mask_px: DataFrame, block: int, tile: int = 1024) -> DataFrame:
    """Viewing tiles whose processing box holds tissue.

    Every mask pixel (a ``block``-sized square) names the few tiles it can fall in from its slide's
    scale and tests them itself; what is shuffled is the distinct (slide, c, r), already reduced per
    task.
    """
    sized = _view_size(slides).select("slide_id", "_k", "view_w", "view_h", "proc_w", "proc_h")
    rows = mask_px.join(F.broadcast(sized) if small_enough(sized) else sized, "slide_id")

    def candidates(pos: str) -> Column:
        at = lambda v: F.floor(v * F.col("_k") / F.lit(float(tile))).cast("int")
        lo = F.greatest(at(F.col(pos) * block) - 1, F.lit(0))
        return F.sequence(lo, at(F.col(pos) * block + block) + 1)

    def hit(index: str, pos: str, view: str, proc: str) -> Column:
        v0, v1, p0, p1 = _span(F.col(index), tile, view, proc)
        return (v0 < F.col(view)) & (p1 > p0) & (F.col(pos) * block < p1) & (F.col(pos) * block + block > p0)

    found = rows.withColumn("c", F.explode(candidates("x"))).where(hit("c", "x", "view_w", "proc_w"))
    found = found.withColumn("r", F.explode(candidates("y"))).where(hit("r", "y", "view_h", "proc_h"))
    return viewing_grid(slides, tile).join(found.select("slide_id", "c", "r").distinct(), ["slide_id", "c", "r"], "left_semi")


def cells_touched(lo: Column, hi: Column, pitch: int, count: Column) -> Column:
    """Indices of the grid cells ``[k*pitch, (k+1)*pitch]`` (closed) that meet ``[lo, hi]``."""
    p = F.lit(pitch).cast("double")
    first = F.greatest(F.ceil(lo / p).cast("int") - 1, F.lit(0))
    last = F.least(F.floor(hi / p).cast("int"), (count - 1).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
