"""Semi joins that keep only placements with something in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tiling import cells_touched, tile_pitch, tile_sets
from tessera.session import small_enough

def attach_slide_size(df: DataFrame, slides: DataFrame) -> DataFrame:
    """Add ``proc_w``/``proc_h``; the slide table is broadcast only when its size is checked."""
    dims = slides.select("slide_id", "proc_w", "proc_h")
    return df.join(F.broadcast(dims) if small_enough(dims) else dims, "slide_id")


def _index(value, pitch: int):
    return F.floor(value / F.lit(pitch).cast("double")).cast("int")


def touching_mask(patches: DataFrame, mask_px: DataFrame, block: int, pitch: int) -> DataFrame:
    """Patches of a regular grid whose write box holds tissue.

    Every mask pixel (a ``block``-sized square) names the grid cells it overlaps by arithmetic, so the
    range predicate becomes an equi semi join on ``(slide, c, r)``.
    """
    cells = mask_px.select(
        "slide_id",
        F.explode(
            F.sequence(_index(F.col("x") * block, pitch), _index(F.col("x") * block + block - 1, pitch))
        ).alias("c"),
        "y",
    ).select(
        "slide_id",
        "c",
        F.explode(
            F.sequence(_index(F.col("y") * block, pitch), _index(F.col("y") * block + block - 1, pitch))
        ).alias("r"),
    )
    return patches.join(cells.distinct(), ["slide_id", "c", "r"], "left_semi")


def patches_by_chunk(patches: DataFrame, slides: DataFrame, pitch: int) -> DataFrame:
    """Every patch with each chunk of the regular grid its write box meets (closed boxes)."""
    sized = attach_slide_size(patches, slides)
    count = lambda v: F.ceil(F.col(v) / F.lit(pitch).cast("double"))
    across = cells_touched(F.col("out_x0"), F.col("out_x1"), pitch, count("proc_w"))
    down = cells_touched(F.col("out_y0"), F.col("out_y1"), pitch, count("proc_h"))
    return sized.withColumn("cc", F.explode(across)).withColumn("cr", F.explode(down))


def tile_sets_meeting(slides: DataFrame, boxes: DataFrame, tile: int = 4096, patch_out: int = 144, margin: int = 64) -> DataFrame:
    """Tiles of ``tile_sets`` that meet at least one box (closed, whole coordinates).

    Every box names the tiles it meets by arithmetic: for either axis the first and last grid tile, strip and cross.
    What is shuffled are distinct spans, already reduced per task, which become tiles behind the exchange.
    Names of tiles that a slide lacks find no partner.
    """
    t = tile_pitch(tile, patch_out)
    halves = {"g": None, "s": margin, "w": 2 * margin}  # grid, strip, cross; half the width of the last two
    spans = []
    for axis, lo, hi in (("c", "x_min", "x_max"), ("r", "y_min", "y_max")):
        for name, half in halves.items():
            # grid tile k is [k * t, (k + 1) * t]; a strip reaches ``half`` to both sides of the line (k + 1) * t
            first = _index(F.col(lo) - (half or 0) - 1, t)
            last = _index(F.col(hi) + (half or 0), t) - (0 if half is None else 1)
            spans += [first.alias(f"{axis}{name}0"), last.alias(f"{axis}{name}1")]
    span = lambda v: F.when(F.col(v + "0") <= F.col(v + "1"), F.sequence(F.col(v + "0"), F.col(v + "1"))).otherwise(F.array().cast("array<int>"))
    met = boxes.select("slide_id", *spans).distinct()
    modes = F.array(*[F.struct(F.lit(mode).alias("mode"), span("c" + x).alias("cs"), span("r" + y).alias("rs")) for mode, (x, y) in enumerate(("gg", "sg", "gs", "ww"))])
    met = met.select("slide_id", F.explode(modes).alias("m")).select("slide_id", "m.mode", "m.rs", F.explode("m.cs").alias("c"))
    met = met.select("slide_id", "mode", "c", F.explode("rs").alias("r")).distinct()
    return tile_sets(slides, tile, patch_out, margin).join(met, ["slide_id", "mode", "c", "r"], "left_semi")
