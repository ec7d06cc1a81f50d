"""Pixel-table rasters: crop, pad, resize, flip, photometric changes, blur.

Geometric operators are row-local: each source pixel lists the target pixels it feeds, so nothing is
joined and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.boxes import truncate
from tessera.operators.stencil import binomial, median, stencil


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b.cast("double")).cast("int")


def _range(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def crop(px: DataFrame, x0: Column, y0: Column, w: Column, h: Column) -> DataFrame:
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return px.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def centre_crop(px: DataFrame, width: int, height: int) -> DataFrame:
    """Middle window; rows carry their image size as ``w``/``h``."""
    x0, y0 = truncate((F.col("w") - width) * F.lit(0.5)), truncate((F.col("h") - height) * F.lit(0.5))
    return crop(px, x0, y0, F.lit(width), F.lit(height))


def centre_pad(px: DataFrame, frames: DataFrame, value: str, width: int, height: int, fill: int = 255) -> DataFrame:
    """Centre each image in a larger one filled with a constant (the odd pixel goes right/below)."""
    moved = px.join(frames, "image_id").select(
        "image_id",
        (F.col("x") + F.floor((width - F.col("w")) / 2).cast("int")).alias("x"),
        (F.col("y") + F.floor((height - F.col("h")) / 2).cast("int")).alias("y"),
        value,
    )
    canvas = frames.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(
        "image_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "y"
    )
    return canvas.join(moved, ["image_id", "x", "y"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def resize_nearest(px: DataFrame, new_w: Column, new_h: Column) -> DataFrame:
    """Nearest-neighbour resize to ``new_w`` x ``new_h``; target t reads source floor(t * w / new_w).

    Inverted: source x feeds targets ceil(x * new_w / w) .. ceil((x + 1) * new_w / w) - 1.
    """
    across = _range(_ceil_div(F.col("x") * new_w, F.col("w")), _ceil_div((F.col("x") + 1) * new_w, F.col("w")) - 1)
    down = _range(_ceil_div(F.col("y") * new_h, F.col("h")), _ceil_div((F.col("y") + 1) * new_h, F.col("h")) - 1)
    return px.withColumn("_tx", F.explode(across)).withColumn("_ty", F.explode(down)).withColumns(
        {"x": F.col("_tx"), "y": F.col("_ty"), "w": new_w, "h": new_h}
    ).drop("_tx", "_ty")


def scale_nearest(px: DataFrame, factor: float) -> DataFrame:
    return resize_nearest(px, F.round(F.col("w") * F.lit(factor)).cast("int"), F.round(F.col("h") * F.lit(factor)).cast("int"))


def flip_horizontal(px: DataFrame) -> DataFrame:
    return px.withColumn("x", F.col("w") - 1 - F.col("x"))


def flip_vertical(px: DataFrame) -> DataFrame:
    return px.withColumn("y", F.col("h") - 1 - F.col("y"))


def rotate90(px: DataFrame, turns) -> DataFrame:
    """Counter-clockwise quarter turns; ``turns`` may be a column."""
    k = F.pmod(turns if isinstance(turns, Column) else F.lit(turns), F.lit(4))
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")
    pick = lambda a, b, c, d: F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(d)
    odd = k % 2 == 1
    return px.withColumns(
        {
            "x": pick(x, y, w - 1 - x, h - 1 - y),
            "y": pick(y, w - 1 - x, h - 1 - y, x),
            "w": F.when(odd, h).otherwise(w),
            "h": F.when(odd, w).otherwise(h),
        }
    )


def to_byte(value: Column) -> Column:
    """Clip to 0..255 and drop the fraction."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


def brightness(value: Column, shift: Column) -> Column:
    return to_byte(value + shift)


def contrast(px: DataFrame, channels: list[str], alpha: Column) -> DataFrame:
    """Stretch about each image's channel mean: alpha * v + (1 - alpha) * mean.

    The means are one small row per image, joined back, so one huge image is not gathered.
    """
    means = px.groupBy("image_id").agg(*[F.avg(c).alias("_m_" + c) for c in channels])
    mixed = px.join(means, "image_id")
    return mixed.withColumns({c: to_byte(F.col(c) * alpha + F.col("_m_" + c) * (1 - alpha)) for c in channels}).drop(
        *["_m_" + c for c in channels]
    )


# Luma weights of red, green and blue
LUMA = (0.299, 0.587, 0.114)


def saturation(px: DataFrame, channels: list[str], factor: Column) -> DataFrame:
    grey = F.round(sum((F.col(c) * w for c, w in zip(channels, LUMA)), F.lit(0.0)))
    kept = px.withColumn("_grey", grey)
    return kept.withColumns({c: to_byte(F.col(c) * factor + F.col("_grey") * (1 - factor)) for c in channels}).drop("_grey")


def gaussian_blur(px: DataFrame, value: str, size: int = 3) -> DataFrame:
    """Binomial blur of odd size with replicated border, rounded; missing pixels have no weight."""
    return stencil(px, [value], _radius(size), binomial, [T.StructField(value, T.IntegerType())], replicate=True)


def median_blur(px: DataFrame, value: str, size: int = 3) -> DataFrame:
    """Median of a window of odd size with replicated border; missing pixels do not count."""
    return stencil(px, [value], _radius(size), median, [T.StructField(value, T.IntegerType())], replicate=True)


def _radius(size: int) -> int:
    if size < 1 or size % 2 == 0:
        raise ValueError(f"a window has odd size, not {size}")
    return size // 2


def reflect_pad(px: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Mirror padding without repeating the edge pixel; coordinates start at the padded corner.

    Position t of the padded line reads fold(t) with period 2 (L - 1), so source x feeds
    x + m * period and -x + m * period.
    """

    def targets(pos: str, length: str, before: int, after: int) -> Column:
        p, n = F.col(pos), F.col(length)
        period = F.greatest(2 * (n - 1), F.lit(1))
        reach = F.ceil((n + before + after) / period.cast("double")).cast("int") + 1
        turns = F.sequence(-reach, reach)
        both = F.concat(F.transform(turns, lambda m: p + m * period), F.transform(turns, lambda m: -p + m * period))
        return F.transform(F.filter(F.array_distinct(both), lambda t: (t >= -before) & (t < n + after)), lambda t: t + before)

    wide = px.withColumn("_tx", F.explode(targets("x", "w", left, right)))
    tall = wide.withColumn("_ty", F.explode(targets("y", "h", top, bottom)))
    return tall.withColumns(
        {"x": F.col("_tx"), "y": F.col("_ty"), "w": F.col("w") + left + right, "h": F.col("h") + top + bottom}
    ).drop("_tx", "_ty")


def normalise(px: DataFrame, value: str) -> DataFrame:
    """255 * v / (largest value of the image), fraction dropped."""
    top = px.groupBy("image_id").agg(F.max(value).alias("_top"))
    return px.join(top, "image_id").withColumn(value, F.floor(255 * F.col(value) / F.col("_top")).cast("int")).drop("_top")


def rescale(value: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi] and map to 0..1."""
    return (F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)


def masked_classes(px: DataFrame, mask_px: DataFrame) -> DataFrame:
    """Class map times mask: classes outside the mask become 0."""
    tagged = mask_px.select("image_id", "x", "y", F.lit(1).alias("_in"))
    return px.join(tagged, ["image_id", "x", "y"], "left").withColumn("cls", F.col("cls") * F.coalesce("_in", F.lit(0))).drop("_in")
