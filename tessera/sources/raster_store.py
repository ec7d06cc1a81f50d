"""Pixel tables in Z-order, and windows of them at a resolution.

One folder per image.  Rows are sorted by pyramid level and by the Morton key of their 64 x 64 cell, so every row group
holds a compact patch and its statistics of ``level`` and ``z`` say which.  A window is a few key ranges: the reader
skips the row groups outside of them, and the exact comparison follows.  Range partitioning cuts a large image over many
writers; each level of the pyramid is averaged from the one before it by a partial aggregate.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.morton import morton, ranges
from tessera.session import small_enough

CELL = 64
ALPHA = ("a", "alpha")  # channels that windows leave out


def _cell(v: Column) -> Column:
    return F.shiftright(v, CELL.bit_length() - 1)


def pyramid(px: DataFrame, levels: int) -> DataFrame:
    """The pixels with ``level``: 0 as given, each further one with the mean (rounded down) of 2 x 2 pixels of the last."""
    channels = [c for c in px.columns if c not in ("image_id", "x", "y")]
    here = px.withColumn("level", F.lit(0))
    out = here
    for level in range(1, levels):
        halved = here.groupBy("image_id", F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
        means = [F.floor(F.avg(c)).cast(px.schema[c].dataType).alias(c) for c in channels]
        here = halved.agg(*means).withColumn("level", F.lit(level)).select(*out.columns)
        out = out.unionByName(here)
    return out


def write_raster(px: DataFrame, path: str, levels: int = 1, group_bytes: int = 8 << 20) -> None:
    """Write ``px(image_id, x, y, channels...)`` with its pyramid; folders of other images stay as they are.

    Coordinates are not negative.  ``group_bytes`` is the size of a row group, the least that is read.
    """
    keyed = pyramid(px, levels).withColumn("z", morton(_cell(F.col("x")), _cell(F.col("y"))))
    order = ["image_id", "level", "z"]
    (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order, "y", "x")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", group_bytes)
        .partitionBy("image_id")
        .parquet(path)
    )


def write_packed(px: DataFrame, path: str, levels: int = 1, group_bytes: int = 8 << 20) -> None:
    """Write the whole store with many images to a file, for stores of more images than a file system likes folders.

    Rows lie in the same order as in ``write_raster`` and the readers work alike: statistics of ``image_id`` stand for folders.
    """
    keyed = pyramid(px, levels).withColumn("z", morton(_cell(F.col("x")), _cell(F.col("y"))))
    order = ["image_id", "level", "z"]
    (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order, "y", "x")
        .write.mode("overwrite")
        .option("parquet.block.size", group_bytes)
        .parquet(path)
    )


def _colours(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("image_id", "x", "y", "z", "level", *ALPHA)]


def read_window(spark: SparkSession, path: str, image_id: int, x: int, y: int, w: int, h: int, level: int = 0) -> DataFrame:
    """``image_id, x, y`` and the channels but alpha of a window in pixels of one pyramid level."""
    df = spark.read.parquet(path)
    cells = [v // CELL for v in (x, y, x + w - 1, y + h - 1)]
    keys = reduce(or_, [F.col("z").between(a, b) for a, b in ranges(*[max(c, 0) for c in cells])], F.lit(False))
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return df.where((F.col("image_id") == image_id) & (F.col("level") == level) & keys & inside).select("image_id", "x", "y", *_colours(df))


def level_for(factor: float, levels: int) -> int:
    """Coarsest level that is still as fine as a window whose pixels are ``factor`` base pixels wide."""
    level = 0
    while level + 1 < levels and 2 ** (level + 1) <= factor:
        level += 1
    return level


def _first(v: Column, step: float) -> Column:
    """First window pixel whose centre lies at or behind a level pixel's start."""
    return F.ceil(v / F.lit(step) - F.lit(0.5))


def _placed(px: DataFrame, step: float) -> DataFrame:
    """Level pixels at the window pixels whose centres lie in them (several if the level is coarser)."""
    to = lambda c: F.explode(F.sequence(_first(F.col(c), step), _first(F.col(c) + 1, step) - 1)).alias(f"_{c}")
    hit = px.where((_first(F.col("x"), step) < _first(F.col("x") + 1, step)) & (_first(F.col("y"), step) < _first(F.col("y") + 1, step)))
    spread = hit.select("*", to("x")).select("*", to("y"))
    rest = [c for c in px.columns if c not in ("x", "y")]
    return spread.select(*rest, F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"))


def read_at(spark: SparkSession, path: str, image_id: int, x: int, y: int, w: int, h: int, factor: float, levels: int) -> DataFrame:
    """A window at a resolution: location and size count pixels that are ``factor`` base pixels wide.

    The coarsest level that is fine enough is read, and of it the pixel under the centre of each window pixel.
    """
    level = level_for(factor, levels)
    step = factor / 2**level
    x0, y0, x1, y1 = (int((v + 0.5) * step) for v in (x, y, x + w - 1, y + h - 1))
    placed = _placed(read_window(spark, path, image_id, x0, y0, x1 - x0 + 1, y1 - y0 + 1, level), step)
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return placed.where(inside).select("image_id", "x", "y", *[c for c in placed.columns if c not in ("image_id", "x", "y")])


def read_windows(spark: SparkSession, path: str, windows: DataFrame, factor: float, levels: int) -> DataFrame:
    """Many windows ``(image_id, x0, y0, w, h)`` at one resolution, with the columns of the window kept.

    The images asked for prune the folders at run time; rows of a level outside the span of all windows are skipped.
    """
    level = level_for(factor, levels)
    step = factor / 2**level
    df = spark.read.parquet(path).where(F.col("level") == level)
    centre = lambda v: F.floor((v + F.lit(0.5)) * F.lit(step))
    spans = windows.select(
        "*",
        centre(F.col("x0")).alias("_x0"),
        centre(F.col("x0") + F.col("w") - 1).alias("_x1"),
        centre(F.col("y0")).alias("_y0"),
        centre(F.col("y0") + F.col("h") - 1).alias("_y1"),
    )
    spans = F.broadcast(spans) if small_enough(windows) else spans
    met = df.join(spans, "image_id").where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    asked = [c for c in windows.columns if c != "image_id"]
    placed = _placed(met.select("image_id", "x", "y", *_colours(df), *asked), step)
    inside = F.col("x").between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    return placed.where(inside)
