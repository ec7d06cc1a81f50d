"""Instance attributes from pixel tables, and projections of instance records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import half_even
from tessera.operators.ranking import numbered

KEY = ["image_id", "inst_id"]


def shape_attributes(px: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Half-open bounding box, centroid and area, in one partially aggregated pass."""
    return px.groupBy(*keys).agg(
        F.min("x").alias("x_min"),
        F.min("y").alias("y_min"),
        (F.max("x") + 1).alias("x_max"),
        (F.max("y") + 1).alias("y_max"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        F.count("*").alias("area"),
    )


def majority_type(px: DataFrame, keys: list[str] = KEY, cls: str = "cls") -> DataFrame:
    """Most frequent class; background only when nothing else occurs; ties go to the smaller class."""
    counts = px.groupBy(*keys, cls).agg(F.count("*").alias("n"))
    best = F.max(F.struct((F.col(cls) != 0).alias("fg"), "n", (-F.col(cls)).alias("neg")))
    picked = counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("area"))
    return picked.select(
        *keys,
        (-F.col("b.neg")).alias("type_id"),
        (F.col("b.n") / (F.col("area") + F.lit(1.0e-6))).alias("type_prob"),
    )


def dominant_class(px: DataFrame, keys: list[str] = KEY, cls: str = "cls") -> DataFrame:
    """Most frequent class, background included; ties go to the smaller class."""
    counts = px.groupBy(*keys, cls).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(cls)).alias("neg")))
    return counts.groupBy(*keys).agg((-best["neg"]).alias("cls"))


def relabel(px: DataFrame, by_size: bool = False) -> DataFrame:
    """Contiguous ids from 1 per image: in id order, or largest first.

    Ranks are computed on one row per instance and joined back, so an image holding most pixels only
    costs its number of instances, ranked across tasks.
    """
    sizes = px.groupBy("image_id", "inst_id").agg(F.count("*").alias("_area"))
    order = [F.col("_area").desc(), F.col("inst_id")] if by_size else ["inst_id"]
    ranks = numbered(sizes, ["image_id"], order, "new_id").select("image_id", "inst_id", "new_id")
    return px.join(ranks, ["image_id", "inst_id"])


def drop_small(px: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Remove objects with fewer than ``least`` pixels."""
    small = px.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(*keys)
    return px.join(small, keys, "left_anti")


# Object size limits per task, in pixels
MIN_PIXELS = {"gland": 1500, "lumen": 150, "nuclei": 8}
MIN_PIXELS_CONTOUR = {"gland": 1000, "lumen": 150, "nuclei": 8}
MIN_MARKER_PIXELS = 4
MIN_TISSUE_PIXELS = 2000


def min_pixels(task: str, scale: float = 1.0, contour_head: bool = False) -> int:
    """Size limit of a task; limits of the contour heads shrink with the squared scale."""
    if not contour_head:
        return MIN_PIXELS[task]
    limit = MIN_PIXELS_CONTOUR[task]
    return limit if task == "nuclei" else int(limit * scale**2)


def foreground(inner: Column, ring: Column | None, task: str) -> Column:
    """Instance foreground from head probabilities.

    Without a contour channel: inner > 0.5.  With one, the binarised contour is cut out of the inner
    map (nuclei join the two instead); glands use a stricter 0.55.
    """
    if ring is None:
        return inner > 0.5
    if task == "nuclei":
        return inner + ring > 0.5
    limit = 0.55 if task == "gland" else 0.5
    return inner - F.when(ring > 0.5, 1.0).otherwise(0.0) > limit


def undo_downsample(df: DataFrame, ds: float, columns: list[str]) -> DataFrame:
    """Divide by the downsample factor, rounding half to even."""
    return df.withColumns({c: half_even(F.col(c) / F.lit(ds)) for c in columns})


def overlap_average(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of stacked predictions per pixel: sum / (count + 1e-8)."""
    return scores.groupBy(*keys).agg((F.sum(value) / (F.count(value) + F.lit(1.0e-8))).alias(value))


def store_report(instances: DataFrame) -> DataFrame:
    """Instance counts per slide and task with totals, and the spread of contour sizes."""
    return instances.rollup("slide_id", "task").agg(
        F.count("*").alias("instances"),
        F.min("points").alias("min_points"),
        F.max("points").alias("max_points"),
        F.count("type_id").alias("typed"),
    )


def typed_or_minus_one(df: DataFrame) -> DataFrame:
    return df.withColumn("type_id", F.coalesce("type_id", F.lit(-1)))


def class_raster(px: DataFrame, classes: DataFrame) -> DataFrame:
    """Class of each pixel's instance; 0 when the instance is unknown."""
    looked_up = classes.select("image_id", "inst_id", F.col("cls").alias("_cls"))
    return px.join(looked_up, ["image_id", "inst_id"], "left").withColumn("cls", F.coalesce("_cls", F.lit(0))).drop("_cls")


def inside_other(px: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels covered by any object of the other table (lumens only inside glands)."""
    return px.join(other.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")
