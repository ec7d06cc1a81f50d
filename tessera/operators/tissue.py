"""Tissue masks: regions, thresholds, local entropy, label lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import component_boxes, label_runs
from tessera.operators.runs import to_runs
from tessera.operators.stencil import entropy, stencil


def regions(mask_px: DataFrame, slides: DataFrame, ratio: float) -> DataFrame:
    """Bounding box of every tissue component in processing pixels; the whole slide if it has none.

    ``ratio`` is mask resolution over processing resolution.
    """
    boxes = component_boxes(label_runs(to_runs(mask_px, ["slide_id"]), ["slide_id"]), ["slide_id"])
    scale = lambda c: F.round(F.col(c) / F.lit(ratio)).cast("int").alias(c)
    found = boxes.select("slide_id", "comp", *[scale(c) for c in ("x_min", "y_min", "x_max", "y_max")])
    bare = slides.join(found.select("slide_id"), "slide_id", "left_anti").select(
        "slide_id",
        F.lit(0).cast("long").alias("comp"),
        F.lit(0).alias("x_min"),
        F.lit(0).alias("y_min"),
        F.col("proc_w").alias("x_max"),
        F.col("proc_h").alias("y_max"),
    )
    return found.unionByName(bare)


def scores_in_region(px: DataFrame, labelled_mask_px: DataFrame, region: list[str]) -> DataFrame:
    """Keep pixels whose own mask component is the region they are asked for."""
    return px.join(labelled_mask_px, [*region, "x", "y"], "left_semi")


def otsu_thresholds(values: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """Threshold of each key maximising the between-class variance of a fixed-bin histogram.

    Values are reduced to ``bins`` counts per key; the cumulative windows run over at most that many
    rows.  The result is the centre of the chosen bin.
    """
    span = values.groupBy(key).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    sized = values.join(span, key).withColumn("width", width)
    index = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int"), F.lit(bins - 1))
    hist = sized.groupBy(key, "lo", "width", index.alias("bin")).agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + F.lit(0.5)) * F.col("width")
    hist = hist.withColumn("centre", centre)
    row = Window.partitionBy(key).orderBy("bin")
    upto, all_ = row.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    cum = hist.select(
        key,
        "bin",
        "centre",
        F.sum("n").over(upto).alias("n0"),
        F.sum(F.col("n") * F.col("centre")).over(upto).alias("s0"),
        F.sum("n").over(all_).alias("n_all"),
        F.sum(F.col("n") * F.col("centre")).over(all_).alias("s_all"),
    )
    n1 = F.col("n_all") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / n1
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * gap * gap, 6)).otherwise(F.lit(-1.0))
    best = cum.select(key, "centre", F.struct(between.alias("v"), (-F.col("bin")).alias("b"), "centre").alias("k"))
    return best.groupBy(key).agg(F.max("k").alias("k")).select(key, F.col("k.centre").alias("threshold"))


def local_entropy(df: DataFrame, value: str, radius: int = 4) -> DataFrame:
    """Entropy (bits) of the whole-number values in a disk round each pixel; missing pixels do not count."""
    whole = df.withColumn("_v", F.col(value).cast("long"))
    return stencil(whole, ["_v"], radius, entropy, [T.StructField("entropy", T.DoubleType())]).drop("_v")


def stain_entropy(px: DataFrame, h: str, e: str, d: str, radius: int = 4) -> DataFrame:
    """``px`` with the combined entropy of three stain channels, H + E - D, as ``entropy``; one exchange for all three."""
    parts = ["_h", "_e", "_d"]
    whole = px.withColumns({p: F.col(c).cast("long") for p, c in zip(parts, (h, e, d))})
    fields = [T.StructField(p + "n", T.DoubleType()) for p in parts]
    bits = stencil(whole, parts, radius, entropy, fields)
    return bits.withColumn("entropy", F.col("_hn") + F.col("_en") - F.col("_dn")).drop(*parts, *[f.name for f in fields])
