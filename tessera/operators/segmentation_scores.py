"""Segmentation quality: Dice, panoptic quality and its averages, running accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.instances import dominant_class
from tessera.operators.matching import match_runs, overlaps, runs_of_both

CELL = ["image_id", "cls"]


def typed_instances(px: DataFrame) -> DataFrame:
    """Replace the pixel class by the dominant class of the pixel's instance."""
    return px.drop("cls").join(dominant_class(px), ["image_id", "inst_id"])


def classes_present(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Foreground classes of either map, per image."""
    return pred.select(*CELL).union(true.select(*CELL)).where("cls <> 0").distinct()


def class_count(pred: DataFrame, true: DataFrame) -> DataFrame:
    """One row: the largest class in use plus one (2 when there is none)."""
    top = pred.select("cls").union(true.select("cls")).agg(F.max(F.when(F.col("cls") != 0, F.col("cls"))).alias("m"))
    return top.select((F.coalesce("m", F.lit(1)) + 1).alias("num_classes"))


def dice(pred: DataFrame, true: DataFrame, images: DataFrame) -> DataFrame:
    """Mean foreground Dice per image; absent classes are skipped, images without any score 0."""
    whole = lambda px: px.where("cls <> 0").select(*CELL, F.lit(0).alias("inst_id"), "x", "y")
    runs = runs_of_both(whole(pred), whole(true))
    sizes = runs.groupBy(*CELL).agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("total"))
    both = overlaps(runs).select(*CELL, "inter")
    scores = sizes.join(both, CELL, "left").groupBy("image_id").agg(
        F.avg(2.0 * F.coalesce("inter", F.lit(0)) / F.col("total")).alias("dice")
    )
    return images.select("image_id").join(scores, "image_id", "left").withColumn("dice", F.coalesce("dice", F.lit(0.0)))


def match_counts(pred: DataFrame, true: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn and summed IoU per image and class."""
    runs = runs_of_both(pred, true)  # pixels are read once
    number = lambda side, name: F.count_if(F.col("true") == side).alias(name)
    both = runs.where("cls <> 0").select("true", *CELL, "inst_id").distinct().groupBy(*CELL).agg(number(0, "n_pred"), number(1, "n_true"))
    hits = match_runs(runs, threshold).groupBy(*CELL).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = both.join(hits, CELL, "left")
    tp = zero("tp")
    return joined.select(
        *CELL,
        tp.alias("tp"),
        (zero("n_pred") - tp).alias("fp"),
        (zero("n_true") - tp).alias("fn"),
        F.coalesce("iou_sum", F.lit(0.0)).alias("iou_sum"),
    )


def _quality(tp, fp, fn, iou_sum):
    weight = tp + fp * F.lit(0.5) + fn * F.lit(0.5)
    sq = F.when(weight > 0, iou_sum / F.greatest(tp, F.lit(1))).otherwise(F.lit(0.0))
    rq = F.when(weight > 0, tp / weight).otherwise(F.lit(0.0))
    return sq, rq


def _with_quality(df: DataFrame) -> DataFrame:
    sq, rq = _quality(F.col("tp"), F.col("fp"), F.col("fn"), F.col("iou_sum"))
    return df.withColumn("sq", sq).withColumn("rq", rq).withColumn("pq", F.col("sq") * F.col("rq"))


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")])


def panoptic_quality(counts: DataFrame) -> DataFrame:
    """PQ, SQ and RQ per image from ``match_counts``."""
    return _with_quality(_summed(counts, "image_id"))


def mean_pq(counts: DataFrame) -> DataFrame:
    """PQ per image and class, averaged over images, then over classes."""
    per_class = _with_quality(counts).groupBy("cls").agg(F.avg("pq").alias("pq"))
    return per_class.agg(F.coalesce(F.avg("pq"), F.lit(0.0)).alias("mpq"))


def mean_pq_pooled(counts: DataFrame) -> DataFrame:
    """Counts pooled over images, PQ per class, averaged over classes."""
    return _with_quality(_summed(counts, "cls")).agg(F.coalesce(F.avg("pq"), F.lit(0.0)).alias("mpq_plus"))


# ---- running accumulators ----------------------------------------------------------------------

# Output classes per head
HEAD_CLASSES = {"Lumen-INST": 3, "Gland-INST": 3, "Nuclei-INST": 3, "Nuclei-TYPE": 7, "Patch-Class": 9}


def contingency(px: DataFrame) -> DataFrame:
    """(head, channel, true, pred) counts of samples that have ground truth.

    ``px(head, channel, true, pred, has_gt)`` holds every pixel; ``channel`` is the class an instance
    channel stands for, null for heads with one label map.  The table is at most classes x classes
    per head, so everything after it is tiny.
    """
    return px.where("has_gt").groupBy("head", "channel", "true", "pred").agg(F.count("*").alias("n"))


def accumulators(table: DataFrame) -> DataFrame:
    """over_inter, over_total, over_correct and nr_pixels per head and class from a contingency table."""
    heads = F.create_map(*[F.lit(v) for kv in HEAD_CLASSES.items() for v in kv])
    first = F.when(F.col("head") == "Patch-Class", F.lit(0)).otherwise(F.lit(1))
    own = F.when(F.col("channel").isNotNull(), F.array("channel")).otherwise(F.sequence(first, heads[F.col("head")] - 1))
    rows = table.select("*", F.explode(own).alias("cls"))
    counted = F.when(F.col("head").endswith("-TYPE"), (F.col("true") > 0).cast("int")).otherwise(F.lit(1))
    is_true, is_pred = (F.col("true") == F.col("cls")).cast("int"), (F.col("pred") == F.col("cls")).cast("int")
    n = F.col("n")
    return rows.groupBy("head", "cls").agg(
        F.sum(n * counted * is_true * is_pred).alias("over_inter"),
        F.sum(n * counted * (is_true + is_pred)).alias("over_total"),
        F.sum(n * (F.col("true") == F.col("pred")).cast("int")).alias("over_correct"),
        F.sum(n).alias("nr_pixels"),
    )


def summarise(acc: DataFrame) -> DataFrame:
    """Accuracy and Dice per head and class, with one ``cls = -1`` row per averaged head."""
    eps = F.lit(1.0e-8)
    rows = acc.select(
        "head",
        "cls",
        ((F.col("over_correct") + eps) / (F.col("nr_pixels") + eps)).alias("accuracy"),
        (2 * F.col("over_inter") / (F.col("over_total") + eps)).alias("dice"),
    )
    averages = rows.where(~F.col("head").endswith("-INST")).groupBy("head").agg(
        F.lit(-1).alias("cls"), F.avg("accuracy").alias("accuracy"), F.avg("dice").alias("dice")
    )
    return rows.unionByName(averages)
