"""Classifier evaluation: accuracy, F1, confusion, average precision, ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import running_totals


def accuracy(preds: DataFrame) -> DataFrame:
    """Per-class recall plus a ``cls = -1`` row (all samples) and a ``cls = -2`` row (macro mean).

    ``preds(y_true, y_pred)``; one pass to at most classes x 2 counts.
    """
    per = preds.groupBy(F.col("y_true").alias("cls")).agg(
        F.sum((F.col("y_true") == F.col("y_pred")).cast("int")).alias("hit"), F.count("*").alias("n")
    )
    rows = per.select("cls", (F.col("hit") / F.col("n")).alias("accuracy"))
    overall = per.agg(F.lit(-1).alias("cls"), (F.sum("hit") / F.sum("n")).alias("accuracy"))
    macro = rows.agg(F.lit(-2).alias("cls"), F.avg("accuracy").alias("accuracy"))
    return rows.unionByName(overall).unionByName(macro)


def f1(preds: DataFrame) -> DataFrame:
    """F1 per class of either side, and the macro mean as ``cls = -1``."""
    pairs = preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.col("y_true").alias("cls"), F.lit(0).alias("s")), F.struct(F.col("y_pred").alias("cls"), F.lit(1).alias("s"))))
    counts = pairs.select("y_true", "y_pred", "n", side.alias("e")).groupBy(F.col("e.cls").alias("cls")).agg(
        F.sum(F.when((F.col("e.s") == 0) & (F.col("y_true") == F.col("y_pred")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("both"),
    )
    rows = counts.select("cls", (2.0 * F.col("tp") / F.col("both")).alias("f1"))
    return rows.unionByName(rows.agg(F.lit(-1).alias("cls"), F.avg("f1").alias("f1")))


def confusion(preds: DataFrame, classes: int) -> DataFrame:
    """Row-normalised confusion matrix over all labels, in long form."""
    counts = preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    spark = preds.sparkSession
    grid = spark.range(classes * classes).select(
        F.floor(F.col("id") / classes).cast("int").alias("y_true"), (F.col("id") % classes).cast("int").alias("y_pred")
    )
    totals = counts.groupBy("y_true").agg(F.sum("n").alias("total"))
    filled = grid.join(counts, ["y_true", "y_pred"], "left").join(totals, "y_true", "left")
    share = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    return filled.select("y_true", "y_pred", share.alias("share"))


def threshold_steps(scored: DataFrame, key: str) -> DataFrame:
    """Cumulative true/false positives per distinct score, highest first.

    ``scored(key, score, positive)``.  Equal scores step together: they are summed before cumulating,
    which also shrinks the data; the cumulation is spread over range partitions.
    """
    steps = scored.groupBy(key, "score").agg(
        F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg")
    )
    running = running_totals(steps, [key], [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = steps.groupBy(key).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running.join(totals, key)


def average_precision(scored: DataFrame, key: str) -> DataFrame:
    """Sum over thresholds of (recall step) x precision; null when a key has no positive."""
    gain = F.col("pos") / F.col("all_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return threshold_steps(scored, key).where("all_pos > 0").groupBy(key).agg(F.sum(gain).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """One row ``map``: the mean of ``average_precision`` over the keys that have one; 0 without any."""
    return ap.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def roc_points(scored: DataFrame, key: str) -> DataFrame:
    """Rates after each distinct score; keys lacking either class are left out."""
    return threshold_steps(scored, key).where("all_pos > 0 and all_neg > 0").select(
        key,
        "score",
        (F.col("fp") / F.col("all_neg")).alias("fpr"),
        (F.col("tp") / F.col("all_pos")).alias("tpr"),
        "tp",
        "fp",
        "pos",
        "neg",
        "all_pos",
        "all_neg",
    )


def roc_auc(points: DataFrame, key: str) -> DataFrame:
    """Trapezoid area; the previous point is (tp - pos, fp - neg), so no ordering is needed."""
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)) / (F.col("all_neg") * F.col("all_pos"))
    return points.groupBy(key).agg(F.sum(strip).alias("auc"))


def interpolated_roc(points: DataFrame, key: str, steps: int) -> DataFrame:
    """True-positive rate of each run at ``k / steps`` false-positive rate, k = 0 .. steps.

    Every curve segment lists the grid values it spans, so the work is segments + runs x steps.
    """
    before_fp, before_tp = F.col("fp") - F.col("neg"), F.col("tp") - F.col("pos")
    up = lambda v: F.ceil((v * steps) / F.col("all_neg").cast("double")).cast("int")
    first, last = up(before_fp), up(F.col("fp")) - 1
    spans = points.where("neg > 0").select(
        "*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("k")
    )
    along = (F.col("k") * F.col("all_neg") / F.lit(float(steps)) - before_fp) / F.col("neg")
    tpr = F.when(F.col("k") == 0, F.lit(0.0)).otherwise((before_tp + along * F.col("pos")) / F.col("all_pos"))
    inner = spans.select(key, "k", tpr.alias("tpr"))
    ends = points.select(key).distinct().select(key, F.lit(steps).alias("k"), F.lit(1.0).alias("tpr"))
    return inner.unionByName(ends)


def mean_roc(points: DataFrame, key: str, steps: int = 100) -> DataFrame:
    """Mean curve over runs with a one-standard-deviation band, limited to [0, 1]."""
    curve = interpolated_roc(points, key, steps).groupBy("k").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr")
    )
    return curve.select(
        "k",
        "mean_tpr",
        F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)).alias("upper"),
        F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)).alias("lower"),
    )


def mean_roc_auc(points: DataFrame, key: str, steps: int = 100) -> DataFrame:
    """Area under the mean curve and spread of the runs' own areas."""
    curve = mean_roc(points, key, steps)
    ends = F.when(F.col("k").isin(0, steps), F.lit(0.5)).otherwise(F.lit(1.0))
    area = curve.agg((F.sum(F.col("mean_tpr") * ends) / F.lit(float(steps))).alias("mean_auc"))
    spread = roc_auc(points, key).agg(F.stddev_pop("auc").alias("std_auc"), F.count("*").alias("runs"))
    return area.join(F.broadcast(spread))
