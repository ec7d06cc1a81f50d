"""Loss aggregates, the head-weighted total and the loss registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import log_sum_exp, nll
from tessera.operators.stencil import correlation, stencil
from tessera.session import stable_copy

EPS = 1.0e-8

# Head names
HEADS = ["Lumen-INST", "Gland-INST", "Nuclei-INST", "Nuclei-TYPE", "Patch-Class"]


def lookup(values: dict, key: Column, default: Column) -> Column:
    """A small dictionary as a literal map."""
    if not values:
        return default
    return F.coalesce(F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[key], default)


def cross_entropy(logits: Column, target: Column, weights: dict[int, float] | None = None) -> Column:
    """Mean negative log likelihood, weighted by target class when weights are given (aggregate)."""
    if not weights:
        return F.avg(nll(logits, target))
    w = lookup(weights, target, F.lit(1.0))
    return F.sum(w * nll(logits, target)) / F.sum(w)


def focal(logits: Column, target: Column, gamma: float = 2.0, weights: dict[int, float] | None = None) -> Column:
    """Batch-mean likelihood times the mean focal factor ``(1 - p)^gamma`` (aggregate)."""
    p = F.exp(-nll(logits, target))
    return cross_entropy(logits, target, weights) * F.avg(F.pow(1 - p, F.lit(gamma)))


def focal_per_sample(df: DataFrame, batch: str, logits: Column, target: Column, gamma: float = 2.0) -> DataFrame:
    """Focal factor of each sample times its batch's mean likelihood."""
    mean = df.groupBy(batch).agg(F.avg(nll(logits, target)).alias("_ce"))
    factor = F.pow(1 - F.exp(-nll(logits, target)), F.lit(gamma))
    return df.join(mean, batch).withColumn("loss", factor * F.col("_ce")).drop("_ce")


def squared_error(pred: Column, true: Column) -> Column:
    return (pred - true) * (pred - true)


def soft_dice(rows: DataFrame, keys: list[str], smooth: float = 1.0e-3) -> DataFrame:
    """Soft Dice loss summed over classes for each key (no key: the whole batch).

    ``rows(keys, cls, pred, true, mask)`` in long form; classes are reduced first.
    """
    m = F.col("mask")
    per_class = rows.groupBy(*keys, "cls").agg(
        F.sum(F.col("pred") * F.col("true") * m).alias("i"),
        F.sum(F.col("pred") * m).alias("l"),
        F.sum(F.col("true") * m).alias("r"),
    )
    term = 1.0 - (2.0 * F.col("i") + smooth) / (F.col("l") + F.col("r") + smooth)
    return per_class.groupBy(*keys).agg(F.sum(term).alias("dice_loss"))


def _gradient_weights(axis: str, size: int = 5) -> np.ndarray:
    """Derivative kernel: offset along the axis over squared distance."""
    span = np.arange(size) - size // 2
    rows, cols = np.meshgrid(span, span, indexing="ij")
    return (rows if axis == "rows" else cols) / (rows * rows + cols * cols + 1.0e-15)


def gradient_error(diff: DataFrame) -> DataFrame:
    """Squared gradient error inside the focus mask, both channels.

    ``diff(image_id, x, y, a, b, focus)`` holds prediction minus truth of the two channels: the
    filter is linear, so it is applied to the difference once.  Both channels share one exchange; pixels outside are 0.
    """
    weights = [_gradient_weights("rows"), _gradient_weights("cols")]
    fields = [T.StructField(c, T.DoubleType()) for c in ("ga", "gb")]
    both = stencil(diff, ["a", "b"], 2, correlation(weights), fields)
    err = F.col("focus") * (F.col("ga") * F.col("ga") + F.col("gb") * F.col("gb"))
    return both.agg((F.sum(err) / (2 * F.sum("focus") + F.lit(EPS))).alias("msge"))


TILE = 1024  # views of a tile: a tile pair's products take 8 MB


def _tile_terms(temperature: float):
    """Per anchor of a tile pair: largest product, sum scaled by it, and sum and number of its own sample's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                here, there = (np.stack([v["feature"] for v in side]) for side in (row.here, row.there))
                mine, theirs = (np.array([(v["sample"], v["view"]) for v in side]) for side in (row.here, row.there))
                product = here @ there.T / temperature
                own = mine[:, None, 0] == theirs[None, :, 0]
                same = own & (mine[:, None, 1] == theirs[None, :, 1])
                product[same] = -np.inf
                top = product.max(axis=1)
                scaled = np.exp(product - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1)
                own &= ~same
                yield pd.DataFrame(
                    {"batch": row.batch, "sample": mine[:, 0], "view": mine[:, 1], "top": top, "scaled": scaled}
                    | {"own_sum": np.where(own, product, 0.0).sum(axis=1), "own_n": own.sum(axis=1)}
                )

    return run


def contrastive(views: DataFrame, temperature: float = 0.07, base: float = 0.07, tile: int = TILE) -> DataFrame:
    """Contrastive loss per batch: views of one sample attract, all others of the batch repel.

    ``views(batch, sample, view, feature)``, at least two views per sample.  A batch is dealt into tiles of about ``tile`` views;
    a task multiplies one pair of tiles and hands on a state per anchor, (largest product, sum scaled by it), which merges.
    Pairs of views are never rows and no batch is gathered, whatever its size.
    """
    keyed = views.select(F.col("batch").cast("long").alias("batch"), F.col("sample").cast("long").alias("sample"), F.col("view").cast("long").alias("view"), "feature")
    tiles = keyed.groupBy("batch").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("tiles"))
    dealt = keyed.join(tiles, "batch").withColumn("tile", F.pmod(F.xxhash64("sample", "view"), F.col("tiles")).cast("int"))
    packed = stable_copy(dealt.groupBy("batch", "tiles", "tile").agg(F.collect_list(F.struct("sample", "view", "feature")).alias("here")))
    asked = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = asked.join(packed.select("batch", F.col("tile").alias("other"), F.col("here").alias("there")), ["batch", "other"])
    schema = "batch bigint, sample bigint, view bigint, top double, scaled double, own_sum double, own_n bigint"
    terms = met.select("batch", "here", "there").mapInPandas(_tile_terms(temperature), schema)
    anchor = ["batch", "sample", "view"]
    highest = terms.withColumn("most", F.max("top").over(Window.partitionBy(*anchor)))
    per_anchor = highest.groupBy(*anchor).agg(
        (F.max("most") + F.log(F.sum(F.col("scaled") * F.exp(F.col("top") - F.col("most"))))).alias("norm"),
        (F.sum("own_sum") / F.sum("own_n")).alias("mean_own"),
    )
    return per_anchor.groupBy("batch").agg(F.avg((F.col("norm") - F.col("mean_own")) * F.lit(temperature / base)).alias("loss"))


def class_weight_map(cls: Column, weights: dict[int, float]) -> Column:
    """Weight of each pixel's class; unlisted classes keep their own value."""
    return lookup(weights, cls, cls.cast("double"))


def foreground_mask(cls: Column) -> Column:
    return (cls > 0).cast("double")


def total_loss(terms: DataFrame, config: dict[str, dict], keys: list[str] | None = None) -> DataFrame:
    """Weighted total over heads of masked per-sample loss terms.

    ``terms(keys, head, term, value, flag)``; ``config[head] = {"weight": w, "loss": {term: coeff}}``.
    Samples without ground truth (flag 0) do not count.
    """
    unknown = set(config) - set(HEADS)
    if unknown:
        raise KeyError(f"unknown heads {sorted(unknown)}; known: {HEADS}")
    keys = keys or []
    coeffs = {f"{h}|{t}": float(c) * float(cfg.get("weight", 1.0)) for h, cfg in config.items() for t, c in cfg["loss"].items()}
    masked = terms.groupBy(*keys, "head", "term").agg(
        (F.sum(F.col("value") * F.col("flag")) / (F.sum("flag") + F.lit(EPS))).alias("mean")
    )
    scaled = masked.withColumn("coeff", lookup(coeffs, F.concat_ws("|", "head", "term"), F.lit(None).cast("double")))
    return scaled.where("coeff is not null").groupBy(*keys).agg(F.sum(F.col("mean") * F.col("coeff")).alias("overall_loss"))


# loss name -> aggregate over (logits, target); "dice" works on long rows
LOSSES: dict[str, Callable] = {"ce": cross_entropy, "focal": focal, "dice": soft_dice}


def loss(name: str) -> Callable:
    if name not in LOSSES:
        raise KeyError(f"unknown loss {name}; known: {sorted(LOSSES)}")
    return LOSSES[name]
