"""One-to-one matching of predicted and true instances by IoU."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BLOCK, block_of, groups, sorted_by_block
from tessera.operators.runs import local_runs
from tessera.session import stable_copy


_GROUP = ["image_id", "_by", "_bx"]


def _crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlap lengths of the two maps' runs inside a block, summed per pair."""
    for key, run in groups(batches, _GROUP):
        line = np.unique(run["cls"], return_inverse=True)[1] * BLOCK + run["y"] % BLOCK
        lo, hi = line * BLOCK + run["x0"] % BLOCK, line * BLOCK + run["x1"] % BLOCK
        true = run["true"].astype(bool)
        p, t = np.flatnonzero(~true), np.flatnonzero(true)
        p, t = p[np.argsort(lo[p], kind="stable")], t[np.argsort(lo[t], kind="stable")]
        # two runs cross if one starts inside the other; equal starts count once
        a, b = [], []
        for outer, inner, side in ((t, p, "left"), (p, t, "right")):
            first = np.searchsorted(lo[inner], lo[outer], side)
            count = np.maximum(np.searchsorted(lo[inner], hi[outer], "right") - first, 0)
            many = np.repeat(outer, count)
            few = inner[np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
            a.append(few if side == "left" else many)
            b.append(many if side == "left" else few)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = pd.DataFrame({"cls": run["cls"][a], "pid": run["inst_id"][a], "tid": run["inst_id"][b], "inter": np.minimum(hi[a], hi[b]) - np.maximum(lo[a], lo[b]) + 1})
            pairs = pairs.groupby(["cls", "pid", "tid"], as_index=False).sum()
            pairs.insert(0, "image_id", key[0])
            yield pairs


def runs_of_both(pred: DataFrame, true: DataFrame) -> DataFrame:
    """``true, image_id, cls, inst_id, y, x0, x1``: the runs of two maps, 0 and 1, built where their pixels lie."""
    cell = ["image_id", "cls", "inst_id", "x", "y"]
    marked = lambda px, side: px.select(F.lit(side).alias("true"), *cell)
    return stable_copy(local_runs(marked(pred, 0).unionByName(marked(true, 1)), ["true", "image_id", "cls", "inst_id"]))


def overlaps(runs: DataFrame) -> DataFrame:
    """``image_id, cls, pid, tid, inter``: common pixels of every overlapping pair of one class.

    Takes ``runs_of_both``.  Only runs are shuffled, to the 512 x 512 blocks they lie in; there the two lists, sorted by
    start, are swept against each other.  Instances of a map may overlap.
    """
    pieces = runs.withColumn("_bx", F.explode(F.sequence(block_of(F.col("x0")), block_of(F.col("x1")))))
    pieces = (
        pieces.withColumn("x0", F.greatest("x0", F.col("_bx") * BLOCK))
        .withColumn("x1", F.least("x1", F.col("_bx") * BLOCK + BLOCK - 1))
        .withColumn("_by", block_of(F.col("y")))
    )
    kind = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = f"image_id {kind['image_id']}, cls {kind['cls']}, pid {kind['inst_id']}, tid {kind['inst_id']}, inter bigint"
    crossing = sorted_by_block(pieces, _GROUP, []).mapInPandas(_crossing, schema)
    return crossing.groupBy("image_id", "cls", "pid", "tid").agg(F.sum("inter").alias("inter"))


def _areas(runs: DataFrame, side: int, name: str, area: str) -> DataFrame:
    """Pixels per instance, summed map-side from its runs."""
    length = (F.col("x1") - F.col("x0") + 1).cast("long")
    return runs.where(F.col("true") == side).groupBy("image_id", "cls", F.col("inst_id").alias(name)).agg(F.sum(length).alias(area))


def iou_pairs(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(image_id, cls, pid, tid, iou) for every overlapping pair of one class.

    Pixels stay where they are; the work follows the runs and the overlap, not predictions x truths.
    """
    return iou_of_runs(runs_of_both(pred, true))


def iou_of_runs(runs: DataFrame) -> DataFrame:
    """``iou_pairs`` of maps that are ``runs_of_both`` already."""
    iou = F.col("inter").cast("double") / (F.col("p_area") + F.col("t_area") - F.col("inter"))
    return (
        overlaps(runs)
        .join(_areas(runs, 0, "pid", "p_area"), ["image_id", "cls", "pid"])
        .join(_areas(runs, 1, "tid", "t_area"), ["image_id", "cls", "tid"])
        .select("image_id", "cls", "pid", "tid", iou.alias("iou"))
    )


def match(pred: DataFrame, true: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy matches by falling IoU.

    At 0.5 and above an instance can exceed the threshold with one partner only, so a filter is the
    whole matching.  Below, rounds of mutual-best pairs give the greedy result: the best remaining
    pair is always mutual, so every round settles at least one pair and the loop ends.
    """
    return match_runs(runs_of_both(pred, true), threshold)


def match_runs(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``match`` of maps that are ``runs_of_both`` already."""
    pairs = iou_of_runs(runs).where(F.col("iou") > threshold)
    return pairs if threshold >= 0.5 else mutual_best(pairs)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one choice under the order (iou desc, pid, tid), set by set."""
    rest = stable_copy(pairs)
    chosen = None
    while not rest.isEmpty():
        order = F.struct("iou", (-F.col("pid")).alias("p"), (-F.col("tid")).alias("t"))
        by_pred = rest.groupBy("image_id", "cls", "pid").agg(F.max(order).alias("b"))
        by_true = rest.groupBy("image_id", "cls", "tid").agg(F.max(order).alias("b"))
        pick = lambda df: df.select("image_id", "cls", (-F.col("b.p")).alias("pid"), (-F.col("b.t")).alias("tid"), F.col("b.iou").alias("iou"))
        won = stable_copy(pick(by_pred).join(pick(by_true).drop("iou"), ["image_id", "cls", "pid", "tid"], "left_semi"))
        chosen = won if chosen is None else chosen.unionByName(won)
        rest = stable_copy(
            rest.join(won.select("image_id", "cls", "pid"), ["image_id", "cls", "pid"], "left_anti").join(
                won.select("image_id", "cls", "tid"), ["image_id", "cls", "tid"], "left_anti"
            )
        )
    return rest if chosen is None else chosen
