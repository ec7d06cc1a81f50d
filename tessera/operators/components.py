"""Connected components (4-neighbour) of sparse pixel sets.

Two levels.  Pixels become row runs, runs are cut at the borders of 512 x 512 blocks and every block is
labelled inside one task (a block is bounded, however large its image).  What is left are edges between
the local labels of neighbouring blocks; those are contracted to stars over the cluster (alternating
large-star / small-star), each round two equi joins written to the checkpoint folder, so a lost executor
costs one round.  Images smaller than a block need no round at all.

A component is named after its first run in raster order: ``y * 2**32 + x``.  Labels therefore sort
like the usual raster-scan numbering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranking import numbered
from tessera.operators.runs import to_pixels, to_runs
from tessera.session import stable_copy

BLOCK = 512


def _block(value):
    return F.floor(value / F.lit(float(BLOCK))).cast("int")


def _label_in_blocks(groups: pd.DataFrame) -> np.ndarray:
    """Index of the first run of each run's component; rows sorted by group, y, x0."""
    code = groups["_grp"].to_numpy() * (BLOCK + 1) + groups["y"].to_numpy() % BLOCK
    width = BLOCK + 1
    lo = code * width + groups["x0"].to_numpy() % BLOCK
    hi = code * width + groups["x1"].to_numpy() % BLOCK
    # runs of the row above that share a column form one stretch of the sorted list
    first = np.searchsorted(hi, lo - width, "left")
    count = np.maximum(np.searchsorted(lo, hi - width, "right") - first, 0)
    below = np.repeat(np.arange(len(lo)), count)
    above = np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(lo))
    while True:
        a, b = root[below], root[above]
        if np.array_equal(a, b):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _label_partition(keys: list[str]):
    group = [*keys, "_by", "_bx"]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        root = _label_in_blocks(pdf)
        pdf["local"] = (pdf["y"].to_numpy().astype("int64") * 2**32 + pdf["x0"].to_numpy())[root]
        return pdf.drop(columns="_grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            fresh = (pdf[group] != pdf[group].shift()).any(axis=1)
            pdf["_grp"] = fresh.cumsum() - 1
            # the last block may go on in the next batch
            last = pdf["_grp"] == pdf["_grp"].iloc[-1]
            held = pdf[last].drop(columns="_grp")
            if not last.all():
                yield label(pdf[~last].copy())
        if held is not None and len(held):
            yield label(held.assign(_grp=0))

    return run


def label_blocks(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Cut runs at block borders and name each piece after the first piece of its block component."""
    pieces = runs.withColumn("_bx", F.explode(F.sequence(_block(F.col("x0")), _block(F.col("x1")))))
    pieces = (
        pieces.withColumn("x0", F.greatest("x0", F.col("_bx") * BLOCK))
        .withColumn("x1", F.least("x1", F.col("_bx") * BLOCK + BLOCK - 1))
        .withColumn("_by", _block(F.col("y")))
    )
    group = [*keys, "_by", "_bx"]
    placed = pieces.repartition(*group).sortWithinPartitions(*group, "y", "x0")
    schema = T.StructType([*placed.schema.fields, T.StructField("local", T.LongType())])
    return placed.mapInPandas(_label_partition(keys), schema)


def border_edges(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a > b) of local labels that touch across a block border."""
    right = pieces.where((F.col("x1") + 1) % BLOCK == 0).select(*keys, "y", (F.col("x1") + 1).alias("x0"), F.col("local").alias("l"))
    sideways = pieces.where(F.col("x0") % BLOCK == 0).join(right, [*keys, "y", "x0"]).select(*keys, F.col("local").alias("m"), "l")
    above = pieces.where((F.col("y") + 1) % BLOCK == 0).select(
        *keys, (F.col("y") + 1).alias("y"), "_bx", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("local").alias("l")
    )
    upward = (
        pieces.where(F.col("y") % BLOCK == 0)
        .join(above, [*keys, "y", "_bx"])
        .where((F.col("x0") <= F.col("u1")) & (F.col("x1") >= F.col("u0")))
        .select(*keys, F.col("local").alias("m"), "l")
    )
    touching = sideways.unionByName(upward).where("m <> l")
    return touching.select(*keys, F.greatest("m", "l").alias("a"), F.least("m", "l").alias("b")).distinct()


def contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Star forest (a -> smallest node of its component) of an edge list with a > b."""
    edges = stable_copy(edges)
    if edges.isEmpty():
        return edges
    while True:
        both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).select(*keys, "u", F.least("u", "_m").alias("m"))
        large = (
            both.join(low, [*keys, "u"]).where(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        hooked = large.join(least, [*keys, "a"]).where(F.col("b") != F.col("m")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stable_copy(hooked.union(least.select(*keys, "a", F.col("m").alias("b"))).distinct())
        roles = edges.select(*keys, F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select(*keys, F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        unsettled = roles.groupBy(*keys, "n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
            (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))
        )
        if unsettled.isEmpty():
            return edges


def label_runs(runs: DataFrame, keys: list[str], name: str = "comp") -> DataFrame:
    """Add the component as column ``name`` to every run (runs come back cut at block borders)."""
    if name in runs.columns:
        raise ValueError(f"column {name} is taken; pass another name")
    pieces = stable_copy(label_blocks(runs, keys))
    stars = contract(border_edges(pieces, keys), keys).withColumnsRenamed({"a": "local", "b": "_root"})
    named = pieces.join(stars, [*keys, "local"], "left").withColumn(name, F.coalesce("_root", "local"))
    return named.select(*runs.columns, name)


def label_pixels(px: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x, y, comp`` for a pixel set."""
    runs = label_runs(to_runs(px, keys), keys)
    return to_pixels(runs, [*keys, "comp"])


def numbered_components(px: DataFrame, image: str = "image_id") -> DataFrame:
    """Components numbered from 1 per image in raster order: ``image, x, y, inst_id``."""
    labelled = label_runs(to_runs(px, [image]), [image])
    names = numbered(labelled.select(image, "comp").distinct(), [image], ["comp"], "inst_id")
    return to_pixels(labelled.join(names, [image, "comp"]), [image, "inst_id"])


def component_boxes(labelled_runs: DataFrame, keys: list[str]) -> DataFrame:
    return labelled_runs.groupBy(*keys, "comp").agg(
        F.min("x0").alias("x_min"),
        F.min("y").alias("y_min"),
        (F.max("x1") + 1).alias("x_max"),
        (F.max("y") + 1).alias("y_max"),
        F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"),
    )


def split_reused_ids(px: DataFrame) -> DataFrame:
    """Give disconnected pieces of one instance id new ids above the largest one.

    The first piece (raster order) keeps the id.  Ids are visited in order; the pieces of one id take
    numbers above everything handed out so far, counted as that id's number of pieces.
    """
    from tessera.operators.ranking import running_totals

    key = ["image_id", "inst_id"]
    runs = label_runs(to_runs(px, key), key)
    pieces = runs.select(*key, "comp").distinct()
    order = numbered(pieces, key, ["comp"], "piece")
    sizes = pieces.groupBy(*key).agg(F.count("*").alias("n"))
    step = F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))
    used = running_totals(sizes, ["image_id"], ["inst_id"], {"upto": step}).select(
        *key, (F.col("upto") - step).alias("used")
    )
    top = sizes.groupBy("image_id").agg(F.max("inst_id").alias("top"))
    names = order.join(used, key).join(top, "image_id")
    fresh = F.when(F.col("piece") == 1, F.col("inst_id")).otherwise(F.col("top") + F.col("used") + F.col("piece"))
    renamed = names.select(*key, "comp", fresh.cast("long").alias("new_id"))
    return to_pixels(runs.join(renamed, [*key, "comp"]), ["image_id", "inst_id", "new_id"])
