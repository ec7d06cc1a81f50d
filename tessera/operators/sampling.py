"""Seeded draws, multi-task sampling, crops and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import rasters as ra
from tessera.operators.ranking import numbered

# Chance of the segmentation group when both groups have samples
SEGMENTATION_SHARE = 0.7


def draw(seed: str | int, *on) -> Column:
    """Uniform number in [0, 1) fixed by the seed and the given columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in on])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(u: Column, n: Column) -> Column:
    """Index 0 .. n-1."""
    return F.floor(u * n).cast("long")


def distinct_picks(seed: int, n: Column, k: int, *on: str) -> Column:
    """Array of ``k`` different indices of 0 .. n-1 (``n`` at least ``k``): every set is as likely, in every order.

    For j = n-k .. n-1 an index up to j is drawn, and j itself taken instead if it is there already; then the set is put in
    the order of a draw per member.  The work follows ``k``, not ``n``.
    """

    def add(chosen: Column, j: Column) -> Column:
        drawn = pick(draw(seed, F.lit("distinct"), *on, j), j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, drawn), j).otherwise(drawn)))

    chosen = F.aggregate(F.sequence(n - k, n - 1), F.array().cast("array<bigint>"), add)
    keyed = F.transform(chosen, lambda i: F.struct(draw(seed, F.lit("order"), *on, i).alias("u"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda p: p["i"])


def sample_batches(samples: DataFrame, batch_size: int, seed: int = 0, mixed: bool = True) -> DataFrame:
    """Draw ``max(1, N // batch_size)`` batches: super task, then task, then sample, each uniformly.

    ``samples(sample_id, task, super)`` with super "seg" or "cls".  The segmentation group is chosen
    with probability 0.7 (always, or never, when one group is empty).  A mixed batch draws a task per
    slot, a fixed batch one task for all; a fixed batch is a random sample without repeats if the task has
    enough.  Samples are numbered once per task and met by an equi join on (task, number): nothing is
    enumerated per batch.
    """
    spark = samples.sparkSession
    sizes = samples.groupBy("super", "task").agg(F.count("*").alias("n"))
    # one row: tasks of each group in name order, with sizes (as many entries as datasets)
    entry = lambda group: F.array_sort(F.collect_list(F.when(F.col("super") == group, F.struct("task", "n"))))
    pools = sizes.agg(entry("seg").alias("seg"), entry("cls").alias("cls"), F.sum("n").alias("total"))
    total = samples.count()
    batches = spark.range(max(1, total // batch_size)).withColumnRenamed("id", "batch").join(F.broadcast(pools))
    use_seg = (F.size("seg") > 0) & ((F.size("cls") == 0) | (draw(seed, F.lit("group"), "batch") < SEGMENTATION_SHARE))
    slots = batches.withColumn("pool", F.when(use_seg, F.col("seg")).otherwise(F.col("cls"))).select(
        "batch", "pool", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("slot")
    )
    on = ["batch", "slot"] if mixed else ["batch"]
    task = F.get("pool", pick(draw(seed, F.lit("task"), *on), F.size("pool")).cast("int"))
    chosen = slots.select("batch", "slot", task.alias("t")).select("batch", "slot", F.col("t.task").alias("task"), F.col("t.n").alias("n"))
    free = pick(draw(seed, F.lit("sample"), "batch", "slot"), F.col("n"))
    if mixed:
        rank = free
    else:
        # one draw of the whole batch, the same on each of its slots
        several = F.get(distinct_picks(seed, F.col("n"), batch_size, "batch"), F.col("slot"))
        rank = F.when(F.col("n") >= batch_size, several).otherwise(free)
    ranked = numbered(samples, ["task"], ["sample_id"], "rn").select("task", "sample_id", (F.col("rn") - 1).alias("rank"))
    return chosen.withColumn("rank", rank).join(ranked, ["task", "rank"]).select("batch", "slot", "task", "sample_id")


def crop_offsets(images: DataFrame, size: int, train: bool, seed: int = 0) -> DataFrame:
    """Top-left of a crop per image: random when training, centred otherwise; same for image and labels."""
    if train:
        x0 = pick(draw(seed, F.lit("x"), "image_id"), F.col("w") - size + 1).cast("int")
        y0 = pick(draw(seed, F.lit("y"), "image_id"), F.col("h") - size + 1).cast("int")
    else:
        x0, y0 = (F.floor((F.col(v) - size) / 2.0).cast("int") for v in ("w", "h"))
    return images.withColumn("x0", x0).withColumn("y0", y0)


# ---- augmentation: each step is a function of (pixels, seed), applied with probability one half ----


def coin(seed: int, name: str) -> Column:
    return draw(seed, F.lit(name), "image_id") > 0.5


def flip_h(px: DataFrame, seed: int) -> DataFrame:
    return px.withColumn("x", F.when(coin(seed, "flip_h"), F.col("w") - 1 - F.col("x")).otherwise(F.col("x")))


def flip_v(px: DataFrame, seed: int) -> DataFrame:
    return px.withColumn("y", F.when(coin(seed, "flip_v"), F.col("h") - 1 - F.col("y")).otherwise(F.col("y")))


def turn(px: DataFrame, seed: int) -> DataFrame:
    k = F.when(coin(seed, "turn"), pick(draw(seed, F.lit("turns"), "image_id"), F.lit(4))).otherwise(F.lit(0).cast("long"))
    return ra.rotate90(px, k.cast("int"))


def brighten(px: DataFrame, seed: int, delta: float = 30.0) -> DataFrame:
    shift = draw(seed, F.lit("shift"), "image_id") * (2 * delta) - delta
    return px.withColumn("v", F.when(coin(seed, "bright"), ra.brightness(F.col("v"), shift)).otherwise(F.col("v")))


def stretch(px: DataFrame, seed: int, lo: float = 0.8, hi: float = 1.2) -> DataFrame:
    alpha = F.when(coin(seed, "contrast"), draw(seed, F.lit("alpha"), "image_id") * (hi - lo) + lo).otherwise(F.lit(1.0))
    return ra.contrast(px, ["v"], alpha)


AUGMENTATIONS = [flip_h, flip_v, turn, brighten, stretch]


def augment(px: DataFrame, seed: int = 0, steps: list | None = None) -> DataFrame:
    """Compose augmentation steps; geometric ones move every column of a pixel row, labels included."""
    for step in AUGMENTATIONS if steps is None else steps:
        px = step(px, seed)
    return px


# ---- batches -----------------------------------------------------------------------------------


def heads_present(samples: DataFrame, mandatory: list[str]) -> DataFrame:
    """Heads of each batch: those with a target plus the mandatory ones; ``has_gt`` tells which are real."""
    real = samples.select("batch", F.explode("heads").alias("head")).distinct().withColumn("has_gt", F.lit(True))
    must = samples.select("batch").distinct().select("batch", F.explode(F.array(*[F.lit(h) for h in mandatory])).alias("head"))
    both = real.unionByName(must.withColumn("has_gt", F.lit(False)))
    return both.groupBy("batch", "head").agg(F.max("has_gt").alias("has_gt"))


def align_batches(samples: DataFrame, targets: DataFrame, mandatory: list[str]) -> DataFrame:
    """Every sample with every mandatory head: its target or zero, a flag, and the batch's largest size.

    ``samples(batch, sample_id, w, h)``, ``targets(sample_id, head, value)``.
    """
    sizes = samples.groupBy("batch").agg(F.max("w").alias("max_w"), F.max("h").alias("max_h"))
    wide = samples.select("batch", "sample_id", "w", "h", F.explode(F.array(*[F.lit(h) for h in mandatory])).alias("head"))
    joined = wide.join(targets, ["sample_id", "head"], "left").join(sizes, "batch")
    return joined.select(
        "batch",
        "sample_id",
        "head",
        F.coalesce("value", F.lit(0.0)).alias("value"),
        F.col("value").isNotNull().alias("has_gt"),
        (F.col("max_w") - F.col("w")).alias("pad_right"),
        (F.col("max_h") - F.col("h")).alias("pad_bottom"),
    )
