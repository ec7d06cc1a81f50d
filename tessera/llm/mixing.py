"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document of weight w gets the key -ln(u) / w, u drawn from a digest of its id, so that taking the smallest
keys of a source is a weighted sample without replacement and a rerun takes the same.  A source first gives
complete epochs; what its target leaves over is a prefix of its documents in key order.

The prefix sums never sort a source in one task.  Keys fall into ``BINS`` ordered bins; a window over at most
``BINS`` totals per source finds the one bin in which the budget ends, and only that bin's documents are
ordered, in one task per source and bin.  Sources are weighed after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, broadcast_if_small, fresh
from tessera.session import stable_copy

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all sizes
CAP = 2  # times a source's size
BINS = 4096
SEED = "mix-1"
UNIT = float(2**52)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letters_of(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""))


def quality_of(letters: Column, size: Column) -> Column:
    """Weight between 0.25 and 1: 1 for an average word of five characters, less the further from it."""
    off = F.abs(letters / F.greatest(size, F.lit(1)) - F.lit(5.0)) / F.lit(10.0)
    return F.greatest(F.lit(1.0) - off, F.lit(0.25))


def uniform_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), the same in every run: 52 bits of a digest of the id (of the text where there is no id)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(UNIT)


def sampling_key(doc_id: Column, text: Column, letters: Column, size: Column) -> Column:
    return -F.log(uniform_of(doc_id, text)) / quality_of(letters, size)


def bin_of(key: Column, bins: int) -> Column:
    return F.floor(F.lit(float(bins)) * (F.lit(1.0) - F.exp(-key))).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from one row per source with its ``size`` (null is a source, the last one).

    A target is its source's weight times a common level, or the cap where that is smaller: caps are met in the
    order of cap / weight, and the level is what is left for the weights that are left.  With a share above the
    cap every source stands at its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", F.col("size").alias("source_size"), F.row_number().over(order).alias("rank"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = weighed.select(
        "*",
        (
            (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        ).alias("level"),
    )
    # the first source in that order whose cap is not below the level sets the level for all
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    level = first["level"]
    target = F.when(level.isNull() | (F.col("cap") / F.col("weight") < level), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return levels.select("source", "source_size", target.alias("target"))


def _budgets(documents: DataFrame, weights: tuple[int, ...], share: float, cap: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """Narrow keyed rows of the documents joined to their source's budget, and the rows of the bins where budgets end."""
    text, size = F.col("text"), F.col("size")
    narrow = documents.select("doc_id", "source", size_of(text).alias("size"), letters_of(text).alias("letters"), F.when(F.col("doc_id").isNull(), text).alias("text"))
    keyed = narrow.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), text, F.col("letters"), size).alias("key"))
    rows = stable_copy(keyed.select("*", bin_of(F.col("key"), bins).alias("bin")))

    binned = stable_copy(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    targets = source_targets(binned.groupBy("source").agg(F.sum("size").alias("size")), weights, share, cap)
    complete = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("complete", complete).withColumn("budget", F.col("target") - F.col("complete") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.select(F.col("source").alias("s"), "bin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    ends = (
        totals.join(budgets, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", "source_size", "target", "complete", "budget")
        .agg(F.max(F.when(F.col("before") <= F.col("budget"), F.struct("bin", "before"))).alias("end"))
        .select("s", "source_size", "target", "complete", "budget", F.col("end.bin").alias("last"), F.col("end.before").alias("before"))
    )
    placed = rows.join(ends, F.col("source").eqNullSafe(F.col("s")))
    inside = Window.partitionBy("s", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(F.col("bin") == F.col("last")).withColumn("earlier", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed, edge.withColumn("extra", (F.col("earlier") + F.col("size") / F.lit(2.0)) <= F.col("budget")).drop("earlier")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, bins: int = BINS) -> DataFrame:
    """Per row of ``documents`` (``doc_id, text, source``): ``doc_id, size, source_size, target, epochs, taken``.

    ``epochs`` is how often the document is taken, ``taken`` its words times that.  The fractional part ends at
    the document whose middle lies within the budget, so a source misses its target by at most half a document.
    Null texts have no words and are never counted; an empty table gives no rows.  Rows that repeat an id share
    its key and are told apart by size; a row without an id is drawn by its text.  Other columns are dropped.
    """
    placed, edge = _budgets(documents, weights, share, cap, bins)
    rest = placed.where(F.col("bin") != F.col("last")).withColumn("extra", F.col("bin") < F.col("last"))
    epochs = F.col("complete") + F.col("extra").cast("long")
    return edge.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))


def mixed_rows(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, bins: int = BINS) -> DataFrame:
    """The rows of ``documents`` (all columns) as often as the mix takes them.

    Only the last key taken per source travels; each document finds its own epochs from it, so texts are not
    shuffled.  Rows alike in key, id and size are taken together.  Rows without words are never taken.
    """
    placed, edge = _budgets(documents, weights, share, cap, bins)
    mine, key, size, plan = fresh(documents, "_mine", "_key", "_size", "_plan")
    last = edge.where("extra").groupBy("s").agg(F.max(F.struct("key", "doc_id", "size")).alias("reached"))
    plans = placed.select("s", "complete", "last").distinct().join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left")
    plans = plans.select(F.struct("s", "complete", "last", "reached").alias(plan))
    text = F.col("text")
    sized = documents.withColumn(size, size_of(text))
    keyed = sized.withColumn(key, sampling_key(F.col("doc_id"), text, letters_of(text), F.col(size)))
    joined = keyed.join(broadcast_if_small(plans), F.col("source").eqNullSafe(F.col(plan)["s"]))
    here = F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col(size).alias("size"))
    of_bin, end = bin_of(F.col(key), bins), F.col(plan)["last"]
    extra = (of_bin < end) | ((of_bin == end) & F.coalesce(here <= F.col(plan)["reached"], F.lit(False)))
    epochs = F.when(F.col(size) > 0, F.col(plan)["complete"] + extra.cast("long")).otherwise(F.lit(0)).cast("int")
    taken = joined.withColumn(mine, epochs).where(F.col(mine) > 0)
    return taken.withColumn(mine, F.explode(F.sequence(F.lit(1), F.col(mine)))).select(*documents.columns)


def op7(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")
