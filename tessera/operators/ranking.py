"""Order-based operators that survive one key holding most of the rows.

A plain ``row_number() over (partition by key order by ...)`` sorts each key in one task.  That is used
only when a count shows every key is small enough.  Otherwise the rows are range-partitioned by
(key, order), each partition counts for itself, and only the keys that run across a partition border
need an offset: at most one per partition, so the offset table is bounded by the partition count and is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shuffle_width, stable_copy


WINDOW_ROWS = 2_000_000  # largest key sorted by a single task


def _order(cols: list) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cols]


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    totals: dict[str, Column],
    parts: int | None = None,
    window_rows: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add cumulative sums of ``totals`` within ``keys`` in ``order`` (which must be unique per key).

    ``size`` names a further column: the rows of the key.
    """
    order = _order(order)
    names = list(totals)
    biggest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest <= (WINDOW_ROWS if window_rows is None else window_rows):
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        sized = [F.count("*").over(Window.partitionBy(*keys)).alias(size)] if size else []
        return df.select("*", *[F.sum(c).over(whole).alias(n) for n, c in totals.items()], *sized)
    spread = df.select("*", *[c.alias("_v_" + n) for n, c in totals.items()]).repartitionByRange(
        parts or shuffle_width(df.sparkSession), *[F.col(k) for k in keys], *order
    )
    fixed = stable_copy(spread.withColumn("_pid", F.spark_partition_id()))
    per_part = fixed.groupBy(*keys, "_pid").agg(F.count("*").alias("_rows"), *[F.sum("_v_" + n).alias("_s_" + n) for n in names])
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_part.select(
            *keys,
            "_pid",
            F.sum("_rows").over(by_key).alias("_all"),
            F.count("*").over(by_key).alias("_parts"),
            *[F.sum("_s_" + n).over(earlier).alias("_o_" + n) for n in names],
        )
        .where("_parts > 1")
        .withColumnsRenamed({k: "_k_" + k for k in keys})
        .withColumnRenamed("_pid", "_k_pid")
    )
    in_part = Window.partitionBy(*keys, "_pid")
    local = in_part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = [F.count("*").over(in_part).alias("_here")] if size else []
    running = fixed.select("*", *[F.sum("_v_" + n).over(local).alias("_l_" + n) for n in names], *counted)
    same_key = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]
    joined = running.join(F.broadcast(offsets), [F.col("_pid") == F.col("_k_pid"), *same_key], "left")
    sized = [F.coalesce("_all", "_here").alias(size)] if size else []
    return joined.select(
        *df.columns, *[(F.col("_l_" + n) + F.coalesce("_o_" + n, F.lit(0))).alias(n) for n in names], *sized
    )


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """Row numbers from 1 within ``keys``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def evenly_spaced(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most ``most`` rows per key, taken at positions ``int(i * n / most)``.

    A row tells from its place and its key's size whether it is taken.  A table of places would have ``most`` rows a
    key, which Spark takes for no larger than the keys and broadcasts.
    """
    ranked = running_totals(df, keys, order, {"_rn": F.lit(1).cast("long")}, size="_n")
    at, step = F.col("_rn") - 1, F.col("_n") / F.lit(most).cast("double")
    i = F.floor(at / step)  # steps are over 1 where rows are left out, so no other i than this and the next leads here
    taken = [(k < most) & (F.floor(k * step) == at) for k in (i, i + 1)]
    return ranked.where((F.col("_n") <= most) | taken[0] | taken[1]).select(*df.columns)


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per key; a negative ``k`` keeps everything.

    ``row_number() <= k`` is limited per map task before the shuffle, so a hot key sends at most
    ``k`` rows per task.
    """
    if k < 0:
        return df
    place = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= k).drop("_rn")


def _part(size: int) -> Column:
    return (F.floor((F.col("_rn") - 1) / F.lit(float(size))) + 1).cast("int")


def parts_only(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Add ``part`` (from 1) as ``part_numbers`` does; without their number nothing is counted or joined."""
    return numbered(df, keys, order, "_rn").withColumn("part", _part(size)).drop("_rn")


def part_numbers(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Add ``part`` (from 1) and ``parts``: groups larger than ``size`` are cut into equal-size parts."""
    ranked = numbered(df, keys, order, "_rn")
    counts = ranked.groupBy(*keys).agg(F.ceil(F.max("_rn") / F.lit(float(size))).cast("int").alias("parts"))
    return ranked.withColumn("part", _part(size)).join(counts, keys).drop("_rn")


def shard(df: DataFrame, order: list, index: int, size: int) -> DataFrame:
    """Rows ``[(index-1)*size, index*size)`` of the whole ordered list."""
    ranked = numbered(df.withColumn("_all", F.lit(0)), ["_all"], order, "_rn")
    return ranked.where(F.col("_rn").between((index - 1) * size + 1, index * size)).drop("_rn", "_all")


def nth_part(df: DataFrame, order: list, index: int, parts: int) -> DataFrame:
    """Part ``index`` (from 1) of ``parts`` of the whole ordered list; the parts hold every row once, also if they differ by one in size."""
    rows = df.count()
    ranked = numbered(df.withColumn("_all", F.lit(0)), ["_all"], order, "_rn")
    return ranked.where(F.col("_rn").between(rows * (index - 1) // parts + 1, rows * index // parts)).drop("_rn", "_all")
