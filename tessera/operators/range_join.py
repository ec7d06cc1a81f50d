"""Range joins of boxes over a hierarchical grid.

A box is filed at the level whose cell side is at least its longer side, so it touches at most four
cells there.  A pair is found at the coarser of its two levels and reported from exactly one cell
(the one holding the top-left corner of the two boxes' common part), so no ``distinct`` is needed.
Cells crowded on both sides are split: the left rows get a salt, the right rows are repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import small_enough, stable_copy

CELL_BUDGET = 50_000_000  # comparisons one task should make for one cell before it is split


def _level(x0: str, y0: str, x1: str, y1: str, cell: int) -> Column:
    side = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0), F.lit(1)).cast("double")
    return F.greatest(F.ceil(F.log2(side / F.lit(float(cell)))), F.lit(0)).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """Distinct levels in use: at most 32 integers."""
    return sorted(r[0] for r in df.select("_lv").distinct().collect())


def _cover(df: DataFrame, box: tuple, partner_levels: list[int], cell: int) -> DataFrame:
    """Repeat each box for its own level, every coarser level of the other side, and every cell it meets there."""
    x0, y0, x1, y1 = (F.col(b) for b in box)
    above = F.filter(F.array(*[F.lit(v) for v in partner_levels]), lambda v: v > F.col("_lv"))
    df = df.withColumn("_at", F.explode(F.concat(F.array("_lv"), above)))
    side = F.lit(cell) * F.expr("shiftleft(1L, _at)")
    at = lambda v: F.floor(v / side.cast("double")).cast("int")
    df = df.withColumn("_cx", F.explode(F.sequence(at(x0), at(x1))))
    return df.withColumn("_cy", F.explode(F.sequence(at(y0), at(y1))))


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_box: tuple = ("x_min", "y_min", "x_max", "y_max"),
    right_box: tuple = ("x_min", "y_min", "x_max", "y_max"),
    keep_left: list[str] | None = None,
    keep_right: list[str] | None = None,
    cell: int = 256,
    distinct_pairs: bool = True,
    split_crowded: bool = True,
    levels: tuple[list[int], list[int]] | None = None,
) -> DataFrame:
    """All pairs of boxes that meet (closed intervals) and agree on ``on``.

    ``levels`` names the grid levels that may occur on each side when they are known (all boxes at most
    ``cell`` wide: ``([0], [0])``); a superset is fine.  Otherwise one small aggregate finds them.
    ``split_crowded`` may be off where one side has few boxes in any cell, which saves counting the cells.

    Output: ``on``, the kept columns as ``l_*``/``r_*`` and both boxes as ``l_<box>``/``r_<box>``.
    """
    keep_left = [c for c in left.columns if c not in on] if keep_left is None else keep_left
    keep_right = [c for c in right.columns if c not in on] if keep_right is None else keep_right

    def prepare(df: DataFrame, box: tuple, keep: list[str], tag: str) -> tuple[DataFrame, tuple]:
        cols = list(dict.fromkeys([*keep, *box]))
        df = df.select(*on, *[F.col(c).alias(tag + c) for c in cols])
        box = tuple(tag + b for b in box)
        return df.withColumn("_lv", _level(*box, cell)), box

    lhs, lbox = prepare(left, left_box, keep_left, "l_")
    rhs, rbox = prepare(right, right_box, keep_right, "r_")
    l_levels, r_levels = levels or (_levels(lhs), _levels(rhs))
    lhs = _cover(lhs, lbox, r_levels, cell).withColumnRenamed("_lv", "_llv")
    rhs = _cover(rhs, rbox, l_levels, cell).withColumnRenamed("_lv", "_rlv")
    keys = [*on, "_at", "_cx", "_cy"]
    if split_crowded:
        lhs, rhs = _salted(lhs, rhs, keys)
        keys = [*keys, "_salt"]
    # cells multiply rows behind the exchange whose size the planner sees, so it must not broadcast either side
    pairs = lhs.join(rhs.hint("merge"), keys)
    lx0, ly0, lx1, ly1 = (F.col(b) for b in lbox)
    rx0, ry0, rx1, ry1 = (F.col(b) for b in rbox)
    meets = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    pairs = pairs.where((F.col("_at") == F.greatest("_llv", "_rlv")) & meets)
    if distinct_pairs:
        side = F.lit(cell) * F.expr("shiftleft(1L, _at)")
        at = lambda v: F.floor(v / side.cast("double")).cast("int")
        pairs = pairs.where(
            (F.col("_cx") == at(F.greatest(lx0, rx0))) & (F.col("_cy") == at(F.greatest(ly0, ry0)))
        )
    wanted = [*["l_" + c for c in keep_left], *["r_" + c for c in keep_right]]
    return pairs.select(*on, *dict.fromkeys([*wanted, *lbox, *rbox]))


def _salted(lhs: DataFrame, rhs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: pieces of the left rows in crowded cells, and as many copies of the right ones.

    One aggregate counts the cells of both sides; without a crowded cell the sides are joined as they are.
    """
    side = lambda df, left: df.select(*keys, F.lit(left).cast("long").alias("_l"), F.lit(1 - left).cast("long").alias("_r"))
    counted = side(lhs, 1).unionByName(side(rhs, 0)).groupBy(*keys).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    product = F.col("_nl") * F.col("_nr")
    crowded = stable_copy(
        counted.where(product > CELL_BUDGET).select(*keys, F.ceil(product / F.lit(float(CELL_BUDGET))).cast("int").alias("_parts"))
    )
    if crowded.isEmpty():
        return lhs.withColumn("_salt", F.lit(0)), rhs.withColumn("_salt", F.lit(0))
    crowded = F.broadcast(crowded) if small_enough(crowded) else crowded
    parts = F.coalesce("_parts", F.lit(1))
    lhs = lhs.join(crowded, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*lhs.columns), parts).cast("int"))
    rhs = rhs.join(crowded, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return lhs.drop("_parts"), rhs.drop("_parts")


def self_pairs(df: DataFrame, on: list[str], id_col: str, cell: int = 256, **kw) -> DataFrame:
    """Unordered pairs of distinct boxes of one table that meet."""
    box = kw.get("left_box", ("x_min", "y_min", "x_max", "y_max"))
    levels = kw.pop("levels", None) or (_levels(df.select(_level(*box, cell).alias("_lv"))),) * 2
    pairs = box_pairs(df, df, on, cell=cell, levels=levels, **kw)
    return pairs.where(F.col("l_" + id_col) < F.col("r_" + id_col))
