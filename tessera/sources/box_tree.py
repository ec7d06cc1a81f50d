"""A packed box tree over the files of an instance store, kept beside the data.

A leaf is a file with the box of its instances, summed from the files by one aggregate; leaves of a folder lie in Z-order of
their centres, every ``FANOUT`` neighbours form a node, and so on up to one root per folder.  A lookup goes down level by
level: nodes whose box meets the region are joined with their children, and only the files under the last of them are
opened.  Inside a file the row groups, in Z-order too, are skipped by their own statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, intersects
from tessera.functions.morton import morton
from tessera.session import small_enough, stable_copy
from tessera.sources.store import INSTANCES

FANOUT = 32
MOST_FILES = 20_000  # that a reader is given by name; beyond that the folders are scanned

_FOLDER = ["slide_id", "task"]
_SIDES = ["x_min", "y_min", "x_max", "y_max"]
_HULL = [F.min, F.min, F.max, F.max]


def _z():
    centre = lambda a, b: F.greatest(F.shiftright(F.col(a) + F.col(b), 1), F.lit(0))
    return morton(centre("x_min", "x_max"), centre("y_min", "y_max"))


def build(spark: SparkSession, path: str) -> None:
    """Write the tree of the store at ``path`` to its ``boxes`` folder, from scratch."""
    rows = spark.read.schema(INSTANCES).parquet(f"{path}/instances")
    hull = lambda df, *by: df.groupBy(*by).agg(*[f(c).alias(c) for f, c in zip(_HULL, _SIDES)])
    level = hull(rows.select("*", F.col("_metadata.file_path").alias("file")), *_FOLDER, "file")
    tree, depth = None, 0
    while True:
        place = Window.partitionBy(*_FOLDER).orderBy(_z(), *(["file"] if depth == 0 else ["node"]))
        number = (F.row_number().over(place) - 1).cast("long")
        if depth == 0:
            level = level.withColumn("node", number)
        parent = F.floor(number / F.lit(float(FANOUT))).cast("long")
        level = stable_copy(level.select(*_FOLDER, F.lit(depth).alias("depth"), "node", parent.alias("parent"), *_SIDES, *(["file"] if depth == 0 else [F.lit(None).cast("string").alias("file")])))
        tree = level if tree is None else tree.unionByName(level)
        if level.where("parent > 0").isEmpty():
            break
        level, depth = hull(level.withColumn("node", F.col("parent")), *_FOLDER, "node"), depth + 1
    tree.repartitionByRange("depth", *_FOLDER, "parent").sortWithinPartitions("depth", *_FOLDER, "parent").write.mode("overwrite").parquet(f"{path}/boxes")


def files_of(spark: SparkSession, path: str, regions: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """``file`` of every file that may hold an instance in a region ``(slide_id, x_min, y_min, x_max, y_max)`` (edges count)."""
    tree = spark.read.parquet(f"{path}/boxes")
    tree = tree.where(F.col("task").isin(tasks)) if tasks is not None else tree
    asked = regions.select("slide_id", *[F.col(c).alias(f"q_{c}") for c in _SIDES])
    asked = F.broadcast(asked) if small_enough(asked) else asked
    depth = tree.agg(F.max("depth")).first()[0] or 0
    meets = intersects(Box.of(), Box.of("q_"))
    near = tree.where(F.col("depth") == depth).join(asked, "slide_id").where(meets)
    while depth:
        depth -= 1
        ahead = near.select(*_FOLDER, F.col("node").alias("parent"), *[f"q_{c}" for c in _SIDES])
        near = tree.where(F.col("depth") == depth).join(ahead, [*_FOLDER, "parent"]).where(meets)
    return near.select("file").distinct()


def read_regions(spark: SparkSession, path: str, regions: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """Instances whose box meets their slide's region (edges count), with the region as ``q_x_min`` and so on."""
    hits = [r["file"] for r in files_of(spark, path, regions, tasks).limit(MOST_FILES + 1).collect()]
    reader = spark.read.schema(INSTANCES)
    if len(hits) > MOST_FILES:
        rows = reader.parquet(f"{path}/instances")
    elif hits:
        rows = reader.option("basePath", f"{path}/instances").parquet(*hits)
    else:
        rows = spark.createDataFrame([], INSTANCES)
    rows = rows.where(F.col("task").isin(tasks)) if tasks is not None else rows
    asked = regions.select("slide_id", *[F.col(c).alias(f"q_{c}") for c in _SIDES])
    asked = F.broadcast(asked) if small_enough(asked) else asked
    return rows.join(asked, "slide_id").where(intersects(Box.of(), Box.of("q_")))
