"""The instance store: Parquet tables partitioned by slide and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.morton import morton
from tessera.operators.instances import typed_or_minus_one

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])

INSTANCES = T.StructType(
    [
        T.StructField("slide_id", T.IntegerType()),
        T.StructField("task", T.StringType()),
        T.StructField("inst_uid", T.StringType()),
        T.StructField("x_min", T.IntegerType()),
        T.StructField("y_min", T.IntegerType()),
        T.StructField("x_max", T.IntegerType()),
        T.StructField("y_max", T.IntegerType()),
        T.StructField("cx", T.DoubleType()),
        T.StructField("cy", T.DoubleType()),
        T.StructField("contour", T.ArrayType(POINT)),
        T.StructField("type_id", T.IntegerType()),
        T.StructField("type_prob", T.DoubleType()),
        T.StructField("area", T.LongType()),
    ]
)


def write_instances(instances: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write one folder per slide and task; only the (slide, task) folders present are replaced.

    The rebalance hint lets the adaptive planner split a huge slide over several writers and put small
    ones together.  Rows lie in Z-order of their boxes' centres, so a file (of at most ``rows_per_file`` rows,
    0: any number) and each row group in it cover a compact area.
    """
    centre = lambda a, b: F.greatest(F.shiftright(F.col(a) + F.col(b), 1), F.lit(0))
    (
        instances.hint("rebalance", "slide_id", "task")
        .sortWithinPartitions("slide_id", "task", morton(centre("x_min", "x_max"), centre("y_min", "y_max")))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slide_id", "task")
        .parquet(f"{path}/instances")
    )


def write_packed(instances: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write the whole store with many slides to a file, for stores of more slides than a file system likes folders.

    Rows are range-partitioned and sorted by slide, task and Z-order, so files and row groups are as compact as in
    ``write_instances``, a huge slide is spread over several files, and ``box_tree`` and the readers work alike.
    """
    centre = lambda a, b: F.greatest(F.shiftright(F.col(a) + F.col(b), 1), F.lit(0))
    place = ["slide_id", "task", morton(centre("x_min", "x_max"), centre("y_min", "y_max"))]
    (
        instances.repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(f"{path}/instances")
    )


def image_outputs(instances: DataFrame) -> DataFrame:
    """Per-image instance rows as they are written: untyped instances carry type -1."""
    return typed_or_minus_one(instances)


def write_image_outputs(path: str, **kinds: DataFrame) -> None:
    """One Parquet table per kind (instance map, instances, type map, class map), image by image."""
    for kind, df in kinds.items():
        df.hint("rebalance", "image_id").sortWithinPartitions("image_id").write.mode("overwrite").parquet(f"{path}/{kind}")


def write_slides(slides: DataFrame, path: str) -> None:
    (
        slides.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slide_id")
        .parquet(f"{path}/slides")
    )


def read_instances(
    spark: SparkSession, path: str, slides: list[int] | None = None, tasks: list[str] | None = None
) -> DataFrame:
    """Read the store; slide and task selections prune partitions."""
    df = spark.read.schema(INSTANCES).parquet(f"{path}/instances")
    if slides is not None:
        df = df.where(F.col("slide_id").isin(slides))
    return of_tasks(df, tasks) if tasks is not None else df


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/slides")


def of_tasks(df: DataFrame, tasks: list[str]) -> DataFrame:
    """Rows of the named tasks; unknown names match nothing."""
    return df.where(F.col("task").isin(tasks))


def in_region(df: DataFrame, x: int, y: int, w: Column | int, h: Column | int) -> DataFrame:
    """Instances whose box meets the region (inclusive)."""
    return df.where(
        (F.col("x_max") >= x) & (F.col("x_min") <= w + F.lit(x)) & (F.col("y_max") >= y) & (F.col("y_min") <= h + F.lit(y))
    )


def flatten_box(df: DataFrame, name: str) -> DataFrame:
    """Nested ``[[r0, c0], [r1, c1]]`` to flat XYXY columns."""
    b = F.col(name)
    return df.select(
        "*", b[0][1].alias("x0"), b[0][0].alias("y0"), b[1][1].alias("x1"), b[1][0].alias("y1")
    ).drop(name)
