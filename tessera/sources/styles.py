"""Class names, colours and head codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Per task, line width, colour of untyped objects, class names and class colours (RGBA)
STYLES = {
    "Gland": {
        "line_width": 12,
        "colour": [255, 255, 0, 0],
        "names": ["nolabel", "healthy", "adenomatous", "moderately differentiated", "poorly differentiated"],
        "colours": [[0, 0, 0, 0], [255, 255, 0, 0], [177, 52, 235, 0], [0, 255, 255, 0], [255, 165, 0, 0]],
    },
    "Lumen": {
        "line_width": 12,
        "colour": [255, 0, 255, 0],
        "names": ["nolabel", "lumen"],
        "colours": [[0, 0, 0, 0], [131, 235, 52, 0]],
    },
    "Nuclei": {
        "line_width": 3,
        "colour": [0, 255, 0, 1],
        "names": ["nolabel", "neutrophil", "epithelial", "lymphocyte", "plasma", "eosinophil", "connective"],
        "colours": [
            [0, 0, 0, 1],
            [0, 0, 255, 1],
            [0, 255, 0, 1],
            [255, 0, 255, 1],
            [176, 244, 230, 1],
            [0, 191, 255, 1],
            [255, 165, 0, 1],
        ],
    },
}
# Tissue classes
TISSUE_CLASSES = [
    "background",
    "abnormal_epi",
    "normal_epi",
    "inflammatory",
    "muscle",
    "stroma",
    "debris",
    "mucous",
    "adipose",
]
# Colours of exported features (RGB)
FEATURE_COLOURS = {"Nuclei": [0, 255, 0], "Gland": [0, 0, 255], "Lumen": [255, 255, 0]}
OTHER_COLOUR = [128, 128, 128]


def style_table(spark: SparkSession) -> DataFrame:
    """``task, type_id, type_name, colour, line_width``; ``type_id`` -1 is the untyped style."""
    rows = []
    for task, s in STYLES.items():
        rows.append((task, -1, s["names"][1], s["colour"], s["line_width"]))
        rows += [(task, i, n, c, s["line_width"]) for i, (n, c) in enumerate(zip(s["names"], s["colours"]))]
    return spark.createDataFrame(rows, "task string, type_id int, type_name string, colour array<int>, line_width int")


def with_style(instances: DataFrame) -> DataFrame:
    """Style of each instance; untyped instances and unknown types take the task's plain colour.

    The style table is a constant of this module (17 rows), hence the broadcast.
    """
    styles = style_table(instances.sparkSession)
    typed = styles.withColumnRenamed("type_id", "_t")
    plain = styles.where("type_id = -1").select(
        "task", F.col("colour").alias("_c"), F.col("type_name").alias("_n"), F.col("line_width").alias("_w")
    )
    keyed = instances.withColumn("_t", F.coalesce("type_id", F.lit(-1)))
    joined = keyed.join(F.broadcast(typed), ["task", "_t"], "left").join(F.broadcast(plain), "task", "left")
    return joined.withColumns(
        {
            "colour": F.coalesce("colour", "_c"),
            "type_name": F.coalesce("type_name", "_n"),
            "line_width": F.coalesce("line_width", "_w"),
        }
    ).drop("_t", "_c", "_n", "_w")


def feature_colour(task):
    table = F.create_map(*[v for k, c in FEATURE_COLOURS.items() for v in (F.lit(k), F.array(*[F.lit(i) for i in c]))])
    return F.coalesce(table[task], F.array(*[F.lit(i) for i in OTHER_COLOUR]))
