"""GeoJSON, nested JSON and viewer annotations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import close_ring, move_points, truncate_points, valid_ring
from tessera.operators.ranking import part_numbers, parts_only
from tessera.sources.styles import feature_colour, with_style

# Exported tasks and the usual part size
EXPORTED_TASKS = ["Nuclei", "Gland", "Lumen"]
PART_SIZE = 30000

FEATURE_SCHEMA = (
    "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
    "properties struct<objectType: string, classification: struct<name: string, color: array<int>>>"
)


def features(instances: DataFrame, digits: int | None = None) -> DataFrame:
    """One polygon feature per instance in base resolution: adds ``ring`` and ``feature`` (JSON text).

    ``instances(slide_id, task, contour, scale, ...)``; task names match whatever their case, contours
    of fewer than three points are skipped, rings are closed.
    """
    task = F.initcap("task")
    kept = instances.withColumn("task", task).where(F.col("task").isin(EXPORTED_TASKS) & (F.size("contour") >= 3))
    # as a column of its own the moved contour is made once, not once for every mention of it in close_ring
    kept = kept.withColumn("_moved", move_points(F.col("contour"), F.col("scale")))
    ring = close_ring(F.col("_moved"))
    place = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
    points = F.transform("ring", lambda p: F.array(place(p["x"]), place(p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"),
        F.struct(
            F.lit("annotation").alias("objectType"),
            F.struct(F.col("task").alias("name"), feature_colour(F.col("task")).alias("color")).alias("classification"),
        ).alias("properties"),
    )
    return kept.withColumn("ring", ring).drop("_moved").withColumn("feature", F.to_json(feature))


def in_parts(rows: DataFrame, order: list, size: int = PART_SIZE) -> DataFrame:
    """Part number and file name of each row: a slide above ``size`` rows is cut into equal parts."""
    cut = part_numbers(rows, ["slide_id"], order, size)
    name = F.when(F.col("parts") > 1, F.format_string("%d_part%dof%d.geojson", "slide_id", "part", "parts")).otherwise(
        F.format_string("%d.geojson", "slide_id")
    )
    return cut.withColumn("file_name", name)


def collections(parted: DataFrame) -> DataFrame:
    """One FeatureCollection per part; a part holds at most the part size, so the list is bounded."""
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inst_id", "feature"))), lambda f: f["feature"]), ","),
        F.lit("]}"),
    )
    return parted.groupBy("slide_id", "file_name").agg(F.count("*").alias("features"), text.alias("text"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """Feature lines, one folder per output file name."""
    rows.select("file_name", F.col("feature").alias("value")).repartition("file_name").write.mode("overwrite").partitionBy(
        "file_name"
    ).text(path)


def parse_features(lines: DataFrame, column: str = "feature") -> DataFrame:
    """GeoJSON text back to rows; unreadable text gives nulls."""
    parsed = lines.withColumn("_f", F.from_json(column, FEATURE_SCHEMA))
    ring = F.transform(F.col("_f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return parsed.withColumns(
        {"object_type": F.col("_f.properties.objectType"), "class_name": F.col("_f.properties.classification.name"), "ring": ring}
    ).drop("_f")


def is_valid(ring: Column, object_type: Column, class_name: Column) -> Column:
    """Structural rules for a polygon a viewer can take: closed finite ring with an area, object and class named."""
    return F.coalesce(valid_ring(ring) & object_type.isNotNull() & class_name.isNotNull(), F.lit(False))


def clean_counts(parsed: DataFrame, by: list[str]) -> DataFrame:
    good = is_valid(F.col("ring"), F.col("object_type"), F.col("class_name"))
    return parsed.groupBy(*by).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def nested_json(instances: DataFrame, mag: float, record: list[str], size: int = PART_SIZE) -> DataFrame:
    """``{"mag", "instances": {task: {id: record}}}`` per slide part of at most ``size`` instances."""
    cut = parts_only(instances, ["slide_id"], ["task", "inst_id"], size)
    entry = F.struct(F.col("inst_id").cast("string").alias("key"), F.struct(*record).alias("value"))
    per_task = cut.groupBy("slide_id", "part", "task").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    tasks = per_task.groupBy("slide_id", "part").agg(
        F.map_from_entries(F.collect_list(F.struct("task", "m"))).alias("instances")
    )
    return tasks.select("slide_id", "part", F.to_json(F.struct(F.lit(mag).alias("mag"), "instances")).alias("text"))


def viewer_annotations(instances: DataFrame, mode: str, scale: float = 1.0) -> DataFrame:
    """Element text of each instance for a web viewer: a point, or a closed polyline with raised coordinates.

    ``instances(seq, task, type_id, contour, cx, cy)``; ``seq`` numbers the elements of a slide.
    """
    styled = with_style(instances)
    c = F.col("colour")
    rgba = F.format_string("rgba(%d,%d,%d,%d)", c[0], c[1], c[2], c[3])
    common = [
        rgba.alias("fillColor"),
        F.lpad(F.col("seq").cast("string"), 24, "0").alias("id"),
        F.struct(F.lit("nuclei").alias("value")).alias("label"),
        F.col("type_name").alias("group"),
    ]
    if mode == "centroid":
        whole = lambda v: F.floor(F.col(v) * scale).cast("int")
        shape = [
            F.lit("rgb(0, 0, 0)").alias("lineColor"),
            F.lit("point").alias("type"),
            F.array(whole("cx"), whole("cy"), F.lit(0)).alias("center"),
        ]
    else:
        up = lambda v: F.ceil(v * scale).cast("int")
        shape = [
            F.format_string("rgb(%d,%d,%d)", c[0], c[1], c[2]).alias("lineColor"),
            F.lit("polyline").alias("type"),
            F.lit(True).alias("closed"),
            F.transform("contour", lambda p: F.array(up(p["x"]), up(p["y"]), F.lit(0))).alias("points"),
        ]
    element = F.to_json(F.struct(*common, *shape, F.col("line_width").alias("lineWidth")))
    return styled.withColumn("element", element)


def viewer_documents(elements: DataFrame, annotator: str = "", size: int = 30_000) -> DataFrame:
    """``slide_id, part, elements, document``: a viewer's annotation documents of at most ``size`` elements.

    ``elements(slide_id, seq, element)`` come in the order of ``seq``; a slide with more is cut into parts, so
    that no row grows with it.
    """
    parted = parts_only(elements.select("slide_id", "seq", "element"), ["slide_id"], ["seq"], size)
    listed = parted.groupBy("slide_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "element"))).alias("e"))
    text = F.array_join(F.transform("e", lambda e: e["element"]), ",")
    head, tail = '{"annotation":{"description":"","elements":[', '],"name":' + json.dumps(annotator) + "}}"
    return listed.select("slide_id", "part", F.size("e").alias("elements"), F.concat(F.lit(head), text, F.lit(tail)).alias("document"))


def overlay_lines(instances: DataFrame, x: int, y: int, w: int, h: int, scale: float) -> DataFrame:
    """Polylines of the instances meeting a region, in region coordinates, coloured by class."""
    xs, ys = F.transform("contour", lambda p: p["x"]), F.transform("contour", lambda p: p["y"])
    near = (
        (F.array_max(xs) >= x) & (F.array_min(xs) <= x + w) & (F.array_max(ys) >= y) & (F.array_min(ys) <= y + h)
    )
    line = truncate_points(move_points(F.col("contour"), scale, -x, -y))
    return with_style(instances.where(near)).withColumn("line", line)
