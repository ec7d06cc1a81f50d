"""File listings and dataset manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Slide extensions tried in turn when the requested one matches nothing
FALLBACK_EXTENSIONS = [".svs", ".tif", ".tiff", ".ndpi", ".mrxs", ".scn", "*"]
# Image extensions of the datasets, in order of preference
IMAGE_EXTENSIONS = [".png", ".jpg", ".tif", ".bmp"]
# Codes of the numeric split column
SPLIT_CODES = {"train": "1", "valid": "2", "test": "3"}
# How the column of a split may be named (whole names), the surest first; the second part is what it
# holds for a split, None for the split's own name
SPLIT_HABITS = (
    ("split", None),
    ("Split", SPLIT_CODES),
    ("fold_{fold}", None),
    ("{split}", None),
    ("(?i)(?=.*fold).*_{fold}.*", None),
)


def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """``path, length, dir``; file contents are never read (the content column is pruned)."""
    paths = [paths] if isinstance(paths, str) else paths
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return found.select("path", "length", folder(F.col("path")).alias("dir"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Last suffix with its dot, empty when there is none."""
    return F.regexp_extract(file_name(path), r"(?<=[^.])(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def parse_extensions(spec: str | None) -> list[str]:
    """``"svs, *.tif;.ndpi"`` -> [".svs", ".tif", ".ndpi"]; "*" stands for every file, nothing for slides.

    Each entry is a suffix: what follows its star, with a dot before a bare word.
    """
    suffixes = [re.sub(r"^(?=[^.*])", ".", entry).lstrip("*") for entry in re.findall(r"[^\s,;]+", spec or "")]
    return ["*" if suffix in ("", ".*") else suffix for suffix in suffixes] or FALLBACK_EXTENSIONS[:1]


def has_extension(path: Column, extensions: list[str]) -> Column:
    if "*" in extensions:
        return F.lit(True)
    hit = F.lit(False)
    for ext in extensions:
        hit = hit | F.endswith(path, F.lit(ext))
    return hit


def collect_slides(files: DataFrame, spec: str | None, group: list[str] | None = None, must_find: bool = False) -> DataFrame:
    """Files of the wanted extensions; a single one that matches nothing falls back along the chain.

    With ``group`` the choice is made per folder.  Only one small aggregate (the best rank in use) is
    joined back.  With ``must_find`` a listing that ends up empty is a ``FileNotFoundError``.
    """
    wanted = parse_extensions(spec)
    chain = [wanted] + ([[e] for e in FALLBACK_EXTENSIONS] if len(wanted) == 1 and wanted != ["*"] else [])
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(chain))):
        rank = F.when(has_extension(F.col("path"), chain[i]), F.lit(i)).otherwise(rank)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    keys = group or []
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    # ".tif" is tried before ".tiff": a name counts for the first suffix it ends with
    rated = ranked.join(best, keys) if keys else ranked.join(F.broadcast(best))
    found = rated.where("_rank = _best").drop("_rank", "_best").distinct()
    if must_find and found.isEmpty():
        raise FileNotFoundError(f"no file ends in one of {', '.join(wanted)}")
    return found


def with_masks(slides: DataFrame, masks: DataFrame) -> DataFrame:
    """Attach ``mask_path`` by stem; slides without one go, unless no slide has any."""
    left = slides.withColumn("_stem", stem(F.col("path")))
    right = masks.where(F.endswith(F.col("path"), F.lit(".png"))).select(
        stem(F.col("path")).alias("_stem"), F.col("path").alias("mask_path")
    )
    joined = left.join(right, "_stem", "left").drop("_stem")
    any_mask = joined.agg(F.coalesce(F.max(F.col("mask_path").isNotNull()), F.lit(False)).alias("_any"))
    return joined.join(F.broadcast(any_mask)).where(F.col("mask_path").isNotNull() | ~F.col("_any")).drop("_any")


def first_existing(wanted: DataFrame, files: DataFrame, keys: list[str], extensions: list[str]) -> DataFrame:
    """First file of each wanted name along the extension list: ``wanted`` columns plus ``found``."""
    ext = extension(F.col("path"))
    ranks = F.create_map(*[F.lit(v) for kv in ((e, i) for i, e in enumerate(extensions)) for v in kv])
    offered = files.select(*[k for k in keys if k != "stem"], stem(F.col("path")).alias("stem"), ranks[ext].alias("_r"), "path")
    best = offered.where("_r is not null").groupBy(*keys).agg(F.min(F.struct("_r", "path")).alias("_b"))
    return wanted.join(best, keys).withColumn("found", F.col("_b.path")).drop("_b")


def companion(wanted: DataFrame, files: DataFrame, places: list[tuple[int, str]], suffix: str) -> DataFrame:
    """``wanted`` with ``found``: the first existing companion along ``places``, null if there is none.

    ``wanted(path, ...)`` and ``files(path)``.  A place (n, folder) is that folder n levels above the file's own; the
    companion bears the file's stem with ``suffix``.  Each file asks for as many paths as there are places, so the join is on equal
    paths and nothing is listed twice.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    candidates = [
        F.concat(F.regexp_replace(folder, "(/[^/]*){" + str(up) + "}$", ""), F.lit(f"/{name}/"), stem(F.col("path")), F.lit(suffix)) for up, name in places
    ]
    asked = wanted.select("path", F.posexplode(F.array(*candidates)).alias("place", "found")).distinct()
    best = asked.join(files.select(F.col("path").alias("found")).distinct(), "found", "left_semi").groupBy("path").agg(F.min(F.struct("place", "found")).alias("b"))
    return wanted.join(best, "path", "left").withColumn("found", F.col("b.found")).drop("b")


# ---- manifests -----------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Split table with a header; every column is text, nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema)


def split_mark(columns: list[str], split: str, fold: int) -> tuple[str, str] | None:
    """The column that tells a split and what it says there, by the first of ``SPLIT_HABITS`` that some column follows."""
    for naming, codes in SPLIT_HABITS:
        followed = re.compile(naming.format(split=re.escape(split), fold=fold))
        column = next(filter(followed.fullmatch, columns), None)
        if column is not None:
            return column, (split if codes is None else codes[split])
    return None


def in_split(rows: DataFrame, split: str, fold: int = 0) -> DataFrame:
    """Rows of one split; all rows when no column tells.  A coded column knows only train, valid and test."""
    mark = split_mark(rows.columns, split, fold)
    return rows if mark is None else rows.where(F.lower(F.trim(F.col(mark[0]).cast("string"))) == mark[1])


def file_name_column(rows: DataFrame) -> Column:
    """``filename`` if present, else the first column."""
    return F.col("filename" if "filename" in rows.columns else rows.columns[0])


# Smallest usable image side for segmentation and classification
MIN_SIDE = {"seg": 448, "class": 144}


def big_enough(df: DataFrame, kind: str) -> DataFrame:
    return df.where((F.col("w") >= MIN_SIDE[kind]) & (F.col("h") >= MIN_SIDE[kind]))


def class_images(wanted: DataFrame, files: DataFrame, type_names: list[str]) -> DataFrame:
    """Find each named image flat, else in the first class folder; label by folder, column, or 0.

    ``wanted(stem, label)``, ``files(path, subdir)`` with ``subdir`` null for the flat folder.
    """
    offered = files.select(stem(F.col("path")).alias("stem"), "path", "subdir")
    order = F.struct(F.col("subdir").isNotNull().alias("nested"), F.coalesce("subdir", F.lit("")).alias("s"), "path", "subdir")
    best = offered.groupBy("stem").agg(F.min(order).alias("b"))
    names = F.array(*[F.lit(n) for n in type_names])
    by_folder = F.array_position(names, F.col("b.subdir")) - 1
    label = F.when(F.col("b.subdir").isNotNull(), F.greatest(by_folder, F.lit(0))).otherwise(F.coalesce(F.col("label"), F.lit(0)))
    return wanted.join(best, "stem").select("stem", F.col("b.path").alias("path"), label.cast("int").alias("label"))


def channel_keys(catalogue: DataFrame, channels: list[str]) -> DataFrame:
    """Array serving each annotation channel: first key in sorted order containing its name.

    ``catalogue(path, key, h, w)``; arrays of at most ten rows or columns are metadata.
    """
    maps = catalogue.where((F.col("h") > 10) & (F.col("w") > 10))
    wanted = catalogue.select("path").distinct().select("path", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    hits = maps.select("path", "key", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel")).where(
        F.contains(F.lower("key"), F.lower("channel"))
    )
    best = hits.groupBy("path", "channel").agg(F.min("key").alias("key"))
    return wanted.join(best, ["path", "channel"], "left")
