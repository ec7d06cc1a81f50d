"""Sources, sinks and registries."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, corners
from tessera.functions.losses import loss, total_loss
from tessera.functions.morton import morton, ranges
from tessera.operators.morphology import POSTPROCESS, TARGETS, postprocess, target_map
from tessera.operators.segmentation_scores import dice, match_counts, mean_pq, panoptic_quality, typed_instances
from tessera.sources import box_tree, exports, listing, raster_store, store


def instances(fx):
    box = Box.of()
    return fx["fx_inst"].select(
        "slide_id",
        "task",
        F.sha2(F.col("inst_id").cast("string"), 256).alias("inst_uid"),
        "x_min",
        "y_min",
        "x_max",
        "y_max",
        ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"),
        ((F.col("y_min") + F.col("y_max")) / 2).alias("cy"),
        corners(box).alias("contour"),
        "type_id",
        F.lit(1.0).alias("type_prob"),
        box.area.alias("area"),
    )


def test_store_round_trip(spark, fx, tmp_path):
    path = str(tmp_path / "store")
    rows = instances(fx)
    store.write_instances(rows, path)
    store.write_slides(fx["fx_slides"], path)
    back = store.read_instances(spark, path)
    assert back.count() == rows.count()
    one = store.read_instances(spark, path, slides=[3], tasks=["Gland", "Organoid"])
    assert one.count() == rows.where("slide_id = 3 and task = 'Gland'").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slide_id" in plan or "PartitionFilters: [isnotnull(slide_id" in plan
    # rewriting one task of one slide leaves everything else alone
    store.write_instances(rows.where("slide_id = 3 and task = 'Gland'").limit(5), path)
    assert store.read_instances(spark, path, slides=[3], tasks=["Gland"]).count() == 5
    others = "slide_id = 3 and task <> 'Gland'"
    assert store.read_instances(spark, path).where(others).count() == rows.where(others).count()
    assert store.read_instances(spark, path).where("slide_id <> 3").count() == rows.where("slide_id <> 3").count()
    assert store.read_slides(spark, path).count() == fx["fx_slides"].count()


def test_image_outputs(spark, fx, tmp_path):
    path = str(tmp_path / "images")
    px = fx["fx_patchwork"]
    typed = px.groupBy("image_id", "inst_id").agg(F.max(F.when((F.col("v") > 30) & (F.col("inst_id") != 3), F.col("cls"))).alias("type_id"))
    store.write_image_outputs(path, instance_map=px.select("image_id", "x", "y", "inst_id"), instances=store.image_outputs(typed))
    back = spark.read.parquet(f"{path}/instances")
    assert back.where("type_id is null").count() == 0
    assert back.where("type_id = -1").count() == typed.where("type_id is null").count() > 0
    assert spark.read.parquet(f"{path}/instance_map").count() == px.count()


def rows_scanned(df):
    """Rows that the scan hands on after partitions and row groups are skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_windows_skip_row_groups(spark, tmp_path):
    """A 1000 x 600 image in small row groups beside another one: the reader touches the patch of the window only."""
    path = str(tmp_path / "raster")
    ids = spark.range(600_000)
    px = ids.select(F.lit(1).alias("image_id"), (F.col("id") % 1000).cast("int").alias("x"), F.floor(F.col("id") / 1000).cast("int").alias("y"))
    px = px.withColumns({"r": ((F.col("x") * 7 + F.col("y") * 13) % 256).cast("int"), "alpha": F.lit(255)})
    other = px.where("x < 50 and y < 50").withColumn("image_id", F.lit(2))
    raster_store.write_raster(px.unionByName(other), path, levels=3, group_bytes=1 << 16)
    window = raster_store.read_window(spark, path, 1, 300, 200, 90, 70)
    assert window.columns == ["image_id", "x", "y", "r"]
    assert {(r.x, r.y): r.r for r in window.collect()} == {(x, y): (x * 7 + y * 13) % 256 for x in range(300, 390) for y in range(200, 270)}
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_id" in plan and "alpha" not in plan.split("ReadSchema")[1]
    everything = spark.read.parquet(path).where("image_id = 1").count()
    assert 90 * 70 <= rows_scanned(window) < everything / 5
    # a new image leaves the others alone, and the one-image folder holds every level
    raster_store.write_raster(px.where("x < 9 and y < 9").withColumn("image_id", F.lit(3)), path)
    assert spark.read.parquet(path).where("image_id = 1").count() == everything
    assert {r.level for r in spark.read.parquet(path).where("image_id = 1").select("level").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("factor", [0.4, 1.0, 1.3, 2.0, 3.0, 7.5])
def test_windows_at_a_resolution(spark, tmp_path, factor):
    path, w, h = str(tmp_path / "raster"), 90, 70
    value = {(x, y): (x * x + 3 * y) % 251 for x in range(w) for y in range(h)}
    raster_store.write_raster(spark.createDataFrame([(4, x, y, v) for (x, y), v in value.items()], "image_id int, x int, y int, v int"), path, levels=3)
    levels = [value]
    for _ in range(2):
        parts = {}
        for (x, y), v in levels[-1].items():
            parts.setdefault((x // 2, y // 2), []).append(v)
        levels.append({k: sum(v) // len(v) for k, v in parts.items()})
    level = 0 if factor < 2 else 1 if factor < 4 else 2
    step = factor / 2**level
    want = {}
    for x in range(3, 23):
        for y in range(2, 17):
            source = levels[level].get((int((x + 0.5) * step), int((y + 0.5) * step)))
            if source is not None:
                want[x, y] = source
    got = raster_store.read_at(spark, path, 4, 3, 2, 20, 15, factor, 3)
    assert {(r.x, r.y): r.v for r in got.collect()} == want and got.count() == len(want)
    asked = spark.createDataFrame([(4, 3, 2, 20, 15), (9, 0, 0, 5, 5)], "image_id int, x0 int, y0 int, w int, h int")
    assert {(r.x, r.y): r.v for r in raster_store.read_windows(spark, path, asked, factor, 3).collect()} == want


def test_morton_ranges(spark):
    cells = [(x, y) for x in range(40) for y in range(40)]
    keyed = spark.createDataFrame(cells, "x int, y int").select("x", "y", morton(F.col("x"), F.col("y")).alias("z")).collect()
    key = {(r.x, r.y): r.z for r in keyed}
    assert sorted(key.values())[-1] == max(key.values()) and len(set(key.values())) == 1600 and key[3, 5] == 0b100111
    for window in ((0, 0, 0, 0), (3, 5, 17, 9), (31, 0, 32, 39), (0, 0, 39, 39)):
        for most in (1, 4, 500):
            parts = ranges(*window, most)
            assert len(parts) <= most
            inside = {c for c in cells if any(a <= key[c] <= b for a, b in parts)}
            want = {(x, y) for x, y in cells if window[0] <= x <= window[2] and window[1] <= y <= window[3]}
            assert want <= inside and (most < 500 or want == inside)


def test_box_tree_skips_files(spark, fx, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr(box_tree, "FANOUT", 3)  # several levels
    rows = instances(fx).where("slide_id < 4")
    store.write_instances(rows, path, rows_per_file=20)
    box_tree.build(spark, path)
    files = store.read_instances(spark, path).select(F.col("_metadata.file_path").alias("f")).distinct().count()
    tree = spark.read.parquet(f"{path}/boxes")
    assert tree.where("depth = 0").count() == files and tree.agg(F.max("depth")).first()[0] >= 2
    regions = spark.createDataFrame([(1, 500, 500, 2500, 2500), (3, 0, 0, 900, 900), (77, 0, 0, 9, 9)], "slide_id int, x_min int, y_min int, x_max int, y_max int")
    for tasks in (None, ["Nuclei"], ["Organoid"]):
        hit = box_tree.files_of(spark, path, regions, tasks).count()
        assert hit < files / 2
        got = sorted(r.inst_uid for r in box_tree.read_regions(spark, path, regions, tasks).collect())
        near = rows.join(regions.select("slide_id", *[F.col(c).alias("q_" + c) for c in ("x_min", "y_min", "x_max", "y_max")]), "slide_id")
        near = near.where("x_max >= q_x_min and x_min <= q_x_max and y_max >= q_y_min and y_min <= q_y_max")
        near = near.where(F.col("task").isin(tasks)) if tasks else near
        assert got == sorted(r.inst_uid for r in near.collect()) and (bool(got) == (tasks != ["Organoid"]))
    monkeypatch.setattr(box_tree, "MOST_FILES", 0)  # too many to name: the folders are scanned
    assert box_tree.read_regions(spark, path, regions).count() > 0


def test_packed_store_has_no_folder_per_slide(spark, fx, tmp_path):
    rows = instances(fx)
    store.write_packed(rows, str(tmp_path), rows_per_file=500)
    box_tree.build(spark, str(tmp_path))
    assert not [p for p in (tmp_path / "instances").iterdir() if p.is_dir()]
    regions = spark.createDataFrame([(1, 500, 500, 2500, 2500), (3, 0, 0, 900, 900), (77, 0, 0, 9, 9)], "slide_id int, x_min int, y_min int, x_max int, y_max int")
    for tasks in (None, ["Nuclei"]):
        got = sorted(r.inst_uid for r in box_tree.read_regions(spark, str(tmp_path), regions, tasks).collect())
        near = rows.join(regions.select("slide_id", *[F.col(c).alias("q_" + c) for c in ("x_min", "y_min", "x_max", "y_max")]), "slide_id")
        near = near.where("x_max >= q_x_min and x_min <= q_x_max and y_max >= q_y_min and y_min <= q_y_max")
        near = near.where(F.col("task").isin(tasks)) if tasks else near
        assert got and got == sorted(r.inst_uid for r in near.collect())


def test_listing(spark, tmp_path):
    for name in ("a/one.svs", "a/two.tif", "b/three.tiff", "b/.hidden", "b/four.x.svs"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    files = listing.list_files(spark, str(tmp_path), recursive=True)
    names = lambda df: sorted(r[0].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(listing.collect_slides(files, "*.svs")) == ["four.x.svs", "one.svs"]
    assert names(listing.collect_slides(files, "ndpi")) == ["four.x.svs", "one.svs"]
    assert names(listing.collect_slides(files, ".tiff;tif")) == ["three.tiff", "two.tif"]
    stems = {r[0] for r in files.select(listing.stem(F.col("path"))).collect()}
    assert {"one", "four.x"} <= stems
    assert listing.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).select("dir").distinct().count() == 2


def test_parse_extensions():
    assert listing.parse_extensions("svs, *.tif;.ndpi") == [".svs", ".tif", ".ndpi"]
    assert listing.parse_extensions("*.*") == ["*"]
    assert listing.parse_extensions(None) == [".svs"]
    assert listing.parse_extensions(" , ") == [".svs"]
    assert listing.parse_extensions("tif *") == [".tif", "*"]


def test_split_columns():
    for columns, want in {
        ("a", "fold_1", "split"): ("split", "valid"),
        ("Split", "fold_1"): ("Split", "2"),
        ("My_Fold_1", "fold_1"): ("fold_1", "valid"),
        ("fold_2", "valid"): ("valid", "valid"),
        ("x", "My_Fold_1"): ("My_Fold_1", "valid"),
        ("x", "fold_2"): None,
    }.items():
        assert listing.split_mark(list(columns), "valid", 1) == want


def test_empty_listing_is_an_error(spark):
    files = spark.createDataFrame([("/a/b.svs",), ("/a/c.txt",)], "path string")
    assert listing.collect_slides(files, "svs", must_find=True).count() == 1
    with pytest.raises(FileNotFoundError):
        listing.collect_slides(files, "png;jpg", must_find=True)


def test_manifest(spark, tmp_path):
    path = tmp_path / "info.csv"
    path.write_text("name,Split,label\na,1,3\nb,2,0\nc,3,1\n")
    rows = listing.read_manifest(spark, str(path), ["name", "Split", "label"])
    assert [r.name for r in listing.in_split(rows, "valid").collect()] == ["b"]
    assert [r[0] for r in listing.in_split(rows, "test").select(listing.file_name_column(rows)).collect()] == ["c"]


def test_geojson_files(spark, fx, tmp_path):
    rows = fx["fx_inst"].withColumn("contour", corners(Box.of())).withColumn("scale", F.lit(2.0))
    parted = exports.in_parts(exports.features(rows), ["inst_id"], 100)
    assert parted.groupBy("slide_id", "file_name").count().agg(F.max("count")).first()[0] <= 100
    path = str(tmp_path / "out")
    exports.write_geojson(parted, path)
    assert spark.read.text(path).count() == rows.count()
    text = exports.collections(parted).first()
    assert len(json.loads(text["text"])["features"]) == text["features"]


def test_registries(spark, fx):
    assert set(TARGETS) == {"IP", "IP-ERODED-3", "IP-ERODED-11", "IP-ERODED-CONTOUR-3", "IP-ERODED-CONTOUR-11", "NP", "TP", "PC"}
    for call in (lambda: target_map("XX", None, None), lambda: postprocess("bone", None, None), lambda: loss("hinge"), lambda: total_loss(None, {"Bone-INST": {}})):
        with pytest.raises(KeyError):
            call()
    assert set(POSTPROCESS) == {"gland", "lumen", "nuclei"}
    frames = fx["fx_true_px"].groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    grown = postprocess("nuclei", fx["fx_true_px"], frames)
    assert grown.count() > fx["fx_true_px"].count()


def test_scores_of_a_perfect_prediction(spark, fx):
    true = fx["fx_true_px"]
    counts = match_counts(typed_instances(true), true)
    row = mean_pq(counts).first()
    assert row.mpq == pytest.approx(1.0)
    assert all(r.pq == pytest.approx(r.sq * r.rq) == pytest.approx(1.0) for r in panoptic_quality(counts).collect())
    images = spark.createDataFrame([(0,), (999,)], "image_id int")
    assert {r.image_id: r.dice for r in dice(true, true, images).collect()} == {0: pytest.approx(1.0), 999: 0.0}
