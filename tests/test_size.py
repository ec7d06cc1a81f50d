"""Work that has to be spread, packed or done for many small images at once."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import contours, ranking
from tessera.operators import morphology as mo
from tessera.operators import segmentation_scores as ss
from tessera.operators import stencil
from tessera.operators.pruning import attach_slide_size, tile_sets_meeting
from tessera.operators.runs import to_runs
from tessera.operators.stitch import stitch_on_grid
from tessera.operators.tiling import centred_patches, tile_pitch, tile_sets
from tessera.session import ship_package
from tessera.sources import exports, raster_store
from tessera.streaming import jobs


@pytest.fixture
def plain(spark):
    """Without the adaptive planner, which merges the small partitions of a test."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("code", ["IP-ERODED-3", "IP-ERODED-CONTOUR-3"])
def test_targets_of_one_image_are_made_in_several_tasks(plain, code):
    cells = [(1, 10 * j + i, 1, 6 * i + a, 6 * j + b) for i in range(10) for j in range(20) for a in range(5) for b in range(5)]
    px = plain.createDataFrame(cells, "image_id int, inst_id int, cls int, x int, y int")
    frames = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    made = mo.target_map(code, px, frames)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert made.count() == made.select("image_id", "x", "y").distinct().count()


def test_small_images_share_a_kernel_call():
    rows = [(i, 0, 0, x, y, i + x * y) for i in range(300) for y in range(4) for x in range(3 + i % 3)]
    whole = pd.DataFrame(rows, columns=["image_id", "_by", "_bx", "x", "y", "v"])
    calls = []

    def kernel(grids, there, radius):
        calls.append(there.shape)
        return stencil.binomial(grids, there, radius)

    run = stencil._run(["v"], 1, kernel, ["b"], False, 256)
    got = pd.concat(run(iter([whole[:1000], whole[1000:]])))
    assert len(got) == len(rows) and len(calls) < 10
    alone = pd.concat(pd.concat(run(iter([part]))) for _, part in whole.groupby("image_id"))
    assert sorted(map(tuple, got[["image_id", "x", "y", "b"]].to_numpy())) == sorted(map(tuple, alone[["image_id", "x", "y", "b"]].to_numpy()))


def test_contours_are_moved_once(spark):
    rows = spark.sql("select 1 slide_id, 'Gland' task, cast(id - 1 as double) scale, transform(sequence(1, id), i -> struct(cast(i * i as int) as x, cast(i as int) as y)) contour from range(3, 9)")
    made = exports.features(rows)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("* scale") <= 2  # x and y
    assert [(r.ring[0], len(r.ring)) for r in made.limit(1).collect()] == [((2.0, 2.0), 4)]


def test_packed_rasters_have_no_folder_per_image(spark, tmp_path):
    px = spark.range(40 * 64).select((F.col("id") % 40).cast("int").alias("image_id"), F.floor(F.col("id") / 320).cast("int").alias("x"), F.floor(F.col("id") / 40 % 8).cast("int").alias("y"), F.col("id").cast("int").alias("v"))
    asked = px.select("image_id").distinct().select("image_id", *[F.lit(v).alias(c) for c, v in (("x0", 1), ("y0", 2), ("w", 3), ("h", 4))])
    folder, packed = str(tmp_path / "folder"), str(tmp_path / "packed")
    raster_store.write_raster(px, folder)
    raster_store.write_packed(px, packed)
    rows = lambda path: sorted((r.image_id, r.x, r.y, r.v) for r in raster_store.read_windows(spark, path, asked, 1.0, 1).collect())
    assert rows(packed) == rows(folder) and len(rows(packed)) == 40 * 12
    assert not [p for p in (tmp_path / "packed").iterdir() if p.is_dir()]


def test_packed_stitch_writes_a_folder_per_batch(spark, fx, tmp_path):
    ship_package(spark)
    base = str(tmp_path)
    fx["fx_det"].write.parquet(f"{base}/detections")
    tiles = fx["fx_tiles"].select("slide_id", "mode", "c", "r").cache()
    layout = tiles.groupBy("slide_id").agg(F.count("*").alias("n_tiles"))
    slow = fx["fx_det"].agg(F.min("slide_id")).first()[0]
    held = (F.col("slide_id") == slow) & (F.col("mode") == 0) & (F.col("c") == 0) & (F.col("r") == 0)
    out = f"{base}/out"

    def arrive(rows, second):
        rows.withColumn("done_at", F.timestamp_seconds(F.lit(1_700_000_000 + second))).write.mode("append").parquet(f"{base}/arrivals")
        jobs.settle(jobs.stitch_arriving_slides(spark, f"{base}/detections", f"{base}/arrivals", fx["fx_slides"], layout, out, f"{base}/state", tile_pitch(), packed=True))

    late = lambda: {r.late for r in jobs.latest_stitched(spark, out).where(F.col("slide_id") == slow).select("late").distinct().collect()}
    arrive(tiles.where(~held), 0)
    assert late() == set()
    arrive(tiles.where(~held).limit(1), 3 * 3600)  # time passes
    assert late() == {True}
    arrive(tiles.where(held), 4 * 3600)
    assert late() == {False}
    want = stitch_on_grid(attach_slide_size(fx["fx_det"], fx["fx_slides"]), tile_pitch()).select("slide_id", "mode", "c", "r", "inst_id", "gx0", "gy0")
    got = jobs.latest_stitched(spark, out).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert all(p.name.startswith(("batch=", "_", ".")) for p in (tmp_path / "out").iterdir())


def test_pixels_of_cells_are_made_in_several_tasks(plain, fx):
    made = fx["fx_true_px"].select(F.spark_partition_id().alias("p"), "image_id", "inst_id").distinct()
    assert made.select("p").distinct().count() > 1
    assert made.count() == made.select("image_id", "inst_id").distinct().count()  # a cell stays in one task


def test_match_counts_read_pixels_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(1, 7, 1, x, y) for x in range(4) for y in range(4)]
    px = spark.createDataFrame(rows, "image_id int, inst_id int, cls int, x int, y int")
    got = ss.match_counts(px.mapInArrow(seen, px.schema), px.withColumn("inst_id", F.lit(9))).collect()
    assert [(r.tp, r.fp, r.fn, r.iou_sum) for r in got] == [(1, 0, 0, 1.0)]
    assert read.value == len(rows)


def test_frames_need_one_exchange(plain, fx):
    """An aggregate, the cross and the runs of a frame are made where its line items were dealt to."""
    made = to_runs(fx["fx_dil"], ["image_id"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    text = fx.made("fx_dil")
    assert fx["fx_dil"].count() == text.count() and fx["fx_dil"].exceptAll(text).count() == 0
    assert fx["fx_blob"].exceptAll(fx.made("fx_blob")).count() == 0 and fx["fx_dil"].dtypes == text.dtypes


def test_overlapping_patches_are_summed_where_they_are_made(plain):
    slide = plain.createDataFrame([(1, 144 * 320, 144 * 4)], "slide_id int, proc_w int, proc_h int")
    made = centred_patches(slide).select("c", "r", F.spark_partition_id().alias("p"))
    assert made.count() == made.select("c", "r").distinct().count() == 320 * 4
    assert made.select("p").distinct().count() > 1  # one slide is still made by many tasks
    at = {r.c: r.p for r in made.collect()}
    assert sum(at[c] != at[c + 1] for c in range(319)) <= 19  # neighbours part at the end of a band only


def test_documents_are_cut_without_a_join(plain):
    rows = plain.range(950).select((F.col("id") % 2).alias("slide_id"), F.col("id").alias("seq"), F.lit("{}").alias("element"))
    made = exports.viewer_documents(rows, "a", 100)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.slide_id, r.part, r.elements) for r in made.collect()) == [(s, p, 100 if p < 5 else 75) for s in (0, 1) for p in range(1, 6)]


def test_small_pieces_are_traced_together(monkeypatch):
    rows = [(i, 0, 0, y, 0, 3 + i % 3) for i in range(300) for y in range(4)]
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["image_id", "_by", "_bx", "y", "x0", "x1"]).astype("int32"))
    calls, whole = [], contours.half_edges
    monkeypatch.setattr(contours, "half_edges", lambda *a: calls.append(1) or whole(*a))
    made = [r for b in contours._trace(["image_id"], 512, True)(iter([batch[:501], batch[501:]])) for r in b.to_pylist()]
    assert [(r["image_id"], [(p["x"], p["y"]) for p in r["points"]]) for r in made] == [(i, [(0, 0), (3 + i % 3, 0), (3 + i % 3, 3), (0, 3)]) for i in range(300)]
    assert len(calls) < 5


def test_instances_are_aggregated_behind_the_exchange(plain, fx):
    plan = fx["fx_inst"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Aggregate(") < plan.index("Exchange hashpartitioning")
    assert fx["fx_inst"].exceptAll(fx.made("fx_inst")).count() == 0 and fx["fx_inst"].count() == fx.made("fx_inst").count()


def test_boxes_name_their_tiles_where_they_are(plain, fx):
    def rows_sent(df):
        plan = df._jdf.queryExecution().executedPlan()
        df.write.format("noop").mode("overwrite").save()
        sent, todo = 0, [plan]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                sent += node.metrics().apply("shuffleRecordsWritten").value()
        return sent

    from tessera.plans.placement import tiles_with_patches

    assert rows_sent(tiles_with_patches(fx)) < fx["fx_mask_px"].count() / 10


def test_tiles_that_touch_boxes(spark):
    slides = spark.createDataFrame([(1, 9000, 7000), (2, 4032, 4033), (3, 300, 12200)], "slide_id int, proc_w int, proc_h int")
    edges = [0, 1, 100, 3903, 3904, 3967, 3968, 4032, 4096, 4097, 4160, 4161, 8063, 8064, 8128, 8192, 8193, 9500]
    boxes = [(s, x, y, x + w, y + h) for s in (1, 2, 3) for x in edges for y in edges for w, h in ((0, 0), (64, 3), (4200, 1))]
    tiles = [tuple(r) for r in tile_sets(slides).select("slide_id", "mode", "c", "r", "x0", "y0", "x1", "y1").collect()]
    for part in [[b] for b in boxes[::37]] + [boxes]:
        made = spark.createDataFrame(part, "slide_id int, x_min int, y_min int, x_max int, y_max int")
        want = {t[:4] for t in tiles if any(b[0] == t[0] and b[1] <= t[6] and b[3] >= t[4] and b[2] <= t[7] and b[4] >= t[5] for b in part)}
        got = [tuple(r) for r in tile_sets_meeting(slides, made).select("slide_id", "mode", "c", "r").collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limit", [0, 10**6])
def test_places_of_spaced_rows_are_no_table(spark, monkeypatch, limit):
    """The places of all keys together were a table, ``most`` rows a key, that Spark sent whole through the driver."""
    monkeypatch.setattr(ranking, "WINDOW_ROWS", limit)
    rows = [(k, (i * 7919) % 1009) for k, n in enumerate((1, 6, 7, 8, 13, 49, 50, 99, 100, 1000)) for i in range(n)]
    rows += [(None, i) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, o int")
    for most in (1, 7, 49, 60):
        made = ranking.evenly_spaced(df, ["k"], ["o"], most)
        want = []
        for k in [None, *range(10)]:
            own = sorted(o for key, o in rows if key == k)
            want += [(k, o) for o in (own if len(own) <= most else [own[int(i * (len(own) / most))] for i in range(most)])]
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
        assert "LeftSemi" not in made._jdf.queryExecution().optimizedPlan().toString()
