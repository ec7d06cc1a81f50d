"""Streams that stop, go on, repeat themselves and come late."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import segmentation_scores as ss
from tessera.operators.pruning import attach_slide_size
from tessera.operators.stitch import stitch_on_grid
from tessera.operators.tiling import tile_pitch
from tessera.plans.fixtures import Fixtures
from tessera.plans.scoring import head_pixels
from tessera.session import ship_package
from tessera.streaming import jobs


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def forget_last_commit(state):
    """As if the driver had died before it could note that the last batch was done."""
    last = max((n for n in os.listdir(f"{state}/commits") if n.isdigit()), key=int)
    os.remove(f"{state}/commits/{last}")
    crc = f"{state}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_slides_are_stitched_when_their_tiles_have_arrived(spark, fx, tmp_path):
    base = str(tmp_path)
    fx["fx_det"].write.partitionBy("slide_id").parquet(f"{base}/detections")
    tiles = fx["fx_tiles"].select("slide_id", "mode", "c", "r").cache()
    layout = tiles.groupBy("slide_id").agg(F.count("*").alias("n_tiles"))
    slides = sorted(r.slide_id for r in layout.collect())
    slow = slides[0]
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    missing = (F.col("slide_id") == slow) & (F.col("mode") == 0) & (F.col("c") == 0) & (F.col("r") == 0)

    def arrive(rows, seconds):
        rows.select("slide_id", "mode", "c", "r", at(seconds).alias("done_at")).write.mode("append").parquet(f"{base}/arrivals")
        run()

    def run():
        jobs.settle(
            jobs.stitch_arriving_slides(
                spark, f"{base}/detections", f"{base}/arrivals", fx["fx_slides"], layout, f"{base}/out", f"{base}/state", tile_pitch(), patience="1 hour"
            )
        )

    def out():
        return spark.read.parquet(f"{base}/out") if os.path.exists(f"{base}/out") else None

    def state_of():
        rows = out().select("slide_id", "late").distinct().collect()
        return {r.slide_id: r.late for r in rows}

    half = F.pmod(F.hash("slide_id", "mode", "c", "r"), F.lit(2)) == 0
    arrive(tiles.where(half & ~missing), 0)
    complete_so_far = {r.slide_id for r in tiles.groupBy("slide_id").agg(F.min((half & ~missing).cast("int")).alias("all")).where("all = 1").collect()}
    assert (set(state_of()) if out() else set()) == complete_so_far
    # the rest, some of it for the second time; the slow slide still lacks a tile
    arrive(tiles.where(~missing), 60)
    with_rows = {r.slide_id for r in fx["fx_det"].select("slide_id").distinct().collect()}
    assert state_of() == {s: False for s in slides if s != slow and s in with_rows}
    forget_last_commit(f"{base}/state")
    run()
    assert state_of() == {s: False for s in slides if s != slow and s in with_rows}
    # time passes on another slide: the slow one is given up for late, once
    arrive(tiles.where(F.col("slide_id") == slides[1]).limit(1), 3 * 3600)
    assert state_of()[slow] is True
    # and is done again when its last tile comes
    arrive(tiles.where(missing), 4 * 3600)
    assert state_of() == {s: False for s in with_rows}
    want = stitch_on_grid(attach_slide_size(fx["fx_det"], fx["fx_slides"]), tile_pitch()).select("slide_id", "mode", "c", "r", "inst_id", "gx0", "gy0")
    got = out().select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert jobs._PROVIDER not in str(spark.conf.get(jobs._PROVIDER)) and spark.conf.get(jobs._PROVIDER) != jobs.ROCKSDB


def test_running_counts_survive_a_restart(spark, fx, tmp_path):
    base = str(tmp_path)
    embeddings = fx["embeddings"]
    parts = [embeddings.where(F.col("vec_id") % 3 == k).coalesce(1) for k in range(3)]

    def run():
        live = Fixtures(spark, fx.sf_dir)
        live._made["embeddings"] = jobs.arriving_tables(spark, f"{base}/in", files_at_once=1)
        jobs.settle(jobs.running_contingency(head_pixels(live), f"{base}/counts", f"{base}/state"))

    def rows(df):
        return sorted(tuple(r) for r in ss.accumulators(df).collect())

    def batch(upto):
        whole = Fixtures(spark, fx.sf_dir)
        whole._made["embeddings"] = embeddings.where(F.col("vec_id") % 3 < upto)
        return rows(ss.contingency(head_pixels(whole)))

    assert jobs.latest_contingency(spark, f"{base}/counts").count() == 0
    for part in parts[:2]:
        part.write.mode("append").parquet(f"{base}/in")
    run()
    assert rows(jobs.latest_contingency(spark, f"{base}/counts")) == batch(2)
    forget_last_commit(f"{base}/state")  # the last batch is merged again
    run()
    assert rows(jobs.latest_contingency(spark, f"{base}/counts")) == batch(2)
    # a version that was cut off while it was written does not count
    shutil.copytree(f"{base}/counts/v1", f"{base}/counts/v7")
    os.remove(f"{base}/counts/v7/_SUCCESS")
    parts[2].write.mode("append").parquet(f"{base}/in")
    run()
    assert rows(jobs.latest_contingency(spark, f"{base}/counts")) == batch(3)
    assert len([n for n in os.listdir(f"{base}/counts") if n != "v7"]) == 2
