"""Golden numbers of the eight-slide fixture, and the two stitch routes against each other."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import stitch as st
from tessera.operators.pruning import attach_slide_size
from tessera.operators.tiling import tile_pitch, tile_sets
from tessera.plans.fixtures import VIEWS, Fixtures

GOLDEN = {
    "0.001": {"inst": 4599, "det": [1545, 48, 15, 1], "kept": [1496, 31, 9, 0], "final": [1496, 31, 9, 0]},
    "0.01": {"inst": 45832, "det": [15169, 514, 312, 28], "kept": [14471, 317, 223, 9], "final": [14469, 317, 223, 9]},
}


def eight_slides(spark, sf):
    return Fixtures(
        spark,
        f"/root/testdata/sf{sf}",
        fx_slides=VIEWS["fx_slides"] + " where s_suppkey < 8",
        fx_inst=VIEWS["fx_inst"].replace("min(l_suppkey) as int", "min(l_suppkey)%8 as int"),
    )


def by_mode(df):
    counts = {r["mode"]: r["count"] for r in df.groupBy("mode").count().collect()}
    return [counts.get(m, 0) for m in range(4)]


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_golden_numbers(spark, sf):
    fx, want = eight_slides(spark, sf), GOLDEN[sf]
    assert fx["fx_inst"].count() == want["inst"]
    assert by_mode(tile_sets(fx["fx_slides"])) == [48, 32, 24, 16]
    assert by_mode(fx["fx_det"]) == want["det"]
    assert by_mode(st.kept_in_tile(fx["fx_det"])) == want["kept"]
    final = st.stitch(fx["fx_det"], fx["fx_tiles"])
    assert by_mode(final) == want["final"]
    assert final.select("slide_id", "inst_id").distinct().count() == sum(want["final"])
    grid = st.stitch_on_grid(attach_slide_size(fx["fx_det"], fx["fx_slides"]), tile_pitch())
    assert by_mode(grid) == want["final"]


def test_hand_checked_tile_set(spark):
    slide = spark.createDataFrame([(1, 10000, 8000), (2, 4000, 4032)], "slide_id int, proc_w int, proc_h int")
    tiles = tile_sets(slide)
    assert by_mode(tiles.where("slide_id = 1")) == [6, 4, 3, 2]
    small = tiles.where("slide_id = 2").collect()
    assert len(small) == 1 and (small[0].ft, small[0].fb, small[0].fl, small[0].fr) == (0, 0, 0, 0)


def test_eviction_routes_agree_on_dense_boxes(spark):
    """Many boxes of all sizes around the junctions: closed form against the joined lines."""
    slides = spark.createDataFrame([(1, 9000, 9000)], "slide_id int, proc_w int, proc_h int")
    tiles = tile_sets(slides)
    grid = tiles.where("mode = 0")
    ids = spark.range(4000).select(
        F.col("id").alias("inst_id"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8600))).cast("int").alias("px"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(8600))).cast("int").alias("py"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(900)) + 4).cast("int").alias("s"),
    )
    rows = (
        grid.join(ids, (F.col("px") < F.col("x1")) & (F.col("px") + F.col("s") > F.col("x0")) & (F.col("py") < F.col("y1")) & (F.col("py") + F.col("s") > F.col("y0")))
        .selectExpr(
            *tiles.columns,
            "inst_id",
            "greatest(px, x0) - x0 bx0",
            "greatest(py, y0) - y0 by0",
            "least(px + s, x1) - x0 bx1",
            "least(py + s, y1) - y0 by1",
        )
    )
    joined = st.stitch(rows, tiles)
    closed = st.stitch_on_grid(attach_slide_size(rows, slides), tile_pitch())
    key = ["slide_id", "mode", "c", "r", "inst_id"]
    a, b = joined.select(key), closed.select(key)
    assert a.count() == b.count() < st.kept_in_tile(rows).count()
    assert a.exceptAll(b).count() == 0


def test_nothing_sized_before_an_explode_is_broadcast(spark, monkeypatch):
    """Neither side of a range join goes through the driver, however small its exchange; evicted keys only when counted small."""
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    evicted = st.evicted(st.kept_in_tile(fx["fx_det"]), fx["fx_tiles"])
    joins = [line for line in evicted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_cx" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    few = {tuple(r) for r in st.stitch(fx["fx_det"], fx["fx_tiles"]).collect()}
    monkeypatch.setattr(st, "small_enough", lambda df: False)
    assert {tuple(r) for r in st.stitch(fx["fx_det"], fx["fx_tiles"]).collect()} == few


def test_layout_precondition():
    with pytest.raises(ValueError):
        st.check_layout(256, 64)
    st.check_layout(4032, 64)
