"""Queries on patch/tile placement and stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stitch as st
from tessera.operators import tiling
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query

TILE_COLS = "slide_id, mode, c, r, x0, y0, x1, y1, ft, fb, fl, fr"

DROP_RULES = """d1 as (
select slide_id,mode,c,r,x0,y0,x1,y1,inst_id,bx0,by0,bx1,by1,bx0+x0 gx0,by0+y0 gy0,bx1+x0 gx1,by1+y0 gy1,
 case when mode in (0,3) then
   ((ft=1 or mode=3) and by1<=64) or ((fb=1 or mode=3) and by0>=(y1-y0)-64) or ((fl=1 or mode=3) and bx1<=64) or ((fr=1 or mode=3) and bx0>=(x1-x0)-64)
 else
   (case when ft=1 then by0<=64 else by0<=1 end) or (case when fb=1 then by1>=(y1-y0)-64 else by1>=(y1-y0)-1 end) or (case when fl=1 then bx0<=64 else bx0<=1 end) or (case when fr=1 then bx1>=(x1-x0)-64 else bx1>=(x1-x0)-1 end) end drop_it from fx_det),
kept as (select * from d1 where not drop_it),
ln as (select slide_id, x0+64 lx0, y0+64 ly0, x1-64 lx1, y0+64 ly1 from fx_tiles where mode=3
 union all select slide_id, x0+64, y1-64, x1-64, y1-64 from fx_tiles where mode=3
 union all select slide_id, x0+64, y0+64, x0+64, y1-64 from fx_tiles where mode=3
 union all select slide_id, x1-64, y0+64, x1-64, y1-64 from fx_tiles where mode=3),
final as (select k.* from kept k where mode=3 or not exists (select 1 from ln where ln.slide_id=k.slide_id and k.gx0<=ln.lx1 and k.gx1>=ln.lx0 and k.gy0<=ln.ly1 and k.gy1>=ln.ly0))"""


@query("tile_sets", f"select {TILE_COLS} from fx_tiles")
def tile_sets(fx: Fixtures) -> DataFrame:
    return tiling.tile_sets(fx["fx_slides"]).select(*TILE_COLS.split(", "))


@query(
    "tile_set_counts",
    "select slide_id, mode, count(*) tiles, min(x0) x0, max(x1) x1, min(y0) y0, max(y1) y1 from fx_tiles group by slide_id, mode",
)
def tile_set_counts(fx: Fixtures) -> DataFrame:
    return tiling.tile_sets(fx["fx_slides"]).groupBy("slide_id", "mode").agg(
        F.count("*").alias("tiles"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))]
    )


@query(
    "patch_grid_slide",
    """with p as (select slide_id, (a.n*50+b.n) c, (d.n*50+e.n) r from fx_slides
 join fx_n a on a.n<3 join fx_n b on (a.n*50+b.n)*144<proc_w join fx_n d on d.n<3 join fx_n e on (d.n*50+e.n)*144<proc_h)
select slide_id, r, count(*) patches, min(c*144-152) first_in_x0, max(c*144-152+448) last_in_x1,
 cast(sum(c*144) as bigint) out_x0_sum, r*144 out_y0, r*144-152 in_y0, r*144-152+448 in_y1, max(c*144+144) last_out_x1 from p group by slide_id, r""",
)
def patch_grid_slide(fx: Fixtures) -> DataFrame:
    return tiling.centred_patches(fx["fx_slides"]).groupBy("slide_id", "r").agg(
        F.count("*").alias("patches"),
        F.min("in_x0").alias("first_in_x0"),
        F.max("in_x1").alias("last_in_x1"),
        F.sum("out_x0").alias("out_x0_sum"),
        F.max("out_y0").alias("out_y0"),
        F.max("in_y0").alias("in_y0"),
        F.max("in_y1").alias("in_y1"),
        F.max("out_x1").alias("last_out_x1"),
    )


@query(
    "patch_grid_image",
    """with s as (select image_id, w, h, (cast(ceil((w-144)/cast(144 as double)) as int)+1)*144 lw, (cast(ceil((h-144)/cast(144 as double)) as int)+1)*144 lh from fx_manifest)
select image_id, a.n c, b.n r, a.n*144 in_x0, b.n*144 in_y0, a.n*144+448 in_x1, b.n*144+448 in_y1,
 a.n*144+152 out_x0, b.n*144+152 out_y0, a.n*144+296 out_x1, b.n*144+296 out_y1
from s join fx_n a on a.n*144<lw join fx_n b on b.n*144<lh where a.n*144+448<=152+lw+448 and b.n*144+448<=152+lh+448""",
)
def patch_grid_image(fx: Fixtures) -> DataFrame:
    return tiling.mirrored_patches(fx["fx_manifest"])


@query(
    "patch_mask_pruned",
    """with h as (select distinct m.slide_id, cast(floor(m.x*64/cast(144 as double)) as int)+i.n c, cast(floor(m.y*64/cast(144 as double)) as int)+j.n r, m.x, m.y
 from fx_mask_px m join fx_n i on i.n<2 join fx_n j on j.n<2),
hit as (select distinct h.slide_id, h.c, h.r from h join fx_slides s on s.slide_id=h.slide_id where h.c*144<h.x*64+64 and h.r*144<h.y*64+64 and h.c*144<s.proc_w and h.r*144<s.proc_h)
select slide_id, count(*) patches, cast(sum(c) as bigint) c_sum, cast(sum(r) as bigint) r_sum from hit group by slide_id""",
)
def patch_mask_pruned(fx: Fixtures) -> DataFrame:
    from tessera.operators.pruning import touching_mask

    patches = tiling.centred_patches(fx["fx_slides"])
    return touching_mask(patches, fx["fx_mask_px"], block=64, pitch=144).groupBy("slide_id").agg(
        F.count("*").alias("patches"), F.sum("c").alias("c_sum"), F.sum("r").alias("r_sum")
    )


@query(
    "chunk_patches",
    """with p as (select slide_id, (a.n*50+b.n) c, (d.n*50+e.n) r from fx_slides
 join fx_n a on a.n<3 join fx_n b on (a.n*50+b.n)*144<proc_w join fx_n d on d.n<3 join fx_n e on (d.n*50+e.n)*144<proc_h),
ch as (select slide_id, a.n cc, b.n cr from fx_slides join fx_n a on a.n*4032<proc_w join fx_n b on b.n*4032<proc_h)
select ch.slide_id, cc, cr, count(*) patches, cast(sum(p.c*1000+p.r) as bigint) code_sum from ch join p on p.slide_id=ch.slide_id
 and p.c*144<=(cc+1)*4032 and p.c*144+144>=cc*4032 and p.r*144<=(cr+1)*4032 and p.r*144+144>=cr*4032 group by ch.slide_id, cc, cr""",
)
def chunk_patches(fx: Fixtures) -> DataFrame:
    from tessera.operators.pruning import patches_by_chunk

    return (
        patches_by_chunk(tiling.centred_patches(fx["fx_slides"]), fx["fx_slides"], pitch=4032)
        .groupBy("slide_id", "cc", "cr")
        .agg(F.count("*").alias("patches"), F.sum(F.col("c") * 1000 + F.col("r")).alias("code_sum"))
    )


@query(
    "tiles_with_patches",
    """with m as (select distinct slide_id, x, y from fx_mask_px)
select t.slide_id, mode, c, r from fx_tiles t where exists (select 1 from m where m.slide_id=t.slide_id
 and m.x*64<=t.x1 and m.x*64+64>=t.x0 and m.y*64<=t.y1 and m.y*64+64>=t.y0)""",
)
def tiles_with_patches(fx: Fixtures) -> DataFrame:
    from tessera.operators.pruning import tile_sets_meeting

    blocks = fx["fx_mask_px"].select(
        "slide_id",
        (F.col("x") * 64).alias("x_min"),
        (F.col("y") * 64).alias("y_min"),
        (F.col("x") * 64 + 64).alias("x_max"),
        (F.col("y") * 64 + 64).alias("y_max"),
    )
    return tile_sets_meeting(fx["fx_slides"], blocks).select("slide_id", "mode", "c", "r")


@query(
    "viewing_grid",
    """with s as (select slide_id, proc_w, proc_h, proc_mpp/coalesce(base_mpp,proc_mpp) k from fx_slides),
v as (select *, cast(round(proc_w*k) as int) vw, cast(round(proc_h*k) as int) vh from s),
t as (select slide_id, a.n c, b.n r, a.n*1024 x0, b.n*1024 y0, least((a.n+1)*1024,vw) x1, least((b.n+1)*1024,vh) y1, k, proc_w, proc_h
 from v join fx_n a on a.n*1024<vw join fx_n b on b.n*1024<vh),
q as (select slide_id,c,r,x0,y0,x1,y1,cast(floor(x0/k) as int) px0,cast(floor(y0/k) as int) py0,least(cast(floor(x1/k) as int),proc_w) px1,least(cast(floor(y1/k) as int),proc_h) py1 from t)
select * from q where px1>px0 and py1>py0""",
)
def viewing_grid(fx: Fixtures) -> DataFrame:
    return tiling.viewing_grid(fx["fx_slides"])


@query(
    "viewing_grid_pruned_sampled",
    """with s as (select slide_id, proc_w, proc_h, proc_mpp/coalesce(base_mpp,proc_mpp) k from fx_slides),
v as (select *, cast(round(proc_w*k) as int) vw, cast(round(proc_h*k) as int) vh from s),
t as (select slide_id, a.n c, b.n r, a.n*1024 x0, b.n*1024 y0, least((a.n+1)*1024,vw) x1, least((b.n+1)*1024,vh) y1, k, proc_w, proc_h
 from v join fx_n a on a.n*1024<vw join fx_n b on b.n*1024<vh),
q as (select slide_id,c,r,cast(floor(x0/k) as int) px0,cast(floor(y0/k) as int) py0,least(cast(floor(x1/k) as int),proc_w) px1,least(cast(floor(y1/k) as int),proc_h) py1 from t),
g as (select * from q where px1>px0 and py1>py0 and exists (select 1 from fx_mask_px m where m.slide_id=q.slide_id and m.x*64<q.px1 and m.x*64+64>q.px0 and m.y*64<q.py1 and m.y*64+64>q.py0)),
n as (select *, row_number() over (partition by slide_id order by r,c)-1 i, count(*) over (partition by slide_id) total from g)
select slide_id, c, r from n where total<=60 or exists (select 1 from fx_n a join fx_n b on a.n<2 and a.n*50+b.n<60 where i=cast(floor((a.n*50+b.n)*(total/cast(60 as double))) as int))""",
)
def viewing_grid_pruned_sampled(fx: Fixtures) -> DataFrame:
    from tessera.operators.ranking import evenly_spaced

    tiles = tiling.viewing_tiles_with_tissue(fx["fx_slides"], fx["fx_mask_px"], block=64)
    return evenly_spaced(tiles, ["slide_id"], ["r", "c"], 60).select("slide_id", "c", "r")


@query(
    "tile_drop_rules",
    f"with {DROP_RULES} select slide_id, mode, count(*) detections, sum(case when drop_it then 1 else 0 end)::bigint dropped from d1 group by slide_id, mode",
)
def tile_drop_rules(fx: Fixtures) -> DataFrame:
    return fx["fx_det"].groupBy("slide_id", "mode").agg(
        F.count("*").alias("detections"), F.sum(st.dropped_in_tile().cast("int")).alias("dropped")
    )


@query(
    "cross_evictions",
    f"with {DROP_RULES} select slide_id, mode, c, r, inst_id from kept where (slide_id, mode, c, r, inst_id) not in (select slide_id, mode, c, r, inst_id from final)",
)
def cross_evictions(fx: Fixtures) -> DataFrame:
    return st.evicted(st.kept_in_tile(fx["fx_det"]), fx["fx_tiles"])


# crosses 2,000 px wider on every side than the layout's
WIDE = DROP_RULES.replace("from fx_tiles where mode=3", "from (select slide_id, mode, x0-2000 x0, y0-2000 y0, x1+2000 x1, y1+2000 y1 from fx_tiles) w where mode=3")


@query(
    "stitch_wide_crosses",
    f"with {WIDE} select slide_id, mode, count(*) instances, sum(inst_id)::bigint ids from final group by slide_id, mode",
)
def stitch_wide_crosses(fx: Fixtures) -> DataFrame:
    out = {n: (F.col(n) + (2000 if n.endswith("1") else -2000)) for n in ("x0", "y0", "x1", "y1")}
    wide = fx["fx_tiles"].where("mode = 3").withColumns(out)
    kept = st.stitch(fx["fx_det"], wide)
    return kept.groupBy("slide_id", "mode").agg(F.count("*").alias("instances"), F.sum("inst_id").cast("long").alias("ids"))


@query(
    "stitch_tiles",
    f"with {DROP_RULES} select slide_id, mode, c, r, inst_id, gx0, gy0, gx1, gy1, sha256(slide_id||'|'||mode||'|'||c||'|'||r||'|'||inst_id) uid from final",
)
def stitch_tiles(fx: Fixtures) -> DataFrame:
    return st.stitch(fx["fx_det"], fx["fx_tiles"]).select(
        "slide_id", "mode", "c", "r", "inst_id", "gx0", "gy0", "gx1", "gy1", "uid"
    )


@query(
    "stitch_summary",
    f"with {DROP_RULES} select slide_id, mode, count(*) instances, cast(sum((gx1-gx0)*(gy1-gy0)) as bigint) box_area from final group by slide_id, mode",
)
def stitch_summary(fx: Fixtures) -> DataFrame:
    from tessera.operators.pruning import attach_slide_size

    placed = attach_slide_size(fx["fx_det"], fx["fx_slides"])
    return st.stitch_on_grid(placed, pitch=tiling.tile_pitch()).groupBy("slide_id", "mode").agg(
        F.count("*").alias("instances"),
        F.sum(((F.col("gx1") - F.col("gx0")) * (F.col("gy1") - F.col("gy0"))).cast("long")).alias("box_area"),
    )
