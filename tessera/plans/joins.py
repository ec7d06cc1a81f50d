"""Queries on spatial, pixel and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, box_iou, contains
from tessera.operators import instances as inst
from tessera.operators import matching
from tessera.operators.neighbours import separation_weights
from tessera.operators.range_join import box_pairs, self_pairs
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query

LEFT, RIGHT = Box.of("l_"), Box.of("r_")


def frames(fx: Fixtures, px: DataFrame) -> DataFrame:
    """Image sizes big enough for the pixel table."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


@query(
    "box_overlaps",
    """select a.slide_id, a.inst_id a_id, b.inst_id b_id,
 round(case when least(a.x_max,b.x_max)<greatest(a.x_min,b.x_min) or least(a.y_max,b.y_max)<greatest(a.y_min,b.y_min) then 0.0
 else (least(a.x_max,b.x_max)-greatest(a.x_min,b.x_min))*(least(a.y_max,b.y_max)-greatest(a.y_min,b.y_min))/
 cast((a.x_max-a.x_min)*(a.y_max-a.y_min)+(b.x_max-b.x_min)*(b.y_max-b.y_min)-(least(a.x_max,b.x_max)-greatest(a.x_min,b.x_min))*(least(a.y_max,b.y_max)-greatest(a.y_min,b.y_min)) as double) end,6) iou
from fx_inst a join fx_inst b on a.slide_id=b.slide_id and a.inst_id<b.inst_id and a.x_min<=b.x_max and a.x_max>=b.x_min and a.y_min<=b.y_max and a.y_max>=b.y_min""",
)
def box_overlaps(fx: Fixtures) -> DataFrame:
    pairs = self_pairs(fx["fx_inst"].select("slide_id", "inst_id", "x_min", "y_min", "x_max", "y_max"), ["slide_id"], "inst_id")
    return pairs.select(
        "slide_id",
        F.col("l_inst_id").alias("a_id"),
        F.col("r_inst_id").alias("b_id"),
        F.round(box_iou(LEFT, RIGHT), 6).alias("iou"),
    )


@query(
    "instances_in_tiles",
    """select t.slide_id, t.c, t.r, count(*) touching, cast(sum(case when i.x_min>=t.x0 and i.x_max<=t.x1 and i.y_min>=t.y0 and i.y_max<=t.y1 then 1 else 0 end) as bigint) inside
from fx_grid t join fx_inst i on i.slide_id=t.slide_id and i.x_min<=t.x1 and i.x_max>=t.x0 and i.y_min<=t.y1 and i.y_max>=t.y0 group by t.slide_id, t.c, t.r""",
)
def instances_in_tiles(fx: Fixtures) -> DataFrame:
    tiles = fx["fx_grid"].select(
        "slide_id", "c", "r", *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("x_min", "y_min", "x_max", "y_max"))]
    )
    pairs = box_pairs(tiles, fx["fx_inst"], ["slide_id"], keep_left=["c", "r"], keep_right=[])
    return pairs.groupBy("slide_id", F.col("l_c").alias("c"), F.col("l_r").alias("r")).agg(
        F.count("*").alias("touching"), F.sum(contains(LEFT, RIGHT).cast("int")).alias("inside")
    )


@query(
    "lumen_inside_gland",
    """select p.image_id, p.inst_id, count(*) area from fx_pred_px p where p.cls=2
 and exists (select 1 from fx_true_px t where t.cls in (1,2,3) and t.image_id=p.image_id and t.x=p.x and t.y=p.y) group by p.image_id, p.inst_id""",
)
def lumen_inside_gland(fx: Fixtures) -> DataFrame:
    lumen, gland = fx["fx_pred_px"].where("cls = 2"), fx["fx_true_px"].where("cls in (1, 2, 3)")
    return inst.inside_other(lumen, gland).groupBy("image_id", "inst_id").agg(F.count("*").alias("area"))


@query(
    "class_raster",
    """select p.image_id, p.x, p.y, coalesce(k.cls,0) cls from fx_patchwork p
 left join (select image_id, inst_id, cast(max(cls) as int) cls from fx_patchwork where cls<>3 group by image_id, inst_id) k
 on k.image_id=p.image_id and k.inst_id=p.inst_id""",
)
def class_raster(fx: Fixtures) -> DataFrame:
    px = fx["fx_patchwork"]
    known = px.where("cls <> 3").groupBy("image_id", "inst_id").agg(F.max("cls").alias("cls"))
    return inst.class_raster(px.drop("cls"), known).select("image_id", "x", "y", "cls")


SHIFTED_TRUTH = """sh as (select image_id, inst_id+100 inst_id, 1 cls, x+3 x, y+2 y from fx_patchwork),
pw as (select image_id, inst_id, 1 cls, x, y from fx_patchwork),
m as (select p.image_id, p.inst_id pid, t.inst_id tid, count(*) inter from pw p join sh t on p.image_id=t.image_id and p.x=t.x and p.y=t.y group by all),
pa as (select image_id, inst_id, count(*) n from pw group by all), ta as (select image_id, inst_id, count(*) n from sh group by all),
pr as (select m.image_id, pid, tid, cast(inter as double)/(pa.n+ta.n-inter) iou from m join pa on pa.image_id=m.image_id and pa.inst_id=pid join ta on ta.image_id=m.image_id and ta.inst_id=tid)"""


@query(
    "iou_matches",
    """with m as (select p.image_id,p.inst_id pid,t.inst_id tid,p.cls cls,count(*) inter from fx_pred_px p join fx_true_px t on p.image_id=t.image_id and p.x=t.x and p.y=t.y and p.cls=t.cls group by p.image_id,p.inst_id,t.inst_id,p.cls),
pa as (select image_id,cls,inst_id,count(*) area from fx_pred_px group by image_id,cls,inst_id),
ta as (select image_id,cls,inst_id,count(*) area from fx_true_px group by image_id,cls,inst_id)
select image_id, cls, pid, tid, round(iou,6) iou from (select m.*, cast(m.inter as double)/(pa.area+ta.area-m.inter) iou from m join pa on pa.inst_id=m.pid and pa.image_id=m.image_id join ta on ta.inst_id=m.tid and ta.image_id=m.image_id) q where iou>0.5""",
)
def iou_matches(fx: Fixtures) -> DataFrame:
    return matching.match(fx["fx_pred_px"], fx["fx_true_px"]).withColumn("iou", F.round("iou", 6))


@query(
    "iou_matches_greedy",
    f"""with recursive {SHIFTED_TRUTH},
rec(step, image_id, pid, tid, iou, won) as (
 select 0, image_id, pid, tid, iou, false from pr where iou>0.02
 union all
 select step+1, image_id, pid, tid, iou, b from (
  select *, max(case when b then 1 else 0 end) over (partition by image_id, pid) pb, max(case when b then 1 else 0 end) over (partition by image_id, tid) tb from (
   select *, row_number() over (partition by image_id, pid order by iou desc, pid, tid)=1 and row_number() over (partition by image_id, tid order by iou desc, pid, tid)=1 b from rec where not won) q1) q2
 where b or (pb=0 and tb=0))
select image_id, pid, tid, round(iou,6) iou from rec where won""",
)
def iou_matches_greedy(fx: Fixtures) -> DataFrame:
    px = fx["fx_patchwork"].withColumn("cls", F.lit(1))
    moved = px.select("image_id", (F.col("inst_id") + 100).alias("inst_id"), "cls", (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"))
    return matching.match(px, moved, 0.02).select("image_id", "pid", "tid", F.round("iou", 6).alias("iou"))


@query(
    "separation_weights",
    """with f as (select image_id, max(x)+1 w, max(y)+1 h from fx_true_px group by image_id),
b as (select image_id, inst_id, greatest(min(x)-10,0) x0, max(x)+10 x1, greatest(min(y)-10,0) y0, max(y)+10 y1 from fx_true_px group by image_id, inst_id),
edge as (select p.image_id, p.inst_id, p.x, p.y from (select *, min(x) over (partition by image_id,inst_id) bx0, max(x) over (partition by image_id,inst_id) bx1, min(y) over (partition by image_id,inst_id) by0, max(y) over (partition by image_id,inst_id) by1 from fx_true_px) p where p.x in (bx0,bx1) or p.y in (by0,by1)),
g as (select b.image_id, b.inst_id, unnest(range(b.x0, least(b.x1, f.w-1)+1)) x, b.y0, least(b.y1, f.h-1) y1 from b join f on f.image_id=b.image_id),
gg as (select image_id, inst_id, x, unnest(range(y0, y1+1)) y from g),
inpx as (select image_id, inst_id, x, y from fx_true_px),
d as (select gg.image_id, gg.inst_id, gg.x, gg.y, min((gg.x-e.x)*(gg.x-e.x)+(gg.y-e.y)*(gg.y-e.y)) d2 from gg join edge e on e.image_id=gg.image_id and e.inst_id=gg.inst_id group by all),
d0 as (select d.image_id, d.x, d.y, case when i.inst_id is null then d2 else 0 end d2 from d left join inpx i on i.image_id=d.image_id and i.inst_id=d.inst_id and i.x=d.x and i.y=d.y),
two as (select image_id, x, y, min(d2) a, list_sort(list(d2))[2] b from d0 group by all)
select image_id, cast(x as int) x, cast(y as int) y, round(case when a=0 then 0.0 else 10.0*exp(-(((sqrt(a)+coalesce(sqrt(b),1000.0))/3.0)*((sqrt(a)+coalesce(sqrt(b),1000.0))/3.0))/2) end,9) weight from two
where image_id in (select image_id from fx_true_px group by image_id having min(inst_id)<max(inst_id))""",
)
def pixel_separation_weights(fx: Fixtures) -> DataFrame:
    px = fx["fx_true_px"]
    return separation_weights(px, frames(fx, px)).withColumn("weight", F.round("weight", 9))
