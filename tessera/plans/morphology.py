"""Queries on components, morphology and target maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import components as cc
from tessera.operators import morphology as mo
from tessera.operators.flood import split_by_markers
from tessera.operators.runs import to_pixels, to_runs, with_frames
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query

IMAGE = ["image_id"]


def blob_frames(fx: Fixtures) -> DataFrame:
    return fx["fx_blob"].select("image_id").distinct().select("image_id", F.lit(64).alias("w"), F.lit(64).alias("h"))


def reach(source: str, keys: str, nth: str = "") -> str:
    """Oracle text: component label of every pixel by breadth-first reach over ``source``."""
    k = ", ".join(f"n.{c}" for c in keys.split(", "))
    on = " and ".join(f"p.{c}=n.{c}" for c in keys.split(", "))
    return f"""reach{nth}({keys}, x, y, lab) as (select {keys}, x, y, cast(y as bigint)*4294967296+x from {source}
 union select {k}, n.x, n.y, p.lab from reach{nth} p join {source} n on {on} and abs(n.x-p.x)+abs(n.y-p.y)=1 where p.lab<cast(n.y as bigint)*4294967296+n.x),
lab{nth} as materialized (select {keys}, x, y, min(lab) comp from reach{nth} group by {keys}, x, y)"""


@query(
    "components",
    f"""with recursive bl as materialized (select image_id, x, y from fx_blob), {reach('bl', 'image_id')} select image_id, x, y, comp from lab""",
)
def components(fx: Fixtures) -> DataFrame:
    return cc.label_pixels(fx["fx_blob"], IMAGE)


@query(
    "components_numbered",
    f"""with recursive bl as materialized (select image_id, x, y from fx_blob), {reach('bl', 'image_id')} select image_id, x, y, dense_rank() over (partition by image_id order by comp) inst_id from lab""",
)
def components_numbered(fx: Fixtures) -> DataFrame:
    return cc.numbered_components(fx["fx_blob"])


@query(
    "component_boxes",
    f"""with recursive bl as materialized (select image_id, x, y from fx_blob), {reach('bl', 'image_id')}
select image_id, comp, min(x) x_min, min(y) y_min, max(x)+1 x_max, max(y)+1 y_max, count(*) area from lab group by image_id, comp having count(*)>=8""",
)
def component_boxes(fx: Fixtures) -> DataFrame:
    return cc.component_boxes(cc.label_runs(to_runs(fx["fx_blob"], IMAGE), IMAGE), IMAGE).where("area >= 8")


@query(
    "tissue_regions",
    f"""with recursive bl as materialized (select slide_id, x, y from fx_mask_px), r as (select slide_id, y, min(x) x0, max(x) x1, cast(y as bigint)*4294967296+min(x) id from (select *, x-row_number() over (partition by slide_id, y order by x) g from bl) group by slide_id, y, g),
e as materialized (select a.slide_id, a.id a, b.id b from r a join r b on a.slide_id=b.slide_id and abs(a.y-b.y)=1 and a.x0<=b.x1 and a.x1>=b.x0),
reach(slide_id, id, lab) as (select slide_id, id, id from r union select p.slide_id, e.b, p.lab from reach p join e on e.slide_id=p.slide_id and e.a=p.id where p.lab<e.b),
lab as (select slide_id, id, min(lab) comp from reach group by slide_id, id)
select r.slide_id, comp, cast(round(min(r.x0)*64.0) as int) x_min, cast(round(min(r.y)*64.0) as int) y_min, cast(round((max(r.x1)+1)*64.0) as int) x_max, cast(round((max(r.y)+1)*64.0) as int) y_max
from r join lab on lab.slide_id=r.slide_id and lab.id=r.id group by r.slide_id, comp""",
)
def tissue_regions(fx: Fixtures) -> DataFrame:
    from tessera.operators.tissue import regions

    return regions(fx["fx_mask_px"], fx["fx_slides"], ratio=1 / 64)


@query(
    "split_reused_ids",
    f"""with recursive bl as materialized (select image_id, inst_id, x, y from fx_patchwork), {reach('bl', 'image_id, inst_id')},
pc as (select image_id, inst_id, comp, row_number() over (partition by image_id, inst_id order by comp) piece, count(*) over (partition by image_id, inst_id) n from (select distinct image_id, inst_id, comp from lab)),
st as (select image_id, inst_id, case when max(n)>1 then max(n) else 0 end s from pc group by all),
us as (select image_id, inst_id, sum(s) over (partition by image_id order by inst_id)-s used, max(inst_id) over (partition by image_id) top from st)
select l.image_id, l.inst_id, l.x, l.y, cast(case when piece=1 then l.inst_id else top+used+piece end as bigint) new_id from lab l join pc on pc.image_id=l.image_id and pc.inst_id=l.inst_id and pc.comp=l.comp join us on us.image_id=l.image_id and us.inst_id=l.inst_id""",
)
def split_reused_ids(fx: Fixtures) -> DataFrame:
    return cc.split_reused_ids(fx["fx_patchwork"]).select("image_id", "inst_id", "x", "y", "new_id")


ELLIPSE3 = "el as (select 0 i, 0 j union all select 1,0 union all select -1,0 union all select 0,1 union all select 0,-1)"
DISK3 = "el as (select a.k i, b.k j from (select unnest(range(-3,4)) k) a join (select unnest(range(-3,4)) k) b on a.k*a.k+b.k*b.k<=9)"


@query(
    "dilate_disk",
    f"with {DISK3} select distinct image_id, cast(x+i as int) x, cast(y+j as int) y from fx_blob join el on x+i between 0 and 63 and y+j between 0 and 63",
)
def dilate_disk(fx: Fixtures) -> DataFrame:
    runs = with_frames(to_runs(fx["fx_blob"], IMAGE), blob_frames(fx), IMAGE)
    return to_pixels(mo.dilate(runs, IMAGE, mo.disk(3), framed=True), IMAGE)


@query(
    "erode_ellipse",
    f"""with {ELLIPSE3}, fr as (select image_id, x, y from fx_dil)
select f.image_id, f.x, f.y from fr f join el on true left join fr n on n.image_id=f.image_id and n.x=f.x+i and n.y=f.y+j
where f.x+i between 0 and 63 and f.y+j between 0 and 63 group by f.image_id, f.x, f.y having count(*)=count(n.x)""",
)
def erode_ellipse(fx: Fixtures) -> DataFrame:
    runs = with_frames(to_runs(dilated(fx), IMAGE), blob_frames(fx), IMAGE)
    return to_pixels(mo.erode(runs, IMAGE, mo.ellipse(3), framed=True), IMAGE)


def dilated(fx: Fixtures) -> DataFrame:
    """The blobs grown by a cross, so that they have an inside."""
    return fx["fx_dil"]


@query(
    "open_disk",
    f"""with {DISK3}, b as (select image_id, x, y from fx_dil),
er as (select f.image_id, f.x, f.y from b f join el on true left join b n on n.image_id=f.image_id and n.x=f.x+i and n.y=f.y+j group by all having count(*)=count(n.x))
select distinct image_id, cast(x+i as int) x, cast(y+j as int) y from er join el on true""",
)
def open_disk(fx: Fixtures) -> DataFrame:
    """Erode with nothing set outside, then dilate without a frame."""
    eroded = mo.erode(to_runs(dilated(fx), IMAGE), IMAGE, mo.disk(3))
    return to_pixels(mo.dilate(eroded, IMAGE, mo.disk(3)), IMAGE)


@query(
    "boundary_pixels",
    """select p.image_id, p.inst_id, p.x, p.y from fx_patchwork p where (select count(*) from fx_patchwork n where n.image_id=p.image_id and n.inst_id=p.inst_id and abs(n.x-p.x)+abs(n.y-p.y)=1)<4""",
)
def boundary_pixels(fx: Fixtures) -> DataFrame:
    return mo.boundary_pixels(fx["fx_patchwork"], ["image_id", "inst_id"])


UNSET = """fr as (select i.image_id, a.k x, b.k y from (select distinct image_id from fx_dil) i join (select unnest(range(64)) k) a on true join (select unnest(range(64)) k) b on true),
un as materialized (select f.image_id, f.x, f.y from fr f left join fx_dil d on d.image_id=f.image_id and d.x=f.x and d.y=f.y where d.x is null)"""


@query(
    "fill_holes",
    f"""with recursive {UNSET}, bb as (select image_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from fx_dil group by image_id),
ub as materialized (select un.*, x in (x0,x1) or y in (y0,y1) edge from un join bb on bb.image_id=un.image_id and x between x0 and x1 and y between y0 and y1),
op(image_id,x,y) as (select image_id, x, y from ub where edge union select n.image_id, n.x, n.y from op p join ub n on n.image_id=p.image_id and abs(n.x-p.x)+abs(n.y-p.y)=1)
select image_id, x, y from fx_dil union all (select image_id, cast(x as int) x, cast(y as int) y from ub except select image_id, cast(x as int), cast(y as int) from op)""",
)
def fill_holes(fx: Fixtures) -> DataFrame:
    return to_pixels(mo.fill_holes(to_runs(dilated(fx), IMAGE), IMAGE), IMAGE)


@query(
    "fill_small_holes",
    f"""with recursive {UNSET}, {reach('un', 'image_id')},
sm as (select image_id, comp from lab group by image_id, comp having count(*)<6)
select image_id, x, y from fx_dil union all select l.image_id, cast(l.x as int), cast(l.y as int) from lab l join sm on sm.image_id=l.image_id and sm.comp=l.comp""",
)
def fill_small_holes(fx: Fixtures) -> DataFrame:
    return to_pixels(mo.fill_small_holes(to_runs(dilated(fx), IMAGE), IMAGE, blob_frames(fx), 6), IMAGE)


@query("refine_tissue")
def refine_tissue(fx: Fixtures) -> DataFrame:
    return mo.refine_tissue(dilated(fx), blob_frames(fx), radius=1, limit=40)


@query(
    "grow_instances",
    f"""with recursive {ELLIPSE3}, bl as materialized (select image_id, x, y from fx_blob), {reach('bl', 'image_id')},
bx as (select image_id, comp, case when min(x)>=6 then min(x)-6 else min(x) end x0, case when min(y)>=6 then min(y)-6 else min(y) end y0,
 case when max(x)+7<=63 then max(x)+7 else max(x)+1 end x1, case when max(y)+7<=63 then max(y)+7 else max(y)+1 end y1 from lab group by image_id, comp having count(*)>=8),
gr as materialized (select distinct l.image_id, l.comp, l.x+i x, l.y+j y from lab l join bx on bx.image_id=l.image_id and bx.comp=l.comp join el on l.x+i>=x0 and l.x+i<x1 and l.y+j>=y0 and l.y+j<y1),
bb as (select image_id, comp, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from gr group by image_id, comp),
bg as (select *, unnest(range(y0, y1+1)) y from (select *, unnest(range(x0, x1+1)) x from bb)),
ub as materialized (select bg.image_id, bg.comp, bg.x, bg.y, bg.x in (x0,x1) or bg.y in (y0,y1) edge from bg left join gr on gr.image_id=bg.image_id and gr.comp=bg.comp and gr.x=bg.x and gr.y=bg.y where gr.x is null),
op(image_id, comp, x, y) as (select image_id, comp, x, y from ub where edge
 union select n.image_id, n.comp, n.x, n.y from op p join ub n on n.image_id=p.image_id and n.comp=p.comp and abs(n.x-p.x)+abs(n.y-p.y)=1)
select image_id, cast(x as int) x, cast(y as int) y, max(comp) comp from (select image_id, comp, x, y from gr union all (select image_id, comp, x, y from ub except select image_id, comp, x, y from op)) group by image_id, x, y""",
)
def grow_instances(fx: Fixtures) -> DataFrame:
    return mo.grow_instances(fx["fx_blob"], blob_frames(fx), size=3, limit=8)


@query(
    "contour_targets",
    f"""with {ELLIPSE3}, fm as (select image_id, max(x)+1 w, max(y)+1 h from fx_true_px group by image_id),
inn as (select f.image_id, f.inst_id, f.x, f.y from fx_true_px f join el on true join fm on fm.image_id=f.image_id left join fx_true_px n on n.image_id=f.image_id and n.inst_id=f.inst_id and n.x=f.x+i and n.y=f.y+j
 where f.x+i between 0 and w-1 and f.y+j between 0 and h-1 group by f.image_id, f.inst_id, f.x, f.y having count(*)=count(n.x)),
ou as (select distinct f.image_id, f.inst_id, f.x+i x, f.y+j y from fx_true_px f join el on true join fm on fm.image_id=f.image_id where f.x+i between 0 and w-1 and f.y+j between 0 and h-1),
rg as (select image_id, inst_id, x, y from ou except select image_id, inst_id, x, y from inn),
a as (select image_id, x, y, max(i) i, max(r) r from (select image_id, x, y, 1 i, 0 r from inn union all select image_id, x, y, 0, 1 from rg) group by all)
select image_id, x, y, i+2*r as value, 1-i-r background from a""",
)
def contour_targets(fx: Fixtures) -> DataFrame:
    from tessera.plans.joins import frames

    px = fx["fx_true_px"]
    return mo.target_map("IP-ERODED-CONTOUR-3", px, frames(fx, px))


@query(
    "eroded_targets",
    f"""with {ELLIPSE3}, fm as (select image_id, max(x)+1 w, max(y)+1 h from fx_true_px group by image_id)
select distinct f.image_id, f.x, f.y, 1 as value from fx_true_px f join el on true join fm on fm.image_id=f.image_id left join fx_true_px n on n.image_id=f.image_id and n.inst_id=f.inst_id and n.x=f.x+i and n.y=f.y+j
 where f.x+i between 0 and w-1 and f.y+j between 0 and h-1 group by f.image_id, f.inst_id, f.x, f.y having count(*)=count(n.x)""",
)
def eroded_targets(fx: Fixtures) -> DataFrame:
    from tessera.plans.joins import frames

    px = fx["fx_true_px"]
    return mo.target_map("IP-ERODED-3", px, frames(fx, px))


FLOOD = """fl(image_id, x, y, d, marker) using key (image_id, x, y) as (
 select k.image_id, k.x, k.y, 0 d, min(k.marker) marker from mk k join msk m on m.image_id=k.image_id and m.x=k.x and m.y=k.y group by all
 union
 select n.image_id, n.x, n.y, f.d+1, min(f.marker) from fl f join msk n on n.image_id=f.image_id and abs(n.x-f.x)+abs(n.y-f.y)=1
  left join recurring.fl s on s.image_id=n.image_id and s.x=n.x and s.y=n.y where s.x is null group by n.image_id, n.x, n.y, f.d)"""


@query(
    "marker_split",
    f"""with recursive mk as (select image_id, x, y, cast(inst_id as bigint) marker from fx_patchwork where v>=48),
msk as materialized (select image_id, x, y from fx_dil), {FLOOD} select image_id, x, y, marker from fl""",
)
def marker_split(fx: Fixtures) -> DataFrame:
    markers = fx["fx_patchwork"].where("v >= 48").select("image_id", "x", "y", F.col("inst_id").alias("marker"))
    return split_by_markers(dilated(fx), markers)


@query(
    "nuclei_from_heads",
    f"""with recursive {ELLIPSE3}, fr as materialized (select image_id, x, y from fx_dil),
er as materialized (select f.image_id, f.x, f.y from fr f join el on true left join fr n on n.image_id=f.image_id and n.x=f.x+i and n.y=f.y+j
 where f.x+i between 0 and 63 and f.y+j between 0 and 63 group by f.image_id, f.x, f.y having count(*)=count(n.x)), {reach('er', 'image_id', '1')},
msk as materialized (select image_id, x, y from lab1 where (image_id, comp) in (select image_id, comp from lab1 group by all having count(*)>=8)),
st as materialized (select image_id, x, y from fx_blob where v>35), {reach('st', 'image_id', '2')},
sd as materialized (select image_id, x, y from lab2 where (image_id, comp) in (select image_id, comp from lab2 group by all having count(*)>=4)),
bb as (select image_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from sd group by image_id),
bg as (select image_id, x0, x1, y0, y1, x, unnest(range(y0, y1+1)) y from (select *, unnest(range(x0, x1+1)) x from bb)),
ub as materialized (select bg.image_id, bg.x, bg.y, bg.x in (x0,x1) or bg.y in (y0,y1) edge from bg left join sd on sd.image_id=bg.image_id and sd.x=bg.x and sd.y=bg.y where sd.x is null),
op(image_id,x,y) as (select image_id, x, y from ub where edge union select n.image_id, n.x, n.y from op p join ub n on n.image_id=p.image_id and abs(n.x-p.x)+abs(n.y-p.y)=1),
sf as materialized (select image_id, x, y from sd union all (select image_id, x, y from ub except select image_id, x, y from op)), {reach('sf', 'image_id', '3')},
mk as (select image_id, x, y, comp marker from lab3), {FLOOD}
select image_id, x, y, marker from fl""",
)
def nuclei_from_heads(fx: Fixtures) -> DataFrame:
    """Grown blobs as foreground with the original strong pixels as inner map."""
    strong = fx["fx_blob"].where("v > 35").select("image_id", "x", "y", F.lit(0.9).alias("inner"))
    scores = dilated(fx).join(strong, ["image_id", "x", "y"], "left").withColumn("ring", F.when(F.col("inner").isNull(), 0.8).otherwise(0.05))
    return mo.nuclei_from_heads(scores.withColumn("inner", F.coalesce("inner", F.lit(0.1))), blob_frames(fx))
