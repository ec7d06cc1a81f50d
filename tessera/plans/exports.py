"""Queries on exports and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import Box, corners, scale_factor
from tessera.operators.contours import outlines
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query
from tessera.sources import exports as ex

BOX = Box.of()


def shaped(fx: Fixtures) -> DataFrame:
    """Instances with a four-corner contour and their slide's scale."""
    from tessera.session import small_enough

    scale = fx["fx_slides"].select("slide_id", F.round(scale_factor(F.col("proc_mpp"), F.col("base_mpp")), 3).alias("scale"))
    scale = F.broadcast(scale) if small_enough(scale) else scale
    return fx["fx_inst"].withColumn("contour", corners(BOX)).join(scale, "slide_id")


SHAPED = """sc as (select slide_id, round(case when base_mpp is null or base_mpp=0 then 1.0 else proc_mpp/base_mpp end,3) k from fx_slides),
q as (select i.*, round(x_min*k,3) a, round(y_min*k,3) b, round(x_max*k,3) c, round(y_max*k,3) d from fx_inst i join sc on sc.slide_id=i.slide_id),
ft as (select *, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['||a||','||b||'],['||c||','||b||'],['||c||','||d||'],['||a||','||d||'],['||a||','||b||']]]},"properties":{"objectType":"annotation","classification":{"name":"'||task||'","color":'||case task when 'Nuclei' then '[0,255,0]' when 'Gland' then '[0,0,255]' else '[255,255,0]' end||'}}}' feature from q)"""


@query("geojson_features", f"with {SHAPED} select inst_id, feature from ft")
def geojson_features(fx: Fixtures) -> DataFrame:
    return ex.features(shaped(fx), digits=3).select("inst_id", "feature")


@query(
    "geojson_parts",
    """with n as (select slide_id, inst_id, row_number() over (partition by slide_id order by inst_id) rn, count(*) over (partition by slide_id) n from fx_inst)
select slide_id, inst_id, case when n>100 then slide_id||'_part'||cast(floor((rn-1)/100.0)+1 as int)||'of'||cast(ceil(n/100.0) as int)||'.geojson' else slide_id||'.geojson' end file_name from n""",
)
def geojson_parts(fx: Fixtures) -> DataFrame:
    return ex.in_parts(fx["fx_inst"], ["inst_id"], 100).select("slide_id", "inst_id", "file_name")


@query(
    "geojson_collections",
    f"""with {SHAPED}, n as (select *, row_number() over (partition by slide_id order by inst_id) rn, count(*) over (partition by slide_id) n from ft),
p as (select *, case when n>200 then slide_id||'_part'||cast(floor((rn-1)/200.0)+1 as int)||'of'||cast(ceil(n/200.0) as int)||'.geojson' else slide_id||'.geojson' end file_name from n)
select slide_id, file_name, count(*) features, md5('{{"type":"FeatureCollection","features":['||string_agg(feature, ',' order by inst_id)||']}}') digest from p group by slide_id, file_name""",
)
def geojson_collections(fx: Fixtures) -> DataFrame:
    parts = ex.in_parts(ex.features(shaped(fx), digits=3), ["inst_id"], 200)
    return ex.collections(parts).select("slide_id", "file_name", "features", F.md5("text").alias("digest"))


@query(
    "geojson_parsed",
    f"with {SHAPED} select inst_id, 'annotation' object_type, task class_name, 5 points, a x0, d y1 from ft",
)
def geojson_parsed(fx: Fixtures) -> DataFrame:
    back = ex.parse_features(ex.features(shaped(fx), digits=3).select("inst_id", "feature"))
    return back.select(
        "inst_id", "object_type", "class_name", F.size("ring").alias("points"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[2]["y"].alias("y1")
    )


@query(
    "polygon_clean_counts",
    """select slide_id, cast(sum(case when y_max-y_min>10 and task<>'Lumen' then 1 else 0 end) as bigint) kept, cast(sum(case when y_max-y_min>10 and task<>'Lumen' then 0 else 1 end) as bigint) dropped from fx_inst group by slide_id""",
)
def polygon_clean_counts(fx: Fixtures) -> DataFrame:
    """Low instances are flattened to a line and lumens lose their class: both must be dropped."""
    flat = F.when(BOX.y1 - BOX.y0 > 10, BOX.y1).otherwise(BOX.y0)
    rows = fx["fx_inst"].withColumn("contour", corners(Box(BOX.x0, BOX.y0, BOX.x1, flat))).withColumn("scale", F.lit(1.0))
    text = ex.features(rows).withColumn("feature", F.when(F.col("task") == "Lumen", F.regexp_replace("feature", '"name":"Lumen",', "")).otherwise(F.col("feature")))
    return ex.clean_counts(ex.parse_features(text.select("slide_id", "feature")), ["slide_id"])


@query(
    "nested_json",
    """with n as (select *, cast(floor((row_number() over (partition by slide_id order by task, inst_id)-1)/150.0)+1 as int) part from fx_inst)
select slide_id, part, task, count(*) n, min(inst_id) first_id, cast(sum(x_min) as bigint) x_sum from n group by all""",
)
def nested_json(fx: Fixtures) -> DataFrame:
    """Read back from the text: the nesting is what is checked."""
    text = ex.nested_json(fx["fx_inst"], 20.0, ["x_min", "y_min", "x_max", "y_max", "type_id"], 150)
    shape = "mag double, instances map<string, map<string, struct<x_min: int>>>"
    tasks = text.select("slide_id", "part", F.explode(F.from_json("text", shape)["instances"]).alias("task", "m"))
    rows = tasks.select("slide_id", "part", "task", F.explode("m").alias("id", "r"))
    return rows.groupBy("slide_id", "part", "task").agg(
        F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first_id"), F.sum("r.x_min").alias("x_sum")
    )


STYLE_SQL = """case task when 'Lumen' then case type_id when 0 then '0,0,0,0' when 1 then '131,235,52,0' else '255,0,255,0' end
 when 'Gland' then case type_id when 0 then '0,0,0,0' when 1 then '255,255,0,0' when 2 then '177,52,235,0' when 3 then '0,255,255,0' when 4 then '255,165,0,0' else '255,255,0,0' end
 else case type_id when 0 then '0,0,0,1' when 1 then '0,0,255,1' when 2 then '0,255,0,1' when 3 then '255,0,255,1' when 4 then '176,244,230,1' when 5 then '0,191,255,1' else '255,165,0,1' end end rgba,
 case task when 'Lumen' then case when type_id=0 then 'nolabel' else 'lumen' end
 when 'Gland' then case type_id when 0 then 'nolabel' when 1 then 'healthy' when 2 then 'adenomatous' when 3 then 'moderately differentiated' when 4 then 'poorly differentiated' else 'healthy' end
 else case type_id when 0 then 'nolabel' when 1 then 'neutrophil' when 2 then 'epithelial' when 3 then 'lymphocyte' when 4 then 'plasma' when 5 then 'eosinophil' else 'connective' end end grp,
 case when task='Nuclei' then 3 else 12 end lw"""


@query(
    "viewer_polylines",
    f"""with s as (select *, {STYLE_SQL} from fx_inst), p as (select *, cast(ceil(x_min*0.4) as int) a, cast(ceil(y_min*0.4) as int) b, cast(ceil(x_max*0.4) as int) c, cast(ceil(y_max*0.4) as int) d from s)
select inst_id, '{{"fillColor":"rgba('||rgba||')","id":"'||lpad(cast(inst_id as varchar),24,'0')||'","label":{{"value":"nuclei"}},"group":"'||grp||'","lineColor":"rgb('||regexp_replace(rgba,',[0-9]+$','')||')","type":"polyline","closed":true,"points":[['||a||','||b||',0],['||c||','||b||',0],['||c||','||d||',0],['||a||','||d||',0]],"lineWidth":'||lw||'}}' element from p""",
)
def viewer_polylines(fx: Fixtures) -> DataFrame:
    rows = fx["fx_inst"].withColumn("contour", corners(BOX)).withColumn("seq", F.col("inst_id"))
    return ex.viewer_annotations(rows, "contour", 0.4).select("inst_id", "element")


@query(
    "viewer_points",
    f"""with s as (select *, {STYLE_SQL} from fx_inst)
select inst_id, '{{"fillColor":"rgba('||rgba||')","id":"'||lpad(cast(inst_id as varchar),24,'0')||'","label":{{"value":"nuclei"}},"group":"'||grp||'","lineColor":"rgb(0, 0, 0)","type":"point","center":['||cast(floor((x_min+x_max)/2.0*0.5) as int)||','||cast(floor((y_min+y_max)/2.0*0.5) as int)||',0],"lineWidth":'||lw||'}}' element from s""",
)
def viewer_points(fx: Fixtures) -> DataFrame:
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    rows = fx["fx_inst"].withColumn("cx", middle("x_min", "x_max")).withColumn("cy", middle("y_min", "y_max")).withColumn("seq", F.col("inst_id"))
    return ex.viewer_annotations(rows, "centroid", 0.5).select("inst_id", "element")


@query(
    "viewer_documents",
    f"""with s as (select *, {STYLE_SQL} from fx_inst),
e as (select slide_id, inst_id, '{{"fillColor":"rgba('||rgba||')","id":"'||lpad(cast(inst_id as varchar),24,'0')||'","label":{{"value":"nuclei"}},"group":"'||grp||'","lineColor":"rgb(0, 0, 0)","type":"point","center":['||cast(floor((x_min+x_max)/2.0*0.5) as int)||','||cast(floor((y_min+y_max)/2.0*0.5) as int)||',0],"lineWidth":'||lw||'}}' element from s),
p as (select *, cast(floor((row_number() over (partition by slide_id order by inst_id)-1)/100.0) as int)+1 part from e)
select slide_id, part, cast(count(*) as int) elements, md5('{{"annotation":{{"description":"","elements":['||string_agg(element, ',' order by inst_id)||'],"name":"tessera"}}}}') document from p group by slide_id, part""",
)
def viewer_documents(fx: Fixtures) -> DataFrame:
    """Documents of at most a hundred elements each."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    rows = fx["fx_inst"].withColumn("cx", middle("x_min", "x_max")).withColumn("cy", middle("y_min", "y_max")).withColumn("seq", F.col("inst_id"))
    made = ex.viewer_documents(ex.viewer_annotations(rows, "centroid", 0.5), "tessera", 100)
    return made.withColumn("document", F.md5("document"))


@query(
    "overlay_lines",
    """select inst_id, cast(trunc((x_min-1500)*2.0) as int) x0, cast(trunc((y_min-900)*2.0) as int) y0, case when task='Nuclei' then 3 else 12 end line_width
from fx_inst where x_max>=1500 and x_min<=5500 and y_max>=900 and y_min<=3900""",
)
def overlay_lines(fx: Fixtures) -> DataFrame:
    lines = ex.overlay_lines(fx["fx_inst"].withColumn("contour", corners(BOX)), 1500, 900, 4000, 3000, 2.0)
    return lines.select("inst_id", F.col("line")[0]["x"].alias("x0"), F.col("line")[0]["y"].alias("y0"), "line_width")


@query(
    "outlines",
    "select image_id, inst_id, cast(4*(max(x)-min(x)) as int) points, min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max from fx_true_px group by image_id, inst_id",
)
def traced_outlines(fx: Fixtures) -> DataFrame:
    """The fixture's instances are squares of side s, whose border has 4 (s - 1) pixels."""
    ring = outlines(fx["fx_true_px"], ["image_id", "inst_id"])
    xs, ys = F.transform("contour", lambda p: p["x"]), F.transform("contour", lambda p: p["y"])
    return ring.select(
        "image_id",
        "inst_id",
        F.size("contour").alias("points"),
        F.array_min(xs).alias("x_min"),
        F.array_max(xs).alias("x_max"),
        F.array_min(ys).alias("y_min"),
        F.array_max(ys).alias("y_max"),
    )


@query(
    "outlines_pieces",
    """select image_id, cls, min(x) x_min, min(y) y_min, cast(4*(max(x)-min(x)) as int) points,
 md5(string_agg(x||','||y, ';' order by y, x) filter (x in (x0,x1) or y in (y0,y1))) border
 from (select *, min(x) over w x0, max(x) over w x1, min(y) over w y0, max(y) over w y1 from fx_true_px window w as (partition by image_id, inst_id))
 group by image_id, cls, inst_id""",
)
def outlines_pieces(fx: Fixtures) -> DataFrame:
    """All instances of a class under one id: an outline for each of its pieces, all points hashed."""
    ring = outlines(fx["fx_true_px"].select("image_id", "cls", "x", "y"), ["image_id", "cls"])
    xs, ys = F.transform("contour", lambda p: p["x"]), F.transform("contour", lambda p: p["y"])
    points = F.sort_array(F.transform("contour", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    listed = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"])), ";")
    return ring.select("image_id", "cls", F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.size("contour").alias("points"), F.md5(listed).alias("border"))


WALKED = """with recursive px as materialized (select image_id, inst_id, x, y from fx_patchwork),
sd(k, ox, oy, dx, dy) as (values (0, 0, -1, 1, 0), (1, 1, 0, 0, 1), (2, 0, 1, -1, 0), (3, -1, 0, 0, -1)),
e as materialized (select p.*, k, coalesce(a.x, b.x, p.x) nx, coalesce(a.y, b.y, p.y) ny, case when a.x is not null then (k+3)%4 when b.x is not null then k else (k+1)%4 end nk
 from px p join sd on true left join px o on o.image_id=p.image_id and o.inst_id=p.inst_id and o.x=p.x+ox and o.y=p.y+oy
 left join px b on b.image_id=p.image_id and b.inst_id=p.inst_id and b.x=p.x+dx and b.y=p.y+dy
 left join px a on a.image_id=p.image_id and a.inst_id=p.inst_id and a.x=p.x+dx+ox and a.y=p.y+dy+oy where o.x is null),
st as (select image_id, inst_id, x, y from e where k=0 and not exists (select 1 from px n where n.image_id=e.image_id and n.inst_id=e.inst_id and ((n.x=e.x-1 and n.y in (e.y, e.y-1)) or (n.x=e.x+1 and n.y=e.y-1)))),
wk(image_id, inst_id, sx, sy, i, x, y, k) as (select image_id, inst_id, x, y, 0, x, y, 0 from st
 union all select w.image_id, w.inst_id, sx, sy, i+1, e.nx, e.ny, e.nk from wk w join e on e.image_id=w.image_id and e.inst_id=w.inst_id and e.x=w.x and e.y=w.y and e.k=w.k
 where not (e.nx=sx and e.ny=sy and e.nk=0)),
ok as (select *, min((cast(y as bigint)*4096+x)*4+k) over (partition by image_id, inst_id, sx, sy) low from wk),
vi as (select *, lag(x) over w px, lag(y) over w py, max(i) over (partition by image_id, inst_id, sx, sy) top from ok where low=(cast(sy as bigint)*4096+sx)*4
 window w as (partition by image_id, inst_id, sx, sy order by i)),
pt as (select image_id, inst_id, sx, sy, i, x, y from vi where i=0 or ((px<>x or py<>y) and not (x=sx and y=sy and i=(select max(j.i) from vi j where j.image_id=vi.image_id and j.inst_id=vi.inst_id and j.sx=vi.sx and j.sy=vi.sy and (j.px<>j.x or j.py<>j.y)))))"""


@query(
    "outline_points",
    WALKED
    + """, nb as (select *, count(*) over r n, coalesce(lag(x) over o, last_value(x) over r) ax, coalesce(lag(y) over o, last_value(y) over r) ay,
 coalesce(lead(x) over o, first_value(x) over r) bx, coalesce(lead(y) over o, first_value(y) over r) by_ from pt
 window o as (partition by image_id, inst_id, sx, sy order by i), r as (partition by image_id, inst_id, sx, sy order by i rows between unbounded preceding and unbounded following))
select image_id, inst_id, sx x, sy y, cast(count(*) as int) points, md5(string_agg(x||','||y, ';' order by i)) border from nb
where n<3 or x-ax<>bx-x or y-ay<>by_-y group by image_id, inst_id, sx, sy""",
)
def outline_points(fx: Fixtures) -> DataFrame:
    """Outlines of irregular pieces with holes, corner points only, in order."""
    ring = outlines(fx["fx_patchwork"], ["image_id", "inst_id"], simplify=True)
    listed = F.array_join(F.transform("contour", lambda p: F.concat_ws(",", p["x"], p["y"])), ";")
    first = F.element_at("contour", 1)
    return ring.select("image_id", "inst_id", first["x"].alias("x"), first["y"].alias("y"), F.size("contour").alias("points"), F.md5(listed).alias("border"))
