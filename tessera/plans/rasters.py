"""Queries on raster geometry and photometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import rasters as ra
from tessera.operators import tissue as ti
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query
from tessera.session import shared_folder
from tessera.sources import raster_store as rs


def grey(fx: Fixtures) -> DataFrame:
    return fx["fx_grey"].select("image_id", "x", "y", "v", F.lit(8).alias("w"), F.lit(8).alias("h"))


def blob(fx: Fixtures) -> DataFrame:
    return fx["fx_blob"].select("image_id", "x", "y", "v", F.lit(64).alias("w"), F.lit(64).alias("h"))


PXV = ["image_id", "x", "y", "v"]


@query("centre_crop", "select image_id, x-9 x, y-12 y, v from fx_blob where x between 9 and 53 and y between 12 and 50")
def centre_crop(fx: Fixtures) -> DataFrame:
    return ra.centre_crop(blob(fx), 45, 39).select(*PXV)


@query(
    "centre_pad",
    """select i.image_id, cast(a.k as int) x, cast(b.k as int) y, coalesce(g.v,255) v from (select distinct image_id from fx_grey) i join (select unnest(range(13)) k) a on true join (select unnest(range(11)) k) b on true
 left join fx_grey g on g.image_id=i.image_id and g.x=a.k-2 and g.y=b.k-1""",
)
def centre_pad(fx: Fixtures) -> DataFrame:
    px = fx["fx_grey"].select(*PXV)
    frames = px.select("image_id").distinct().select("image_id", F.lit(8).alias("w"), F.lit(8).alias("h"))
    return ra.centre_pad(px, frames, "v", 13, 11)


@query(
    "resize_to_shape",
    "select g.image_id, cast(a.k as int) x, cast(b.k as int) y, v from (select unnest(range(13)) k) a join (select unnest(range(5)) k) b on true join fx_grey g on g.x=cast(floor(a.k*8/13.0) as int) and g.y=cast(floor(b.k*8/5.0) as int)",
)
def resize_to_shape(fx: Fixtures) -> DataFrame:
    return ra.resize_nearest(grey(fx), F.lit(13), F.lit(5)).select(*PXV)


@query("enlarge_twice", "select image_id, x*2+a.k x, y*2+b.k y, v from fx_blob join (select unnest([0,1]) k) a on true join (select unnest([0,1]) k) b on true")
def enlarge_twice(fx: Fixtures) -> DataFrame:
    return ra.scale_nearest(blob(fx), 2.0).select(*PXV)


@query("shrink_quarter", "select image_id, cast(x/4 as int) x, cast(y/4 as int) y, v from fx_blob where x%4=0 and y%4=0")
def shrink_quarter(fx: Fixtures) -> DataFrame:
    return ra.scale_nearest(blob(fx), 0.25).select(*PXV)


@query(
    "flips_and_turns",
    """select image_id, 'h' op, 7-x x, y, v from fx_grey union all select image_id, 'v', x, 7-y, v from fx_grey union all select image_id, 'r1', y, 7-x, v from fx_grey
 union all select image_id, 'r2', 7-x, 7-y, v from fx_grey union all select image_id, 'r3', 7-y, x, v from fx_grey""",
)
def flips_and_turns(fx: Fixtures) -> DataFrame:
    px = grey(fx)
    made = {"h": ra.flip_horizontal(px), "v": ra.flip_vertical(px), **{f"r{k}": ra.rotate90(px, k) for k in (1, 2, 3)}}
    out = None
    for name, df in made.items():
        df = df.select("image_id", F.lit(name).alias("op"), "x", "y", "v")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "photometric_jitter",
    """with c as (select image_id, x, y, v r, (v*2)%256 g, 255-v b from fx_grey), m as (select image_id, avg(r) mr, avg(g) mg, avg(b) mb from c group by image_id),
t as (select c.*, 1.1875 a, cast(round(r*0.299+g*0.587+b*0.114) as double) l, mr, mg, mb from c join m on m.image_id=c.image_id)
select image_id, x, y, cast(floor(least(greatest(r+17.5,0),255)) as int) bright,
 cast(floor(least(greatest(cast(r as double)*a+mr*(1-a),0),255)) as int) con_r, cast(floor(least(greatest(cast(g as double)*a+mg*(1-a),0),255)) as int) con_g, cast(floor(least(greatest(cast(b as double)*a+mb*(1-a),0),255)) as int) con_b,
 cast(floor(least(greatest(cast(r as double)*a+l*(1-a),0),255)) as int) sat_r, cast(floor(least(greatest(cast(g as double)*a+l*(1-a),0),255)) as int) sat_g, cast(floor(least(greatest(cast(b as double)*a+l*(1-a),0),255)) as int) sat_b from t""",
)
def photometric_jitter(fx: Fixtures) -> DataFrame:
    v = F.col("v")
    px = fx["fx_grey"].select("image_id", "x", "y", v.alias("r"), (v * 2 % 256).alias("g"), (255 - v).alias("b"))
    a, ch = F.lit(1.1875), ["r", "g", "b"]
    con = ra.contrast(px, ch, a).withColumnsRenamed({c: "con_" + c for c in ch})
    sat = ra.saturation(px.withColumn("bright", ra.brightness(F.col("r"), F.lit(17.5))), ch, a).withColumnsRenamed({c: "sat_" + c for c in ch})
    return con.join(sat, ["image_id", "x", "y"])


HOOD = """h as (select p.image_id, p.x, p.y, i.k di, j.k dj, n.v from fx_grey p join (select unnest([-1,0,1]) k) i on true join (select unnest([-1,0,1]) k) j on true
 join fx_grey n on n.image_id=p.image_id and n.x=least(greatest(p.x+i.k,0),7) and n.y=least(greatest(p.y+j.k,0),7))"""


@query("gaussian_blur", f"with {HOOD} select image_id, x, y, cast(floor((sum(v*(2-abs(di))*(2-abs(dj)))+8)/16.0) as int) v from h group by image_id, x, y")
def gaussian_blur(fx: Fixtures) -> DataFrame:
    return ra.gaussian_blur(fx["fx_grey"].select(*PXV), "v")


@query("median_blur", f"with {HOOD} select image_id, x, y, list_sort(list(v))[5] v from h group by image_id, x, y")
def median_blur(fx: Fixtures) -> DataFrame:
    return ra.median_blur(fx["fx_grey"].select(*PXV), "v")


def hood(radius: int) -> str:
    """Oracle text: the window round each pixel of the grey images, border replicated."""
    span = f"(select unnest(range({-radius},{radius + 1})) k)"
    return f"""h as (select p.image_id, p.x, p.y, i.k di, j.k dj, n.v from fx_grey p join {span} i on true join {span} j on true
 join fx_grey n on n.image_id=p.image_id and n.x=least(greatest(p.x+i.k,0),7) and n.y=least(greatest(p.y+j.k,0),7))"""


@query(
    "gaussian_blur_wide",
    f"with {hood(3)} select image_id, x, y, cast(floor((sum(v*[1,6,15,20,15,6,1][di+4]*[1,6,15,20,15,6,1][dj+4])+2048)/4096.0) as int) v from h group by image_id, x, y",
)
def gaussian_blur_wide(fx: Fixtures) -> DataFrame:
    return ra.gaussian_blur(fx["fx_grey"].select(*PXV), "v", 7)


@query("median_blur_wide", f"with {hood(2)} select image_id, x, y, list_sort(list(v))[13] v from h group by image_id, x, y")
def median_blur_wide(fx: Fixtures) -> DataFrame:
    return ra.median_blur(fx["fx_grey"].select(*PXV), "v", 5)


@query(
    "reflect_pad",
    """select g.image_id, cast(a.k+5 as int) x, cast(b.k+3 as int) y, v from (select unnest(range(-5,8+9)) k) a join (select unnest(range(-3,8+4)) k) b on true
 join fx_grey g on g.x=case when ((a.k%14)+14)%14<8 then ((a.k%14)+14)%14 else 14-((a.k%14)+14)%14 end and g.y=case when ((b.k%14)+14)%14<8 then ((b.k%14)+14)%14 else 14-((b.k%14)+14)%14 end""",
)
def reflect_pad(fx: Fixtures) -> DataFrame:
    return ra.reflect_pad(grey(fx), 5, 3, 9, 4).select(*PXV)


@query(
    "normalised_values",
    "select g.image_id, x, y, cast(floor(255*v/cast(t as double)) as int) v, round((least(greatest(v,40),200)-40)/160.0,6)::double r from fx_grey g join (select image_id, max(v) t from fx_grey group by image_id) m on m.image_id=g.image_id",
)
def normalised_values(fx: Fixtures) -> DataFrame:
    px = fx["fx_grey"].select(*PXV).withColumn("r", F.round(ra.rescale(F.col("v").cast("double"), 40.0, 200.0), 6))
    return ra.normalise(px, "v")


@query(
    "masked_class_map",
    "select p.image_id, p.x, p.y, case when d.x is null then 0 else p.cls end cls from fx_patchwork p left join fx_dil d on d.image_id=p.image_id and d.x=p.x and d.y=p.y",
)
def masked_class_map(fx: Fixtures) -> DataFrame:
    return ra.masked_classes(fx["fx_patchwork"].select("image_id", "x", "y", "cls"), fx["fx_dil"])


@query(
    "tissue_mask",
    "select g.image_id, cast(a.k as int) x, cast(b.k as int) y from (select unnest(range(20)) k) a join (select unnest(range(12)) k) b on true join fx_grey g on g.x=cast(floor(a.k*8/20.0) as int) and g.y=cast(floor(b.k*8/12.0) as int) where v-120>0",
)
def tissue_mask(fx: Fixtures) -> DataFrame:
    from tessera.sources.masks import load_mask

    return load_mask(grey(fx).withColumn("v", F.col("v") - 120), F.lit(20), F.lit(12)).select("image_id", "x", "y")


@query(
    "otsu_thresholds",
    """with s as (select image_id, cast(min(v) as double) lo, cast(max(v) as double) hi from fx_grey group by image_id),
b as (select g.image_id, lo, case when hi>lo then (hi-lo)/256 else 1.0 end wd, v from fx_grey g join s on s.image_id=g.image_id),
h as (select image_id, lo, wd, least(cast(floor((v-lo)/wd) as int),255) bin, count(*) n from b group by all),
c as (select image_id, bin, lo+(bin+0.5)*wd ctr, n from h),
k as (select image_id, bin, ctr, sum(n) over w n0, sum(n*ctr) over w s0, sum(n) over (partition by image_id) na, sum(n*ctr) over (partition by image_id) sa from c window w as (partition by image_id order by bin rows unbounded preceding)),
v as (select image_id, bin, ctr, case when na>n0 then round(n0*(na-n0)*(s0/n0-(sa-s0)/(na-n0))*(s0/n0-(sa-s0)/(na-n0)),6) else -1 end var from k)
select image_id, round(ctr,6) threshold from (select *, row_number() over (partition by image_id order by var desc, bin) rn from v) where rn=1""",
)
def otsu_thresholds(fx: Fixtures) -> DataFrame:
    return ti.otsu_thresholds(fx["fx_grey"], "image_id", "v").withColumn("threshold", F.round("threshold", 6))


@query(
    "local_entropy",
    """with o as (select a.k i, b.k j from (select unnest(range(-4,5)) k) a join (select unnest(range(-4,5)) k) b on a.k*a.k+b.k*b.k<=16),
q as (select image_id, x, y, cast(floor(v/8.0) as int) v from fx_grey),
c as (select p.image_id, p.x, p.y, n.v, count(*) c from q p join o on true join q n on n.image_id=p.image_id and n.x=p.x+i and n.y=p.y+j group by all),
t as (select *, c/sum(c) over (partition by image_id, x, y) f from c)
select image_id, x, y, abs(round(-sum(f*log2(f)),6)) entropy from t group by all""",
)
def local_entropy(fx: Fixtures) -> DataFrame:
    px = fx["fx_grey"].select("image_id", "x", "y", F.floor(F.col("v") / 8.0).cast("int").alias("v"))
    return ti.local_entropy(px, "v").select("image_id", "x", "y", F.abs(F.round("entropy", 6)).alias("entropy"))


@query(
    "stain_entropy",
    """with o as (select a.k i, b.k j from (select unnest(range(-4,5)) k) a join (select unnest(range(-4,5)) k) b on a.k*a.k+b.k*b.k<=16),
q as (select image_id, x, y, unnest([0, 1, 2]) ch, unnest([cast(floor(v/8.0) as int), (v*7)%23, cast(floor((255-v)/16.0) as int)]) v from fx_grey),
c as (select p.image_id, p.x, p.y, p.ch, n.v, count(*) c from q p join o on true join q n on n.image_id=p.image_id and n.ch=p.ch and n.x=p.x+i and n.y=p.y+j group by all),
t as (select *, c/sum(c) over (partition by image_id, x, y, ch) f from c)
select image_id, x, y, round(-sum(case when ch=2 then -1 else 1 end*f*log2(f)),5)+0.0 entropy from t group by all""",
)
def stain_entropy(fx: Fixtures) -> DataFrame:
    """Combined entropy of three channels made from the grey value."""
    v = F.col("v")
    px = fx["fx_grey"].select("image_id", "x", "y", F.floor(v / 8.0).alias("h"), (v * 7 % 23).alias("e"), F.floor((255 - v) / 16.0).alias("d"))
    return ti.stain_entropy(px, "h", "e", "d").select("image_id", "x", "y", (F.round("entropy", 5) + 0.0).alias("entropy"))


@query(
    "window_read",
    """select w.image_id, count(*) n, cast(sum(v) as bigint) v_sum from fx_blob b join (select image_id, 10+image_id%7 x0, 20 y0 from fx_blob group by image_id) w on w.image_id=b.image_id
 where b.x between w.x0 and w.x0+24 and b.y between w.y0 and w.y0+17 group by w.image_id""",
)
def window_read(fx: Fixtures) -> DataFrame:
    """The rasters are written in Z-order, then a window of each is read."""
    rows = _stored(fx, 1, F.lit(10) + F.col("image_id") % 7, F.lit(20), 25, 18, 1.0)
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("v_sum"))


def _stored(fx: Fixtures, levels: int, x0: Column, y0: Column, w: int, h: int, factor: float) -> DataFrame:
    path = shared_folder(fx.spark, "raster")
    rs.write_packed(fx["fx_blob"].withColumn("a", F.lit(255)), path, levels)
    windows = fx["fx_blob"].select("image_id").distinct().select("image_id", x0.alias("x0"), y0.alias("y0"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    return rs.read_windows(fx.spark, path, windows, factor, levels)


@query(
    "window_at_resolution",
    """with half as (select image_id, x>>1 x, y>>1 y, cast(floor(avg(v)) as int) v from fx_blob group by all),
o as (select image_id, cast(image_id%5+a as int) x, cast(3+b as int) y from (select distinct image_id from fx_blob) join (select unnest(range(15)) a) on true join (select unnest(range(12)) b) on true)
select o.image_id, o.x, o.y, half.v from o join half on half.image_id=o.image_id and half.x=floor((o.x+0.5)*1.5) and half.y=floor((o.y+0.5)*1.5)""",
)
def window_at_resolution(fx: Fixtures) -> DataFrame:
    """Windows whose pixels are three base pixels wide: the level of twice the pixel size is read."""
    return _stored(fx, 3, F.col("image_id") % 5, F.lit(3), 15, 12, 3.0).select("image_id", "x", "y", "v")
