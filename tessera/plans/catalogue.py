"""Queries on file listings, manifests and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import nth_part, numbered, running_totals
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query
from tessera.sources import listing as ls
from tessera.sources.slides import pick_level
from tessera.sources.styles import with_style


@query("slides_by_extension", "select distinct path, dir from fx_files where path like '%.svs' or path like '%.tif' or path like '%.ndpi'")
def slides_by_extension(fx: Fixtures) -> DataFrame:
    return ls.collect_slides(fx["fx_files"].select("path", "dir"), "svs, *.tif;.ndpi")


@query(
    "slides_with_fallback",
    """with r as (select path, dir, case when path like '%.mrxs' then 0 when path like '%.svs' then 1 when path like '%.tif' then 2 when path like '%.tiff' then 3 when path like '%.ndpi' then 4 else 7 end rk from fx_files)
select path, dir from r where rk=(select min(rk) from r b where b.dir=r.dir)""",
)
def slides_with_fallback(fx: Fixtures) -> DataFrame:
    return ls.collect_slides(fx["fx_files"].select("path", "dir"), ".mrxs", ["dir"])


@query("files_by_suffix", "select path from fx_files where path like '%.tif' or path like '%.png' order by path")
def files_by_suffix(fx: Fixtures) -> DataFrame:
    return fx["fx_files"].where(ls.has_extension(F.col("path"), [".tif", ".png"])).select("path").orderBy("path")


@query("files_by_folder", "select dir, path, row_number() over (partition by dir order by path) place from fx_files")
def files_by_folder(fx: Fixtures) -> DataFrame:
    return numbered(fx["fx_files"].select("dir", "path"), ["dir"], ["path"], "place")


@query(
    "file_name_parts",
    """select page_id, regexp_extract(url,'([^/]*)$',1) name, case when regexp_matches(regexp_extract(url,'([^/]*)$',1),'[^.]\\.[^.]+$') then regexp_extract(regexp_extract(url,'([^/]*)$',1),'(\\.[^.]+)$',1) else '' end ext,
 case when regexp_matches(regexp_extract(url,'([^/]*)$',1),'[^.]\\.[^.]+$') then regexp_replace(regexp_extract(url,'([^/]*)$',1),'\\.[^.]+$','') else regexp_extract(url,'([^/]*)$',1) end stem,
 regexp_replace(url,'/[^/]*$','') dir, lpad(cast(page_id as varchar),24,'0') padded, 'rgba('||page_id%256||','||0||','||255||','||1||')' rgba from pages""",
)
def file_name_parts(fx: Fixtures) -> DataFrame:
    url = F.col("url")
    return fx["pages"].select(
        "page_id",
        ls.file_name(url).alias("name"),
        ls.extension(url).alias("ext"),
        ls.stem(url).alias("stem"),
        ls.folder(url).alias("dir"),
        F.lpad(F.col("page_id").cast("string"), 24, "0").alias("padded"),
        F.format_string("rgba(%d,%d,%d,%d)", F.col("page_id") % 256, F.lit(0), F.lit(255), F.lit(1)).alias("rgba"),
    )


@query(
    "slides_with_masks",
    """with s as (select '/slides/'||s_name||'.svs' path, s_name from supplier), m as (select '/masks/'||s_name||'.png' mask_path, s_name from supplier where s_acctbal>0)
select path, mask_path from s left join m on m.s_name=s.s_name where mask_path is not null or not exists (select 1 from m)""",
)
def slides_with_masks(fx: Fixtures) -> DataFrame:
    slides = fx["supplier"].select(F.concat(F.lit("/slides/"), "s_name", F.lit(".svs")).alias("path"))
    masks = fx["supplier"].where("s_acctbal > 0").select(F.concat(F.lit("/masks/"), "s_name", F.lit(".png")).alias("path"))
    return ls.with_masks(slides, masks)


@query(
    "slides_without_any_mask",
    "select '/slides/'||s_name||'.svs' path, cast(null as varchar) mask_path from supplier",
)
def slides_without_any_mask(fx: Fixtures) -> DataFrame:
    slides = fx["supplier"].select(F.concat(F.lit("/slides/"), "s_name", F.lit(".svs")).alias("path"))
    masks = fx["supplier"].select(F.concat(F.lit("/masks/other_"), "s_name", F.lit(".png")).alias("path"))
    return ls.with_masks(slides, masks)


@query(
    "annotation_of_image",
    """with w as (select 'img'||image_id stem, dataset from fx_manifest),
f as (select '/ann/img'||image_id||'.tif' path, 'img'||image_id stem, 2 rk from fx_manifest where w>300 union all select '/ann/img'||image_id||'.png', 'img'||image_id, 0 from fx_manifest where h>400 union all select '/ann/img'||image_id||'.mat', 'img'||image_id, 9 from fx_manifest)
select w.stem, w.dataset, (select path from f where f.stem=w.stem and rk<9 order by rk limit 1) found from w where exists (select 1 from f where f.stem=w.stem and rk<9)""",
)
def annotation_of_image(fx: Fixtures) -> DataFrame:
    name = F.concat(F.lit("img"), F.col("image_id"))
    wanted = fx["fx_manifest"].select(name.alias("stem"), "dataset")
    offered = lambda cond, ext: fx["fx_manifest"].where(cond).select(F.concat(F.lit("/ann/"), name, F.lit(ext)).alias("path"))
    files = offered("w > 300", ".tif").unionByName(offered("h > 400", ".png")).unionByName(offered("true", ".mat"))
    return ls.first_existing(wanted, files, ["stem"], ls.IMAGE_EXTENSIONS)


@query(
    "class_image_labels",
    """with w as (select 'img'||image_id stem, fold label from fx_manifest),
f as (select '/img/img'||image_id||'.png' path, 'img'||image_id stem, cast(null as varchar) subdir from fx_manifest where w>500 union all select '/img/'||subdir||'/img'||image_id||'.png', 'img'||image_id, subdir from fx_manifest where h>300),
b as (select *, row_number() over (partition by stem order by (subdir is not null), subdir, path) rn from f)
select w.stem, b.path, case when b.subdir is null then w.label else case b.subdir when 'en' then 0 when 'de' then 1 when 'fr' then 2 else 0 end end label from w join b on b.stem=w.stem and rn=1""",
)
def class_image_labels(fx: Fixtures) -> DataFrame:
    name = F.concat(F.lit("img"), F.col("image_id"))
    m = fx["fx_manifest"]
    wanted = m.select(name.alias("stem"), F.col("fold").alias("label"))
    flat = m.where("w > 500").select(F.concat(F.lit("/img/"), name, F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("subdir"))
    nested = m.where("h > 300").select(F.concat(F.lit("/img/"), "subdir", F.lit("/"), name, F.lit(".png")).alias("path"), "subdir")
    return ls.class_images(wanted, flat.unionByName(nested), ["en", "de", "fr"])


@query(
    "manifest_splits",
    """select 'split' habit, image_id from fx_manifest where split='valid' union all select 'Split', image_id from fx_manifest where split='test'
 union all select 'fold_1', image_id from fx_manifest where fold=1 union all select 'train', image_id from fx_manifest where fold<>2 union all select 'myfold_2', image_id from fx_manifest where fold=0 union all select 'none', image_id from fx_manifest""",
)
def manifest_splits(fx: Fixtures) -> DataFrame:
    m, word = fx["fx_manifest"], lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit("other"))
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "valid", 2).otherwise(3)
    tables = {
        "split": (m.select("image_id", F.concat(F.lit(" "), F.initcap("split")).alias("split")), "valid", 0),
        "Split": (m.select("image_id", code.alias("Split")), "test", 0),
        "fold_1": (m.select("image_id", word(F.col("fold") == 1, "train").alias("fold_1")), "train", 1),
        "train": (m.select("image_id", word(F.col("fold") != 2, "train").alias("train")), "train", 0),
        "myfold_2": (m.select("image_id", word(F.col("fold") == 0, "test").alias("myfold_2")), "test", 2),
        "none": (m.select("image_id"), "train", 0),
    }
    out = None
    for habit, (df, split, fold) in tables.items():
        df = ls.in_split(df, split, fold).select(F.lit(habit).alias("habit"), "image_id")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "manifest_big_enough",
    "select split, count(*) n, cast(sum(case when w>=448 and h>=448 then 1 else 0 end) as bigint) seg from fx_manifest where w>=144 and h>=144 group by split",
)
def manifest_big_enough(fx: Fixtures) -> DataFrame:
    usable = ls.big_enough(fx["fx_manifest"], "class")
    seg = ls.big_enough(fx["fx_manifest"], "seg").groupBy("split").agg(F.count("*").alias("seg"))
    return usable.groupBy("split").agg(F.count("*").alias("n")).join(seg, "split")


@query(
    "shard_of_files",
    "select path from (select path, row_number() over (order by path) rn from fx_files) where rn>(select count(*) from fx_files)/8*2 and rn<=(select count(*) from fx_files)/8*3",
)
def shard_of_files(fx: Fixtures) -> DataFrame:
    return nth_part(fx["fx_files"].select("path"), ["path"], index=3, parts=8)


@query(
    "annotation_channels",
    """with k as (select source path, lang||'_'||case when n_chars>2000 then 'Inst_Map' when n_chars>1000 then 'type_map' else 'class' end as key, cast(n_chars%40 as int) h, cast(n_chars%37 as int) w from documents),
c as (select unnest(['INST','TYPE']) channel)
select p.path, c.channel, (select min(key) from k where k.path=p.path and h>10 and w>10 and lower(key) like '%'||lower(c.channel)||'%') as key from (select distinct path from k) p join c on true""",
)
def annotation_channels(fx: Fixtures) -> DataFrame:
    n = F.col("n_chars")
    kind = F.when(n > 2000, "Inst_Map").when(n > 1000, "type_map").otherwise("class")
    catalogue = fx["documents"].select(
        F.col("source").alias("path"), F.concat("lang", F.lit("_"), kind).alias("key"), (n % 40).cast("int").alias("h"), (n % 37).cast("int").alias("w")
    )
    return ls.channel_keys(catalogue, ["INST", "TYPE"])


@query(
    "pyramid_levels",
    """with lv as (select slide_id, k level, (case when slide_id%2=0 then 40.0 else 20.0 end)/power(2,k) mag from fx_slides join (select unnest(range(4)) k) on true),
rq as (select slide_id, cast(r as double) req_mag from fx_slides join (select unnest([50.0,40.0,15.0,10.0,3.0]) r) on true),
j as (select rq.slide_id, req_mag, level, mag, row_number() over (partition by rq.slide_id, req_mag order by (mag<req_mag), case when mag>=req_mag then mag else -mag end) rn from rq join lv on lv.slide_id=rq.slide_id)
select slide_id, req_mag, cast(level as int) level, req_mag/mag scale from j where rn=1""",
)
def pyramid_levels(fx: Fixtures) -> DataFrame:
    base = F.when(F.col("slide_id") % 2 == 0, 40.0).otherwise(20.0)
    levels = fx["fx_slides"].select("slide_id", base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    levels = levels.select("slide_id", "level", (F.col("base") / F.pow(F.lit(2.0), F.col("level"))).alias("mag"))
    requests = fx["fx_slides"].select("slide_id", F.explode(F.array(*[F.lit(v) for v in (50.0, 40.0, 15.0, 10.0, 3.0)])).alias("req_mag"))
    return pick_level(requests, levels)


@query(
    "styled_instances",
    """select inst_id, task, case task when 'Lumen' then case when type_id=0 then 'nolabel' else 'lumen' end
 when 'Gland' then case type_id when 0 then 'nolabel' when 1 then 'healthy' when 2 then 'adenomatous' when 3 then 'moderately differentiated' when 4 then 'poorly differentiated' else 'healthy' end
 else case type_id when 0 then 'nolabel' when 1 then 'neutrophil' when 2 then 'epithelial' when 3 then 'lymphocyte' when 4 then 'plasma' when 5 then 'eosinophil' else 'connective' end end type_name,
 case when task='Nuclei' then 3 else 12 end line_width,
 case task when 'Lumen' then case type_id when 0 then 0 when 1 then 131 else 255 end when 'Gland' then case type_id when 0 then 0 when 2 then 177 when 3 then 0 else 255 end else case type_id when 3 then 255 when 4 then 176 when 6 then 255 else 0 end end red from fx_inst""",
)
def styled_instances(fx: Fixtures) -> DataFrame:
    return with_style(fx["fx_inst"]).select("inst_id", "task", "type_name", "line_width", F.col("colour")[0].alias("red"))


@query(
    "channel_offsets",
    """with h as (select p_brand model, p_partkey pos, case when p_type like 'E%' then 'INST' else 'TYPE' end kind, p_size n from part),
s as (select *, case when kind='INST' then n-1 else 1 end width from h)
select model, pos, cast(sum(width) over (partition by model order by pos rows unbounded preceding)-width as bigint) first_channel, cast(sum(width) over (partition by model order by pos rows unbounded preceding) as bigint) end_channel from s""",
)
def channel_offsets(fx: Fixtures) -> DataFrame:
    """Channel range of every head of a model: instance heads drop the background, others use one."""
    heads = fx["part"].select(
        F.col("p_brand").alias("model"), F.col("p_partkey").alias("pos"), F.col("p_type").startswith("E").alias("inst"), F.col("p_size").alias("n")
    )
    width = F.when(F.col("inst"), F.col("n") - 1).otherwise(F.lit(1)).cast("long")
    placed = running_totals(heads, ["model"], ["pos"], {"end_channel": width})
    return placed.select("model", "pos", (F.col("end_channel") - width).alias("first_channel"), "end_channel")


@query(
    "companion_files",
    """with w as (select distinct image_id, dir, path, regexp_replace(regexp_replace(path, '.*/', ''), '[.][^.]*$', '') st from fx_files where path like '%.svs' or path like '%.tif')
select path, case when image_id%3=0 then '/data/thumb/'||st||'.png' when image_id%5=0 then '/thumb/'||st||'.png' when image_id%2=0 then '/data/'||dir||'/thumb/'||st||'.png' end found from w""",
)
def companion_files(fx: Fixtures) -> DataFrame:
    """Thumbnails beside the folder of a file, above it, or in it, whichever exists first."""
    slides = fx["fx_files"].where("path like '%.svs' or path like '%.tif'").select("image_id", "dir", "path").distinct()
    name = F.concat(F.regexp_replace(F.regexp_replace("path", ".*/", ""), "[.][^.]*$", ""), F.lit(".png"))
    thumbs = F.array(
        F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("/data/thumb/"), name)),
        F.when(F.col("image_id") % 5 == 0, F.concat(F.lit("/thumb/"), name)),
        F.when(F.col("image_id") % 2 == 0, F.concat(F.lit("/data/"), F.col("dir"), F.lit("/thumb/"), name)),
    )
    offered = slides.select(F.explode(F.array_compact(thumbs)).alias("path"))
    return ls.companion(slides.select("path"), offered, [(1, "thumb"), (2, "thumb"), (0, "thumb")], ".png")
