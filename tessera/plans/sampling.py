"""Queries on sampling, crops, augmentation and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.losses import HEADS
from tessera.operators import sampling as sa
from tessera.operators.series import smoothed
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query


def samples(fx: Fixtures) -> DataFrame:
    group = F.when(F.col("dataset") < "src3", F.lit("seg")).otherwise(F.lit("cls"))
    return fx["fx_manifest"].select(F.col("image_id").alias("sample_id"), F.col("dataset").alias("task"), group.alias("super"))


def u(text: str) -> str:
    """Oracle text of a seeded draw."""
    return f"(cast('0x'||substr(md5({text}),1,8) as bigint)/4294967296.0::double)"


SAMPLES = """sm as (select image_id sample_id, dataset task, case when dataset<'src3' then 'seg' else 'cls' end super from fx_manifest),
sz as (select super, task, count(*) n, row_number() over (partition by super order by task)-1 ti from sm group by super, task),
rk as (select task, sample_id, row_number() over (partition by task order by sample_id)-1 rank from sm),
bt as (select unnest(range(greatest(1,(select count(*) from sm)//16))) batch)"""


@query(
    "mixed_batches",
    f"""with {SAMPLES}, g as (select batch, case when {u("'7|group|'||batch")}<0.7 then 'seg' else 'cls' end super from bt),
s as (select g.batch, g.super, unnest(range(16)) slot from g),
t as (select s.batch, s.slot, s.super, cast(floor({u("'7|task|'||batch||'|'||slot")}*(select count(*) from sz where sz.super=s.super)) as bigint) ti from s),
c as (select t.batch, t.slot, sz.task, cast(floor({u("'7|sample|'||batch||'|'||slot")}*sz.n) as bigint) rank from t join sz on sz.super=t.super and sz.ti=t.ti)
select c.batch, cast(c.slot as int) slot, c.task, rk.sample_id from c join rk on rk.task=c.task and rk.rank=c.rank""",
)
def mixed_batches(fx: Fixtures) -> DataFrame:
    return sa.sample_batches(samples(fx), 16, seed=7)


@query(
    "fixed_batches",
    f"""with recursive {SAMPLES}, g as (select batch, case when {u("'7|group|'||batch")}<0.7 then 'seg' else 'cls' end super from bt),
t as (select g.batch, sz.task, sz.n from g join sz on sz.super=g.super and sz.ti=cast(floor({u("'7|task|'||batch")}*(select count(*) from sz z where z.super=g.super)) as bigint)),
fl(batch, task, n, j, s) as (select batch, task, n, n-16, cast([] as bigint[]) from t where n>=16
 union all select batch, task, n, j+1, list_append(s, case when list_contains(s, c) then j else c end) from (select *, cast(floor({u("'7|distinct|'||batch||'|'||j")}*(j+1)) as bigint) c from fl where j<n)),
dr as (select batch, task, unnest(s) rank from fl where j=n),
c as (select batch, row_number() over (partition by batch order by {u("'7|order|'||batch||'|'||rank")}, rank)-1 slot, task, rank from dr
 union all select batch, slot, task, cast(floor({u("'7|sample|'||batch||'|'||slot")}*n) as bigint) from (select *, unnest(range(16)) slot from t where n<16))
select c.batch, cast(c.slot as int) slot, c.task, rk.sample_id from c join rk on rk.task=c.task and rk.rank=c.rank""",
)
def fixed_batches(fx: Fixtures) -> DataFrame:
    return sa.sample_batches(samples(fx), 16, seed=7, mixed=False)


@query(
    "crop_offsets",
    f"""select image_id, 'eval' phase, cast(floor((w-200)/2.0) as int) x0, cast(floor((h-200)/2.0) as int) y0 from fx_manifest
 union all select image_id, 'train', cast(floor({u("'3|x|'||image_id")}*(w-199)) as int), cast(floor({u("'3|y|'||image_id")}*(h-199)) as int) from fx_manifest""",
)
def crop_offsets(fx: Fixtures) -> DataFrame:
    m = fx["fx_manifest"].select("image_id", "w", "h")
    cut = lambda train, name: sa.crop_offsets(m, 200, train, seed=3).select("image_id", F.lit(name).alias("phase"), "x0", "y0")
    return cut(False, "eval").unionByName(cut(True, "train"))


@query(
    "augmented_images",
    f"""with d as (select distinct image_id, {u("'5|flip_h|'||image_id")}>0.5 fh, {u("'5|flip_v|'||image_id")}>0.5 fv, case when {u("'5|turn|'||image_id")}>0.5 then cast(floor({u("'5|turns|'||image_id")}*4) as int) else 0 end k,
 {u("'5|bright|'||image_id")}>0.5 br, {u("'5|shift|'||image_id")}*60.0::double-30.0::double sh from fx_grey),
a as (select g.image_id, case when fh then 7-x else x end x, case when fv then 7-y else y end y, case when br then cast(floor(least(greatest(v+sh,0),255)) as int) else v end v, k from fx_grey g join d on d.image_id=g.image_id)
select image_id, case k when 0 then x when 1 then y when 2 then 7-x else 7-y end x, case k when 0 then y when 1 then 7-x when 2 then 7-y else x end y, v from a""",
)
def augmented_images(fx: Fixtures) -> DataFrame:
    px = fx["fx_grey"].select("image_id", "x", "y", "v", F.lit(8).alias("w"), F.lit(8).alias("h"))
    return sa.augment(px, 5, [sa.flip_h, sa.flip_v, sa.turn, sa.brighten]).select("image_id", "x", "y", "v")


def batched(fx: Fixtures) -> DataFrame:
    """Documents as samples in batches of sixteen, with the heads their language offers."""
    heads = (
        F.when(F.col("subdir") == "en", F.array(F.lit("Gland-INST"), F.lit("Extra")))
        .when(F.col("subdir") == "de", F.array(F.lit("Nuclei-INST"), F.lit("Nuclei-TYPE")))
        .otherwise(F.array(F.lit("Patch-Class")))
    )
    return fx["fx_manifest"].select(
        F.floor(F.col("image_id") / 16.0).alias("batch"), F.col("image_id").alias("sample_id"), "w", "h", heads.alias("heads")
    )


BATCHED = """bs as (select cast(floor(image_id/16.0) as bigint) batch, image_id sample_id, w, h, case subdir when 'en' then ['Gland-INST','Extra'] when 'de' then ['Nuclei-INST','Nuclei-TYPE'] else ['Patch-Class'] end heads from fx_manifest),
hd as (select unnest(['Lumen-INST','Gland-INST','Nuclei-INST','Nuclei-TYPE','Patch-Class']) head)"""


@query(
    "heads_present",
    f"""with {BATCHED}, r as (select distinct batch, unnest(heads) head from bs)
select coalesce(r.batch,m.batch) batch, coalesce(r.head,m.head) head, r.head is not null has_gt from r full join (select distinct batch, head from bs join hd on true) m on m.batch=r.batch and m.head=r.head""",
)
def heads_present(fx: Fixtures) -> DataFrame:
    return sa.heads_present(batched(fx), HEADS)


@query(
    "aligned_batches",
    f"""with {BATCHED}, t as (select sample_id, unnest(heads) head, (w%10)/cast(4 as double) as value from bs)
select b.batch, b.sample_id, hd.head, coalesce(t.value,0.0)::double as value, t.value is not null has_gt, max(w) over (partition by batch)-w pad_right, max(h) over (partition by batch)-h pad_bottom
from bs b join hd on true left join t on t.sample_id=b.sample_id and t.head=hd.head""",
)
def aligned_batches(fx: Fixtures) -> DataFrame:
    b = batched(fx)
    targets = b.select("sample_id", F.explode("heads").alias("head"), (F.col("w") % 10 / F.lit(4.0)).alias("value"))
    return sa.align_batches(b, targets, HEADS)


@query(
    "smoothed_series_slow",
    """with e as (select l_quantity::double v, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)-1 i from lineitem),
s as (select i, sum(case when i=0 then v else v*(1-0.9999::double) end*exp(-i*ln(0.9999::double))) over (order by i) * exp(i*ln(0.9999::double)) smooth from e)
select i, round(smooth,5) smooth from s""",
)
def smoothed_series_slow(fx: Fixtures) -> DataFrame:
    """One long series whose smoothing reaches far over the chunks it is cut into."""
    from tessera.operators.ranking import numbered

    rows = fx["lineitem"].select(F.lit(0).alias("s"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").cast("double").alias("v"))
    steps = numbered(rows, ["s"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "i").select("s", (F.col("i") - 1).alias("i"), "v")
    return smoothed(steps, "s", "i", "v", alpha=0.9999).select("i", F.round("smooth", 5).alias("smooth"))


@query(
    "smoothed_series",
    """with recursive e as (select user_id, value, row_number() over (partition by user_id order by event_id) rn from events where value is not null),
s(user_id, rn, smooth) as (select user_id, rn, value from e where rn=1 union all select e.user_id, e.rn, 0.95::double*s.smooth+(1-0.95::double)*e.value from s join e on e.user_id=s.user_id and e.rn=s.rn+1)
select user_id, rn, round(ln(1+abs(smooth)),6) log_smooth from s""",
)
def smoothed_series(fx: Fixtures) -> DataFrame:
    from tessera.operators.ranking import numbered

    steps = numbered(fx["events"].where("value is not null").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])
    return smoothed(steps, "user_id", "event_id", "value").select("user_id", "rn", F.round(F.ln(1 + F.abs("smooth")), 6).alias("log_smooth"))
