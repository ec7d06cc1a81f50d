"""Queries on training losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import losses as ls
from tessera.functions.vectors import as_doubles, nll
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query
from tessera.plans.scoring import predictions

# Pixel weights of the nuclei types
TYPE_WEIGHTS = {0: 1.0, 1: 2.0, 2: 1.5, 3: 3.0, 4: 2.5, 5: 1.0, 6: 1.0}


def logits():
    return F.col("logits")


def target():
    return F.col("y_true")


NLL = """nl as (select sample_id, y_true, ln(sum(exp(cast(embedding[k] as double))))-max(case when k=y_true+1 then cast(embedding[k] as double) end) nll
 from (select sample_id, y_true, embedding, unnest(range(1,11)) k from fx_preds) group by sample_id, y_true)"""
WEIGHT = "case y_true when 0 then 1.0 when 1 then 2.0 when 2 then 1.5 when 3 then 3.0 when 4 then 2.5 else 1.0 end"


@query(
    "cross_entropy",
    f"with {NLL} select round(avg(nll),9) ce, round(sum({WEIGHT}*nll)/sum({WEIGHT}),9) weighted_ce from nl",
)
def cross_entropy(fx: Fixtures) -> DataFrame:
    return predictions(fx).agg(
        F.round(ls.cross_entropy(logits(), target()), 9).alias("ce"),
        F.round(ls.cross_entropy(logits(), target(), TYPE_WEIGHTS), 9).alias("weighted_ce"),
    )


@query("cross_entropy_per_sample", f"with {NLL} select sample_id, round(nll,9) nll from nl")
def cross_entropy_per_sample(fx: Fixtures) -> DataFrame:
    return predictions(fx).select("sample_id", F.round(nll(logits(), target()), 9).alias("nll"))


@query(
    "focal_loss",
    f"with {NLL} select y_true batch, round(avg(nll)*avg((1-exp(-nll))*(1-exp(-nll))),9) focal from nl group by y_true",
)
def focal_loss(fx: Fixtures) -> DataFrame:
    return predictions(fx).groupBy(F.col("y_true").alias("batch")).agg(F.round(ls.focal(logits(), target()), 9).alias("focal"))


@query(
    "focal_loss_per_sample",
    f"with {NLL} select sample_id, round((1-exp(-nll))*(1-exp(-nll))*avg(nll) over (partition by y_true),9) loss from nl",
)
def focal_loss_per_sample(fx: Fixtures) -> DataFrame:
    out = ls.focal_per_sample(predictions(fx), "y_true", logits(), target())
    return out.select("sample_id", F.round("loss", 9).alias("loss"))


def dice_rows(fx: Fixtures) -> DataFrame:
    g = fx["fx_grey"]
    v, true = F.col("v") / 255.0, (F.col("x") + F.col("y") + F.col("v")) % 2
    pair = F.array(
        F.struct(F.lit(1).alias("cls"), v.alias("pred"), true.cast("double").alias("true")),
        F.struct(F.lit(2).alias("cls"), (1 - v).alias("pred"), (1 - true).cast("double").alias("true")),
    )
    mask = (F.col("v") % 3 > 0).cast("double")
    return g.select("image_id", mask.alias("mask"), F.explode(pair).alias("p")).select("image_id", "mask", "p.*")


DICE = """dr as (select image_id, case when v%3>0 then 1.0 else 0.0 end mask, 1 cls, v/255.0 pred, cast((x+y+v)%2 as double) tru from fx_grey
 union all select image_id, case when v%3>0 then 1.0 else 0.0 end, 2, 1-v/255.0, cast(1-(x+y+v)%2 as double) from fx_grey)"""


@query(
    "soft_dice",
    f"""with {DICE}, c as (select cls, sum(cast(pred*tru*mask as double)) i, sum(cast(pred*mask as double)) l, sum(tru*mask) r from dr group by cls)
select round(sum(1-(2*i+1e-3)/(l+r+1e-3)),9) dice_loss from c""",
)
def soft_dice(fx: Fixtures) -> DataFrame:
    return ls.soft_dice(dice_rows(fx), []).withColumn("dice_loss", F.round("dice_loss", 9))


@query(
    "soft_dice_per_sample",
    f"""with {DICE}, c as (select image_id, cls, sum(cast(pred*tru*mask as double)) i, sum(cast(pred*mask as double)) l, sum(tru*mask) r from dr group by all)
select image_id, round(sum(1-(2*i+1e-3)/(l+r+1e-3)),9) dice_loss from c group by image_id""",
)
def soft_dice_per_sample(fx: Fixtures) -> DataFrame:
    return ls.soft_dice(dice_rows(fx), ["image_id"]).withColumn("dice_loss", F.round("dice_loss", 9))


@query(
    "squared_error",
    "select image_id, round(avg((v/255.0-x/8.0)*(v/255.0-x/8.0)),9) mse from fx_grey group by image_id",
)
def squared_error(fx: Fixtures) -> DataFrame:
    return fx["fx_grey"].groupBy("image_id").agg(
        F.round(F.avg(ls.squared_error(F.col("v") / 255.0, F.col("x") / 8.0)), 9).alias("mse")
    )


@query(
    "gradient_error",
    """with d as (select image_id, x, y, v/255.0-x/8.0 a, v/255.0-y/8.0 b, case when v%2=0 then 1.0 else 0.0 end focus from fx_grey),
o as (select i.k di, j.k dj from (select unnest(range(-2,3)) k) i join (select unnest(range(-2,3)) k) j on true),
g as (select p.image_id, p.x, p.y, p.focus, sum(coalesce(n.a,0)*(di/(di*di+dj*dj+1e-15))) ga, sum(coalesce(n.b,0)*(dj/(di*di+dj*dj+1e-15))) gb
 from d p join o on true left join d n on n.image_id=p.image_id and n.y=p.y+di and n.x=p.x+dj group by all)
select round(sum(focus*(ga*ga+gb*gb))/(2*sum(focus)+1e-8),6) msge from g""",
)
def gradient_error(fx: Fixtures) -> DataFrame:
    v = F.col("v") / 255.0
    diff = fx["fx_grey"].select(
        "image_id", "x", "y", (v - F.col("x") / 8.0).alias("a"), (v - F.col("y") / 8.0).alias("b"), (F.col("v") % 2 == 0).cast("double").alias("focus")
    )
    return ls.gradient_error(diff).select(F.round("msge", 6).alias("msge"))


@query(
    "contrastive_loss",
    """with f as (select cast(floor(vec_id/16.0) as bigint) batch, vec_id sample, 0 vw, list_transform(embedding[1:32], lambda e: cast(e as double)) v from embeddings
 union all select cast(floor(vec_id/16.0) as bigint), vec_id, 1, list_transform(embedding[33:64], lambda e: cast(e as double)) from embeddings),
s as (select a.batch, a.sample, a.vw, a.sample=b.sample own, list_inner_product(a.v,b.v)/0.07 s from f a join f b on a.batch=b.batch and (a.sample<>b.sample or a.vw<>b.vw)),
l as (select batch, sample, vw, ln(sum(exp(s)))-avg(s) filter (where own) loss from s group by all)
select batch, round(avg(loss),6) loss from l group by batch""",
)
def contrastive_loss(fx: Fixtures) -> DataFrame:
    halves = F.array(*[F.struct(F.lit(i).alias("view"), as_doubles(F.slice("embedding", 1 + 32 * i, 32)).alias("feature")) for i in (0, 1)])
    views = fx["embeddings"].select(
        F.floor(F.col("vec_id") / 16).alias("batch"), F.col("vec_id").alias("sample"), F.explode(halves).alias("h")
    ).select("batch", "sample", "h.view", "h.feature")
    return ls.contrastive(views).withColumn("loss", F.round("loss", 6))


CONFIG = {
    "Nuclei-TYPE": {"weight": 2.0, "loss": {"ce": 1, "dice": 0.5}},
    "Patch-Class": {"weight": 0.5, "loss": {"ce": 1}},
}


@query(
    "multi_task_loss",
    f"""with {NLL}, t as (select sample_id, 'Nuclei-TYPE' head, 'ce' term, nll as value, case when y_true<6 then 1.0 else 0.0 end flag from nl
 union all select sample_id, 'Nuclei-TYPE', 'dice', 1-exp(-nll), case when y_true<6 then 1.0 else 0.0 end from nl
 union all select sample_id, 'Patch-Class', 'ce', nll, case when y_true>=6 then 1.0 else 0.0 end from nl
 union all select sample_id, 'Gland-INST', 'ce', nll*3, 1.0 from nl),
m as (select sample_id%5 step, head, term, sum(value*flag)/(sum(flag)+1e-8) mean from t group by all)
select step, round(sum(mean*case when head='Nuclei-TYPE' and term='ce' then 2.0 when head='Nuclei-TYPE' then 1.0 else 0.5 end),6) overall_loss from m where head<>'Gland-INST' group by step""",
)
def multi_task_loss(fx: Fixtures) -> DataFrame:
    n = nll(logits(), target())
    seg, cls = (target() < 6).cast("double"), (target() >= 6).cast("double")
    term = lambda head, name, value, flag: F.struct(F.lit(head).alias("head"), F.lit(name).alias("term"), value.alias("value"), flag.alias("flag"))
    terms = F.array(
        term("Nuclei-TYPE", "ce", n, seg),
        term("Nuclei-TYPE", "dice", 1 - F.exp(-n), seg),
        term("Patch-Class", "ce", n, cls),
        term("Gland-INST", "ce", n * 3, F.lit(1.0)),
    )
    rows = predictions(fx).select((F.col("sample_id") % 5).alias("step"), F.explode(terms).alias("t")).select("step", "t.*")
    return ls.total_loss(rows, CONFIG, ["step"]).withColumn("overall_loss", F.round("overall_loss", 6))


@query(
    "class_weight_map",
    "select image_id, x, y, case v%9 when 0 then 1.0 when 1 then 2.0 when 2 then 1.5 when 3 then 3.0 when 4 then 2.5 when 5 then 1.0 when 6 then 1.0 else cast(v%9 as double) end::double weight, case when v%9>0 then 1.0 else 0.0 end::double mask from fx_grey",
)
def class_weight_map(fx: Fixtures) -> DataFrame:
    cls = F.col("v") % 9
    return fx["fx_grey"].select(
        "image_id", "x", "y", ls.class_weight_map(cls, TYPE_WEIGHTS).alias("weight"), ls.foreground_mask(cls).alias("mask")
    )
