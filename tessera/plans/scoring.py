"""Queries on segmentation and classifier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import argmax, as_doubles, foreground_probabilities, softmax
from tessera.operators import classifier_scores as cs
from tessera.operators import segmentation_scores as ss
from tessera.plans.fixtures import Fixtures
from tessera.plans.registry import query

COUNTS = """m as (select p.image_id,p.inst_id pid,t.inst_id tid,p.cls cls,count(*) inter from fx_pred_px p join fx_true_px t on p.image_id=t.image_id and p.x=t.x and p.y=t.y and p.cls=t.cls group by all),
pa as (select image_id,cls,inst_id,count(*) area from fx_pred_px group by all),
ta as (select image_id,cls,inst_id,count(*) area from fx_true_px group by all),
tp as (select image_id,cls,count(*) tp,sum(iou) iou_sum from (select m.image_id,m.cls,cast(m.inter as double)/(pa.area+ta.area-m.inter) iou from m join pa on pa.inst_id=m.pid join ta on ta.inst_id=m.tid) q where iou>0.5 group by all),
np as (select image_id,cls,count(*) n from pa group by all), nt as (select image_id,cls,count(*) n from ta group by all),
c as (select coalesce(np.image_id,nt.image_id) image_id, coalesce(np.cls,nt.cls) cls, coalesce(np.n,0) n_pred, coalesce(nt.n,0) n_true from np full join nt on np.image_id=nt.image_id and np.cls=nt.cls),
counts as (select c.image_id, c.cls, coalesce(tp,0) tp, n_pred-coalesce(tp,0) fp, n_true-coalesce(tp,0) fn, coalesce(iou_sum,0.0) iou_sum from c left join tp on tp.image_id=c.image_id and tp.cls=c.cls)"""


def counts(fx: Fixtures) -> DataFrame:
    return ss.match_counts(fx["fx_pred_px"], fx["fx_true_px"])


@query("match_counts", f"with {COUNTS} select image_id, cls, tp, fp, fn, round(iou_sum,6) iou_sum from counts")
def match_counts(fx: Fixtures) -> DataFrame:
    return counts(fx).withColumn("iou_sum", F.round("iou_sum", 6))


@query(
    "panoptic_quality",
    f"""with {COUNTS}, s as (select image_id, cast(sum(tp) as bigint) tp, cast(sum(fp) as bigint) fp, cast(sum(fn) as bigint) fn, sum(iou_sum) iou_sum from counts group by image_id)
select image_id, tp, fp, fn, round(iou_sum/greatest(tp,1),6) sq, round(tp/(tp+0.5*fp+0.5*fn),6) rq, round(iou_sum/greatest(tp,1)*(tp/(tp+0.5*fp+0.5*fn)),6) pq from s""",
)
def panoptic_quality(fx: Fixtures) -> DataFrame:
    return ss.panoptic_quality(counts(fx)).select(
        "image_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("sq", "rq", "pq")]
    )


@query(
    "mean_panoptic_quality",
    f"""with {COUNTS}, q as (select cls, iou_sum/greatest(tp,1)*(tp/(tp+0.5*fp+0.5*fn)) pq from counts)
select round(avg(pq),6) mpq from (select cls, avg(pq) pq from q group by cls)""",
)
def mean_panoptic_quality(fx: Fixtures) -> DataFrame:
    return ss.mean_pq(counts(fx)).select(F.round("mpq", 6).alias("mpq"))


@query(
    "mean_panoptic_quality_pooled",
    f"""with {COUNTS}, s as (select cls, sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(iou_sum) iou_sum from counts group by cls)
select round(avg(iou_sum/greatest(tp,1)*(tp/(tp+0.5*fp+0.5*fn))),6) mpq_plus from s""",
)
def mean_panoptic_quality_pooled(fx: Fixtures) -> DataFrame:
    return ss.mean_pq_pooled(counts(fx)).select(F.round("mpq_plus", 6).alias("mpq_plus"))


@query(
    "dice_scores",
    """with a as (select image_id, cls, count(*) n from (select image_id, cls from fx_pred_px union all select image_id, cls from fx_true_px) group by all),
i as (select p.image_id, p.cls, count(*) n from fx_pred_px p join fx_true_px t on p.image_id=t.image_id and p.x=t.x and p.y=t.y and p.cls=t.cls group by all)
select a.image_id, round(avg(2.0*coalesce(i.n,0)/a.n),6) dice from a left join i on i.image_id=a.image_id and i.cls=a.cls group by a.image_id""",
)
def dice_scores(fx: Fixtures) -> DataFrame:
    images = fx["fx_cells"].select("image_id").distinct()
    return ss.dice(fx["fx_pred_px"], fx["fx_true_px"], images).withColumn("dice", F.round("dice", 6))


@query(
    "class_sets",
    """with u as (select distinct image_id, cls from (select image_id, cls from fx_patchwork union all select image_id, (cls+1)%5 from fx_patchwork) where cls<>0)
select image_id, cls, (select max(cls)+1 from u) num_classes from u""",
)
def class_sets(fx: Fixtures) -> DataFrame:
    a = fx["fx_patchwork"].select("image_id", "cls")
    b = a.select("image_id", ((F.col("cls") + 1) % 5).alias("cls"))
    return ss.classes_present(a, b).join(F.broadcast(ss.class_count(a, b)))


def head_pixels(fx: Fixtures) -> DataFrame:
    """Pixels of three heads over the grey images: a type map, two instance channels, a patch class."""
    g = fx["fx_grey"]
    label = F.col("label")
    row = lambda head, channel, true, pred, gt: F.struct(
        F.lit(head).alias("head"), F.lit(channel).cast("int").alias("channel"), true.cast("int").alias("true"), pred.cast("int").alias("pred"), gt.alias("has_gt")
    )
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    on = lambda cond, k: F.when(cond, k).otherwise(0)
    rows = F.array(
        row("Nuclei-TYPE", None, v % 7, (v + (x == y).cast("int")) % 7, label <= 5),
        row("Gland-INST", 1, v % 3, on(v / 255.0 > 0.5, 1), label >= 3),
        row("Gland-INST", 2, v % 3, on((255 - v) / 255.0 > 0.5, 2), label >= 3),
        F.when((x == 0) & (y == 0), row("Patch-Class", None, v % 9, (v + F.col("image_id") % 2) % 9, label != 4)),
    )
    return g.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


HEAD_ROWS = """hp as (select 'Nuclei-TYPE' head, k.k cls, v%7 t, (v+case when x=y then 1 else 0 end)%7 p, label<=5 gt, v%7>0 m from fx_grey join (select unnest(range(1,7)) k) k on true
 union all select 'Gland-INST', 1, v%3, case when v/255.0>0.5 then 1 else 0 end, label>=3, true from fx_grey
 union all select 'Gland-INST', 2, v%3, case when (255-v)/255.0>0.5 then 2 else 0 end, label>=3, true from fx_grey
 union all select 'Patch-Class', k.k, v%9, (v+image_id%2)%9, label<>4, true from fx_grey join (select unnest(range(9)) k) k on x=0 and y=0),
acc as (select head, cast(cls as int) cls, cast(sum(case when m and t=cls and p=cls then 1 else 0 end) as bigint) over_inter, cast(sum(case when m then (case when t=cls then 1 else 0 end)+(case when p=cls then 1 else 0 end) else 0 end) as bigint) over_total,
 cast(sum(case when t=p then 1 else 0 end) as bigint) over_correct, count(*) nr_pixels from hp where gt group by all)"""


@query("head_accumulators", f"with {HEAD_ROWS} select * from acc")
def head_accumulators(fx: Fixtures) -> DataFrame:
    return ss.accumulators(ss.contingency(head_pixels(fx)))


@query(
    "head_summary",
    f"""with {HEAD_ROWS}, s as (select head, cls, (over_correct+1e-8)/(nr_pixels+1e-8) accuracy, 2*over_inter/(over_total+1e-8) dice from acc)
select head, cls, round(accuracy,6) accuracy, round(dice,6) dice from (select * from s union all select head, -1, avg(accuracy), avg(dice) from s where head not like '%-INST' group by head)""",
)
def head_summary(fx: Fixtures) -> DataFrame:
    out = ss.summarise(ss.accumulators(ss.contingency(head_pixels(fx))))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("dice", F.round("dice", 6))


# ---- classifier ---------------------------------------------------------------------------------

CLASSES = 10


def predictions(fx: Fixtures) -> DataFrame:
    logits = as_doubles(F.slice("embedding", 1, CLASSES))
    return fx["fx_preds"].select("sample_id", "y_true", logits.alias("logits")).withColumn("y_pred", argmax(F.col("logits")))


ARGMAX = """p as (select sample_id, y_true, cast(list_position(embedding[1:10], list_max(embedding[1:10]))-1 as int) y_pred from fx_preds)"""


@query("argmax_class", f"with {ARGMAX} select * from p")
def argmax_class(fx: Fixtures) -> DataFrame:
    return predictions(fx).select("sample_id", "y_true", "y_pred")


@query(
    "softmax_foreground",
    """with e as (select sample_id, unnest(range(1,11)) k, embedding from fx_preds), v as (select sample_id, k, exp(cast(embedding[k] as double)) e from e),
s as (select sample_id, k, e/sum(e) over (partition by sample_id) p from v)
select sample_id, cast(k-1 as int) channel, round(p,9) p from s where k>1""",
)
def softmax_foreground(fx: Fixtures) -> DataFrame:
    fg = foreground_probabilities(F.col("logits"))
    return predictions(fx).select("sample_id", F.posexplode(fg).alias("pos", "p")).select(
        "sample_id", (F.col("pos") + 1).alias("channel"), F.round("p", 9).alias("p")
    )


@query(
    "class_accuracy",
    f"""with {ARGMAX}, c as (select y_true cls, avg(case when y_true=y_pred then 1.0 else 0.0 end) a from p group by y_true)
select cls, round(a,6) accuracy from (select * from c union all select -1, avg(case when y_true=y_pred then 1.0 else 0.0 end) from p union all select -2, avg(a) from c)""",
)
def class_accuracy(fx: Fixtures) -> DataFrame:
    return cs.accuracy(predictions(fx)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "class_f1",
    f"""with {ARGMAX}, l as (select y_true cls from p union select y_pred from p),
f as (select cls, 2.0*(select count(*) from p where y_true=cls and y_pred=cls)/((select count(*) from p where y_true=cls)+(select count(*) from p where y_pred=cls)) f1 from l)
select cls, round(f1,6) f1 from (select * from f union all select -1, avg(f1) from f)""",
)
def class_f1(fx: Fixtures) -> DataFrame:
    return cs.f1(predictions(fx)).withColumn("f1", F.round("f1", 6))


@query(
    "confusion_matrix",
    f"""with {ARGMAX}, g as (select cast(a.k as int) y_true, cast(b.k as int) y_pred from (select unnest(range(12)) k) a join (select unnest(range(12)) k) b on true)
select g.y_true, g.y_pred, round(coalesce(c.n/t.n,0.0),6) share from g left join (select y_true, y_pred, cast(count(*) as double) n from p group by all) c on c.y_true=g.y_true and c.y_pred=g.y_pred
left join (select y_true, count(*) n from p group by all) t on t.y_true=g.y_true""",
)
def confusion_matrix(fx: Fixtures) -> DataFrame:
    return cs.confusion(predictions(fx), 12).withColumn("share", F.round("share", 6))


def one_against_rest(fx: Fixtures) -> DataFrame:
    return predictions(fx).select("y_true", F.posexplode("logits").alias("cls", "score")).select(
        "cls", "score", (F.col("y_true") == F.col("cls")).alias("positive")
    )


STEPS = """st as (select key, score, cast(sum(case when positive then 1 else 0 end) as bigint) pos, cast(sum(case when positive then 0 else 1 end) as bigint) neg from scored group by key, score),
cum as (select *, cast(sum(pos) over w as bigint) tp, cast(sum(neg) over w as bigint) fp, cast(sum(pos) over (partition by key) as bigint) all_pos, cast(sum(neg) over (partition by key) as bigint) all_neg from st window w as (partition by key order by score desc rows unbounded preceding))"""
REST = """scored as (select cast(k-1 as int) as key, cast(embedding[k] as double) score, y_true=k-1 positive from (select y_true, embedding, unnest(range(1,11)) k from fx_preds))"""
GROUPS = """scored as (select d.source as key, cast(d.n_chars as double) score, l.quality=1 positive from labels l join documents d on d.doc_id=l.doc_id)"""


@query(
    "average_precision",
    f"with {REST}, {STEPS} select key cls, round(sum(pos/all_pos*(tp/(tp+fp))),6) ap from cum where all_pos>0 group by key",
)
def average_precision(fx: Fixtures) -> DataFrame:
    return cs.average_precision(one_against_rest(fx), "cls").withColumn("ap", F.round("ap", 6))


@query(
    "mean_average_precision",
    f"with {REST}, {STEPS}, ap as (select key, sum(pos/all_pos*(tp/(tp+fp))) ap from cum where all_pos>0 group by key) select round(avg(ap),6) map from ap",
)
def mean_average_precision(fx: Fixtures) -> DataFrame:
    ap = cs.average_precision(one_against_rest(fx), "cls")
    return cs.mean_average_precision(ap).select(F.round("map", 6).alias("map"))


def quality_runs(fx: Fixtures) -> DataFrame:
    """Text length as a score for the quality label, one run per source."""
    return fx["labels"].join(fx["documents"].select("doc_id", "source", "n_chars"), "doc_id").select(
        F.col("source").alias("run"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive")
    )


@query(
    "roc_curve",
    f"with {GROUPS}, {STEPS} select key run, score, round(fp/all_neg,6) fpr, round(tp/all_pos,6) tpr from cum where all_pos>0 and all_neg>0",
)
def roc_curve(fx: Fixtures) -> DataFrame:
    points = cs.roc_points(quality_runs(fx), "run")
    return points.select("run", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "roc_auc",
    f"with {GROUPS}, {STEPS} select key run, round(sum(neg*(tp-pos/2.0)/(cast(all_neg as double)*all_pos)),6) auc from cum where all_pos>0 and all_neg>0 group by key",
)
def roc_auc(fx: Fixtures) -> DataFrame:
    return cs.roc_auc(cs.roc_points(quality_runs(fx), "run"), "run").withColumn("auc", F.round("auc", 6))


CURVES = f"""{GROUPS}, {STEPS},
pt as (select key, fp/all_neg f, tp/all_pos t from cum where all_pos>0 and all_neg>0 union all select distinct key, 0.0, 0.0 from cum where all_pos>0 and all_neg>0),
g as (select k.key, unnest(range(101)) k from (select distinct key from pt) k),
ip as (select g.key, g.k, max(struct_pack(f:=f,t:=t)) filter (where pt.f<=g.k/100.0+1e-12) a, min(struct_pack(f:=f,t:=t)) filter (where pt.f>g.k/100.0+1e-12) b from g join pt on pt.key=g.key group by all),
cv as (select key, k, case when k=0 then 0.0 when k=100 then 1.0 else a.t+(k/100.0-a.f)*(b.t-a.t)/(b.f-a.f) end tpr from ip),
mean as (select k, avg(tpr) m, stddev_pop(tpr) s from cv group by k)"""


@query(
    "mean_roc",
    f"with {CURVES} select cast(k as int) k, round(m,9) mean_tpr, round(least(m+s,1),9) upper, round(greatest(m-s,0),9) lower from mean",
)
def mean_roc(fx: Fixtures) -> DataFrame:
    curve = cs.mean_roc(cs.roc_points(quality_runs(fx), "run"), "run", 100)
    return curve.select("k", *[F.round(c, 9).alias(c) for c in ("mean_tpr", "upper", "lower")])


@query(
    "mean_roc_auc",
    f"""with {CURVES}, au as (select key, sum(neg*(tp-pos/2.0)/(cast(all_neg as double)*all_pos)) auc from cum where all_pos>0 and all_neg>0 group by key)
select round((select sum(m*case when k in (0,100) then 0.5 else 1 end)/100 from mean),9) mean_auc, round(stddev_pop(auc),9) std_auc, count(*) runs from au""",
)
def mean_roc_auc(fx: Fixtures) -> DataFrame:
    out = cs.mean_roc_auc(cs.roc_points(quality_runs(fx), "run"), "run", 100)
    return out.select(F.round("mean_auc", 9).alias("mean_auc"), F.round("std_auc", 9).alias("std_auc"), "runs")
