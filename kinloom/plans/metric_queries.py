"""Queries of the verification metrics and hard-case mining, with their SQL.

Pairs: each vec_id with the one 1, 2, 3, 5 or 8 further; genuine = labels of equal parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.vectors import dot, learning_rate, squared_distance, unit
from kinloom.operators import metrics, simjoin, vectors
from kinloom.plans.lineage import cut
from kinloom.plans.vector_queries import _U
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
TARGETS = [0.001, 0.01, 0.1]


def query(f):
    Q[f.__name__] = f
    return f


def _scored(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", unit("embedding").alias("v"))
    left = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"), F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 8)])).alias("step"))
    right = e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    j = left.withColumn("b", F.col("a") + F.col("step")).join(right, "b")
    return j.select((F.col("a") * 10 + F.col("step")).alias("pair_id"), "a", "b", (F.col("la") % 2 == F.col("lb") % 2).cast("int").alias("genuine"), dot("va", "vb").alias("score"), squared_distance("va", "vb").alias("dist"))


def _pairs(spark, d) -> DataFrame:
    return cut(_scored(spark, d).drop("dist"))


_S = _U + ", st as (select unnest([1, 2, 3, 5, 8]) step), pr as (select a.vec_id * 10 + step pair_id, a.vec_id a, b.vec_id b, (a.label % 2 = b.label % 2)::int genuine, list_dot_product(a.v, b.v) score, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) ** 2)) dist from u a, st, u b where b.vec_id = a.vec_id + step)"
_N = _S + ", tot as (select sum(genuine) ng, sum(1 - genuine) ni from pr)"
_CUM = _N + ", cum as (select pair_id, score, sum(genuine) over w tp, sum(1 - genuine) over w fp, sum(1 - genuine) over w / ni far, (ng - sum(genuine) over w) / ng frr from pr, tot window w as (order by score desc, pair_id rows unbounded preceding))"
_ROC = _N + ", ps as (select score, sum(genuine) g, sum(1 - genuine) i from pr group by 1), roc as (select score, g, i, sum(g) over w tp, sum(i) over w fp, sum(i) over w / ni fpr, sum(g) over w / ng tpr, ng, ni from ps, tot window w as (order by score desc rows unbounded preceding))"


@query
def pair_scores(spark, d):
    return _scored(spark, d).select("pair_id", "genuine", F.round("score", 6).alias("score"))


SQL["pair_scores"] = f"with {_S} select pair_id, genuine, round(score, 6) score from pr"


@query
def roc_curve(spark, d):
    return metrics.roc(_pairs(spark, d)).select(F.round("score", 6).alias("score"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


SQL["roc_curve"] = f"with {_ROC} select round(score, 6) score, round(fpr, 6) fpr, round(tpr, 6) tpr from roc"


@query
def auc(spark, d):
    return metrics.auc(metrics.roc(_pairs(spark, d))).select(F.round("auc", 6).alias("auc"))


SQL["auc"] = f"with {_ROC} select round(sum(i / ni * (tp - g / 2.0) / ng), 6) auc from roc"


@query
def eer(spark, d):
    return metrics.eer(metrics.roc(_pairs(spark, d))).select(F.round("eer", 6).alias("eer"), F.round("threshold", 6).alias("threshold"))


SQL["eer"] = f"with {_ROC} select round((fpr + 1 - tpr) / 2, 6) eer, round(score, 6) threshold from roc order by abs(fpr - (1 - tpr)), score desc limit 1"


def _nearest(spark, d, value, name):
    r = metrics.nearest_rate(metrics.roc(_pairs(spark, d)), TARGETS, "fpr", value, name)
    return r.select("target", F.round("threshold", 6).alias("threshold"), F.round(name, 6).alias(name))


def _nearest_sql(value: str, name: str) -> str:
    return " union all ".join(f"select * from (with {_ROC} select {t}::double target, round(score, 6) threshold, round({value}, 6) {name} from roc order by abs(fpr - {t}), score desc limit 1)" for t in TARGETS)


@query
def fnmr_at_fmr(spark, d):
    return _nearest(spark, d, 1 - F.col("tpr"), "fnmr")


@query
def tpr_at_fpr(spark, d):
    return _nearest(spark, d, F.col("tpr"), "tpr")


SQL["fnmr_at_fmr"] = _nearest_sql("1 - tpr", "fnmr")
SQL["tpr_at_fpr"] = _nearest_sql("tpr", "tpr")


@query
def frr_at_far(spark, d):
    r = metrics.constrained(metrics.cumulative(_pairs(spark, d)), TARGETS, "far", "frr", first=False)
    return r.select("target", F.round("threshold", 6).alias("threshold"), F.round("frr", 6).alias("frr"))


@query
def far_at_frr(spark, d):
    r = metrics.constrained(metrics.cumulative(_pairs(spark, d)), TARGETS, "frr", "far", first=True)
    return r.select("target", F.round("threshold", 6).alias("threshold"), F.round("far", 6).alias("far"))


def _constrained_sql(rate: str, other: str, first: bool) -> str:
    o, back = ("score desc, pair_id", "score, pair_id desc") if first else ("score, pair_id desc", "score desc, pair_id")
    return " union all ".join(
        f"select * from (with {_CUM} select {t}::double target, round(score, 6) threshold, round({other}, 6) {other} from (select *, 0 z, row_number() over (order by {o}) n from cum where {rate} <= {t} union all select *, 1, row_number() over (order by {back}) from cum) order by z, n limit 1)"
        for t in TARGETS
    )


SQL["frr_at_far"] = _constrained_sql("far", "frr", False)
SQL["far_at_frr"] = _constrained_sql("frr", "far", True)


@query
def far_frr_nearest(spark, d):
    r = metrics.nearest_rate(metrics.cumulative(_pairs(spark, d)), TARGETS, "far", F.col("frr"), "frr")
    return r.select("target", F.round("threshold", 6).alias("threshold"), F.round("frr", 6).alias("frr"))


SQL["far_frr_nearest"] = " union all ".join(f"select * from (with {_CUM} select {t}::double target, round(score, 6) threshold, round(frr, 6) frr from cum order by abs(far - {t}), score desc limit 1)" for t in TARGETS)


@query
def far_frr_at(spark, d):
    return metrics.rates_at(_pairs(spark, d), 0.1).select(F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


SQL["far_frr_at"] = f"with {_S} select round(count(*) filter (score >= 0.1 and genuine = 0) / count(*) filter (genuine = 0), 6) far, round(count(*) filter (score < 0.1 and genuine = 1) / count(*) filter (genuine = 1), 6) frr from pr"


@query
def gray_zone(spark, d):
    return metrics.gray_zone(_pairs(spark, d), -0.1, 0.1)


SQL["gray_zone"] = f"with {_S} select case when score >= 0.1 then 'accept' when score <= -0.1 then 'reject' else 'review' end as zone, genuine, count(*) n from pr group by 1, 2"


@query
def worst_case_pairs(spark, d):
    return metrics.worst_cases(_pairs(spark, d), "a", "b").withColumn("score", F.round("score", 6))


SQL["worst_case_pairs"] = f"with {_S}, bo as (select a \"template\", b other, genuine, score from pr union all select b, a, genuine, score from pr), r as (select *, row_number() over (partition by \"template\", genuine order by case when genuine = 1 then score else -score end, other) n from bo) select \"template\", genuine, other, round(score, 6) score from r where n = 1"


def _thresholds(step: float, n: int) -> list[float]:
    return [round(i * step, 6) for i in range(n)]


@query
def kfold_accuracy(spark, d):
    f = cut(metrics.folds(_scored(spark, d), 10))
    return metrics.kfold_accuracy(f, _thresholds(0.01, 400)).select("fold", "threshold", F.round("accuracy", 6).alias("accuracy"))


_F = _N + ", fo as (select *, ntile(10) over (order by pair_id) - 1 fold from pr)"
SQL["kfold_accuracy"] = f"""with {_F}, th as (select i, round(i * 0.01, 6)::double t from range(400) x(i)), c as (select fold, i, t, sum(((dist < t)::int = genuine)::int) ok, count(*) n from fo, th group by 1, 2, 3),
tr as (select c.*, sum(ok) over (partition by i) - ok train from c), b as (select *, row_number() over (partition by fold order by train desc, i) r from tr) select fold::int fold, t threshold, round(ok / n, 6) accuracy from b where r = 1"""


@query
def val_at_far(spark, d):
    f = cut(metrics.folds(_scored(spark, d), 10))
    r = metrics.kfold_val(f, _thresholds(0.001, 4000), 0.05)
    return r.select("fold", F.round("threshold", 6).alias("threshold"), F.round("val", 6).alias("val"), F.round("far", 6).alias("far"))


SQL["val_at_far"] = f"""with {_F}, th as (select i, round(i * 0.001, 6)::double t from range(4000) x(i)), ce as (select fold, least(4000, greatest(0, floor(dist * 1000) - 1))::bigint lo, dist, genuine from fo),
cf as (select fold, dist, genuine, lo + (case when round(lo * 0.001, 6)::double <= dist then 1 else 0 end) + (case when round((lo + 1) * 0.001, 6)::double <= dist then 1 else 0 end) + (case when round((lo + 2) * 0.001, 6)::double <= dist then 1 else 0 end) cell from ce),
k as (select fold, cell, sum(1 - genuine) i from cf group by 1, 2), tt as (select fold, sum(1 - genuine) ai from fo group by 1), g as (select fold, th.i, t, ai, coalesce(sum(k.i) over (partition by fold order by th.i rows unbounded preceding), 0) fp from tt cross join th left join k using (fold) where false),
g2 as (select tt.fold, th.i, th.t, tt.ai, sum(coalesce(k.i, 0)) over (partition by tt.fold order by th.i rows unbounded preceding) fp from tt cross join th left join k on k.fold = tt.fold and k.cell = th.i),
f2 as (select *, (sum(fp) over (partition by i) - fp) / (sum(ai) over (partition by i) - ai) far from g2),
ed as (select fold, max(i) filter (far < 0.05) lo, min(i) filter (far >= 0.05) hi from f2 group by 1),
ct as (select ed.fold, case when hi is null then 0.0 when lo is null then h.t else l.t + (h.t - l.t) * (0.05 - l.far) / (h.far - l.far) end thr from ed left join f2 l on l.fold = ed.fold and l.i = lo left join f2 h on h.fold = ed.fold and h.i = hi)
select fo.fold::int fold, round(any_value(thr), 6) threshold, round(count(*) filter (genuine = 1 and dist < thr) / sum(genuine), 6) val, round(count(*) filter (genuine = 0 and dist < thr) / sum(1 - genuine), 6) far from fo join ct using (fold) group by 1""".replace(
    "g as (select fold, th.i, t, ai, coalesce(sum(k.i) over (partition by fold order by th.i rows unbounded preceding), 0) fp from tt cross join th left join k using (fold) where false),\n", "\n"
)


def _hard(spark, d):
    """Medoids of small identities (label, vec_id % 20), impostor links between them."""
    e = table(spark, d, "embeddings").withColumn("identity", (F.col("label") * 20 + F.col("vec_id") % 20).cast("long"))
    m = cut(vectors.medoids(e, "identity", "vec_id", "embedding").select("identity", "vec_id").join(e.select("vec_id", "embedding"), "vec_id"))
    top = simjoin.top_neighbours(simjoin.units(m, "identity", "embedding"), 10)
    pairs = cut(top.select(F.least("id", "other").alias("class_a"), F.greatest("id", "other").alias("class_b"), F.col("sim").alias("score")).groupBy("class_a", "class_b").agg(F.max("score").alias("score")))
    n = m.count()
    cutoff = metrics.threshold_at_rate(pairs, 0.01, F.lit(n * (n - 1) / 2), [F.col("score").desc(), F.col("class_a"), F.col("class_b")])
    return e, m, pairs, cut(cutoff)


_H = (
    _U
    + """, ie as (select vec_id, label * 20 + vec_id % 20 identity, embedding::double[] raw, v from embeddings join u using (vec_id, label)),
hx as (select identity, generate_subscripts(raw, 1) pos, unnest(raw) val from ie), hs as (select identity, pos, sum(val) s from hx group by 1, 2), hc as (select identity, list(s order by pos) c from hs group by 1),
hm as (select identity, arg_min(vec_id, (-list_dot_product(v, c) / sqrt(list_dot_product(c, c)), vec_id)) vec_id from ie join hc using (identity) group by 1),
md as (select hm.identity, hm.vec_id, v from hm join ie using (vec_id)),
nk as (select a.identity a, b.identity b, list_dot_product(a.v, b.v) score, row_number() over (partition by a.identity order by list_dot_product(a.v, b.v) desc, b.identity) n from md a join md b on a.identity <> b.identity),
hp as (select least(a, b) class_a, greatest(a, b) class_b, max(score) score from nk where n <= 10 group by 1, 2), hr as (select *, row_number() over (order by score desc, class_a, class_b) place from hp),
hw as (select greatest(1, round_even(0.01 * (select count(*) * (count(*) - 1) / 2 from md), 0))::bigint want), ht as (select score threshold, place, want > (select count(*) from hr) lower_bound from hr, hw where place = least(want, (select count(*) from hr)))"""
)


@query
def hard_threshold(spark, d):
    return _hard(spark, d)[3].select(F.round("threshold", 6).alias("threshold"), "rank", "lower_bound")


@query
def false_accept(spark, d):
    _, _, pairs, t = _hard(spark, d)
    return pairs.join(F.broadcast(t)).where("score >= threshold").select("class_a", "class_b", F.round("score", 6).alias("score"))


@query
def false_reject(spark, d):
    e, m, _, t = _hard(spark, d)
    mm = m.select("identity", F.col("vec_id").alias("medoid"), unit("embedding").alias("mv"))
    s = e.join(mm, "identity").where("vec_id <> medoid").withColumn("score", dot(unit("embedding"), "mv"))
    return s.join(F.broadcast(t)).where("score < threshold").select("identity", "vec_id", F.round("score", 6).alias("score"))


@query
def hard_neighbors(spark, d):
    _, _, pairs, t = _hard(spark, d)
    p = pairs.join(F.broadcast(t)).where("score >= threshold").withColumn("score", F.round("score", 6))
    return p.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("neighbor_class_id"), "score").unionByName(p.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("neighbor_class_id"), "score"))


SQL["hard_threshold"] = f"with {_H} select round(threshold, 6) threshold, place \"rank\", lower_bound from ht"
SQL["false_accept"] = f"with {_H} select class_a::bigint class_a, class_b::bigint class_b, round(score, 6) score from hp, ht where score >= threshold"
SQL["false_reject"] = f"with {_H} select ie.identity::bigint identity, ie.vec_id, round(list_dot_product(ie.v, md.v), 6) score from ie join md using (identity), ht where ie.vec_id <> md.vec_id and list_dot_product(ie.v, md.v) < threshold"
SQL["hard_neighbors"] = f"with {_H}, fa as (select class_a, class_b, round(score, 6) score from hp, ht where score >= threshold) select class_a::bigint class_id, class_b::bigint neighbor_class_id, score from fa union all select class_b, class_a, score from fa"


@query
def lr_schedule(spark, d):
    return spark.range(0, 101, 5).select(F.col("id").alias("step"), F.round(learning_rate(F.col("id"), 0.1, 20, 100), 6).alias("lr"))


SQL["lr_schedule"] = "select i step, round(case when i < 20 then i * 0.1 / 20 else pow(1 - (i - 20) / 80.0, 2) * 0.1 end, 6) lr from range(0, 101, 5) x(i)"
