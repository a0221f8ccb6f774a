"""Queries of the vector, graph, merge and clustering operators, with their SQL.

Bindings: row = vec_id, identity = label, image count = 1 + vec_id % 7, anchor =
vec_id % 3 = 0, medium = vec_id % 5, type = vec_id % 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.vectors import angular_margin, cosine_margin, dot, norm, unit
from kinloom.operators import cluster, graph, merge, simjoin, vectors
from kinloom.plans.lineage import cut
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
LOWER, UPPER = 0.33, 0.38


def query(f):
    Q[f.__name__] = f
    return f


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _flat(df: DataFrame, key: str, array: str, *keep: str) -> DataFrame:
    return df.select(key, *keep, F.posexplode(array).alias("pos", "value")).withColumn("value", F.round("value", 6))


_U = "e as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / greatest(n, 1e-9)) v from e)"
_X = _U + ", x as (select vec_id, label, generate_subscripts(v, 1) - 1 pos, unnest(v) val from (select vec_id, label, embedding::double[] v from embeddings))"


@query
def template_centers(spark, d):
    return _flat(vectors.templates(_e(spark, d), "label", "embedding"), "label", "embedding_center", "img_count")


SQL["template_centers"] = f"""with {_X}, s as (select label, pos, sum(val) s, count(*) img_count from x group by 1, 2), n as (select label, sqrt(sum(s * s)) n from s group by 1)
select label, img_count, pos, round(s / greatest(n, 1e-9), 6) as value from s join n using (label)"""


@query
def media_pooled_templates(spark, d):
    t = vectors.media_templates(_e(spark, d).withColumn("media", F.col("vec_id") % 5), "label", "media", "embedding")
    return _flat(t, "label", "embedding_center", "n_media")


SQL["media_pooled_templates"] = f"""with {_X}, m as (select label, vec_id % 5 media, pos, avg(val) a from x group by 1, 2, 3), s as (select label, pos, sum(a) s, count(*) n_media from m group by 1, 2), n as (select label, sqrt(sum(s * s)) n from s group by 1)
select label, n_media, pos, round(s / n, 6) as value from s join n using (label)"""


@query
def weighted_templates(spark, d):
    t = vectors.templates(_e(spark, d).withColumn("w", (F.col("vec_id") % 4 + 1) / 4.0), "label", "embedding", "w")
    return _flat(t, "label", "embedding_center")


SQL["weighted_templates"] = f"""with {_X}, s as (select label, pos, sum(val * (vec_id % 4 + 1) / 4.0) s from x group by 1, 2), n as (select label, sqrt(sum(s * s)) n from s group by 1)
select label, pos, round(s / n, 6) as value from s join n using (label)"""


@query
def global_templates_offset(spark, d):
    e = _e(spark, d)
    top = e.where("vec_id % 3 = 0").agg(F.max("label").alias("top"))
    shifted = e.join(F.broadcast(top)).withColumn("person_id", F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(F.col("label") + F.col("top") + 1).cast("long"))
    return vectors.templates(shifted, "person_id", "embedding").select("person_id", "img_count", F.posexplode("embedding_center").alias("pos", "value")).withColumn("value", F.round("value", 6))


SQL["global_templates_offset"] = f"""with {_X}, o as (select max(label) + 1 o from embeddings where vec_id % 3 = 0), y as (select case when vec_id % 3 = 0 then label else label + o end person_id, pos, val from x, o),
s as (select person_id, pos, sum(val) s, count(*) c from y group by 1, 2), n as (select person_id, sqrt(sum(s * s)) n from s group by 1)
select person_id::bigint person_id, c img_count, pos, round(s / n, 6) as value from s join n using (person_id)"""


@query
def l2_normalize(spark, d):
    return _e(spark, d).select("vec_id", F.posexplode(unit("embedding")).alias("pos", "value")).withColumn("value", F.round("value", 6))


SQL["l2_normalize"] = f"with {_U} select vec_id, generate_subscripts(v, 1) - 1 pos, round(unnest(v), 6) as value from u"


@query
def norm_audit(spark, d):
    return vectors.norm_audit(_e(spark, d), "embedding", 1e-7).select("n_rows", F.round("max_off", 6).alias("max_off"))


SQL["norm_audit"] = f"with {_U} select count(*) n_rows, round(max(abs(n - 1)), 6) max_off from e"


def _pairs(spark, d, low=LOWER):
    return simjoin.similar_pairs(simjoin.units(_e(spark, d), "vec_id", "embedding"), low)


_P = _U + f", p as (select a.vec_id a, b.vec_id b, list_dot_product(a.v, b.v) sim from u a join u b on a.vec_id < b.vec_id and list_dot_product(a.v, b.v) > {LOWER})"


@query
def similarity_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.round("sim", 6).alias("sim"))


SQL["similarity_pairs"] = f"with {_P} select a, b, round(sim, 6) sim from p"


@query
def topk_neighbors(spark, d):
    return simjoin.top_neighbours(simjoin.units(_e(spark, d), "vec_id", "embedding"), 5).select(F.col("id").alias("vec_id"), "other", "rank", F.round("sim", 6).alias("sim"))


SQL["topk_neighbors"] = f"""with {_U}, r as (select a.vec_id, b.vec_id other, list_dot_product(a.v, b.v) sim from u a join u b on a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by vec_id order by sim desc, other) "rank" from r) select vec_id, other, "rank", round(sim, 6) sim from k where "rank" <= 5"""


def _near_identities(spark, d, k=3):
    t = vectors.templates(_e(spark, d), "label", "embedding")
    return simjoin.top_neighbours(simjoin.units(t, "label", "embedding_center"), k)


_C = _X + ", cs as (select label, pos, sum(val) s from x group by 1, 2), cn as (select label, sqrt(sum(s * s)) n from cs group by 1), c as (select label, list(s / n order by pos) v from cs join cn using (label) group by 1)"
_NI = _C + ', ni as (select a.label id, b.label other, list_dot_product(a.v, b.v) sim, row_number() over (partition by a.label order by list_dot_product(a.v, b.v) desc, b.label) "rank" from c a join c b on a.label <> b.label)'


@query
def near_identities(spark, d):
    return _near_identities(spark, d).select("id", "other", "rank", F.round("sim", 6).alias("sim"))


SQL["near_identities"] = f'with {_NI} select id::bigint id, other::bigint other, "rank", round(sim, 6) sim from ni where "rank" <= 3'


def _injections(spark, d, n=4):
    e = _e(spark, d)
    near = _near_identities(spark, d).select(F.col("id").alias("host"), F.col("other").alias("label"))
    cand = e.join(near, "label").select(F.col("host").alias("key"), F.col("vec_id").alias("id"), unit("embedding").alias("v"))
    links = simjoin.best_links(cand, simjoin.units(e, "vec_id", "embedding", F.col("label")))
    src = e.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 2).alias("kind"))
    from pyspark.sql import Window

    w = Window.partitionBy("key", "label", "kind").orderBy(F.col("link").desc(), "id")
    return links.join(src, "id").withColumn("no", F.row_number().over(w)).where(F.col("no") <= n).select(F.col("key").alias("host"), F.col("label").alias("src_label"), "kind", F.col("id").alias("vec_id"), "link")


_INJ = (
    _NI
    + """, l as (select ni.id host, q.label src_label, q.vec_id % 2 kind, q.vec_id, max(list_dot_product(q.v, h.v)) link from ni join u q on q.label = ni.other join u h on h.label = ni.id where "rank" <= 3 group by 1, 2, 3, 4),
inj as (select * from (select *, row_number() over (partition by host, src_label, kind order by link desc, vec_id) as no from l) where no <= 4)"""
)


@query
def max_link_injections(spark, d):
    return _injections(spark, d).withColumn("link", F.round("link", 6))


SQL["max_link_injections"] = f"with {_INJ} select host::bigint host, src_label, kind, vec_id, round(link, 6) link from inj"


@query
def contaminated_set(spark, d):
    own = _e(spark, d).select(F.col("label").cast("long").alias("assigned_id"), F.col("label").alias("src_id"), "vec_id", F.lit(False).alias("is_injected"), F.lit(1.0).alias("sim_to_host"))
    inj = _injections(spark, d).select(F.col("host").alias("assigned_id"), F.col("src_label").alias("src_id"), "vec_id", F.lit(True).alias("is_injected"), F.round("link", 6).alias("sim_to_host"))
    return own.unionByName(inj)


SQL["contaminated_set"] = f"with {_INJ} select label::bigint assigned_id, label src_id, vec_id, false is_injected, 1.0::double sim_to_host from embeddings union all select host, src_label, vec_id, true, round(link, 6) from inj"


@query
def medoid_by_centroid(spark, d):
    return vectors.medoids(_e(spark, d), "label", "vec_id", "embedding").withColumn("sim", F.round("sim", 6))


SQL["medoid_by_centroid"] = f"with {_C}, m as (select u.label, vec_id, list_dot_product(u.v, c.v) sim from u join c using (label)) select label, arg_min(vec_id, (-sim, vec_id)) vec_id, round(max(sim), 6) sim from m group by label"


@query
def medoid_by_sum(spark, d):
    return vectors.medoids(_e(spark, d), "label", "vec_id", "embedding", by_sum=True).withColumn("sim", F.round("sim", 6))


SQL["medoid_by_sum"] = f"with {_U}, m as (select a.label, a.vec_id, sum(list_dot_product(a.v, b.v)) sim from u a join u b using (label) group by 1, 2) select label, arg_min(vec_id, (-sim, vec_id)) vec_id, round(max(sim), 6) sim from m group by label"


@query
def connected_components(spark, d):
    return graph.components(_pairs(spark, d, UPPER), "a", "b")


_R = f"pu as (select a, b from p where sim > {UPPER}), s as (select a, b from pu union select b, a from pu), r(id, root) as (select a, a from s union select s.b, r.root from r join s on s.a = r.id where r.root < s.b)"
_CC = f"with recursive {_P}, {_R}, cc as (select id, min(root) component from r group by id)"
SQL["connected_components"] = f"{_CC} select id, component from cc"


def _merge_input(spark, d):
    centres = _e(spark, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7 + 1).alias("img_count"), (F.col("vec_id") % 3 == 0).alias("anchor"))
    return centres, cut(_pairs(spark, d))


_SYM = (
    _CC
    + """, ct as (select vec_id id, 1 + vec_id % 7 n, vec_id % 3 = 0 anchor from embeddings), m as (select ct.*, coalesce(component, id) comp from ct left join cc using (id)),
ld as (select comp, arg_min(id, (-n, id)) leader, sum(n) total from m group by 1), ml as (select m.id, m.n, m.anchor, leader, total from m join ld using (comp)),
z as (select x.leader la, x.total ta, y.leader lb, y.total tb from p join ml x on x.id = p.a join ml y on y.id = p.b where p.sim <= """
    + f"{UPPER} and x.leader <> y.leader), lost as (select distinct case when ta < tb then la when tb < ta then lb else greatest(la, lb) end leader from z)"
)


@query
def merge_symmetric_map(spark, d):
    return merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)[0]


@query
def merge_symmetric_drops(spark, d):
    return merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)[1]


SQL["merge_symmetric_map"] = f"{_SYM} select id og_id, leader new_id from ml where id <> leader and leader not in (select leader from lost)"
SQL["merge_symmetric_drops"] = f"{_SYM} select id from ml where leader in (select leader from lost)"


@query
def merge_groups(spark, d):
    m, _ = merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)
    return m.groupBy(F.col("new_id").alias("leader_id")).agg(F.count("*").alias("n_members"), F.min("og_id").alias("first_member"))


SQL["merge_groups"] = f"{_SYM} select leader leader_id, count(*) n_members, min(id) first_member from ml where id <> leader and leader not in (select leader from lost) group by 1"


@query
def merge_group_members(spark, d):
    """Every member of every merge group, one row each, so a group of any size is spread."""
    m, _ = merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)
    return m.select(F.col("new_id").alias("leader_id"), F.col("og_id").alias("member_id"))


SQL["merge_group_members"] = f"{_SYM} select leader leader_id, id member_id from ml where id <> leader and leader not in (select leader from lost)"


@query
def merge_anchored(spark, d):
    return merge.anchored_merge(*_merge_input(spark, d), LOWER, UPPER)


@query
def merge_new_only_map(spark, d):
    return merge.new_only_merge(*_merge_input(spark, d), LOWER, UPPER)[0]


@query
def merge_new_only_drops(spark, d):
    return merge.new_only_merge(*_merge_input(spark, d), LOWER, UPPER)[1]


_NEW = (
    _SYM
    + f""", g as (select comp, bool_or(anchor) ha from m group by 1), dr as (select m.id from m join g using (comp) where ha and not anchor
  union select case when x.anchor then p.b else p.a end from p join ct x on x.id = p.a join ct y on y.id = p.b where p.sim <= {UPPER} and x.anchor <> y.anchor)"""
)
SQL["merge_new_only_drops"] = f"{_NEW} select id from dr"
SQL["merge_new_only_map"] = f"{_NEW} select ml.id og_id, ml.leader new_id from ml join m using (id) join g using (comp) where not ha and ml.id <> ml.leader and ml.id not in (select id from dr) and ml.leader not in (select id from dr)"


@query
def apply_merge_map(spark, d):
    mapping, drops = merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)
    facts = _e(spark, d).select("vec_id", "label")
    return merge.apply_map(facts, "vec_id", mapping, drops).groupBy("vec_id").agg(F.count("*").alias("n_rows"))


SQL["apply_merge_map"] = f"{_SYM} select leader vec_id, count(*) n_rows from ml where leader not in (select leader from lost) group by 1"


@query
def reindex_contiguous(spark, d):
    mapping, drops = merge.symmetric_merge(*_merge_input(spark, d), LOWER, UPPER)
    return merge.contiguous_labels(_e(spark, d), "vec_id", mapping, drops)


SQL["reindex_contiguous"] = f"{_SYM}, k as (select id, leader, leader in (select leader from lost) dead from ml), n as (select distinct leader from k where not dead), f as (select leader, row_number() over (order by leader) - 1 final_id from n) select id orig_id, case when dead then -1 else final_id end final_id from k left join f using (leader)"


def _by_label(spark, d):
    return simjoin.units(_e(spark, d), "vec_id", "embedding", F.col("label"))


_DB = (
    "with recursive "
    + _U
    + """, l as (select a.label, a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.28),
k as (select u.vec_id from u left join l on l.a = u.vec_id group by 1 having count(l.b) + 1 >= 3), kl as (select a, b from l where a in (select vec_id from k) and b in (select vec_id from k)),
r(id, root) as (select vec_id, vec_id from k union select kl.b, r.root from r join kl on kl.a = r.id where r.root < kl.b), kc as (select id, min(root) root from r group by 1),
nm as (select u.label, id, dense_rank() over (partition by label order by root) - 1 cluster from kc join u on u.vec_id = kc.id),
bd as (select l.a id, min(nm.cluster) near from l join nm on nm.id = l.b group by 1),
lb as (select u.label "key", u.vec_id id, coalesce(nm.cluster, bd.near, -1) cluster from u left join nm on nm.id = u.vec_id left join bd on bd.id = u.vec_id)"""
)


@query
def dbscan_labels(spark, d):
    return cluster.density_clusters(_by_label(spark, d), 0.72, 3)


@query
def dbscan_clean(spark, d):
    return cluster.cleaned(_by_label(spark, d), 0.72, 3)


_BEST = _DB + ', bn as (select "key", cluster, count(*) n from lb where cluster >= 0 group by 1, 2), bb as (select "key", arg_min(cluster, (-n, cluster)) cluster from bn group by 1)'
SQL["dbscan_labels"] = f'{_DB} select "key"::bigint "key", id, cluster from lb'
SQL["dbscan_clean"] = f'{_BEST} select "key"::bigint "key", id from lb join bb using ("key", cluster)'


@query
def retention_by_type(spark, d):
    kept = cluster.cleaned(_by_label(spark, d), 0.72, 3).select(F.col("id").alias("vec_id"), F.lit(1).alias("kept"))
    e = _e(spark, d).select("vec_id", (F.col("vec_id") % 2).alias("kind")).join(kept, "vec_id", "left")
    return e.rollup("kind").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("kept"), F.lit(0)).alias("n_kept")).withColumn("share", F.round(F.col("n_kept") / F.col("n_rows"), 6))


SQL["retention_by_type"] = f"{_BEST} select u.vec_id % 2 kind, count(*) n_rows, count(bb.cluster) n_kept, round(count(bb.cluster) / count(*), 6) share from u join lb on lb.id = u.vec_id left join bb using (\"key\", cluster) group by rollup (u.vec_id % 2)"


@query
def dbscan_global_splits(spark, d):
    c = cluster.density_clusters(simjoin.units(_e(spark, d), "vec_id", "embedding"), 0.64, 3)
    j = c.join(_e(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    return j.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(F.col("cluster") < 0).alias("n_noise"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"))


SQL["dbscan_global_splits"] = (
    "with recursive "
    + _U
    + """, l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.36),
k as (select u.vec_id from u left join l on l.a = u.vec_id group by 1 having count(l.b) + 1 >= 3), kl as (select a, b from l where a in (select vec_id from k) and b in (select vec_id from k)),
r(id, root) as (select vec_id, vec_id from k union select kl.b, r.root from r join kl on kl.a = r.id where r.root < kl.b), kc as (select id, min(root) root from r group by 1),
nm as (select id, dense_rank() over (order by root) - 1 cluster from kc), bd as (select l.a id, min(nm.cluster) near from l join nm on nm.id = l.b group by 1),
lb as (select u.label, coalesce(nm.cluster, bd.near, -1) cluster from u left join nm on nm.id = u.vec_id left join bd on bd.id = u.vec_id)
select label, count(*) n_rows, count(*) filter (cluster < 0) n_noise, count(distinct case when cluster >= 0 then cluster end) n_clusters from lb group by 1"""
)


@query
def contamination_sweep(spark, d):
    e = _e(spark, d).select("vec_id", (F.col("vec_id") % 5 != 0).alias("genuine"))
    rows = cut(_by_label(spark, d))
    out = None
    for eps in (0.70, 0.72, 0.74):
        c = cut(cluster.density_clusters(rows, eps, 3).join(e.withColumnRenamed("vec_id", "id"), "id"))
        n = c.where("cluster >= 0").groupBy("key", "cluster").agg(F.count_if("genuine").alias("g"), F.count("*").alias("n"))
        main = n.groupBy("key").agg(F.max(F.struct("g", (-F.col("cluster")).alias("c"), "n")).alias("m"))
        total = c.groupBy("key").agg(F.count_if("genuine").alias("genuine"))
        row = total.join(main, "key", "left").agg(F.sum("genuine").alias("n_genuine"), F.coalesce(F.sum("m.g"), F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.col("m.n") - F.col("m.g")), F.lit(0)).alias("n_leaked"), F.count_if(F.col("m.n") > F.col("m.g")).alias("n_dirty"))
        row = row.select(F.lit(eps).alias("eps"), "*", F.round(F.col("n_kept") / F.col("n_genuine"), 6).alias("retention"))
        out = row if out is None else out.unionByName(row)
    return out


def _sweep_sql(eps: float) -> str:
    s = _DB.replace("0.28", f"{1 - eps:.2f}")
    return f"""select * from ({s}, n as (select "key", cluster, count(*) filter (id % 5 <> 0) g, count(*) n from lb where cluster >= 0 group by 1, 2), mn as (select "key", arg_min(g, (-g, cluster)) g, arg_min(n, (-g, cluster)) n from n group by 1), t as (select "key", count(*) filter (id % 5 <> 0) genuine from lb group by 1)
select {eps}::double eps, sum(genuine)::bigint n_genuine, coalesce(sum(g), 0)::bigint n_kept, coalesce(sum(n - g), 0)::bigint n_leaked, count(*) filter (n > g) n_dirty, round(coalesce(sum(g), 0) / sum(genuine), 6) retention from t left join mn using ("key"))"""


SQL["contamination_sweep"] = " union all ".join(_sweep_sql(x) for x in (0.70, 0.72, 0.74))


@query
def margin_scores(spark, d):
    t = vectors.templates(_e(spark, d), "label", "embedding")
    c = dot(unit("embedding"), "embedding_center")
    return _e(spark, d).join(t, "label").withColumn("c", c).select("vec_id", F.round(angular_margin(F.col("c"), 0.5, 64.0), 4).alias("angular"), F.round(cosine_margin(F.col("c"), 0.4, 64.0), 4).alias("additive"))


SQL["margin_scores"] = f"with {_C}, m as (select vec_id, list_dot_product(u.v, c.v) c from u join c using (label)) select vec_id, round(cos(acos(greatest(least(c, 1), -1)) + 0.5) * 64, 4) angular, round((c - 0.4) * 64, 4) additive from m"


@query
def weight_soup(spark, d):
    """The plain average of all weight vectors of each label."""
    s = vectors.vector_sums(_e(spark, d), ["label"], "embedding")
    return s.select("label", "n", F.posexplode("sums").alias("pos", "s")).select("label", "pos", F.round(F.col("s") / F.col("n"), 6).alias("value"))


SQL["weight_soup"] = f"with {_X} select label, pos, round(avg(val), 6) as value from x group by label, pos"
