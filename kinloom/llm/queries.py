"""Queries of the training-data problems over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.text import bare
from kinloom.llm import clusters, contraction, hnsw, language, leakage, packing, recall, survivor
from kinloom.plans.lineage import cut
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _nearest_images(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.nearest(table(spark, d, "image_embedding"), "img_key", "embedding", F.unix_micros(F.col("loaded_at").cast("timestamp")))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest_images(spark, d).select(F.least("key", "other").alias("img_key_a"), F.greatest("key", "other").alias("img_key_b")).distinct()


def _usable(table_name: str, key: str, order: str) -> str:
    finite = "len(embedding) = 512 and list_count(embedding) = 512 and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) and list_max(list_transform(embedding, lambda x: abs(x))) > 0"
    return f"v as materialized (select {key} k, arg_min(embedding, {order})::double[512] e from {table_name} where {finite} group by 1)"


@query
def p1_most_similar(spark: SparkSession, d: str) -> DataFrame:
    person = table(spark, d, "image_embedding").groupBy(F.col("img_key").alias("other")).agg(F.min_by("person_id", "loaded_at").alias("other_person_id"))
    return _nearest_images(spark, d).join(person, "other").select(F.col("key").alias("img_key"), "rank", F.col("other").alias("other_img_key"), "other_person_id", F.round(F.col("sim").cast("double"), 3).alias("cosine"))


@query
def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index against brute force, for every image whose hash is divisible by 50 and all images."""
    return recall.measured(table(spark, d, "image_embedding"), _nearest_images(spark, d), "img_key", "embedding", F.unix_micros(F.col("loaded_at").cast("timestamp")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "merge_pairs").where("score >= threshold").select("person_id", "merged_into")
    return contraction.linked_groups(pairs, "person_id", "merged_into").select("group_id", F.col("id").alias("person_id"))


SQL["p5_found"] = """
with recursive e as (select distinct person_id u, merged_into v from merge_pairs where score >= threshold and person_id <> merged_into),
s as (select u, v from e union select v, u from e),
r(id, root) as (select u, u from s union select s.v, r.root from r join s on s.u = r.id where r.root < s.v)
select min(root) group_id, id person_id from r group by id"""


def _person_members(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rules = survivor.filled_fields()
    records = table(spark, d, "person_records").select("rec_id", "src", "person_id", *rules, "updated_at")
    p = survivor.with_fill(records, rules).withColumn("src_key", bare(F.col("src")))
    m = table(spark, d, "label_map").where("final_id >= 0").select(bare(F.col("src")).alias("src_key"), F.col("orig_id").alias("person_id"), F.col("final_id").alias("group_id")).dropna().distinct()
    trust = table(spark, d, "source_trust").groupBy(bare(F.col("src")).alias("src_key")).agg(F.min("trust_rank").alias("trust"))
    joined = p.join(m, ["src_key", "person_id"]).join(trust, "src_key", "left").withColumn("trust_rank", F.coalesce("trust", F.lit(survivor.LEAST_TRUST)))
    return joined.dropDuplicates(["group_id", "rec_id"]), list(rules)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, fields = _person_members(spark, d)
    return survivor.unbeaten(members, fields).select(F.col("group_id").alias("final_id"), "rec_id")


@query
def p7_built_records(spark: SparkSession, d: str) -> DataFrame:
    members, fields = _person_members(spark, d)
    return survivor.built_records(members, fields).withColumnRenamed("group_id", "final_id")


_P7 = """
with f as (
  select *, lower(trim(src)) s,
    coalesce(lower(trim(name)) not in ('', '-', '?', '??', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'und', 'undefined', 'unknown', 'xx'), false) h1,
    coalesce(birth_year between 1900 and year(current_date), false) h2,
    coalesce(lower(trim(country)) not in ('', '-', '?', '??', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'und', 'undefined', 'unknown', 'xx'), false) h3,
    coalesce(img_count > 0, false) h4,
    coalesce(lower(trim(best_img_key)) not in ('', '-', '?', '??', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'und', 'undefined', 'unknown', 'xx'), false) h5
  from person_records),
m as (select distinct l.final_id, f.*, coalesce(t.trust_rank, 2147483647) k from f
  join label_map l on lower(trim(l.src)) = f.s and l.orig_id = f.person_id and l.final_id >= 0 left join source_trust t on t.src = f.s),
"""
SQL["p7_found"] = (
    _P7
    + """g as (select final_id, count(*) n, bool_or(h1) g1, bool_or(h2) g2, bool_or(h3) g3, bool_or(h4) g4, bool_or(h5) g5, max(updated_at) u, min(k) k from m group by final_id),
c as (select m.final_id, m.rec_id from m join g using (final_id) where g.n >= 2 and m.updated_at = g.u and m.k = g.k and m.h1 >= g1 and m.h2 >= g2 and m.h3 >= g3 and m.h4 >= g4 and m.h5 >= g5),
x as (select m.final_id, count(*) n from m join g using (final_id) where m.updated_at = g.u group by 1)
select c.* from c join x using (final_id) where x.n = 1"""
)
SQL["p7_built_records"] = (
    _P7
    + """o as (select *, -k as a, coalesce(updated_at, timestamp '1000-01-01') as b, -rec_id as c, h1::int + h2::int + h3::int + h4::int + h5::int n from m)
select final_id, count(*) n_members, arg_max(name, (a, b, c)) filter (h1) as name, arg_max(birth_year, (a, b, c)) filter (h2) birth_year, arg_max(country, (a, b, c)) filter (h3) country,
  arg_max(img_count, (a, b, c)) filter (h4) img_count, arg_max(best_img_key, (a, b, c)) filter (h5) best_img_key, arg_max(rec_id, (n, a, b, c)) lead_rec_id from o group by final_id"""
)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    found = p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(found, "item_id").select("item_id", "suite", "n_documents")


def _packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.token_counts(table(spark, d, "documents")))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_items(_packing(spark, d)).withColumnRenamed("item_id", "doc_id")


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packing(spark, d))


def _language_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.language_segments(docs, language.fitted(language.labelled_sample(docs, "doc_id", "text", "lang")))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_language_segments(spark, d))


@query
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _language_segments(spark, d).drop("label")


def _face_clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = hnsw.usable_vectors(table(spark, d, "contaminated_cfp_embeddings"), "rel_path", "embedding", F.col("seq_no"), kind=clusters.KIND)
    return clusters.similarity_clusters(vectors, 0.46)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members = _face_clusters(spark, d)
    size = members.where("closed").groupBy("cluster").agg(F.min("key").alias("cluster_path"), F.count("*").alias("n")).where("n >= 3")
    return members.join(size, "cluster").select("cluster_path", F.col("key").alias("rel_path"))


# a cluster is a set of images that all have the same similar images, and no others
SQL["p2_found"] = f"""with {_usable("contaminated_cfp_embeddings", "rel_path", "seq_no")},
n as (select a.k, list(b.k order by b.k) near from v a, v b where a.k = b.k or array_cosine_similarity(a.e, b.e) >= 0.46 group by 1),
g as (select near from n group by near having count(*) = len(near) and len(near) >= 3)
select near[1] cluster_path, unnest(near) rel_path from g"""


def _hosted_faces(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "contaminated_cfp_embeddings").select(F.col("rel_path").alias("key"), "assigned_id").distinct()
    return _face_clusters(spark, d).join(hosts, "key")


@query
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(cut(_hosted_faces(spark, d)), "assigned_id")


@query
def p2_cluster_hosts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.host_counts(cut(_hosted_faces(spark, d)), "assigned_id")
