"""Queries of the id life cycle over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.text import bare
from kinloom.operators import lifecycle, profile
from kinloom.plans.lineage import cut
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
FLOOR = 500


def query(f):
    Q[f.__name__] = f
    return f


def _src(df: DataFrame) -> DataFrame:
    return df.withColumn("src", bare(F.col("src")))


def _effective(spark, d) -> DataFrame:
    """Native ids of all centres; the pairs that hold as internal map, the ids last mapped to -1 as internal drops."""
    native = _src(table(spark, d, "centers")).where("src is not null").groupBy("src", F.col("person_id").alias("orig_id")).agg(F.max("img_count").alias("img_count"))
    pairs = table(spark, d, "merge_pairs").where("score >= threshold and person_id > merged_into").groupBy("person_id").agg(F.min("merged_into").alias("new_id"))
    internal = native.select("src").distinct().crossJoin(pairs.select(F.col("person_id").alias("og_id"), "new_id"))
    gone = _labels(spark, d).where("final_id = -1").select("src", F.col("orig_id").alias("id"))
    return lifecycle.effective_ids(native, internal, gone, "crawl", FLOOR)


def _labels(spark, d) -> DataFrame:
    return lifecycle.latest_map(_src(table(spark, d, "label_map")).where("src is not null and orig_id is not null and final_id is not null"), "src", "orig_id")


def _final(spark, d) -> DataFrame:
    """The pairs below their threshold as global map, the ids paired with themselves as global drops."""
    p = table(spark, d, "merge_pairs")
    mapping = p.where("score < threshold and person_id > merged_into").groupBy(F.col("person_id").alias("og_id")).agg(F.min("merged_into").alias("new_id"))
    return cut(lifecycle.final_labels(_effective(spark, d), mapping, p.where("person_id = merged_into").select(F.col("person_id").alias("id"))))


_N = """
with n as (select lower(trim(src)) src, person_id orig_id, max(img_count) img_count from centers where src is not null group by 1, 2),
im as (select person_id og, min(merged_into) new_id from merge_pairs where score >= threshold and person_id > merged_into group by 1),
lm as (select lower(trim(src)) src, orig_id, arg_max(final_id, (mapped_at, map_id)) final_id from label_map where src is not null and orig_id is not null and final_id is not null group by 1, 2),
e0 as (select n.*, case when lm.final_id = -1 then null else coalesce(im.new_id, n.orig_id) end e from n left join im on im.og = n.orig_id left join lm on lm.src = n.src and lm.orig_id = n.orig_id),
o as (select greatest(coalesce(max(e), 0) + 1, 500) o from e0 where src <> 'crawl'),
e1 as (select src, orig_id, img_count, case when src = 'crawl' then e + o else e end e1 from e0, o)"""
_F = (
    _N
    + """, gm as (select person_id og, min(merged_into) new_id from merge_pairs where score < threshold and person_id > merged_into group by 1),
gd as (select distinct person_id from merge_pairs where person_id = merged_into),
e2 as (select e1.*, case when e1 is not null and e1 not in (select person_id from gd) then coalesce(gm.new_id, e1) end e2 from e1 left join gm on gm.og = e1),
k as (select e2, row_number() over (order by e2) - 1 final_id from (select distinct e2 from e2 where e2 is not null)),
f as (select src, orig_id, img_count, coalesce(k.final_id, -1) final_id from e2 left join k using (e2))"""
)


@query
def template_offset(spark, d):
    return _effective(spark, d).select("src", "orig_id", F.col("e1").alias("effective_id"))


SQL["template_offset"] = _N + " select src, orig_id, e1 effective_id from e1"


@query
def reindex_labels(spark, d):
    return _final(spark, d).select("src", "orig_id", "final_id")


SQL["reindex_labels"] = _F + " select src, orig_id, final_id from f"


@query
def reindex_summary(spark, d):
    return lifecycle.label_summary(_final(spark, d))


SQL["reindex_summary"] = (
    _F
    + """ select src, count(*) n_ids, count(*) filter (final_id >= 0) n_kept, coalesce(sum(img_count) filter (final_id >= 0), 0)::bigint num_image,
  min(final_id) filter (final_id >= 0) first_label, max(final_id) filter (final_id >= 0) last_label, count(distinct final_id) filter (final_id >= 0) n_classes from f group by rollup (src)"""
)


def _surviving(spark, d) -> DataFrame:
    images = _src(table(spark, d, "image_embedding").select("src", "person_id", "img_key"))
    return lifecycle.surviving_rows(images, _labels(spark, d))


_S = """
with lm as (select lower(trim(src)) src, orig_id, arg_max(final_id, (mapped_at, map_id)) final_id from label_map where src is not null and orig_id is not null and final_id is not null group by 1, 2),
s as (select distinct lower(trim(i.src)) src, lm.final_id, img_key from image_embedding i join lm on lm.src = lower(trim(i.src)) and lm.orig_id = i.person_id where lm.final_id >= 0)"""


@query
def surviving_manifest(spark, d):
    return _surviving(spark, d)


SQL["surviving_manifest"] = _S + " select * from s"


@query
def archive_plan(spark, d):
    return lifecycle.archive_plan(_surviving(spark, d), 4)


SQL["archive_plan"] = (
    _S
    + """, p as (select split_part(img_key, '.tar/', 1) || '.tar' tar_path, split_part(img_key, '.tar/', 2) member_name, final_id from s where img_key like '%.tar/%'),
t as (select tar_path, ((row_number() over (order by tar_path) - 1) % 4)::int shard from (select distinct tar_path from p))
select p.tar_path, t.shard, p.member_name, p.final_id from p join t using (tar_path)"""
)


@query
def inherit_parent_label(spark, d):
    """Images under the last label of their (source, native id); dropped parents leave none."""
    return _surviving(spark, d).select(F.col("img_key").alias("child"), "final_id").distinct()


SQL["inherit_parent_label"] = _S + " select distinct img_key child, final_id from s"


@query
def size_distribution(spark, d):
    """Classes and images per range of class size, per source and over all (no source)."""
    sized = _src(table(spark, d, "image_embedding")).where("src is not null and person_id is not null").groupBy("src", "person_id").agg(F.count("*").alias("n"))
    bucket = profile.bucket_label(F.col("n"), profile.FULL_BUCKETS)
    return sized.withColumn("bucket", bucket).where("bucket is not null").cube("src", "bucket").agg(F.count("*").alias("ids"), F.sum("n").alias("imgs")).where("bucket is not null")


SQL["size_distribution"] = """
with s as (select lower(trim(src)) src, person_id, count(*) n from image_embedding where src is not null and person_id is not null group by 1, 2),
b as (select src, n, case when n < 3 then null when n <= 5 then '3-5' when n <= 10 then '6-10' when n <= 20 then '11-20' when n <= 50 then '21-50' when n <= 100 then '51-100' when n <= 200 then '101-200' when n <= 500 then '201-500'
  when n <= 1000 then '501-1000' when n <= 2000 then '1001-2000' when n <= 5000 then '2001-5000' when n <= 10000 then '5001-10000' else '10001+' end bucket from s)
select src, bucket, count(*) ids, sum(n)::bigint imgs from b where bucket is not null group by 1, 2 union all select null, bucket, count(*), sum(n)::bigint from b where bucket is not null group by 2"""
