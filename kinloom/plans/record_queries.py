"""Queries of the profiling, numbering, selection, text and incremental operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.text import canonical_path
from kinloom.operators import ordered, profile, records
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _per_order(spark, d) -> DataFrame:
    return profile.group_counts(table(spark, d, "lineitem"), "l_orderkey")


_PO = "po as (select l_orderkey, count(*) n from lineitem group by 1)"


@query
def count_buckets(spark, d):
    return profile.bucket_distribution(_per_order(spark, d), "n")


SQL["count_buckets"] = f"with {_PO}, b as (select n, case when n between 3 and 5 then '3-5' when n between 6 and 10 then '6-10' when n between 11 and 20 then '11-20' when n between 21 and 50 then '21-50' when n between 51 and 100 then '51-100' when n between 101 and 200 then '101-200' when n >= 201 then '201+' end bucket from po) select bucket, count(*) ids, sum(n)::bigint \"rows\" from b where bucket is not null group by 1"


@query
def count_percentiles(spark, d):
    return profile.percentiles(_per_order(spark, d), "n").withColumn("value", F.round("value", 6))


SQL["count_percentiles"] = f"with {_PO}, q as (select unnest([0.01, 0.25, 0.5, 0.75, 0.99]) p) select p::double p, round((select quantile_cont(n::double, [0.01, 0.25, 0.5, 0.75, 0.99]) from po)[list_position([0.01, 0.25, 0.5, 0.75, 0.99], p)], 6) as value from q"


@query
def count_stats(spark, d):
    return profile.count_stats(_per_order(spark, d), "n").select("n", "least", "most", F.round("mean", 6).alias("mean"), F.round("middle", 6).alias("middle"), F.round("sd", 6).alias("sd"))


SQL["count_stats"] = f"with {_PO} select count(n) n, min(n) least, max(n) most, round(avg(n), 6) mean, round(quantile_cont(n::double, 0.5), 6) middle, round(stddev_samp(n), 6) sd from po"


@query
def histogram_equal_width(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20)


SQL["histogram_equal_width"] = "with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::int bin, count(*) n from lineitem, e group by 1"


@query
def coverage_audit(spark, d):
    return profile.coverage(table(spark, d, "lineitem"), "l_orderkey", 20_000, 6)


SQL["coverage_audit"] = f"with {_PO}, a as (select count(*) filter (l_orderkey between 0 and 19999) n_present, coalesce(sum(n) filter (l_orderkey not between 0 and 19999), 0)::bigint n_out_of_range, count(*) filter (l_orderkey between 0 and 19999 and n > 6) n_large from po) select n_present, n_out_of_range, n_large, 20000 - n_present n_missing, n_present = 20000 and n_out_of_range = 0 passed from a"


@query
def gap_report(spark, d):
    return profile.gaps(table(spark, d, "lineitem"), "l_orderkey")


SQL["gap_report"] = "select min(l_orderkey) least, max(l_orderkey) most, count(distinct l_orderkey) n_ids, max(l_orderkey) - min(l_orderkey) + 1 - count(distinct l_orderkey) n_gaps from lineitem"


@query
def duplicate_keys(spark, d):
    return profile.duplicate_keys(table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("text_key")), "text_key")


SQL["duplicate_keys"] = "select md5(text) text_key, count(*) n from documents where text is not null group by 1 having count(*) > 1"


@query
def large_ids(spark, d):
    return _per_order(spark, d).where("n > 6")


SQL["large_ids"] = f"with {_PO} select l_orderkey, n from po where n > 6"


@query
def before_after_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    r = profile.before_after(docs, records.keep_first(docs, ["k"], "doc_id"), "source")
    return r.withColumn("mean_per_id", F.round("mean_per_id", 6))


SQL["before_after_report"] = """with d as (select doc_id, source, md5(coalesce(text, '')) k from documents), f as (select arg_min(source, doc_id) as x, k, min(doc_id) doc_id from d group by k), a as (select d.source from d join f using (doc_id)),
c as (select 'before' stage, source, count(*) n from d group by 2 union all select 'after', source, count(*) from a group by 2) select stage, sum(n)::bigint n_rows, count(*) n_ids, round(avg(n), 6) mean_per_id, max(n) most_per_id from c group by 1"""


@query
def dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source").where("text_key is not null")
    return records.keep_first(docs, ["text_key"], "doc_id")


SQL["dedup_keep_first"] = "select md5(text) text_key, doc_id, source from documents where text is not null qualify row_number() over (partition by text order by doc_id) = 1"


@query
def dedup_distinct(spark, d):
    return table(spark, d, "documents").select("source", "lang", "doc_kind").distinct()


SQL["dedup_distinct"] = "select distinct source, lang, doc_kind from documents"


@query
def duplicate_groups(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("k"), "doc_id")
    g = docs.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return docs.join(g.where("n > 1"), "k").select("first_id", "doc_id", "n")


SQL["duplicate_groups"] = "select min(doc_id) over w first_id, doc_id, count(*) over w n from documents where text is not null window w as (partition by text) qualify count(*) over w > 1"


@query
def cross_source_ids(spark, d):
    return profile.shared_between(table(spark, d, "image_embedding").where("src is not null"), "person_id", "src")


SQL["cross_source_ids"] = "select person_id, count(distinct src) n_parts from image_embedding where person_id is not null and src is not null group by 1 having count(distinct src) > 1"


@query
def files_per_key(spark, d):
    return profile.parts_per_key(table(spark, d, "events"), "user_id", "event_type")


SQL["files_per_key"] = "with k as (select user_id, count(distinct event_type) n_parts from events group by 1) select n_parts, count(*) n_keys from k group by 1"


@query
def partition_overlap(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return profile.shared_between(e, "user_id", "day")


SQL["partition_overlap"] = "select user_id, count(distinct strftime(ts, '%Y-%m-%d')) n_parts from events group by 1 having count(distinct strftime(ts, '%Y-%m-%d')) > 1"


@query
def encode_names(spark, d):
    return records.encoded(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "name_id").select("p_partkey", "p_name", "name_id")


SQL["encode_names"] = "select p_partkey, p_name, dense_rank() over (order by p_name) - 1 name_id from part"


@query
def topn_per_group(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").where("l_extendedprice >= 400")
    return records.top_rows(li.dropDuplicates(), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 3, "l_linenumber")


SQL["topn_per_group"] = "select l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) \"rank\" from (select distinct l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice >= 400) qualify \"rank\" <= 3"


@query
def largest_per_group(spark, d):
    f = table(spark, d, "faces_exploded").where(F.col("bbox").isNotNull() & F.col("landmark").isNotNull())
    area = (F.col("bbox")[2] - F.col("bbox")[0]) * (F.col("bbox")[3] - F.col("bbox")[1])
    best = f.groupBy("s3_path").agg(F.max(F.struct(area.alias("area"), (-F.col("face_index")).alias("i"))).alias("b"))
    return best.select("s3_path", (-F.col("b.i")).alias("face_index"), F.round("b.area", 4).alias("area"))


SQL["largest_per_group"] = "with a as (select distinct s3_path, face_index, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) area from faces_exploded where bbox is not null and landmark is not null) select s3_path, face_index, round(area, 4) area from a qualify row_number() over (partition by s3_path order by area desc, face_index) = 1"


@query
def parse_nested_json(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k int").getField("k"), F.lit(-1)).alias("k"))


SQL["parse_nested_json"] = "select event_id, coalesce((props->>'k')::int, -1) k from events"


_KEY = "img_key like 's3://%'"


@query
def parse_paths(spark, d):
    p = table(spark, d, "image_embedding").where(_KEY).select("img_key").distinct()
    cut = F.split("img_key", r"\.tar/", 2)
    return p.select("img_key", F.concat(cut[0], F.lit(".tar")).alias("tar_path"), cut[1].alias("member_name"), F.lower(F.substring_index("img_key", ".", -1)).alias("suffix"))


SQL["parse_paths"] = f"select distinct img_key, split_part(img_key, '.tar/', 1) || '.tar' tar_path, split_part(img_key, '.tar/', 2) member_name, lower(split_part(img_key, '.', -1)) suffix from image_embedding where {_KEY}"


@query
def regex_extract_id(spark, d):
    p = table(spark, d, "image_embedding").select("img_key").distinct()
    return p.select("img_key", F.nullif(F.regexp_extract("img_key", r"person_(\d+)\.tar", 1), F.lit("")).try_cast("long").alias("path_id"))


SQL["regex_extract_id"] = r"select distinct img_key, try_cast(nullif(regexp_extract(img_key, 'person_(\d+)\.tar', 1), '') as bigint) path_id from image_embedding"


@query
def shard_folder(spark, d):
    p = table(spark, d, "image_embedding").where("person_id is not null").select("person_id").distinct()
    lo = F.floor(F.col("person_id") / 1000) * 1000
    return p.select("person_id", F.concat_ws("_", F.lit("person"), lo.cast("string"), (lo + 999).cast("string")).alias("folder"), F.concat(F.lit("person_"), F.lpad(F.col("person_id").cast("string"), 7, "0"), F.lit(".tar")).alias("tar_name"))


SQL["shard_folder"] = "select distinct person_id, 'person_' || (person_id // 1000 * 1000) || '_' || (person_id // 1000 * 1000 + 999) folder, 'person_' || lpad(person_id::varchar, 7, '0') || '.tar' tar_name from image_embedding where person_id is not null"


@query
def tar_plan(spark, d):
    """Members per archive, archives dealt to 4 shards in their order."""
    p = table(spark, d, "image_embedding").where(_KEY).select(F.concat(F.split("img_key", r"\.tar/", 2)[0], F.lit(".tar")).alias("tar_path"), "img_key").distinct()
    return records.round_robin(p.groupBy("tar_path").agg(F.count("*").alias("n_members")), "tar_path", 4)


SQL["tar_plan"] = f"with t as (select split_part(img_key, '.tar/', 1) || '.tar' tar_path, count(distinct img_key) n_members from image_embedding where {_KEY} group by 1) select tar_path, n_members, ((row_number() over (order by tar_path) - 1) % 4)::int shard from t"


@query
def canonical_paths(spark, d):
    p = table(spark, d, "faces_exploded").select("s3_path").distinct()
    return p.select("s3_path", canonical_path(F.concat(F.lit(" S3A"), F.expr("substring(s3_path, 3)"), F.lit("/.//x%5Fy "))).alias("path"))


SQL["canonical_paths"] = "select distinct s3_path, s3_path || '/x_y' path from faces_exploded"


@query
def round_robin_shards(spark, d):
    return records.round_robin(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


SQL["round_robin_shards"] = "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) % 7)::int shard from orders"


@query
def contiguous_shards(spark, d):
    return records.contiguous_shards(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


SQL["contiguous_shards"] = "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // (select ceil(count(*) / 7)::bigint from orders))::int shard from orders"


@query
def reindex_overflow(spark, d):
    return records.overflow_labels(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", 10_000)


SQL["reindex_overflow"] = "with i as (select distinct l_orderkey from lineitem) select l_orderkey, l_orderkey new_label from i where l_orderkey <= 10000 union all select l_orderkey, row_number() over (order by l_orderkey) + 10000 from i where l_orderkey > 10000"


@query
def reindex_gap_close(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return ordered.closed_gaps(orders, "o_orderkey", orders.where("o_orderkey % 10 = 3"))


SQL["reindex_gap_close"] = "with m as (select o_orderkey, o_orderkey % 10 = 3 x from orders), r as (select *, sum(x::int) over (order by o_orderkey) below from m) select o_orderkey, (o_orderkey - below)::bigint new_label from r where not x"


@query
def stratified_sample(spark, d):
    return records.stratified_sample(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id", 3)


SQL["stratified_sample"] = "select doc_id, source from documents where source is not null qualify row_number() over (partition by source order by md5('42' || doc_id), doc_id) <= 3"


@query
def sample_without_replacement(spark, d):
    return records.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


SQL["sample_without_replacement"] = "select doc_id from documents order by md5('42' || doc_id), doc_id limit 50"


@query
def capped_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.least("l_quantity", F.lit(30.0))), 4).alias("capped"))


SQL["capped_sum"] = "select l_returnflag, round(sum(least(l_quantity, 30)), 4) capped from lineitem group by 1"


@query
def case_bins(spark, d):
    q = F.col("l_quantity")
    label = F.when(q <= 10, "0-10").when(q <= 25, "11-25").when(q <= 40, "26-40").otherwise("41+")
    return table(spark, d, "lineitem").groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


SQL["case_bins"] = "select case when l_quantity <= 10 then '0-10' when l_quantity <= 25 then '11-25' when l_quantity <= 40 then '26-40' else '41+' end bin, count(*) n from lineitem group by 1"


@query
def band_filter(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0.02 and l_discount <= 0.05 and l_quantity between 10 and 20").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


SQL["band_filter"] = "select count(*) n, round(sum(l_extendedprice), 2) price from lineitem where l_discount > 0.02 and l_discount <= 0.05 and l_quantity between 10 and 20"


@query
def prefix_integrity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang")
    copy = docs.where("doc_id % 11 <> 4").withColumn("lang", F.when(F.col("doc_id") % 13 == 5, "zz").otherwise(F.col("lang")))
    return records.unequal_prefix(docs, copy, "doc_id", "h", "lang")


SQL["prefix_integrity"] = "select doc_id from documents where doc_id % 11 = 4 or (doc_id % 13 = 5 and lang is distinct from 'zz')"


@query
def anti_resume(spark, d):
    o = table(spark, d, "orders")
    return records.not_done(o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F'"), "o_orderkey")


SQL["anti_resume"] = "select o_orderkey, o_custkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"


@query
def lookup_with_default(spark, d):
    """Dictionary join: images per class, -1 where the mapped class is not known."""
    m = table(spark, d, "label_map").where("orig_id is not null").groupBy(F.col("orig_id").alias("person_id")).agg(F.max("final_id").alias("f"))
    return table(spark, d, "image_embedding").join(m, "person_id", "left").groupBy(F.coalesce("f", F.lit(-1)).alias("final_id")).agg(F.count("*").alias("n"))


SQL["lookup_with_default"] = "with m as (select orig_id, max(final_id) f from label_map where orig_id is not null group by 1) select coalesce(f, -1) final_id, count(*) n from image_embedding i left join m on m.orig_id = i.person_id group by 1"


@query
def overall_and_per_source(spark, d):
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


SQL["overall_and_per_source"] = "select source, count(*) n, grouping(source)::bigint as level from documents group by rollup (source)"


@query
def running_mean(spark, d):
    return profile.running_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity").select(F.round("mean", 8).alias("mean"))


SQL["running_mean"] = "select round(sum(l_discount * l_quantity) / sum(l_quantity), 8) mean from lineitem"


@query
def best_so_far(spark, d):
    """Best value so far over time, over all events."""
    from kinloom.operators.ordered import with_running_max

    e = table(spark, d, "events").select("event_id", "ts", "value")
    return with_running_max(e, [F.col("ts"), F.col("event_id")], "value", "best").select("event_id", "best")


SQL["best_so_far"] = "select event_id, max(value) over (order by ts, event_id rows unbounded preceding) best from events"


@query
def score_udf(spark, d):
    from kinloom.functions.scoring import text_embedding

    return table(spark, d, "documents").where("text is not null").select("doc_id", text_embedding("text").alias("embedding"))


@query
def incremental_events(spark, d):
    """Events that arrive in two lots; the second call reads the second lot alone and adds to the first, late hours included."""
    import uuid

    from kinloom.plans.lineage import ensure_shared_folder
    from kinloom.streaming.incremental import hourly_counts

    base = f"{ensure_shared_folder(spark)}/kinloom-stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("ts", "event_type", "value")
    early = F.col("event_type") < "m"
    for lot in (events.where(early), events.where(~early)):
        lot.write.mode("append").parquet(f"{base}/in")
        counts = hourly_counts(spark, f"{base}/in", f"{base}/state")
    return counts


SQL["incremental_events"] = "select date_trunc('hour', ts) hour_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"
