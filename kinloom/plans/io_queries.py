"""Round trips of the sources and sinks: whole tables are written in a form, read back and compared with SQL over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.plans.lifecycle_queries import SQL as LIFE
from kinloom.plans.lifecycle_queries import surviving_manifest
from kinloom.plans.lineage import ensure_shared_folder
from kinloom.sources import files, recordio, sinks
from kinloom.sources.tables import scan, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _folder(spark: SparkSession) -> str:
    base = ensure_shared_folder(spark)
    return f"{base if ':' in base else f'file://{base}'}/kinloom-io-{uuid.uuid4().hex}"


@query
def io_csv(spark, d):
    p = _folder(spark)
    sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), p, "csv")
    return files.csv_table(spark, p, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


SQL["io_csv"] = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders"


@query
def io_json(spark, d):
    p = _folder(spark)
    sinks.write_table(table(spark, d, "events").select("event_id", "event_type", "props"), p, "json")
    return spark.read.schema("event_id long, event_type string, props string").json(p)


SQL["io_json"] = "select event_id, event_type, props from events"


@query
def io_spaced_text(spark, d):
    p = _folder(spark)
    sinks.write_table(table(spark, d, "lineitem").select(F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey").alias("value")), p, "text")
    return files.spaced_text(spark, p, "template_a long, template_b int, label long")


SQL["io_spaced_text"] = "select l_orderkey template_a, l_linenumber template_b, l_partkey label from lineitem"


@query
def io_id_lines(spark, d):
    p = _folder(spark)
    sinks.write_table(table(spark, d, "merge_pairs").where("person_id is not null").select(F.concat_ws(" ", F.col("person_id"), F.lit("x"), F.col("merged_into")).alias("value")), p, "text")
    return files.id_lines(spark, p)


SQL["io_id_lines"] = "select person_id id from merge_pairs where person_id is not null union select merged_into from merge_pairs where person_id is not null and merged_into is not null"


@query
def io_landmark_lines(spark, d):
    p = _folder(spark)
    f = table(spark, d, "faces_exploded").where("size(landmark) = 10 and not exists(landmark, x -> x is null)")
    name = F.concat_ws(":", F.col("s3_path"), F.col("face_index"))
    sinks.write_table(f.select(F.concat_ws(" ", name, F.array_join(F.transform("landmark", lambda x: x.cast("string")), " ")).alias("value")), p, "text")
    back = files.landmark_lines(spark, p)
    # the name ends in the number after its last colon
    return back.groupBy(F.regexp_extract("name", r"^(.*):", 1).alias("s3_path"), F.substring_index("name", ":", -1).cast("int").alias("face_index")).agg(F.count("*").alias("n"), F.round(F.max(F.col("landmark")[0]), 3).alias("x"), F.round(F.max(F.col("landmark")[9]), 3).alias("y"), F.max("score").alias("score"))


SQL["io_landmark_lines"] = "select s3_path, face_index, count(*) n, round(max(landmark[1]), 3) x, round(max(landmark[10]), 3) y, 1.0::double score from faces_exploded where len(landmark) = 10 and list_count(landmark) = 10 group by 1, 2"


@query
def io_partitioned(spark, d):
    """Hive layout; the filter on the key reads its folders alone."""
    p = _folder(spark)
    sinks.write_partitioned(table(spark, d, "events").select("event_id", "event_type", "value"), p, "event_type")
    return scan(spark, p).where("event_type >= 'm'").select("event_id", "event_type", F.round("value", 6).alias("value"))


SQL["io_partitioned"] = "select event_id, event_type, round(value, 6) as value from events where event_type >= 'm'"


@query
def io_chunks_and_patterns(spark, d):
    """Files of at most 1,000 rows under two folders, read by a pattern; one folder of them is read again by its path."""
    p = _folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "doc_kind")
    sinks.write_chunks(docs.where("source is null"), f"{p}/none", 1_000)
    sinks.write_chunks(docs.where("source is not null"), f"{p}/some", 1_000)
    return scan(spark, f"{p}/*e", f"{p}/none", columns=["doc_id", "source"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


SQL["io_chunks_and_patterns"] = "select source, count(*) * case when source is null then 2 else 1 end n, (sum(doc_id) * case when source is null then 2 else 1 end)::bigint total from documents group by 1"


def _records(spark, d) -> DataFrame:
    return table(spark, d, "image_embedding").where("person_id is not null").select(F.col("person_id").cast("double").alias("label"), F.encode("img_key", "utf-8").alias("payload"))


@query
def io_records(spark, d):
    written = recordio.write_records(_records(spark, d), _folder(spark)).select("rec_path").toLocalIterator()
    back = recordio.read_records(spark, [r.rec_path for r in written])
    return back.groupBy(F.col("label").cast("long").alias("person_id"), F.decode("payload", "utf-8").alias("img_key")).agg(F.count("*").alias("n"))


@query
def io_records_without_index(spark, d):
    """The same files, their index left behind."""
    from pyarrow import fs as pafs

    written = [r.rec_path for r in recordio.write_records(_records(spark, d), _folder(spark)).select("rec_path").toLocalIterator()]
    for path in written:
        fs, place = pafs.FileSystem.from_uri(path)
        fs.delete_file(place[: -len("rec")] + "idx")
    back = recordio.read_records(spark, written)
    return back.groupBy(F.col("label").cast("long").alias("person_id"), F.decode("payload", "utf-8").alias("img_key")).agg(F.count("*").alias("n"))


# labels are 32-bit numbers in the format
SQL["io_records"] = SQL["io_records_without_index"] = "select person_id::float::bigint person_id, img_key, count(*) n from image_embedding where person_id is not null group by 1, 2"


@query
def io_archives(spark, d):
    """One archive per product type and part, its members listed with their byte ranges and read by them."""
    p = _folder(spark)
    sinks.write_archives(table(spark, d, "part").select(F.translate("p_type", " ", "_").alias("kind"), F.concat(F.col("p_partkey"), F.lit(".txt")).alias("name"), F.encode("p_name", "utf-8").alias("body")), p, "kind", "name", "body")
    back = files.byte_ranges(files.tar_members(spark, p, ".txt"), "tar_path", "start_byte", "length")
    return back.select(F.regexp_extract("tar_path", r"([^/]+)-\d{4}\.tar$", 1).alias("kind"), "member_name", F.decode("payload", "utf-8").alias("p_name"))


SQL["io_archives"] = "select replace(p_type, ' ', '_') kind, p_partkey || '.txt' member_name, p_name from part"


@query
def io_listing(spark, d):
    """Archives per folder label, from a listing and from labelled files."""
    p = _folder(spark)
    sinks.write_archives(table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("name"), F.encode("n_name", "utf-8").alias("body")), f"{p}/regions", "n_regionkey", "name", "body", rows=1_000)
    listed = files.listing(spark, p, ".tar").agg(F.count("*").alias("n_files"))
    return listed.crossJoin(files.labelled_files(spark, p).groupBy("label").agg(F.count("*").alias("n")))


SQL["io_listing"] = "select count(distinct n_regionkey) n_files, 'regions' as label, count(distinct n_regionkey) n from nation"


@query
def io_publish(spark, d):
    """A folder replaced by what was read from it."""
    p = _folder(spark)
    sinks.publish(table(spark, d, "customer").select("c_custkey", "c_acctbal"), p)
    sinks.publish(spark.read.parquet(p).where("c_acctbal >= 0"), p)
    return spark.read.parquet(p)


SQL["io_publish"] = "select c_custkey, c_acctbal from customer where c_acctbal >= 0"


@query
def io_manifest(spark, d):
    p = _folder(spark)
    sinks.write_manifest(surviving_manifest(spark, d), p)
    return scan(spark, p, columns=["src", "final_id", "img_key"])


SQL["io_manifest"] = LIFE["surviving_manifest"]
