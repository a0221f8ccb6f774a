"""Queries over faces, and the remaining selection operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.functions.images import TEMPLATE_112, alignment, box_area, expanded_crop, grey_hash
from kinloom.functions.vectors import norm
from kinloom.operators import ordered, quality, records
from kinloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def top_faces(spark, d):
    """Faces of at least 20 x 20, the five largest per picture, numbered by size, with the encoded name."""
    f = table(spark, d, "faces_exploded").where(F.col("bbox").isNotNull()).select("s3_path", "face_index", "name", box_area(F.col("bbox")).alias("area")).dropDuplicates(["s3_path", "face_index", "area"])
    top = records.top_rows(f.where("area >= 400").drop("name"), ["s3_path"], [F.col("area").desc(), F.col("face_index")], 5, "face_index")
    return top.select("s3_path", "face_index", F.round("area", 4).alias("area"), (F.col("rank") - 1).alias("place"))


SQL["top_faces"] = "with f as (select distinct s3_path, face_index, greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0) area from faces_exploded where bbox is not null) select s3_path, face_index, round(area, 4) area, row_number() over (partition by s3_path order by area desc, face_index) - 1 place from f where area >= 400 qualify place < 5"


@query
def encoded_person_names(spark, d):
    names = table(spark, d, "faces_exploded").select("name").distinct()
    return records.encoded(names.select(F.coalesce("name", F.lit("unknown")).alias("name")).distinct(), "name", "name_id").select("name", "name_id")


SQL["encoded_person_names"] = "with n as (select distinct coalesce(name, 'unknown') as name from faces_exploded) select name, row_number() over (order by name) - 1 name_id from n"


@query
def crop_boxes(spark, d):
    f = table(spark, d, "faces_exploded").where(F.col("bbox").isNotNull()).select("s3_path", "face_index", "bbox").distinct()
    return f.select("s3_path", "face_index", expanded_crop(F.col("bbox"), F.lit(640), F.lit(640)).alias("c")).select("s3_path", "face_index", "c.*").distinct()


SQL["crop_boxes"] = "select distinct s3_path, face_index, greatest(0, trunc(bbox[1] - (bbox[3] - bbox[1]) / 4))::int x1, greatest(0, trunc(bbox[2] - (bbox[4] - bbox[2]) / 4))::int y1, least(640, trunc(bbox[3] + (bbox[3] - bbox[1]) / 4))::int x2, least(640, trunc(bbox[4] + (bbox[4] - bbox[2]) / 4))::int y2 from faces_exploded where bbox is not null"


@query
def face_alignment(spark, d):
    """Transforms of the landmarks, on a grid of 1/512: the engines round decimal halves in different ways."""
    f = table(spark, d, "faces_exploded").where(F.size("landmark") == 10).select("s3_path", "face_index", "landmark").distinct()
    m = f.select("s3_path", "face_index", alignment(F.col("landmark")).alias("m")).select("s3_path", "face_index", *[(F.floor(F.col(f"m.{c}") * 512 + 0.3) / 512).alias(c) for c in ("a", "b", "tx", "ty")])
    return m.distinct()


_U = "[" + ", ".join(f"{u}::double" for u, _ in TEMPLATE_112) + "]"
_V = "[" + ", ".join(f"{v}::double" for _, v in TEMPLATE_112) + "]"
SQL["face_alignment"] = f"""with f as (select distinct s3_path, face_index, landmark from faces_exploded where len(landmark) = 10),
p as (select s3_path, face_index, landmark, unnest([1, 2, 3, 4, 5]) i from f), x as (select s3_path, face_index, landmark, landmark[2 * i - 1] x, landmark[2 * i] y, {_U}[i] u, {_V}[i] v from p),
m as (select s3_path, face_index, landmark, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv from x group by 1, 2, 3),
s as (select m.*, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) b from m join x using (s3_path, face_index, landmark) group by all)
select distinct s3_path, face_index, floor(a * 512 + 0.3) / 512 a, floor(b * 512 + 0.3) / 512 b, floor((mu - a * mx + b * my) * 512 + 0.3) / 512 tx, floor((mv - b * mx - a * my) * 512 + 0.3) / 512 ty from s"""


@query
def picture_hashes(spark, d):
    """Perceptual hash of each 64-number vector read as an 8 x 8 picture."""
    return table(spark, d, "embeddings").select("vec_id", grey_hash(F.col("embedding").cast("array<double>")).alias("phash"))


@query
def mean_feature_norm(spark, d):
    return table(spark, d, "embeddings").agg(F.round(F.avg(norm("embedding")), 6).alias("mean_norm"))


SQL["mean_feature_norm"] = "select round(avg(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) mean_norm from embeddings"


@query
def flip_pairs(spark, d):
    """Even and odd rows form a pair by position."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    half = e.withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    a, b = half.where("vec_id % 2 = 0").select("pair_id", F.col("label").alias("even_label")), half.where("vec_id % 2 = 1").select("pair_id", F.col("label").alias("odd_label"))
    return a.join(b, "pair_id")


SQL["flip_pairs"] = "select a.vec_id // 2 pair_id, a.label even_label, b.label odd_label from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1"


@query
def shifted_labels(spark, d):
    return table(spark, d, "manifest").where("removed_at is null").groupBy((F.col("final_id") + 3_000_000).alias("final_id")).agg(F.count("*").alias("n"))


SQL["shifted_labels"] = "select final_id + 3000000 final_id, count(*) n from manifest where removed_at is null group by 1"


@query
def segment_bounds(spark, d):
    """First and last line number and size of each run of one order; runs are the groups of the sorted key."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count("*").alias("n"))


SQL["segment_bounds"] = "select l_orderkey, min(l_linenumber) first_line, max(l_linenumber) last_line, count(*) n from lineitem group by 1"


@query
def label_changes(spark, d):
    """Where the event type changes from one event of a user to the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where("before <> event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


SQL["label_changes"] = "with e as (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) select before, event_type, count(*) n from e where before <> event_type group by 1, 2"


@query
def first_groups(spark, d):
    """All rows of the first 20 groups in order of first appearance."""
    e = table(spark, d, "events").select("event_id", "user_id")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("at")).orderBy("at").limit(20)
    return e.join(F.broadcast(first.select("user_id")), "user_id", "left_semi")


SQL["first_groups"] = "select event_id, user_id from events where user_id in (select user_id from events group by 1 order by min(event_id) limit 20)"


@query
def largest_classes(spark, d):
    """Top ten classes by published images."""
    return table(spark, d, "manifest").groupBy("final_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "final_id").limit(10)


SQL["largest_classes"] = "select final_id, count(*) n from manifest group by 1 order by n desc, final_id limit 10"


@query
def shuffled_order(spark, d):
    """Full shuffle: places by a keyed hash, the same on every run."""
    o = table(spark, d, "orders").select("o_orderkey").withColumn("h", F.md5(F.concat(F.lit("7"), F.col("o_orderkey").cast("string"))))
    return ordered.with_row_number(o, [F.col("h"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


SQL["shuffled_order"] = "select o_orderkey, row_number() over (order by md5('7' || o_orderkey), o_orderkey) place from orders"


@query
def even_sampler(spark, d):
    """Equal shares for 7 ranks, the first rows repeated to fill."""
    return records.even_shares(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


SQL["even_sampler"] = "with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders), p as (select o_orderkey, i from r union all select o_orderkey, n + i from r where i < (7 - n % 7) % 7) select o_orderkey, (i % 7)::int \"rank\", i // 7 place from p"


@query
def whitelist_and_blocklist(spark, d):
    """Orders of listed customers that are not among the blocked ones."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c.where("c_mktsegment = 'BUILDING'"), "o_custkey", "left_semi").join(c.where("c_acctbal < 0"), "o_custkey", "left_anti")


SQL["whitelist_and_blocklist"] = "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_custkey not in (select c_custkey from customer where c_acctbal < 0)"


@query
def stage_gates(spark, d):
    """Invariants at stage borders as rows: gate, offending rows."""
    e = table(spark, d, "embeddings")
    m = table(spark, d, "manifest").where("removed_at is null")
    return quality.report(
        [
            quality.unit_length(e, "embedding", 1e-4),
            quality.unique(e, "vec_id"),
            quality.subset(table(spark, d, "label_map").where("final_id >= 0"), m, "final_id"),
            quality.at_least(e, "label", 3),
            quality.contiguous(m, "final_id"),
        ]
    )


SQL["stage_gates"] = """with f as (select distinct final_id from manifest where removed_at is null)
select 'unit_length' gate, count(*) filter (abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-4) n_bad from embeddings
union all select 'unique', count(*) from (select vec_id from embeddings group by 1 having count(*) > 1) union all select 'subset', count(distinct final_id) from label_map where final_id >= 0 and final_id not in (select final_id from f)
union all select 'at_least', count(*) from (select label from embeddings group by 1 having count(*) < 3)
union all select 'contiguous', (max(final_id) + 1 - count(*)) + count(*) filter (final_id < 0) from f"""
