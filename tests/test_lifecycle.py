import datetime as dt

from pyspark.sql import functions as F

from kinloom.operators import graph, lifecycle, profile
from kinloom.streaming.incremental import hourly_counts


def test_ids_through_all_stages(spark):
    native = spark.createDataFrame([("webface", 0, 5), ("webface", 1, 4), ("webface", 2, 3), ("public", 7, 6), ("crawl", 0, 2), ("crawl", 1, 9), ("crawl", 3, 1)], "src string, orig_id long, img_count long")
    internal = spark.createDataFrame([("webface", 1, 0), ("crawl", 3, 1)], "src string, og_id long, new_id long")
    dropped = spark.createDataFrame([("webface", 2)], "src string, id long")
    e = lifecycle.effective_ids(native, internal, dropped, "crawl")
    assert {(r.src, r.orig_id): r.e1 for r in e.collect()} == {("webface", 0): 0, ("webface", 1): 0, ("webface", 2): None, ("public", 7): 7, ("crawl", 0): 8, ("crawl", 1): 9, ("crawl", 3): 9}
    assert {r.e1 for r in lifecycle.effective_ids(native, internal, dropped, "crawl", 100).where("src = 'crawl'").collect()} == {100, 101}
    mapping = spark.createDataFrame([(8, 0)], "og_id long, new_id long")
    f = lifecycle.final_labels(e, mapping, spark.createDataFrame([(7,)], "id long"))
    got = {(r.src, r.orig_id): r.final_id for r in f.collect()}
    assert got == {("webface", 0): 0, ("webface", 1): 0, ("webface", 2): -1, ("public", 7): -1, ("crawl", 0): 0, ("crawl", 1): 1, ("crawl", 3): 1}
    total = lifecycle.label_summary(f).where("src is null").first()
    assert (total.n_ids, total.n_kept, total.num_image, total.first_label, total.last_label, total.n_classes) == (7, 5, 21, 0, 1, 2)
    assert lifecycle.label_summary(f.limit(0)).count() == 0


def test_manifest_and_archives(spark):
    images = spark.createDataFrame([("crawl", 1, "s3://b/a.tar/x.jpg"), ("crawl", 1, "s3://b/a.tar/x.jpg"), ("crawl", 2, "s3://b/b.tar/y.jpg"), ("crawl", 3, "s3://b/c.tar/z.jpg"), (None, 1, "k:1"), ("webface", 1, "w:1")], "src string, person_id long, img_key string")
    labels = spark.createDataFrame([("crawl", 1, 4), ("crawl", 2, -1), ("crawl", 3, 5), ("webface", 1, 6)], "src string, orig_id long, final_id long")
    rows = lifecycle.surviving_rows(images, labels)
    assert {tuple(r) for r in rows.collect()} == {("crawl", 4, "s3://b/a.tar/x.jpg"), ("crawl", 5, "s3://b/c.tar/z.jpg"), ("webface", 6, "w:1")}
    assert {tuple(r) for r in lifecycle.archive_plan(rows, 2).collect()} == {("s3://b/a.tar", 0, "x.jpg", 4), ("s3://b/c.tar", 1, "z.jpg", 5)}


def test_chains_and_cycles_end(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 3), (0, 9), (20, 21), (21, 22), (30, 30), (40, 41), (41, 40), *[(100 + i, 101 + i) for i in range(70)]]
    got = {r.child: r.parent for r in graph.flattened(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 0: 1, 20: 22, 21: 22, 30: 30, 40: 40, 41: 40, **{100 + i: 170 for i in range(70)}}
    assert graph.flattened(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_percentiles_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 1, 5, 9, None)], "n long")
    assert {r.p: r.value for r in profile.percentiles(df, "n", (0.0, 0.5, 0.625, 1.0)).collect()} == {0.0: 1.0, 0.5: 1.0, 0.625: 3.0, 1.0: 9.0}
    assert profile.percentiles(df.limit(0), "n").count() == 0


def test_new_files_alone_are_read_and_late_rows_count(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 5, 30)
    def lot(*rows):
        spark.createDataFrame(list(rows), "ts timestamp_ntz, event_type string, value double").write.mode("append").parquet(f"{tmp_path}/in")
        return {(r.hour_start, r.event_type): (r.n, r.total) for r in hourly_counts(spark, f"{tmp_path}/in", f"{tmp_path}/state").collect()}
    hour = at.replace(minute=0)
    assert lot((at, "a", 1.0), (at, "b", 2.0)) == {(hour, "a"): (1, 1.0), (hour, "b"): (1, 2.0)}
    assert lot((at, "a", 3.0), (at - dt.timedelta(days=90), "a", 5.0)) == {(hour, "a"): (2, 4.0), (hour, "b"): (1, 2.0), (hour - dt.timedelta(days=90), "a"): (1, 5.0)}
    assert spark.read.parquet(f"{tmp_path}/state/partial").agg(F.sum("n")).first()[0] == 4
