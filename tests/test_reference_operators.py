"""Planted fixtures and brute force for the curation operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions.text import canonical_path, known
from kinloom.functions.vectors import unit
from kinloom.operators import cluster, graph, merge, metrics, ordered, records, simjoin, vectors
from kinloom.plans.lineage import cut

DIM = 64


def planted(seed=0):
    """(id, row, vector): ids 0-8 x 5 clean, id 5 with one outlier, id 9 x 2, ids 10 x 6 and 11 x 4 of one person."""
    g = np.random.default_rng(seed)
    centres = {i: g.standard_normal(DIM) for i in range(11)}
    centres[11] = centres[10]
    rows, n = [], 0
    for i, count in [*((i, 5) for i in range(9)), (9, 2), (10, 6), (11, 4)]:
        for j in range(count):
            c = g.standard_normal(DIM) if (i, j) == (5, 0) else centres[i] / np.linalg.norm(centres[i])
            v = c / np.linalg.norm(c) + g.standard_normal(DIM) * 0.02
            rows.append((i, n, [float(x) for x in v / np.linalg.norm(v)]))
            n += 1
    return rows


def test_self_cleaning_flow(spark):
    df = spark.createDataFrame(planted(), "person_id long, row long, embedding array<double>")
    kept = cluster.cleaned(simjoin.units(df, "row", "embedding", F.col("person_id")), 0.4, 3)
    clean = cut(df.join(kept.select(F.col("id").alias("row")), "row", "left_semi"))
    n = {r.person_id: r.n for r in clean.groupBy("person_id").agg(F.count("*").alias("n")).collect()}
    assert n == {**{i: 5 for i in range(9)}, 5: 4, 10: 6, 11: 4}
    t = cut(vectors.templates(clean, "person_id", "embedding"))
    pairs = simjoin.similar_pairs(simjoin.units(t, "person_id", "embedding_center"), 0.43)
    centres = t.select(F.col("person_id").alias("id"), "img_count")
    mapping, drops = merge.symmetric_merge(centres, cut(pairs), 0.43, 0.56)
    assert [tuple(r) for r in mapping.collect()] == [(11, 10)] and drops.count() == 0
    labels = {r.orig_id: r.final_id for r in merge.contiguous_labels(t, "person_id", mapping, drops).collect()}
    assert labels[10] == labels[11] and sorted(set(labels.values())) == list(range(10))
    facts = merge.apply_map(clean, "person_id", mapping, drops)
    assert facts.where("person_id = 10").count() == 10


def test_block_join_equals_brute_force_at_any_block(spark):
    g = np.random.default_rng(1)
    v = g.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(99, None)], "id long, e array<double>")
    u = simjoin.units(df, "id", "e")
    s = v @ v.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] > 0.4}
    assert {(r.a, r.b) for r in simjoin.similar_pairs(u, 0.4).collect()} == want
    kernel_rows = simjoin.top_neighbours(u, 3).collect()
    np.fill_diagonal(s, -2)
    assert {(r.id, r.rank): r.other for r in kernel_rows} == {(i, k + 1): int(np.argsort(-s[i])[k]) for i in range(60) for k in range(3)}
    old, simjoin.BLOCK = simjoin.BLOCK, 16
    try:
        small = simjoin.block_products(u, u, lambda key, a, b, x, same: __import__("pandas").DataFrame({"n": [x.size]}), "n long", block=16)
        assert small.agg(F.sum("n")).first()[0] == 3600
    finally:
        simjoin.BLOCK = old


def test_components_chain_star_and_nulls(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 60)]
    e = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (3, None), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in graph.components(e, "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}
    assert graph.components(e.limit(0), "a", "b").count() == 0
    f = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (8, 9), (9, 8)], "c long, p long")
    assert {r.child: r.parent for r in graph.flattened(f, "c", "p").collect()} == {5: 1, 4: 1, 3: 1, 8: 8, 9: 8}


def test_components_of_a_long_unordered_chain(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 25)
    n = 150
    path = [0, *range(n, 0, -1)]
    e = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
    got = {r.id: r.component for r in graph.components(e, "a", "b").collect()}
    assert got == dict.fromkeys(path, 0)
    monkeypatch.setattr(graph, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.components(e, "a", "b")


def test_merge_zone_drops_smaller_then_larger_id(spark):
    c = spark.createDataFrame([(1, 5), (2, 3), (3, 4), (4, 4), (5, 1)], "id long, img_count long")
    p = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.5), (2, 5, 0.5)], "a long, b long, sim double")
    m, d = merge.symmetric_merge(c, p, 0.43, 0.56)
    assert [tuple(r) for r in m.collect()] == [(2, 1)] and {r.id for r in d.collect()} == {4, 5}


def test_ordered_numbers_and_gaps(spark):
    df = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k long")
    assert {r.k: r.row_no for r in ordered.with_row_number(df, [F.col("k")]).collect()} == {k: k + 1 for k in range(101)}
    drop = spark.createDataFrame([(3,), (50,), (None,)], "k long")
    got = {r.k: r.new_label for r in ordered.closed_gaps(df, "k", drop).collect()}
    assert got == {k: k - (k > 3) - (k > 50) for k in range(101) if k not in (3, 50)}
    assert ordered.dense_ids(df.limit(0), "k").count() == 0


def test_metrics_on_separable_pairs(spark):
    rows = [(i, 1, 0.5 + i / 100) for i in range(20)] + [(100 + i, 0, i / 100) for i in range(20)]
    p = spark.createDataFrame(rows, "pair_id long, genuine int, score double")
    curve = metrics.roc(p)
    assert abs(metrics.auc(curve).first()[0] - 1) < 1e-9 and metrics.eer(curve).first()["eer"] == 0.0
    f = metrics.folds(p.withColumn("dist", 1 - F.col("score")), 3)
    assert sorted(r.n for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [13, 13, 14]


def test_text_and_selection(spark):
    df = spark.createDataFrame([("s3n://B/a/./b//c.jpg",), (" s3://B/a/b/c.jpg",), ("s3://B/a%2Fb/c%2", ), (None,), ("plain/x",)], "p string")
    assert [r[0] for r in df.select(canonical_path(F.col("p"))).collect()] == ["s3://B/a/b/c.jpg", "s3://B/a/b/c.jpg", "s3://B/a%2Fb/c%2", None, "plain/x"]
    k = spark.createDataFrame([(" N/A",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in k.select(known(F.col("t"))).collect()] == [False, True, False, False]
    d = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", 2, "y"), (None, 9, "z")], "k string, id int, v string")
    assert {tuple(r) for r in records.keep_first(d, ["k"], "id").collect()} == {("a", 1, "x"), ("b", 2, "y"), (None, 9, "z")}
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(unit("v").alias("u")).collect()
    assert z[0].u == [0.0, 0.0] and abs(z[1].u[0] - 0.6) < 1e-12
