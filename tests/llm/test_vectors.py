import random

import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import clusters, contraction, hnsw, recall

DIM = 32


def faces(n_ids=60, seed=3, noise=0.12):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n_ids):
        c = g.standard_normal(DIM)
        for j in range(int(g.integers(1, 8))):
            v = (c / np.linalg.norm(c) + g.standard_normal(DIM) * noise) * g.uniform(0.5, 20)
            rows.append((f"k{i:03d}/{j}", [float(x) for x in v]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(rows)], "key string, v array<float>, n int")


def usable(spark, rows):
    return hnsw.usable_vectors(frame(spark, rows), "key", "v", F.col("n"), DIM, clusters.KIND)


def nearest(spark, rows, k=5, min_sim=0.5, **more):
    return {(r.key, r["rank"]): r.other for r in hnsw.nearest(frame(spark, rows), "key", "v", F.col("n"), k, min_sim, DIM, **more).collect()}


def unit_rows(rows):
    v = np.array([x for _, x in rows])
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_recall_over_shards_and_unusable_rows(spark):
    rows = faces()
    dirty = [("z1", None), ("z2", []), ("z3", [1.0] * 5), ("z4", [0.0] * DIM), ("z5", [float("nan")] * DIM), ("z6", [float("inf")] * DIM), ("z7", [None, *[1.0] * (DIM - 1)]), (None, [1.0] * DIM), (rows[0][0], [5.0] * DIM)]
    keys = [k for k, _ in rows]
    v = unit_rows(rows)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.5}
    for shard_rows in (120, hnsw.SHARD_ROWS):
        assert hnsw.shard_number(len(rows), shard_rows) == (1 if shard_rows > 200 else 5)
        got = nearest(spark, rows + dirty, shard_rows=shard_rows)
        assert {k for k, _ in got} <= set(keys)
        found = {(k, o) for (k, _), o in got.items()}
        assert len(want & found) / len(want) >= 0.95 and len(found - want) <= 0.02 * len(want)


def test_single_empty_and_copied_vectors(spark):
    assert nearest(spark, []) == {} and nearest(spark, [("a", [1.0] * DIM)]) == {}
    g = np.random.default_rng(5)
    x, y = (list(map(float, g.standard_normal(DIM))) for _ in range(2))
    # 30 keys with one vector, some keys twice: everyone has the smallest other keys
    rows = [(f"c{i:02d}", x) for i in range(30)] + [("c03", x), ("other", y), ("zero", [0.0] * DIM), *[(f"n{i}", [float("nan")] * DIM) for i in range(9)]]
    got = nearest(spark, rows, k=3)
    keys = [f"c{i:02d}" for i in range(30)]
    assert got == {(k, n + 1): o for k in keys for n, o in enumerate([x for x in keys if x != k][:3])}


def test_graph_search_against_brute_force():
    g = np.random.default_rng(1)
    centres = g.standard_normal((900, 64)).astype(np.float32)
    v = np.repeat(centres, 5, axis=0) + g.standard_normal((4_500, 64)).astype(np.float32) * 0.6
    codes = hnsw.codes_of(v)
    graph = hnsw.Graph(codes, 0.4)
    assert graph.per > 10 and graph.flat.shape == (4_500, hnsw.LINKS)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    q = (centres / np.linalg.norm(centres, axis=1)[:, None])[:200]
    s = q @ u.T
    want = {(i, int(j)) for i in range(200) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.5}
    r, c, sims = graph.search(q, 5)
    assert len(want & set(zip(r.tolist(), c.tolist(), strict=True))) / len(want) > 0.97
    assert np.abs(sims - s[r, c]).max() < 0.01
    r, c, _ = graph.search_own(4)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(4_500) for j in np.argsort(-s[i])[:4] if s[i, j] >= 0.5}
    assert len(want & set(zip(r.tolist(), c.tolist(), strict=True))) / len(want) > 0.97


def test_crowded_hub_and_crowded_centre_are_split():
    g = np.random.default_rng(2)
    x = g.standard_normal(32).astype(np.float32)
    v = np.concatenate([x + g.standard_normal((3_000, 32)).astype(np.float32) * 0.01, g.standard_normal((3_000, 32)).astype(np.float32)])
    graph = hnsw.Graph(hnsw.codes_of(v), 0.4, families=4, cell=64)
    r, c, s = graph.search_own(5)
    assert np.bincount(r, minlength=6_000)[:3_000].min() == 5 and s[r < 3_000].min() > 0.99
    u = v / np.linalg.norm(v, axis=1)[:, None]
    router = hnsw.Router(np.concatenate([np.repeat(u[:1], 3_000, 0), u[3_000:]]), 12)
    to = router.route(u, g.integers(0, 2**62, 6_000))
    assert router.shards > 12 and to.max() < router.shards
    assert np.bincount(to.ravel(), minlength=router.shards).max() < 2.5 * to.size / 12


def test_shards_and_filings():
    assert [hnsw.filings(s) for s in (1, 2, 3, 12)] == [1, 2, 2, 3]
    for rows in (0, 1, 1_100, 11_000, 110_000, 1_000_000):
        s = hnsw.shard_number(rows)
        assert s == 1 or hnsw.filings(s) * rows <= s * hnsw.SHARD_ROWS


def test_recall_is_measured(spark):
    rows = faces(400)
    df = frame(spark, rows)
    got = recall.measured(df, hnsw.nearest(df, "key", "v", F.col("n"), 5, 0.5, DIM), "key", "v", F.col("n"), 5, 0.5, DIM).first()
    assert got.n_true > 50 and got.recall >= 0.95 and got.reached
    assert tuple(recall.measured(df.limit(0), hnsw.nearest(df, "key", "v", F.col("n"), 5, 0.5, DIM), "key", "v", F.col("n"), 5, 0.5, DIM).first()) == (0, 1.0, True)


def test_clusters_against_planted_identities(spark):
    rows = faces(40, seed=6, noise=0.05)
    rows += [("copy/a", rows[0][1]), ("copy/b", [2 * x for x in rows[0][1]])]
    members = clusters.similarity_clusters(usable(spark, rows), 0.6, DIM).collect()
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T >= 0.6
    keys = [k for k, _ in rows]
    want = {frozenset(keys[j] for j in np.flatnonzero(s[i])) for i in range(len(keys)) if s[i].sum() > 1}
    got = {}
    for r in members:
        got.setdefault(r.cluster, set()).add(r.key)
        assert r.closed
    assert {frozenset(x) for x in got.values()} == want


def test_similar_pairs_outside_the_nearest_join_clusters(spark, monkeypatch):
    g = np.random.default_rng(8)

    def near(v):
        v = v + g.standard_normal(DIM) * 0.004
        return [float(x) for x in v / np.linalg.norm(v)]

    e = np.eye(DIM)
    # two groups of 13 near copies at cosine 0.6; a clique of 16 and one vector at cosine 0.6 to it; a group alone
    rows = [(f"a{i}", near(e[0])) for i in range(13)] + [(f"b{i}", near(0.6 * e[0] + 0.8 * e[1])) for i in range(13)]
    rows += [(f"c{i:02d}", near(e[2])) for i in range(16)] + [("d", near(0.6 * e[2] + 0.8 * e[3]))] + [(f"f{i}", near(e[4])) for i in range(3)] + [("alone", near(e[5]))]
    # seen from d, only one of the clique is in reach of its own nearest others
    rows += [(f"h{i:02d}", near(0.75 * e[3] + 0.6614 * e[6 + i])) for i in range(13)]
    v = np.array([x for _, x in rows])
    s, keys = v @ v.T >= 0.46, [k for k, _ in rows]
    reach = np.linalg.matrix_power(s.astype(np.int64), 8) > 0
    want = {frozenset(keys[j] for j in np.flatnonzero(x)): bool(s[np.ix_(x, x)].all()) for x in reach if x.sum() > 1}
    assert sorted(want.values()) == [False, True, True]
    for block in (7, 4_096):
        monkeypatch.setattr(clusters, "JOIN_BLOCK", block)
        got: dict = {}
        for r in clusters.similarity_clusters(usable(spark, rows), 0.46, DIM).collect():
            got.setdefault((r.cluster, r.closed), set()).add(r.key)
        # groups that are not closed may lie in several clusters
        assert {frozenset(x) for (_, closed), x in got.items() if closed} == {x for x, closed in want.items() if closed}
        assert {k for (_, closed), x in got.items() if not closed for k in x} == {k for x, closed in want.items() if not closed for k in x}


def test_flow_decides_the_clusters(spark, monkeypatch):
    rows = faces(12, seed=6, noise=0.05)
    monkeypatch.setattr(clusters, "flow_clusters", lambda flow: flow.select(F.col("col").alias("id"), F.col("col").alias("cluster")).distinct())
    got = clusters.similarity_clusters(usable(spark, rows), 0.6, DIM).collect()
    assert len({r.cluster for r in got}) == len(got) and not any(r.closed for r in got)


def test_groups_at_rest_take_no_part_in_the_rounds(spark, monkeypatch):
    rows = faces(30, seed=6, noise=0.05)
    rows += [("copy/a", rows[0][1]), ("copy/b", [2 * x for x in rows[0][1]])]

    def rounds(links, *more):
        raise AssertionError("a complete group without links to others needs no round")

    monkeypatch.setattr(clusters, "markov_flow", rounds)
    members = clusters.similarity_clusters(usable(spark, rows), 0.6, DIM).collect()
    s, keys = unit_rows(rows) @ unit_rows(rows).T >= 0.6, [k for k, _ in rows]
    got: dict = {}
    for r in members:
        got.setdefault(r.cluster, set()).add(r.key)
        assert r.closed and (r.flow >= 0.6 or len(got[r.cluster]) == 1)
    assert {frozenset(x) for x in got.values()} == {frozenset(keys[j] for j in np.flatnonzero(x)) for x in s if x.sum() > 1}


def test_short_heads_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(clusters, "JOIN_BLOCK", 90)
    monkeypatch.setattr(clusters, "JOIN_ROWS", 64)
    monkeypatch.setattr(clusters, "PAIR_ROWS", 7)
    rows = faces(150, seed=9)
    path, known = clusters.packed(usable(spark, rows + [("copy", rows[0][1])]))
    of = {r.key: r.id for r in known.collect()}
    assert len(of) == len(rows) + 1 and of["copy"] == of[rows[0][0]] and len(set(of.values())) == len(rows)
    fs, place = clusters.pafs.FileSystem.from_uri(path)
    groups = clusters.grouped(fs, place, DIM)
    assert len(groups) > 3
    stored = [clusters.Block(fs, g, DIM) for g in groups]
    v, ids = np.concatenate([b.v for b in stored]), np.concatenate([b.ids for b in stored])
    s = v.astype(np.float64) @ v.T
    # but for the rounding of cosines in single precision
    sure, maybe = ({frozenset(ids[list(x)].tolist()) for x in zip(*np.nonzero(np.triu(s >= t, 1)), strict=True)} for t in (0.460001, 0.459999))
    whole = clusters.fitted_head([v], 0.46, DIM)
    for dense in (1, 10**9):
        monkeypatch.setattr(clusters, "DENSE", dense)
        for m in (1, 8, DIM):
            basis = np.linalg.qr(np.concatenate([whole, np.eye(DIM, dtype=np.float32)], axis=1))[0][:, :m].astype(np.float32)
            parts, got = [clusters.Block(fs, g, DIM, basis) for g in groups], []
            for i, a in enumerate(parts):
                for b in parts[i:]:
                    x, y, z = a.near(b, 0.46)
                    got += zip(a.ids[x].tolist(), b.ids[y].tolist(), strict=True)
                    assert len(z) == 0 or z.min() >= 0.46
            assert len(got) == len({frozenset(x) for x in got}) and sure <= {frozenset(x) for x in got} <= maybe
    # vectors of few dimensions are compared on few
    flat = np.random.default_rng(1).standard_normal((2_000, 4)) @ np.random.default_rng(2).standard_normal((4, 64))
    assert clusters.fitted_head([(flat / np.linalg.norm(flat, axis=1)[:, None]).astype(np.float32)], 0.999, 64).shape == (64, 4)


def test_large_clique_is_one_cluster_and_bridged_groups_are_not_closed(spark):
    g = np.random.default_rng(4)
    e = np.eye(DIM)

    def near(v, noise=0.03):
        v = v + g.standard_normal(DIM) * noise
        return [float(x) for x in v / np.linalg.norm(v)]

    a, b = e[1], 0.4 * e[1] + 0.9165 * e[2]
    rows = [(f"big{i:03d}", near(e[0])) for i in range(150)] + [(f"a{i:02d}", near(a)) for i in range(20)] + [(f"b{i:02d}", near(b)) for i in range(20)]
    s = unit_rows(rows) @ unit_rows(rows).T >= 0.46
    assert s[:150, :150].all() and 0 < s[150:170, 170:].sum() < 100
    members = clusters.similarity_clusters(usable(spark, rows), 0.46, DIM).collect()
    big = {r.cluster for r in members if r.key.startswith("big")}
    assert len(big) == 1 and all(r.closed == (r.cluster in big) for r in members) and len(members) == 190


def test_every_host_of_a_cluster_is_given(spark):
    # nine hosts; k0 is filed under two of them
    rows = [(1, f"k{i}", f"h{i % 8}", 1.0 / (i + 1), True) for i in range(20)] + [(1, "k0", "h9", 1.0, True), (2, "z1", "h1", 1.0, False), (2, "z2", "h1", 0.5, False)]
    members = spark.createDataFrame(rows, "cluster long, key string, host string, flow double, closed boolean")
    got = {(r.cluster_path, r.host): r.n_images for r in clusters.host_counts(members, "host").collect()}
    assert got == {**{("k0", f"h{i}"): 3 if i < 4 else 2 for i in range(8)}, ("k0", "h9"): 1, ("z1", "h1"): 2}
    about = {r.cluster_path: r for r in clusters.described(members, "host").collect()}
    assert (about["k0"].n_images, about["k0"].n_hosts, list(about["k0"].typical)) == (20, 9, ["k0", "k1", "k2"])
    assert list(about["k0"].main_hosts) == ["h0", "h1", "h2", "h3", "h4"]


def test_closed_is_checked_in_blocks(spark):
    a, b, c = [1.0, 0.0], [0.8, 0.6], [0.28, 0.96]
    rows = [(1, i, np.rint(np.array(v) * 32767).astype(np.int16).tobytes()) for i, v in enumerate([a, b, c])] + [(2, i + 9, np.rint(np.array(v) * 32767).astype(np.int16).tobytes()) for i, v in enumerate([a, b])]
    df = spark.createDataFrame(rows, "cluster long, id long, code binary")
    for block in (1, 1_024):
        old, clusters.BLOCK = clusters.BLOCK, block
        assert {r.cluster: r.closed for r in clusters.closed_clusters(df, 0.5, 2).collect()} == {1: False, 2: True}
        clusters.BLOCK = old


def test_contraction_against_union_find(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5080)]
    pairs += [(b, a) for a, b in pairs[:40]] + [(7, 7), (None, 4), (4, None)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.group_id for r in contraction.linked_groups(df, "a", "b").collect()} == {x: find(x) for x in list(root)}
    assert contraction.linked_groups(df.limit(0), "a", "b").count() == 0
