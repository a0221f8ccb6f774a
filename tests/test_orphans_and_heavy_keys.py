import datetime as dt
import random

from pyspark.sql import functions as F

from kinloom.operators import heavy_keys as h
from kinloom.operators import orphans as o


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_orphans_against_brute_force(spark):
    rnd = random.Random(5)
    parents = [(rnd.choice(["a", "b"]), rnd.randrange(60), day(s := rnd.randrange(300)), rnd.choice([None, day(s + rnd.randrange(0, 90))])) for _ in range(150)]
    refs = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(70)]), day(rnd.randrange(330))) for i in range(400)]
    p = spark.createDataFrame(parents, "src string, k long, built timestamp_ntz, gone timestamp_ntz")
    r = spark.createDataFrame(refs, "ref_id long, scope string, key long, at timestamp_ntz")
    spans = o.spans_in_force(p, F.col("src"), "k", "built", "gone")
    for bits in (2, 16):
        got = {x.ref_id for x in o.orphan_references(r, spans, o.contiguous_runs(spans, "scope", "key", bits)).collect()} if bits == 16 else None
        gone = {(x.scope, x.key) for x in o.beyond_runs(r.where("scope is not null and key is not null"), o.contiguous_runs(spans, "scope", "key", bits), bits).collect()}
        have = {(s, k) for s, k, b, g in parents if g is None or g > b}
        assert gone == {(s, k) for _, s, k, _ in refs if s is not None and k is not None and (s, k) not in have}
    want = {i for i, s, k, at in refs if k is not None and not any(s == ps and k == pk and b <= at and (g is None or g > at) for ps, pk, b, g in parents)}
    assert got == want


def test_runs_and_empty_parents(spark):
    p = spark.createDataFrame([("a", k) for k in (1, 2, 3, 5, 5, 65535, 65536)] + [("b", None)], "s string, k long")
    assert {(r.run_start, r.run_end) for r in o.contiguous_runs(p, "s", "k").collect()} == {(1, 3), (5, 5), (65535, 65535), (65536, 65536)}
    none = o.spans_in_force(spark.createDataFrame([], "s string, k long, b timestamp_ntz, e timestamp_ntz"), F.col("s"), "k", "b", "e")
    r = spark.createDataFrame([(1, "a", 4, day(1)), (2, "a", None, day(1))], "ref_id long, scope string, key long, at timestamp_ntz")
    assert [x.ref_id for x in o.orphan_references(r, none, o.contiguous_runs(none, "scope", "key")).collect()] == [1]


def test_heavy_keys_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, *range(10, 40), None]), rnd.choice([None, day(rnd.randrange(500))]), rnd.choice([None, float(rnd.randrange(9))]), i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, at timestamp, size double, t int")
    got = {r.key: r for r in h.per_key_results(h.balanced_states(df, "k", "at", "size", "t")).collect()}
    assert set(got) == {k for k, *_ in rows if k is not None}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        times = sorted(x[1] for x in own if x[1])
        sizes = [x[2] for x in own if x[2] is not None]
        gaps = [int((b - a).total_seconds() * 1e6) for a, b in zip(times, times[1:])]
        assert r.n_rows == len(own) and r.last_at == times[-1] and r.first_at == times[0]
        assert r.longest_gap_us == max(gaps, default=0) and abs(r.mean_size - sum(sizes) / len(sizes)) < 1e-9
    assert {r.key for r in h.heavy_keys(h.per_key_results(h.balanced_states(df, "k", "at", "size")), 0.05).collect()} == {1}
    assert h.per_key_results(h.balanced_states(df.limit(0), "k", "at", "size")).count() == 0


def test_times_before_1970_are_times(spark):
    rows = [(1, dt.datetime(1960, 1, 1), 1.0), (1, dt.datetime(1961, 1, 1), 3.0), (2, None, None), (None, dt.datetime(1960, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "k int, at timestamp, size double")
    got = {r.key: (r.n_rows, r.first_at, r.last_at, r.longest_gap_us, r.mean_size) for r in h.per_key_results(h.balanced_states(df, "k", "at", "size")).collect()}
    assert got == {1: (2, rows[0][1], rows[1][1], 366 * 86_400_000_000, 2.0), 2: (1, None, None, 0, None)}
    p = spark.createDataFrame([("a", 1, dt.datetime(1950, 1, 1), dt.datetime(1960, 6, 1)), ("a", 1, dt.datetime(1965, 1, 1), None)], "s string, k long, b timestamp_ntz, e timestamp_ntz")
    spans = o.spans_in_force(p, F.col("s"), "k", "b", "e")
    r = spark.createDataFrame([(i, "a", 1, dt.datetime(y, 1, 1)) for i, y in enumerate((1949, 1955, 1962, 1966, 2020))], "ref_id long, scope string, key long, at timestamp_ntz")
    assert sorted(x.ref_id for x in o.orphan_references(r, spans, o.contiguous_runs(spans, "scope", "key")).collect()) == [0, 2]
