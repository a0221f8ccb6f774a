"""Most similar vectors for every vector (problem 1).

Method: one hierarchical navigable small-world graph per shard, stored as flat
neighbour arrays, with the shards' results merged.

* Rows are brought to one vector per key, as 8-bit integers scaled to the row's
  largest number (cosine does not see the scale; the error of a cosine is about
  0.0005), and filed in the ``filings`` shards whose centres are nearest. Centres
  come from a bounded sample of ``SAMPLE`` rows; a weight per centre, fitted on
  the sample, keeps the shards of about equal size, and a centre that draws more
  than twice its share is split by a hash.
* The graph of a shard has an upper layer of hubs, in ``FAMILIES`` families of one
  hub per ``CELL`` rows, and a base layer of all rows. A vector descends from the
  nearest hub of every family to the base nodes below that hub; what it finds
  there are its links, nearest first, in one flat array.
* Every vector is then a query: a walk over the links from the nodes where it
  entered, which finds the neighbours that no hub had in common with it.
* A pair found from one side, in any shard, counts for both sides.

Why many entries: the vectors of different identities point in independent
directions, so a walk from one entry has no slope to follow (from few entry
points it found 42 to 82 % of the pairs). The chance that two similar vectors
share a hub or a shard depends on their angle and falls with a small power of the
number of hubs or shards, so the filings grow with the cube root of the number of
shards and no vector ever meets all the others. Vectors less similar than
``FLOOR`` are no neighbours: at that angle all unrelated vectors lie.

Defined results: vectors that are null, of another length, all zero, or hold a
null, NaN or infinity take no part; rows with one key are one vector (the
earliest by order column, then the smallest hash); ties go to the smaller key; a
collection of one vector has no neighbours. Of more than ``COPIES`` keys with
the very same vector only those with the smallest keys are filed, because they
are the nearest of all the others; the rest get them as their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

SHARD_ROWS = 32_768
TASKS = 12
TASK_ROWS = 1_024
SAMPLE = 16_384
MOST_CENTRES = 1_024
FAMILIES = 16
CELL = 256
LINKS = 16
HOPS = 2
EXPAND = 8
FLOOR = 0.25
COPIES = 6
BATCH = 2_048
SEED = 20


# ---- numpy kernels -------------------------------------------------------------------------------------------------


def top_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first."""
    k = min(k, sims.shape[1])
    pick = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
    return np.take_along_axis(pick, np.argsort(-np.take_along_axis(sims, pick, 1), axis=1, kind="stable"), 1)


def codes_of(m: np.ndarray, kind: type = np.int8) -> np.ndarray:
    """Integer codes of rows that are not all zero."""
    return np.rint(m * (np.float32(np.iinfo(kind).max) / np.abs(m).max(axis=1))[:, None]).astype(kind)


def decode(codes: list[bytes], dim: int, kind: type = np.int8) -> np.ndarray:
    """Unit vectors of integer codes."""
    v = np.frombuffer(b"".join(codes), kind).reshape(-1, dim).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def best(r: np.ndarray, c: np.ndarray, s: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ``c`` of each ``r``, each once, in order of ``r``, falling ``s`` and ``c``."""
    _, once = np.unique(r.astype(np.int64) * n + c, return_index=True)
    r, c, s = r[once], c[once], s[once]
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], s[keep]


class Graph:
    """Small-world graph of one shard over its coded rows; ``flat`` holds up to ``LINKS`` positions a row, nearest first, -1 where none."""

    def __init__(self, codes: np.ndarray, floor: float = FLOOR, families: int = FAMILIES, cell: int = CELL):
        self.codes, self.floor, self.cell = codes, floor, cell
        self.n, dim = codes.shape
        self.scale = np.ones(self.n, np.float32)
        self.scale = np.concatenate([1 / np.linalg.norm(codes[i : i + BATCH].astype(np.float32), axis=1) for i in range(0, self.n, BATCH)] or [self.scale])
        rng = np.random.default_rng(SEED)
        self.per = max(1, self.n // cell)
        self.families = families if self.per > 1 else 1
        self.hubs = np.concatenate([rng.choice(self.n, self.per, replace=False) for _ in range(self.families)]) if self.n else np.empty(0, np.int64)
        # one more direction a family orders the rows below a hub that has too many
        self.upper = np.concatenate([self.rows(self.hubs), rng.standard_normal((self.families, dim)).astype(np.float32)])
        self.below: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat = np.full((self.n, LINKS), -1, np.int32)
        if self.n:
            own = [self.entries(self.rows(slice(i, i + BATCH))) for i in range(0, self.n, BATCH)]
            hub, spot = (np.concatenate(x) for x in zip(*own, strict=True))
            for f in range(self.families):
                order = np.lexsort((spot[:, f], hub[:, f])).astype(np.int32)
                self.below.append((order, np.searchsorted(hub[order, f], np.arange(self.per + 1)), spot[order, f]))
            r, c, s = self.descend(None, hub, spot, LINKS)
            self._link(r, c)
            # what a walk from a row's links finds are better links
            r, c, s = self.walk(None, r, c, s, LINKS, 1)
            self._link(r, c)
            self.own = (r, c, s)

    def _link(self, r: np.ndarray, c: np.ndarray) -> None:
        self.flat[r, np.arange(len(r)) - np.searchsorted(r, r)] = c

    def rows(self, at) -> np.ndarray:
        return self.codes[at].astype(np.float32) * self.scale[at][:, None]

    def entries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and family the nearest hub, and the place in the family's order."""
        s = q @ self.upper.T
        return s[:, : len(self.hubs)].reshape(len(q), self.families, self.per).argmax(2).astype(np.int32), s[:, len(self.hubs) :]

    def descend(self, q: np.ndarray | None, hub: np.ndarray, spot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best base nodes below the hubs of each query, as (query, node, cosine); no ``q``: the rows themselves, without the loops."""
        found, size = [], 0
        for f, (order, start, spots) in enumerate(self.below):
            asked = np.argsort(hub[:, f], kind="stable")
            first = np.searchsorted(hub[asked, f], np.arange(self.per + 1))
            for h in range(self.per):
                lo, hi = start[h], start[h + 1]
                pieces = max(1, -(-(hi - lo) // (4 * self.cell)))
                edges = lo + (hi - lo) * np.arange(pieces + 1) // pieces
                a = asked[first[h] : first[h + 1]]
                which = np.searchsorted(spots[edges[1:-1]], spot[a, f], side="right") if pieces > 1 else None
                for p in range(pieces):
                    mine, b = a if which is None else a[which == p], order[edges[p] : edges[p + 1]]
                    for i in range(0, len(mine), BATCH):
                        x = mine[i : i + BATCH]
                        s = (self.rows(x) if q is None else q[x]) @ self.rows(b).T
                        r, c = np.nonzero(s >= self.floor)
                        if len(r) > 2 * k * len(x):
                            c = top_k(s, k + 1)
                            r, c = np.repeat(np.arange(len(x)), c.shape[1]), c.ravel()
                        s = s[r, c]
                        r, c = x[r], b[c]
                        keep = (s >= self.floor) & (r != c) if q is None else s >= self.floor
                        found.append((r[keep], c[keep], s[keep]))
                        size += len(r)
            if size > 4_000_000:
                found = [best(*(np.concatenate(x) for x in zip(*found, strict=True)), self.n, k)]
                size = len(found[0][0])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
        return best(*(np.concatenate(x) for x in zip(*found, strict=True)), self.n, k)

    def walk(self, q: np.ndarray | None, r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int, hops: int = HOPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow links from the nodes (query, node, cosine), sorted by query and best first, and keep the k best."""
        front_r, front_c = r, c
        for _ in range(hops):
            near = np.arange(len(front_r)) - np.searchsorted(front_r, front_r) < EXPAND
            a, e = np.repeat(front_r[near], LINKS), self.flat[front_c[near]].ravel()
            ok = (e >= 0) & (a != e) if q is None else e >= 0
            key = np.setdiff1d(a[ok].astype(np.int64) * self.n + e[ok], r.astype(np.int64) * self.n + c)
            a, e = key // self.n, key % self.n
            sims = np.empty(len(key), np.float32)
            for i in range(0, len(key), BATCH):
                x, y = a[i : i + BATCH], e[i : i + BATCH]
                np.einsum("ij,ij->i", self.rows(x) if q is None else q[x], self.rows(y), out=sims[i : i + BATCH])
            up = sims >= self.floor
            front_r, front_c = a[up], e[up]
            if not len(front_r):
                break
            r, c, s = best(np.concatenate([r, front_r]), np.concatenate([c, front_c]), np.concatenate([s, sims[up]]), self.n, max(k, LINKS))
        return best(r, c, s, self.n, k)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best nodes of each query vector, as (query, node, cosine): descend from the hubs, then walk."""
        if not self.n or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
        return self.walk(q, *self.descend(q, *self.entries(q), LINKS), k)

    def search_own(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The search of every row of the shard, which starts from its own links."""
        return self.walk(None, *self.own, k) if self.n else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32))


# ---- routing to shards ---------------------------------------------------------------------------------------------


def filings(shards: int) -> int:
    """In how many shards a vector is filed."""
    return min(shards, max(1, round(1.45 * shards ** (1 / 3))))


def shard_number(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    """The least number of shards that keeps them near ``shard_rows``; more for tasks, as long as these have ``TASK_ROWS``. At most ``MOST_CENTRES``."""
    s = max(1, min(TASKS, rows // TASK_ROWS))
    while s < MOST_CENTRES and filings(s) * rows > s * shard_rows:
        s += 1
    return s


class Router:
    """Centres of the shards (spherical k-means of a sample) with balancing weights; of bounded size, made for sending to workers."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.keep = filings(shards)
        rng = np.random.default_rng(SEED)
        self.centres = sample[rng.choice(len(sample), shards, replace=len(sample) < shards)] if shards > 1 else sample[:0]
        self.weight, self.split = np.zeros(shards, np.float32), np.ones(shards, np.int64)
        if shards > 1:
            for _ in range(8):
                label = (sample @ self.centres.T).argmax(1)
                order = np.argsort(label, kind="stable")
                groups, first = np.unique(label[order], return_index=True)
                total = np.zeros_like(self.centres)
                total[groups] = np.add.reduceat(sample[order], first, axis=0)
                norm = np.linalg.norm(total, axis=1, keepdims=True)
                self.centres = np.where(norm > 0, total / np.maximum(norm, 1e-9), self.centres).astype(np.float32)
            s = sample @ self.centres.T
            for step in range(31):
                c = np.argpartition(s - self.weight, shards - self.keep, axis=1)[:, shards - self.keep :]
                share = np.bincount(c.ravel(), minlength=shards) * shards / c.size
                if step < 30:
                    self.weight += (0.02 * 0.93**step * np.log(np.maximum(share, 0.1))).astype(np.float32)
            self.split = np.where(share > 2, np.ceil(share), 1).astype(np.int64)
        self.offset = np.cumsum(self.split) - self.split
        self.shards = int(self.split.sum())

    def route(self, v: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Per vector the numbers of its shards; ``h``, a hash of the vector, spreads those of a split centre."""
        if len(self.split) == 1:
            return np.zeros((len(v), 1), np.int64)
        c = top_k(v @ self.centres.T - self.weight, self.keep)
        return self.offset[c] + (h.astype(np.int64) & (2**62 - 1))[:, None] % self.split[c]


# ---- Spark ---------------------------------------------------------------------------------------------------------

_CODED = pa.schema([("key", pa.string()), ("ord", pa.int64()), ("h", pa.int64()), ("code", pa.binary())])


def coded_vectors(df: DataFrame, key: str, vector: str, order: Column, dim: int = 512, kind: type = np.int8) -> DataFrame:
    """``key, ord, h, code`` of the usable rows."""
    slim = df.where((F.size(vector) == dim) & F.col(key).isNotNull())
    slim = slim.select(F.col(key).alias("key"), F.coalesce(order.cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(vector).alias("h"), F.col(vector).alias("v"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            if not len(m):
                continue
            with np.errstate(all="ignore"):
                ok = np.isfinite(m).all(axis=1) & (np.abs(m).max(axis=1) > 1e-30)
            codes = codes_of(m[ok], kind)
            code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * (dim * codes.itemsize)), pa.py_buffer(codes.tobytes())])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("key").filter(keep).cast(pa.string()), b.column("ord").filter(keep), b.column("h").filter(keep), code], schema=_CODED)

    return slim.mapInArrow(coded, "key string, ord long, h long, code binary")


def usable_vectors(df: DataFrame, key: str, vector: str, order: Column, dim: int = 512, kind: type = np.int8) -> DataFrame:
    """``key, h, code``: one coded vector per key; repeats are reduced before the shuffle."""
    first = coded_vectors(df, key, vector, order, dim, kind).groupBy("key").agg(F.min(F.struct("ord", "h", "code")).alias("f"))
    return first.select("key", "f.h", "f.code")


def fitted_router(vectors: DataFrame, rows: int, dim: int, shard_rows: int) -> Router:
    """The router for ``key, code`` rows, of which there are ``rows`` at most; its sample of about ``SAMPLE`` rows is drawn by a hash of the key."""
    shards = shard_number(rows, shard_rows)
    if shards == 1:
        return Router(np.empty((0, dim), np.float32), 1)
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < max(1, int((1 << 20) * SAMPLE / rows))
    sample = [bytes(r[0]) for r in vectors.where(share).select("code").collect()]
    return Router(decode(sorted(sample), dim), shards) if sample else Router(np.empty((0, dim), np.float32), 1)


def similar_pairs(vectors: DataFrame, router: Router, k: int, min_sim: float, dim: int = 512, floor: float | None = None) -> DataFrame:
    """``key, other, sim`` with key < other: the pairs at or above ``min_sim`` that are among the k best of one of the two in a shard.

    ``vectors``: ``key, h, code``, each key once.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(router)
    floor = min(FLOOR, min_sim) if floor is None else floor

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            to = shipped.value.route(decode(b.column("code").to_pylist(), dim), b.column("h").to_numpy())
            at = pa.array(np.repeat(np.arange(b.num_rows), to.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), b.column("key").take(at), b.column("code").take(at)], names=["shard", "key", "code"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one partition is one shard
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = np.concatenate([b.column("key").to_pandas().to_numpy(object) for b in held])
        codes = np.concatenate([np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, dim) for b in held])
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        graph = Graph(codes[order], floor)
        r, c, s = graph.search_own(k)
        keep = s >= min_sim
        a, b = np.minimum(r, c)[keep].astype(np.int64), np.maximum(r, c)[keep].astype(np.int64)
        _, once = np.unique(a * graph.n + b, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[a[once]], pa.string()), pa.array(keys[b[once]], pa.string()), pa.array(np.minimum(s[keep][once], 1.0), pa.float32())], names=["key", "other", "sim"])

    by_shard = vectors.select("key", "h", "code").mapInArrow(filed, "shard int, key string, code binary").repartitionById(router.shards, "shard")
    return by_shard.select("key", "code").mapInArrow(searched, "key string, other string, sim float")


def both_ways(found: DataFrame) -> DataFrame:
    """Each found pair for both of its keys, once, partitioned by the key and a salt of the other."""
    ways = F.array(F.struct("key", "other", "sim"), F.struct(F.col("other").alias("key"), F.col("key").alias("other"), "sim"))
    pairs = found.select(F.explode(ways).alias("p")).select("p.key", "p.other", "p.sim").withColumn("salt", F.pmod(F.hash("other"), F.lit(16)))
    # the grouping and the first ranking of `most_similar` reuse this partitioning
    return pairs.repartition("key", "salt").groupBy("key", "salt", "other").agg(F.max("sim").alias("sim"))


def most_similar(found: DataFrame, k: int) -> DataFrame:
    """Merge the shards' results: per key the k best, ``rank`` from 1.

    Ranked in two steps, first within a salt, so a vector that very many others
    found is not ranked in one task.
    """
    order = [F.col("sim").desc(), F.col("other")]
    salted = both_ways(found).withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return salted.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k)


def copies(df: DataFrame, key: str, vector: str, order: Column, dim: int = 512, most: int = COPIES) -> tuple[DataFrame, DataFrame] | None:
    """(``key, h`` beyond the first ``most`` keys of one vector, ``h, face, rank`` of those first keys), from keys and hashes alone; None if no vector has so many."""
    light = df.where((F.size(vector) == dim) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(F.coalesce(order.cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(vector).alias("h")).alias("f"))
    first = cut(light.groupBy("key").agg(F.min("f.h").alias("any"), F.min("f").alias("f")).select("key", "f.h"))
    many = cut(first.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most).select("h"))
    if many.isEmpty():
        return None
    grouped = first.join(many, "h").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    faces = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("h", "salt").orderBy("key"))).where(F.col("rank") <= most)
    faces = cut(faces.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("rank") <= most).select("h", F.col("key").alias("face"), "rank"))
    return cut(grouped.join(faces.select(F.col("face").alias("key")), "key", "left_anti").select("key", "h")), faces


def nearest(df: DataFrame, key: str, vector: str, order: Column, k: int = 5, min_sim: float = 0.5, dim: int = 512, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``key, other, sim, rank``: the up to k most similar others at or above ``min_sim`` of every key."""
    copied = copies(df, key, vector, order, dim, k + 1)
    coded = coded_vectors(df, key, vector, order, dim)
    router = fitted_router(coded, df.count(), dim, shard_rows)
    filed = usable_vectors(df, key, vector, order, dim)
    if copied is None:
        return most_similar(similar_pairs(filed, router, k + 3, min_sim, dim), k).select("key", "other", "sim", "rank")
    rest, faces = copied
    top = most_similar(similar_pairs(filed.join(rest.select("key"), "key", "left_anti"), router, k + 3, min_sim, dim), k)
    # a hash of a vector that is not usable has copies too, but these are filed nowhere
    usable = faces.join(coded.select(F.col("key").alias("face")).distinct(), "face", "left_semi")
    far = rest.join(usable.where(F.col("rank") <= k), "h").select("key", F.col("face").alias("other"), F.lit(1.0).cast("float").alias("sim"), "rank")
    return top.select("key", "other", "sim", "rank").unionByName(far)
