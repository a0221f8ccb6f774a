"""Exact similarity joins in blocks.

Rows are spread over blocks of about ``BLOCK`` rows by a hash of the id; each
block is one row of bytes, and each pair of blocks one bounded group whose cosines
are one matrix product. A group
of rows that are compared (all rows, or the rows of one key) of any size becomes
many such groups, so no task holds more than two blocks. The work is the square
of the rows compared, as an exact answer needs; for very many rows use an index.
Cosines are in double. Null vectors take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.vectors import unit
from kinloom.plans.lineage import cut

BLOCK = 1_024


def packed_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, i, blocks, ids, data``: the rows of ``key, id, v`` in blocks of about ``block`` rows, vectors as bytes, one row a block.

    ``blocks`` is the number of the key's blocks. Written once, as both sides of a join read it.
    """
    n = rows.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(n, F.col("key") == F.col("of")).select("key", "id", "v", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("i"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "i": [key[1]], "blocks": [key[2]], "ids": [pdf["id"].to_numpy()], "data": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()]})

    return cut(placed.groupBy("key", "i", "blocks").applyInPandas(pack, "key long, i int, blocks int, ids array<long>, data binary"))


def block_products(left: DataFrame, right: DataFrame, kernel, schema: str, block: int = BLOCK, upper: bool = False) -> DataFrame:
    """``kernel(key, left ids, right ids, cosines) -> frame`` over all block pairs of ``key, id, v`` frames with equal key."""
    a = packed_blocks(left, block)
    b = a if right is left else packed_blocks(right, block)
    na, nb = (x.groupBy("key").agg(F.first("blocks").alias("n")) for x in (a, b))

    def spread(side: DataFrame, other: DataFrame, own: str, others: str) -> DataFrame:
        met = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(others)
        return side.join(other, "key").select("key", F.col("i").alias(own), "ids", "data", met)

    # names of their own, as both sides may be one table
    lb = spread(a, nb, "i", "j")
    rb = spread(b, na, "j", "i").select(F.col("key").alias("rkey"), F.col("i").alias("ri"), F.col("j").alias("rj"), F.col("ids").alias("rids"), F.col("data").alias("rdata"))
    if upper:
        lb, rb = lb.where("i <= j"), rb.where("ri <= rj")

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return kernel(key[0], np.empty(0, np.int64), np.empty(0, np.int64), np.zeros((0, 0)), key[1] == key[2])
        p, u = np.asarray(x["ids"].iloc[0]), np.asarray(y["rids"].iloc[0])
        q, v = np.frombuffer(x["data"].iloc[0]).reshape(len(p), -1), np.frombuffer(y["rdata"].iloc[0]).reshape(len(u), -1)
        return kernel(key[0], p, u, q @ v.T, key[1] == key[2])

    return lb.groupBy("key", "i", "j").cogroup(rb.groupBy("rkey", "ri", "rj")).applyInPandas(run, schema)


def units(df: DataFrame, row: str, vector: str, key: Column | None = None) -> DataFrame:
    """``key, id, v`` with unit vectors."""
    return df.where(F.col(vector).isNotNull()).select((F.lit(0).cast("long") if key is None else key.cast("long")).alias("key"), F.col(row).cast("long").alias("id"), unit(vector).alias("v")).where("key is not null")


def similar_pairs(rows: DataFrame, min_sim: float, strict: bool = True) -> DataFrame:
    """``key, a, b, sim`` with a < b and cosine over ``min_sim`` (or at least it), within a key. ``rows``: see :func:`units`."""

    def kernel(key, a, b, s, same):
        i, j = np.nonzero(s > min_sim if strict else s >= min_sim)
        x, y, z = a[i], b[j], s[i, j]
        if same:
            keep = x < y
            x, y, z = x[keep], y[keep], z[keep]
        return pd.DataFrame({"key": key, "a": np.minimum(x, y), "b": np.maximum(x, y), "sim": z})

    return block_products(rows, rows, kernel, "key long, a long, b long, sim double", upper=True)


def top_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """``id, other, sim, rank``: the k most similar others of each row; ties to the smaller id."""

    def kernel(key, a, b, s, same):
        if same:
            s = np.where(a[:, None] == b[None, :], -2.0, s)
        order = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, :k] if s.size else np.empty((len(a), 0), int)
        z = np.take_along_axis(s, order, 1)
        i, c = np.nonzero(z > -1.5)
        return pd.DataFrame({"id": a[i], "other": b[order[i, c]], "sim": z[i, c]})

    best = block_products(rows, rows, kernel, "id long, other long, sim double")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_links(candidates: DataFrame, hosts: DataFrame) -> DataFrame:
    """``key, id, link``: the largest cosine of each candidate to the host rows of its key."""

    def kernel(key, a, b, s, same):
        return pd.DataFrame({"key": key, "id": a, "link": s.max(axis=1)} if s.size else {"key": [], "id": [], "link": []}).astype({"key": "int64", "id": "int64", "link": "float64"})

    return block_products(candidates, hosts, kernel, "key long, id long, link double").groupBy("key", "id").agg(F.max("link").alias("link"))
