"""Recall of the index of problem 1 against brute force over a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.hnsw import decode, top_k, usable_vectors

QUERY_SHARE = 50
BLOCK = 1_024


def true_neighbours(df: DataFrame, key: str, vector: str, order: Column, k: int = 5, min_sim: float = 0.5, dim: int = 512) -> DataFrame:
    """``key, other, sim``: the k best others at or above ``min_sim`` of every key whose hash ``QUERY_SHARE`` divides, compared with all keys in blocks.

    A task holds one block of queries and reads its rows as a stream.
    """
    rows = usable_vectors(df, key, vector, order, dim).select("key", "code")
    asked = rows.where(F.pmod(F.xxhash64("key"), F.lit(QUERY_SHARE)) == 0)
    blocks = max(1, -(-df.count() // (QUERY_SHARE * BLOCK)))
    asked = asked.withColumn("block", F.pmod(F.hash("key"), F.lit(blocks)))
    packed = asked.groupBy("block").agg(F.collect_list(F.struct("key", "code")).alias("asked"))
    slices = rows.withColumn("slice", F.pmod(F.hash("key"), F.lit(16 * blocks))).groupBy("slice").agg(F.collect_list(F.struct("key", "code")).alias("held"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asked, held in zip(pdf["asked"], pdf["held"], strict=True):
                qk, rk = (np.array([x["key"] for x in side], object) for side in (asked, held))
                q, r = (decode([bytes(x["code"]) for x in side], dim) for side in (asked, held))
                s = q @ r.T
                s[qk[:, None] == rk[None, :]] = -2
                c = top_k(s, k)
                i = np.repeat(np.arange(len(qk)), c.shape[1])
                c = c.ravel()
                keep = s[i, c] >= min_sim
                yield pd.DataFrame({"key": qk[i[keep]], "other": rk[c[keep]], "sim": s[i[keep], c[keep]]})

    # every block of queries meets every slice of the rows; both sides are tables of blocks, not of rows
    met = packed.join(slices.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block")
    found = met.select("asked", "held").mapInPandas(compared, "key string, other string, sim float")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("sim").desc(), "other"))).where(F.col("rank") <= k)


def measured(df: DataFrame, found: DataFrame, key: str, vector: str, order: Column, k: int = 5, min_sim: float = 0.5, dim: int = 512, least: float = 0.95) -> DataFrame:
    """``n_true, recall, reached``: pairs of the stated queries, the share of them found from the query's side, and whether that is at least ``least``."""
    true = true_neighbours(df, key, vector, order, k, min_sim, dim)
    hit = found.select("key", "other", F.lit(1).alias("hit"))
    n = true.join(hit, ["key", "other"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_hit"))
    share = F.coalesce(F.try_divide("n_hit", "n_true"), F.lit(1.0))
    return n.select("n_true", F.round(share, 4).alias("recall"), (share >= least).alias("reached"))
