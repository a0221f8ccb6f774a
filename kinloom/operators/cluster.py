"""Density clustering within keys, in relational form.

A row's neighbourhood holds itself and all rows of its key within cosine distance
``eps``. Rows with at least ``min_samples`` neighbours are core; clusters are the
components of core-core links, numbered per key by their smallest core id; a
border row takes the lowest-numbered adjacent cluster; others are noise (-1).
Pairs come from the block join, so a key of any size is cut into bounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import components
from kinloom.operators.simjoin import similar_pairs
from kinloom.plans.lineage import cut


def density_clusters(rows: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``key, id, cluster`` for ``key, id, v`` rows with ids unique over all keys."""
    pairs = similar_pairs(rows, 1 - eps, strict=False)
    links = cut(pairs.select("key", "a", "b").union(pairs.select("key", F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    core = cut(rows.select("key", "id").join(degree, F.col("id") == F.col("a"), "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("key", "id"))
    among = links.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    comp = core.join(components(among, "a", "b"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    numbers = comp.select("key", "component").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("key").orderBy("component")) - 1)
    cored = comp.join(numbers, ["key", "component"]).select("key", "id", "cluster")
    reach = links.join(cored.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    return rows.select("key", "id").join(cored.select("id", "cluster"), "id", "left").join(reach, "id", "left").select("key", "id", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def main_cluster(clusters: DataFrame) -> DataFrame:
    """``key, cluster, n``: the largest cluster per key, ties to the lowest number; keys of noise alone are left out."""
    n = clusters.where("cluster >= 0").groupBy("key", "cluster").agg(F.count("*").alias("n"))
    best = n.groupBy("key").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("b"))
    return best.select("key", (-F.col("b.c")).alias("cluster"), F.col("b.n").alias("n"))


def cleaned(rows: DataFrame, eps: float, min_samples: int = 3) -> DataFrame:
    """``key, id`` of the rows in their key's largest cluster."""
    c = density_clusters(rows, eps, min_samples)
    return c.join(main_cluster(c).drop("n"), ["key", "cluster"]).select("key", "id")
