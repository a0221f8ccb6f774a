"""Connected components by random contraction; following parents to their end.

Every round hooks a vertex to the first of its closed neighbourhood in a fresh
hash order, relabels the edges to the hooks and drops loops and repeated edges,
written to the shared folder. The number of vertices falls by a constant factor
in expectation whatever the shape of the graph and the order of its ids, so
rounds are logarithmic for long chains too. Minima are combined before the
shuffle, so a hub is no heavier than its share of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

MAX_ROUNDS = 100


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """``v, hook`` of every vertex of ``edges``, which hold both directions."""
    def order(c: str):
        return F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))

    return edges.groupBy(F.col("u").alias("v")).agg(F.min(order("v")).alias("n")).select("v", F.least("n", order("v")).getField("id").alias("hook"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component`` (smallest id) of every vertex with an edge to another; null ends and loops are no edges. Raises if ``MAX_ROUNDS`` do not end it."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = cut(e.union(e.select("v", "u")).distinct())
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        if len(rounds) >= MAX_ROUNDS:
            raise RuntimeError(f"components: edges left after {MAX_ROUNDS} rounds")
        hooks = cut(_hooks(both, len(rounds)))
        rounds.append(hooks)
        hu, hv = hooks.select(F.col("v").alias("u"), F.col("hook").alias("hu")), hooks.withColumnRenamed("hook", "hv")
        both = cut(both.join(hu, "u").join(hv, "v").where("hu <> hv").select(F.col("hu").alias("u"), F.col("hv").alias("v")).distinct())
    if not rounds:
        return both.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("v").alias("hook"), F.col("hook").alias("root"))
        roots = cut(rounds.pop().join(later, "hook", "left").select("v", F.coalesce("root", "hook").alias("hook")))
    least = roots.groupBy("hook").agg(F.min("v").alias("component"))
    return roots.join(least, "hook").select(F.col("v").alias("id"), "component")


def flattened(parents: DataFrame, child: str, parent: str) -> DataFrame:
    """``child, parent`` with the last parent of every child; of a cycle, and of what leads to it, the smallest member. Several parents: the smallest counts.

    Steps double every round, so the rounds are logarithmic in the longest chain.
    ``low`` is the least vertex on the steps taken; where it is the same at the end
    of the steps and at the end of as many more, all the steps after are on the
    cycle (or at the last parent) and have passed its least member.
    """
    p = parents.select(F.col(child).alias("child"), F.col(parent).alias("jump")).dropna().groupBy("child").agg(F.min("jump").alias("jump"))
    ends = p.select(F.col("jump").alias("child")).distinct().join(p.select("child"), "child", "left_anti")
    state = cut(p.union(ends.select("child", "child")).withColumn("low", F.col("jump")))
    for _ in range(MAX_ROUNDS):
        ahead = state.select(F.col("child").alias("jump"), F.col("jump").alias("far"), F.col("low").alias("far_low"))
        state = cut(state.join(ahead, "jump").select("child", F.col("far").alias("jump"), F.least("low", "far_low").alias("low"), F.col("far_low").alias("last")))
        ahead = state.select(F.col("child").alias("jump"), F.col("last").alias("far_last"))
        if state.join(ahead, "jump").where("last <> far_last").isEmpty():
            return state.join(ends, "child", "left_anti").select("child", F.col("last").alias("parent"))
        state = state.drop("last")
    raise RuntimeError(f"flattened: no end after {MAX_ROUNDS} rounds")
