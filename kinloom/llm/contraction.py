"""Consolidating pairwise matches into groups (problem 5).

Method: random graph contraction. In each round every vertex hooks to the vertex
of its closed neighbourhood that comes first in a fresh hash order, edges are
relabelled to the hooks, loops and repeated edges go; the number of vertices
falls by a constant factor in expectation, whatever the shape of the graph. When
no edge is left the rounds' mappings are expanded from the last to the first.

Scale: a round is two joins and two aggregates with map-side combining; a hub's
edges are reduced before the shuffle (its hook is a minimum), and the relabelling
joins split skewed keys. Mappings shrink geometrically, so composing them from
the last round on costs in proportion to the vertices. Every round is written to
the shared folder. Nothing is collected but the number of edges left.

Defined results: null ends and loops link nothing; repeated and reversed pairs
are one link; no links give no rows; ids linked to nothing are not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

MAX_ROUNDS = 200


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """``v, hook``: the first of the closed neighbourhood in the hash order of this round."""
    def order(c: str):
        return F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))

    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), order("v").alias("n")), F.struct(F.col("v").alias("v"), order("u").alias("n")))).alias("e"))
    return ends.groupBy("e.v").agg(F.min("e.n").alias("n")).select("v", F.least("n", order("v")).getField("id").alias("hook"))


def linked_groups(pairs: DataFrame, a: str, b: str, seed: int = 20) -> DataFrame:
    """``id, group_id`` for every id linked to another; ``group_id`` is the smallest id of the group."""
    edges = cut(_edges(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    empty = edges.select(F.col("u").alias("v"), F.col("u").alias("hook")).limit(0)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        if len(rounds) >= MAX_ROUNDS:
            raise RuntimeError(f"no end after {MAX_ROUNDS} rounds of contraction")
        hooks = cut(_hooks(edges, seed + len(rounds)))
        rounds.append(hooks)
        to_u, to_v = hooks.select(F.col("v").alias("u"), F.col("hook").alias("hu")), hooks.withColumnRenamed("hook", "hv")
        edges = cut(_edges(edges.join(to_u, "u").join(to_v, "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))))
    mapping = rounds[-1] if rounds else empty
    for hooks in reversed(rounds[:-1]):
        later = mapping.select(F.col("v").alias("hook"), F.col("hook").alias("root"))
        mapping = cut(hooks.join(later, "hook", "left").select("v", F.coalesce("root", "hook").alias("hook")))
    first = mapping.groupBy("hook").agg(F.min("v").alias("group_id"))
    return mapping.join(first, "hook").select(F.col("v").alias("id"), "group_id")
