"""Merging and dropping near-duplicate entities, and carrying id maps through.

``centres``: ``id, img_count, v``. All rules are free of row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.graph import components
from kinloom.operators.ordered import dense_ids


def _leaders(centres: DataFrame, merge_pairs: DataFrame, order) -> DataFrame:
    """``id, leader, total`` of every centre; the leader comes first in ``order``, ``total`` is its component's count."""
    comp = centres.join(components(merge_pairs, "a", "b"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lead = comp.groupBy("component").agg(F.min(order).getField("id").alias("leader"), F.sum("img_count").alias("total"))
    return comp.join(lead, "component").select("id", "img_count", "leader", "total")


def symmetric_merge(centres: DataFrame, pairs: DataFrame, lower: float, upper: float) -> tuple[DataFrame, DataFrame]:
    """(map ``og_id, new_id``, drops ``id``).

    Pairs over ``upper`` merge to the member of largest count (ties: smaller id);
    a pair in (lower, upper] across different leaders drops the leader whose
    component has fewer images (ties: the larger id) with all its members.
    """
    c = centres.select("id", "img_count")
    lead = _leaders(c, pairs.where(F.col("sim") > upper), F.struct((-F.col("img_count")).alias("n"), F.col("id").alias("id")))
    zone = pairs.where((F.col("sim") > lower) & (F.col("sim") <= upper)).select("a", "b")
    sides = zone.join(lead.select(F.col("id").alias("a"), F.col("leader").alias("la"), F.col("total").alias("ta")), "a").join(
        lead.select(F.col("id").alias("b"), F.col("leader").alias("lb"), F.col("total").alias("tb")), "b"
    )
    loser = F.when(F.col("ta") < F.col("tb"), F.col("la")).when(F.col("tb") < F.col("ta"), F.col("lb")).otherwise(F.greatest("la", "lb"))
    lost = sides.where("la <> lb").select(loser.alias("leader")).distinct()
    drops = lead.join(lost, "leader", "left_semi").select("id")
    kept = lead.join(lost, "leader", "left_anti").where("id <> leader").select(F.col("id").alias("og_id"), F.col("leader").alias("new_id"))
    return kept, drops


def anchored_merge(centres: DataFrame, pairs: DataFrame, lower: float, upper: float) -> DataFrame:
    """``og_id, new_id``. ``centres`` also has ``anchor`` (boolean).

    Components over ``upper`` lead to their largest anchor, or without one to the
    largest member. A pair in the zone between leaders merges too: every leader
    takes as parent the best zone partner that outranks it (anchors before
    others, then larger count, then smaller id; by similarity, then id), and
    parents are followed to the last.
    """
    from kinloom.operators.graph import flattened

    c = centres.select("id", "img_count", "anchor")
    rank = F.struct(F.when(F.col("anchor"), 0).otherwise(1).alias("k"), (-F.col("img_count")).alias("n"), F.col("id").alias("id"))
    comp = c.join(components(pairs.where(F.col("sim") > upper), "a", "b"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lead = comp.groupBy("component").agg(F.min(rank).alias("r"))
    lead = comp.join(lead, "component").select("id", F.col("r.id").alias("leader"), "r")
    zone = pairs.where((F.col("sim") > lower) & (F.col("sim") <= upper))
    s = zone.join(lead.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(lead.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b").where("ra <> rb")
    low, high = F.greatest("ra", "rb"), F.least("ra", "rb")
    # two anchors never merge through the zone
    up = s.where("not (ra.k = 0 and rb.k = 0)").select(low.getField("id").alias("child"), F.struct((-F.col("sim")).alias("s"), high.getField("id").alias("id")).alias("p"))
    parents = flattened(up.groupBy("child").agg(F.min("p").getField("id").alias("parent")), "child", "parent")
    final = lead.join(parents.withColumnRenamed("child", "leader"), "leader", "left").select("id", F.coalesce("parent", "leader").alias("new_id"))
    return final.where("id <> new_id").select(F.col("id").alias("og_id"), "new_id")


def new_only_merge(centres: DataFrame, pairs: DataFrame, lower: float, upper: float) -> tuple[DataFrame, DataFrame]:
    """(map, drops): components with an anchor drop their other members, others merge to their leader; a zone pair with an anchor drops the other."""
    c = centres.select("id", "img_count", "anchor")
    comp = c.join(components(pairs.where(F.col("sim") > upper), "a", "b"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    g = comp.groupBy("component").agg(F.max("anchor").alias("has_anchor"), F.min(F.struct((-F.col("img_count")).alias("n"), F.col("id").alias("id"))).getField("id").alias("leader"))
    j = comp.join(g, "component")
    in_zone = pairs.where((F.col("sim") > lower) & (F.col("sim") <= upper)).join(c.select(F.col("id").alias("a"), F.col("anchor").alias("xa")), "a").join(c.select(F.col("id").alias("b"), F.col("anchor").alias("xb")), "b").where("xa <> xb")
    drops = j.where("has_anchor and not anchor").select("id").union(in_zone.select(F.when(F.col("xa"), F.col("b")).otherwise(F.col("a")).alias("id"))).distinct()
    kept = j.where("not has_anchor and id <> leader").join(drops, "id", "left_anti").join(drops.withColumnRenamed("id", "leader"), "leader", "left_anti")
    return kept.select(F.col("id").alias("og_id"), F.col("leader").alias("new_id")), drops


def apply_map(facts: DataFrame, key: str, mapping: DataFrame, drops: DataFrame) -> DataFrame:
    """Facts without dropped keys, mapped keys replaced; other columns stay. A fact with a null key is kept."""
    d, m = drops.select(F.col("id").alias("_drop")), mapping.select(F.col("og_id").alias("_og"), F.col("new_id").alias("_new"))
    kept = facts.join(d, facts[key] == d["_drop"], "left_anti")
    return kept.join(m, kept[key] == m["_og"], "left").withColumn(key, F.coalesce("_new", key)).drop("_og", "_new")


def contiguous_labels(ids: DataFrame, key: str, mapping: DataFrame, drops: DataFrame) -> DataFrame:
    """``orig_id, final_id``: map, then number the survivors from 0 by id; dropped ids get -1."""
    d = drops.select(F.col("id").alias("orig_id"), F.lit(True).alias("gone"))
    m = mapping.select(F.col("og_id").alias("orig_id"), "new_id")
    eff = ids.select(F.col(key).alias("orig_id")).distinct().join(d, "orig_id", "left").join(m, "orig_id", "left").withColumn("eff", F.coalesce("new_id", "orig_id"))
    gone = d.select(F.col("orig_id").alias("eff"), F.lit(True).alias("eff_gone"))
    eff = eff.join(gone, "eff", "left").withColumn("dead", F.coalesce("gone", "eff_gone", F.lit(False)))
    numbers = dense_ids(eff.where("not dead"), "eff")
    return eff.join(numbers.withColumnRenamed("dense_id", "final_id"), "eff", "left").select("orig_id", F.when(F.col("dead"), F.lit(-1)).otherwise(F.coalesce("final_id", F.lit(-1))).cast("long").alias("final_id"))
