"""Carrying native ids through their stages: offsets, internal and global maps, final labels, manifests.

All steps are equi-joins on ``(src, id)`` or ``id`` and one numbering by ranges; no
map is held in one place. Rows with a null source or id take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ordered import dense_ids


def effective_ids(native: DataFrame, internal: DataFrame, dropped: DataFrame, moved: str, floor: int = 0) -> DataFrame:
    """``src, orig_id, img_count, e1``: the id after the internal map of the source, moved past all others for the source ``moved``.

    ``internal``: ``src, og_id, new_id``; ``dropped``: ``src, id``; their ids get a null ``e1``.
    The offset is one more than the largest effective id of the other sources, and at least ``floor``.
    """
    m = internal.select("src", F.col("og_id").alias("orig_id"), "new_id")
    d = dropped.select("src", F.col("id").alias("orig_id")).distinct().withColumn("gone", F.lit(True))
    e = native.join(m, ["src", "orig_id"], "left").join(d, ["src", "orig_id"], "left")
    e = e.withColumn("e1", F.when(F.col("gone").isNull(), F.coalesce("new_id", "orig_id")))
    # one row
    top = e.where(F.col("src") != moved).agg(F.greatest(F.coalesce(F.max("e1"), F.lit(0)) + 1, F.lit(floor)).alias("offset"))
    return e.crossJoin(F.broadcast(top)).withColumn("e1", F.when(F.col("src") == moved, F.col("e1") + F.col("offset")).otherwise(F.col("e1"))).select("src", "orig_id", "img_count", "e1")


def final_labels(effective: DataFrame, mapping: DataFrame, dropped: DataFrame) -> DataFrame:
    """``src, orig_id, img_count, final_id``: the global map on the effective ids, survivors numbered from 0 by id, -1 for dropped ones.

    ``mapping``: ``og_id, new_id``; ``dropped``: ``id``, both of effective ids. An id is dropped by its effective id, not by the id it maps to.
    """
    m = mapping.select(F.col("og_id").alias("e1"), "new_id")
    d = dropped.select(F.col("id").alias("e1")).distinct().withColumn("gone", F.lit(True))
    e = effective.join(m, "e1", "left").join(d, "e1", "left").withColumn("e2", F.when(F.col("e1").isNotNull() & F.col("gone").isNull(), F.coalesce("new_id", "e1")))
    numbers = dense_ids(e.select("e2"), "e2").withColumnRenamed("dense_id", "final_id")
    return e.join(numbers, "e2", "left").select("src", "orig_id", "img_count", F.coalesce("final_id", F.lit(-1)).cast("long").alias("final_id"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Per source, and over all in the row without one: native ids, kept ids, images kept, smallest and largest label. No ids give no rows."""
    kept = F.col("final_id") >= 0
    return labels.rollup("src").agg(
        F.count("*").alias("n_ids"), F.count_if(kept).alias("n_kept"), F.coalesce(F.sum(F.when(kept, F.col("img_count"))), F.lit(0)).alias("num_image"), F.min(F.when(kept, F.col("final_id"))).alias("first_label"), F.max(F.when(kept, F.col("final_id"))).alias("last_label"), F.count_distinct(F.when(kept, F.col("final_id"))).alias("n_classes")
    )


def latest_map(maps: DataFrame, *key: str) -> DataFrame:
    """Of every key the last mapping by ``mapped_at``, then ``map_id``."""
    return maps.groupBy(*key).agg(F.max_by("final_id", F.struct("mapped_at", "map_id")).alias("final_id"))


def surviving_rows(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (``src, person_id, img_key``) under their final labels; those without a label of 0 or more are left out. Each once."""
    held = labels.where("final_id >= 0").select("src", F.col("orig_id").alias("person_id"), "final_id")
    return images.join(held, ["src", "person_id"]).select("src", "final_id", "img_key").distinct()


def archive_plan(rows: DataFrame, shards: int) -> DataFrame:
    """``tar_path, shard, member_name, final_id``: rows of archives, the archives dealt round-robin to shards in the order of their paths."""
    from kinloom.operators.records import round_robin

    parts = F.split("img_key", r"\.tar/", 2)
    inside = rows.where(F.col("img_key").contains(".tar/")).select(F.concat(parts[0], F.lit(".tar")).alias("tar_path"), parts[1].alias("member_name"), "final_id")
    return inside.join(round_robin(inside.select("tar_path").distinct(), "tar_path", shards), "tar_path").select("tar_path", "shard", "member_name", "final_id")
