"""Global order without a single task: numbers and running totals over a whole table.

Rows are range partitioned by the order; totals per partition (one row each) give
the offsets that are added to the numbers inside a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, per name, the running total of its column over the order, the row itself included. The order must be total."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged.withColumns({f"_x_{n}": c for n, c in sums.items()}))
    per = ranged.groupBy("_range").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    # one row per partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range").withColumns({n: F.sum(f"_x_{n}").over(w) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_range", *[f"_x_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Adds the place of a row in the total order, from 1."""
    return with_running(df, order, {name: F.lit(1).cast("long")})


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """``key, dense_id``: distinct non-null keys numbered from 0 in their order."""
    return with_row_number(df.select(key).dropna().distinct(), [F.col(key)], "dense_id").withColumn("dense_id", F.col("dense_id") - 1)


def closed_gaps(labels: DataFrame, label: str, dropped: DataFrame) -> DataFrame:
    """``label, new_label``: labels without the dropped ones, lowered by the number of dropped labels below."""
    d = dropped.select(F.col(label)).dropna().distinct().withColumn("_d", F.lit(1).cast("long"))
    marked = labels.select(label).dropna().distinct().join(d, label, "full").withColumn("_d", F.coalesce("_d", F.lit(0)))
    return with_running(marked, [F.col(label)], {"_below": F.col("_d")}).where("_d = 0").select(label, (F.col(label) - F.col("_below")).alias("new_label"))


def with_running_max(df: DataFrame, order: list[Column], col: str, name: str) -> DataFrame:
    """Adds the largest value of ``col`` up to the row in the total order."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(F.max(col).alias("_m"))
    # one row per partition
    before = F.max("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(per.select("_range", before.alias("_before"))), "_range")
    return out.withColumn(name, F.greatest(F.max(col).over(w), "_before")).drop("_range", "_before")
