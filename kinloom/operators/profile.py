"""Counting, distributions, audits and reports. All are hash aggregates with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.ordered import with_running

# Closed count ranges, the last one open; counts under 3 are in none.
BUCKETS = ((3, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, None))

# The ranges of the audit of written classes.
FULL_BUCKETS = (*BUCKETS[:-1], (201, 500), (501, 1000), (1001, 2000), (2001, 5000), (5001, 10000), (10001, None))


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, *by: str) -> DataFrame:
    """Keys that stand more than once, with their number of rows."""
    return group_counts(df, *by).where("n > 1")


def count_stats(counts: DataFrame, col: str) -> DataFrame:
    """Count, min, max, mean, median and sample deviation."""
    c = F.col(col)
    return counts.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.median(c).alias("middle"), F.stddev_samp(c).alias("sd"))


def percentiles(counts: DataFrame, col: str, at: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Exact percentiles by linear interpolation, one row each; no rows where there are no values.

    Values are counted and their running totals taken by ranges, so no task holds all of them.
    """
    v = counts.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    v = with_running(v, [F.col("v")], {"upto": F.col("n")})
    total = v.agg(F.max("upto").alias("total"))
    p = F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("p")
    spots = v.crossJoin(F.broadcast(total)).select("v", (F.col("upto") - F.col("n")).alias("first"), "upto", "total", p)
    spot = F.col("p") * (F.col("total") - 1)

    def at_place(place):
        return (F.col("first") <= place) & (place < F.col("upto"))

    low, high = at_place(F.floor(spot)), at_place(F.ceil(spot))
    ends = spots.where(low | high).groupBy("p").agg(F.max(F.when(low, F.col("v"))).alias("lo"), F.max(F.when(high, F.col("v"))).alias("hi"), F.first(spot - F.floor(spot)).alias("part"))
    return ends.select("p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def bucket_label(count: Column, buckets=BUCKETS) -> Column:
    """Label of the range that holds a count; null outside all."""
    out = None
    for lo, hi in buckets:
        inside = (count >= lo) if hi is None else count.between(lo, hi)
        label = f"{lo}+" if hi is None else f"{lo}-{hi}"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bucket_distribution(counts: DataFrame, col: str, buckets=BUCKETS) -> DataFrame:
    """Per range: number of ids and sum of their counts."""
    return counts.groupBy(bucket_label(F.col(col), buckets).alias("bucket")).agg(F.count("*").alias("ids"), F.sum(col).alias("rows")).where("bucket is not null")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins from least to largest value; the last bin is closed on the right. One value fills bin 0."""
    edge = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    no = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / width)))
    return df.where(F.col(col).isNotNull()).join(F.broadcast(edge)).groupBy(no.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, key: str, n_classes: int, large: int) -> DataFrame:
    """Audit of labels against 0..n_classes-1: present, missing, rows out of range, large ids, and whether it passes."""
    counts = group_counts(df.where(F.col(key).isNotNull()), key)
    inside = F.col(key).between(0, n_classes - 1)
    a = counts.agg(F.count_if(inside).alias("n_present"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_out_of_range"), F.count_if(inside & (F.col("n") > large)).alias("n_large"))
    a = a.withColumn("n_missing", n_classes - F.col("n_present"))
    return a.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_out_of_range") == 0))


def gaps(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count_distinct(key).alias("n_ids"), (F.max(key) - F.min(key) + 1 - F.count_distinct(key)).alias("n_gaps"))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows, ids and rows per id before and after cleaning."""
    def side(df: DataFrame, name: str) -> DataFrame:
        c = group_counts(df, key)
        return c.agg(F.lit(name).alias("stage"), F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.avg("n").alias("mean_per_id"), F.max("n").alias("most_per_id"))

    return side(before, "before").unionByName(side(after, "after"))


def shared_between(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that stand in more than one part, with the number of parts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def parts_per_key(df: DataFrame, key: str, part: str) -> DataFrame:
    """Distribution: how many keys stand in how many parts."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("n_parts")).groupBy("n_parts").agg(F.count("*").alias("n_keys"))


def running_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
