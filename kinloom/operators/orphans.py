"""References to records that do not exist (problem 4).

Method: sorted integer parent keys are compressed into contiguous runs and a
reference is matched as-of to the start of the run before it; a reference beyond
the end of that run is an orphan. The same step is used twice: over the *keys*
(no row with that key at any time), then over the *time* of the keys that are
left (the runs of one key are the spans in which a row of it is in force).

Scale: runs are cut at block borders (of 2^16 keys; of 2^43 microseconds, about
102 days, over time), so the as-of match is partitioned by (scope, block) and no
partition holds more than one block of distinct keys or times. References are reduced to distinct keys before matching, so a key that a
third of all references name is matched once. The spans of one key are merged in
two levels (by month, then over months).

Defined results: null references are no case; a null scope never has a parent;
an empty parent table makes every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
TIME_BITS = 43
FOREVER = "9999-12-31 00:00:00"


def contiguous_runs(parents: DataFrame, scope: str, key: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct keys -> ``scope, block, run_start, run_end``, runs being cut at block borders."""
    blocked = parents.select(F.col(scope).alias("scope"), F.col(key).cast("long").alias("key")).dropna().distinct().withColumn("block", F.shiftright("key", bits))
    w = Window.partitionBy("scope", "block").orderBy("key")
    return blocked.withColumn("island", F.col("key") - F.row_number().over(w)).groupBy("scope", "block", "island").agg(F.min("key").alias("run_start"), F.max("key").alias("run_end")).drop("island")


def beyond_runs(refs: DataFrame, runs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct ``scope, key`` of ``refs`` that lie in no run, by an as-of match to the preceding run start."""
    keys = refs.select("scope", "key").distinct().withColumn("block", F.shiftright("key", bits))
    both = keys.select("scope", "block", "key", F.lit(None).cast("long").alias("run_end"), F.lit(1).alias("is_ref")).unionByName(
        runs.select("scope", "block", F.col("run_start").alias("key"), "run_end", F.lit(0).alias("is_ref"))
    )
    w = Window.partitionBy("scope", "block").orderBy("key", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("end_before", F.last("run_end", ignorenulls=True).over(w))
    return matched.where("is_ref = 1 and (end_before is null or key > end_before)").select("scope", "key")


def spans_in_force(parents: DataFrame, scope: Column, key: str, start: str, end: str) -> DataFrame:
    """Per key the merged spans ``[since, until)`` in which a row is in force."""
    rows = parents.select(scope.alias("scope"), F.col(key).alias("key"), F.col(start).cast("timestamp_ntz").alias("since"), F.coalesce(F.col(end).cast("timestamp_ntz"), F.lit(FOREVER).cast("timestamp_ntz")).alias("until"))
    rows = rows.dropna().where("since < until").groupBy("scope", "key", "since").agg(F.max("until").alias("until"))

    def merged(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("scope", "key", *by).orderBy("since")
        before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("opens", F.coalesce((F.col("since") > before).cast("int"), F.lit(1)))
        df = df.withColumn("no", F.sum("opens").over(w))
        return df.groupBy("scope", "key", *by, "no").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("no")

    monthly = merged(rows.withColumn("month", F.date_trunc("month", "since")), "month").drop("month")
    return merged(monthly)


def spans_as_runs(spans: DataFrame, last_us: int, bits: int = TIME_BITS) -> DataFrame:
    """Spans in force as runs of microseconds per (scope, key), cut at block borders and at ``last_us``."""
    us = spans.select(F.struct("scope", "key").alias("scope"), F.unix_micros(F.col("since").cast("timestamp")).alias("lo"), F.least(F.unix_micros(F.col("until").cast("timestamp")) - 1, F.lit(last_us)).alias("hi")).where("lo <= hi")
    cuts = us.select("scope", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))).alias("block"))
    start = F.shiftleft("block", bits)
    return cuts.select("scope", "block", F.greatest("lo", start).alias("run_start"), F.least("hi", start + ((1 << bits) - 1)).alias("run_end"))


def orphan_references(refs: DataFrame, parents: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``refs`` (``ref_id, scope, key, at``) without a parent in force at ``at``.

    ``parents`` are spans from :func:`spans_in_force`, ``runs`` the runs of their keys.
    """
    refs = refs.where("key is not null")
    no_scope = refs.where("scope is null or at is null")
    placed = refs.where("scope is not null and at is not null")
    gone = beyond_runs(placed, runs)
    never = placed.join(gone, ["scope", "key"], "left_semi")
    once = placed.join(gone, ["scope", "key"], "left_anti").withColumn("at_us", F.unix_micros(F.col("at").cast("timestamp")))
    last_us = placed.agg(F.max(F.unix_micros(F.col("at").cast("timestamp")))).first()[0]
    times = once.select(F.struct("scope", "key").alias("scope"), F.col("at_us").alias("key"))
    out_of_force = beyond_runs(times, spans_as_runs(parents, last_us or 0), TIME_BITS).select("scope.scope", "scope.key", F.col("key").alias("at_us"))
    late = once.join(out_of_force, ["scope", "key", "at_us"], "left_semi").drop("at_us")
    return no_scope.unionByName(never).unionByName(late)


def orphans_by_period(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Report per referenced table and month: references, orphans and their share."""
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("month")
    total = refs.where("key is not null").groupBy("ref_table", month).agg(F.count("*").alias("n_refs"))
    bad = orphans.groupBy("ref_table", month).agg(F.count("*").alias("n_orphans"))
    return total.join(bad, ["ref_table", "month"], "left").select("ref_table", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.round(F.coalesce("n_orphans", F.lit(0)) / F.col("n_refs"), 6).alias("share"))
