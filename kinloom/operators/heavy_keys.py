"""Per-key results when a few keys hold most rows (problem 6).

Method: rows are range partitioned on the composite of key and secondary order,
with bounds from sampled quantiles, so a heavy key is split over as many
partitions as its share needs. Each partition reads its rows once, in order, and
emits one partial state per key in it. States of a key that reaches over a
partition border are stitched in partition order; a key has at most as many
states as there are partitions, whatever its number of rows.

Defined results: rows with a null key form no group; null times are left out of
first, last and gap, null or incomplete boxes out of the mean size; repeated rows
count as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.plans.lineage import cut

_STATE = "range_no int, key long, n long, n_timed long, first_us long, last_us long, gap_us long, total double, n_total long"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _partial_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # key, time and whether there is a time, of the last row of the batch before
    held: tuple[int, int, bool] | None = None
    parts = []
    for pdf in batches:
        if pdf.empty:
            continue
        key, at, timed, size = (pdf[c].to_numpy() for c in ("key", "at_us", "timed", "size"))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        gap = np.zeros(len(key), np.int64)
        same = (key[1:] == key[:-1]) & timed[1:] & timed[:-1]
        gap[1:][same] = (at[1:] - at[:-1])[same]
        if held is not None and held[0] == key[0] and timed[0] and held[2]:
            gap[0] = at[0] - held[1]
        ok = ~np.isnan(size)
        parts.append(
            pd.DataFrame(
                {
                    "range_no": pdf["range_no"].iloc[0],
                    "key": key[start],
                    "n": np.diff(np.r_[start, len(key)]),
                    "n_timed": np.add.reduceat(timed.astype(np.int64), start),
                    "first_us": np.minimum.reduceat(np.where(timed, at, _MOST), start),
                    "last_us": np.maximum.reduceat(np.where(timed, at, _LEAST), start),
                    "gap_us": np.maximum.reduceat(gap, start),
                    "total": np.add.reduceat(np.where(ok, size, 0.0), start),
                    "n_total": np.add.reduceat(ok.astype(np.int64), start),
                }
            )
        )
        held = (int(key[-1]), int(at[-1]), bool(timed[-1]))
    if parts:
        # a key has one state per batch here; one per partition leaves
        yield (
            pd.concat(parts)
            .groupby(["range_no", "key"], as_index=False)
            .agg({"n": "sum", "n_timed": "sum", "first_us": "min", "last_us": "max", "gap_us": "max", "total": "sum", "n_total": "sum"})
        )


def balanced_states(df: DataFrame, key: str, at: str, size: str, *ties: str) -> DataFrame:
    """Partial states per (key range, key); ``at`` is a timestamp, ``size`` a number. Written once, as several results read them."""
    slim = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"),
        F.coalesce(F.col(size).cast("double"), F.lit(float("nan"))).alias("size"),
        F.xxhash64(*ties).alias("tie") if ties else F.lit(0).alias("tie"),
    )
    ranged = slim.repartitionByRange("key", "at_us", "tie").withColumn("range_no", F.spark_partition_id())
    ordered = ranged.sortWithinPartitions("key", "at_us").select("range_no", "key", F.coalesce("at_us", F.lit(0)).alias("at_us"), F.col("at_us").isNotNull().alias("timed"), "size")
    return cut(ordered.mapInPandas(_partial_states, _STATE))


def per_key_results(states: DataFrame) -> DataFrame:
    """Stitch partial states: count, first and last time, longest gap between neighbours in time, mean size."""
    timed = F.col("n_timed") > 0
    s = states.withColumns({"first_us": F.when(timed, F.col("first_us")), "last_us": F.when(timed, F.col("last_us"))})
    before = F.last("last_us", ignorenulls=True).over(Window.partitionBy("key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("gap_us", F.greatest("gap_us", F.coalesce(F.col("first_us") - before, F.lit(0))))
    return s.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.timestamp_micros(F.min("first_us")).alias("first_at"),
        F.timestamp_micros(F.max("last_us")).alias("last_at"),
        F.max("gap_us").alias("longest_gap_us"),
        F.try_divide(F.sum("total"), F.sum("n_total")).alias("mean_size"),
    )


def heavy_keys(results: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys that hold at least ``share`` of all rows."""
    total = results.agg(F.sum("n_rows").alias("all_rows"))
    return results.join(F.broadcast(total)).where(F.col("n_rows") >= F.col("all_rows") * share).drop("all_rows")
