"""Row-level selection: keep-first, top rows per group, samples, shards, numbering and set operations.

Ranking inside a group runs in two steps where groups can be large: within salted
parts, then over the parts' survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.ordered import dense_ids, with_row_number

SALTS = 32


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int, salt_on: str, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the order must be total. ``rank`` from 1."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
    part = salted.withColumn(rank, F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col(rank) <= k)
    return part.drop("_salt").withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row per key, the first by a unique column; by a map-side combined minimum, without sorting groups."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*by, "_r.*").select(*df.columns)


def encoded(df: DataFrame, name: str, code: str) -> DataFrame:
    """Adds the place of ``name`` in code-point order as ``code``; null names get no code."""
    return df.join(dense_ids(df, name).withColumnRenamed("dense_id", code), name, "left")


def overflow_labels(df: DataFrame, label: str, base: int) -> DataFrame:
    """``label, new_label``: labels over ``base`` become base+1, base+2, ...; others stay."""
    over = dense_ids(df.where(F.col(label) > base), label).select(label, (F.col("dense_id") + base + 1).alias("new_label"))
    under = df.where(F.col(label) <= base).select(label, F.col(label).alias("new_label")).distinct()
    return under.unionByName(over)


def inherited_labels(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``child, final_id`` of children whose parent was kept (final_id >= 0). ``children``: child, parent."""
    return children.join(parents.where("final_id >= 0"), "parent").select("child", "final_id")


def round_robin(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``shard`` by place modulo n."""
    return with_row_number(df, [F.col(order)], "_no").withColumn("shard", F.pmod(F.col("_no") - 1, F.lit(n)).cast("int")).drop("_no")


def contiguous_shards(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``shard`` of ceil(rows / n) rows in a row."""
    total = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / n)).alias("_per"))
    return with_row_number(df, [F.col(order)], "_no").join(F.broadcast(total)).withColumn("shard", F.floor((F.col("_no") - 1) / F.col("_per")).cast("int")).drop("_no", "_per")


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows without replacement, the first by md5 of seed and key: the same on every run and engine."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return top_rows(df.withColumn("_h", h), [stratum], [F.col("_h"), F.col(key)], n, key).drop("_h", "rank")


def unequal_prefix(a: DataFrame, b: DataFrame, key: str, *cols: str) -> DataFrame:
    """Keys of ``a`` that are missing in ``b`` or differ in a column (nulls are equal)."""
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    return j.where(F.col(f"b.{key}").isNull() | ~same).select(F.col(f"a.{key}").alias(key))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the rows whose key is not among the finished ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def even_shares(df: DataFrame, order: str, ranks: int) -> DataFrame:
    """``order, rank, place``: rows dealt to ranks in turn; the first rows are repeated until all shares are equal."""
    total = df.agg(F.count("*").alias("_n"))
    p = with_row_number(df.select(order), [F.col(order)], "_no").join(F.broadcast(total)).withColumn("_i", F.col("_no") - 1)
    fill = (ranks - F.col("_n") % ranks) % ranks
    at = F.explode(F.when(F.col("_i") < fill, F.array(F.col("_i"), F.col("_n") + F.col("_i"))).otherwise(F.array("_i")))
    return p.select(order, at.alias("_at")).select(order, F.pmod("_at", F.lit(ranks)).cast("int").alias("rank"), F.floor(F.col("_at") / ranks).alias("place"))
