"""Invariants at stage borders. Each gate is one row ``gate, n_bad``; a stage passes when all are zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.vectors import norm


def _gate(name: str, df: DataFrame, bad=None) -> DataFrame:
    return df.agg(F.lit(name).alias("gate"), (F.count("*") if bad is None else F.coalesce(bad, F.lit(0))).cast("long").alias("n_bad"))


def unit_length(df: DataFrame, vector: str, tolerance: float = 1e-4) -> DataFrame:
    return _gate("unit_length", df, F.count_if(F.abs(norm(vector) - 1) > tolerance))


def unique(df: DataFrame, *by: str) -> DataFrame:
    return _gate("unique", df.groupBy(*by).count().where("count > 1"))


def subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    return _gate("subset", part.select(key).distinct().join(whole.select(key), key, "left_anti"))


def at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    return _gate("at_least", df.groupBy(key).count().where(F.col("count") < n))


def contiguous(df: DataFrame, label: str) -> DataFrame:
    """Labels are exactly 0..K-1: counts missing and negative ones."""
    ids = df.select(F.col(label).alias("x")).dropna().distinct()
    return _gate("contiguous", ids, (F.max("x") + 1 - F.count("*")) + F.count_if(F.col("x") < 0))


def report(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)
