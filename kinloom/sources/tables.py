"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet under one or several paths or patterns, partitioned folders with their keys as columns; only ``columns`` are read."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df
