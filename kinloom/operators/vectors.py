"""Templates, medoids and pooled vectors per entity.

Sums are made in two steps: every input partition adds up its rows per key in
double with numpy, and only partial sums (one per key and partition) are
shuffled. A key that holds most rows is therefore no larger than any other after
the first step. Null vectors and null keys are left out; vectors of one call must
have one length, rows of another length are left out too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.vectors import dot, norm, unit

FLUSH_KEYS = 20_000


def vector_sums(df: DataFrame, by: list[str], vector: str, weight: str | None = None, unit_rows: bool = False) -> DataFrame:
    """``by..., n, sums``: number of rows and element-wise sum of ``vector`` (times ``weight``, or scaled to length one)."""
    types = dict(df.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)
    v = unit(vector) if unit_rows else F.col(vector).cast("array<double>")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    slim = df.dropna(subset=[*by, vector]).select(*by, v.alias("_v"), w.alias("_w"), F.lit(1).cast("long").alias("_n"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["_v"].to_numpy()) * pdf["_w"].to_numpy()[:, None]
        code, at = pdf.groupby(by, sort=False).ngroup().to_numpy(), pdf.drop_duplicates(by)[by].reset_index(drop=True)
        order = np.argsort(code, kind="stable")
        start = np.searchsorted(code[order], np.arange(len(at)))
        at["_n"] = np.add.reduceat(pdf["_n"].to_numpy()[order], start)
        at["_v"] = list(np.add.reduceat(m[order], start, axis=0))
        at["_w"] = 1.0
        return at

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if pdf.empty:
                continue
            held = add(pdf) if held is None else add(pd.concat([held, add(pdf)], ignore_index=True))
            if len(held) > FLUSH_KEYS:
                yield held[[*by, "_n", "_v"]]
                held = None
        if held is not None:
            yield held[[*by, "_n", "_v"]]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return add(pdf.assign(_w=1.0))[[*by, "_n", "_v"]]

    schema = f"{keys}, _n long, _v array<double>"
    summed = slim.mapInPandas(partial, schema).groupBy(*by).applyInPandas(final, schema)
    return summed.select(*by, F.col("_n").alias("n"), F.col("_v").alias("sums"))


def templates(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """``key, img_count, embedding_center``: the normalised sum per key."""
    return vector_sums(df, [key], vector, weight).select(key, F.col("n").alias("img_count"), unit("sums").alias("embedding_center"))


def media_templates(df: DataFrame, key: str, media: str, vector: str) -> DataFrame:
    """Mean per medium, sum over media, normalised."""
    per_medium = vector_sums(df, [key, media], vector).withColumn("mean", F.transform("sums", lambda x: x / F.col("n")))
    return templates(per_medium, key, "mean").withColumnRenamed("img_count", "n_media")


def medoids(df: DataFrame, key: str, row: str, vector: str, by_sum: bool = False) -> DataFrame:
    """``key, row, sim``: the row most similar to its key's centre, or with ``by_sum`` of most summed cosine to all rows of the key.

    The summed cosine to all rows is the product with the sum of unit rows, so no
    row meets another. Ties go to the smaller row id.
    """
    if by_sum:
        centre = vector_sums(df, [key], vector, unit_rows=True).select(key, F.col("sums").alias("_c"))
    else:
        centre = templates(df, key, vector).select(key, F.col("embedding_center").alias("_c"))
    scored = df.dropna(subset=[key, vector]).join(centre, key).select(key, row, dot(unit(vector), "_c").alias("sim"))
    best = scored.groupBy(key).agg(F.max(F.struct("sim", (-F.col(row)).alias("r"))).alias("b"))
    return best.select(key, (-F.col("b.r")).alias(row), F.col("b.sim").alias("sim"))


def norm_audit(df: DataFrame, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """Rows, largest distance of a length from one, and rows beyond the tolerance."""
    off = F.abs(norm(vector) - 1)
    return df.agg(F.count(vector).alias("n_rows"), F.max(off).alias("max_off"), F.count_if(off > tolerance).alias("n_bad"))
