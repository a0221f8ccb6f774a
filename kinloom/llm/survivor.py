"""Best representative of each duplicate group (problem 7).

Method: records are ranked within their group by completeness, trust and recency
with a deterministic tie-break, by window ordering. The ranking runs twice, first
within salted parts of a group and then over the parts' leaders, so a group that
holds a third of all records is not sorted in one task. Fields the leader lacks
are filled one by one from the best record that has them; each field is a
map-side combined maximum.

Defined results: null, blank and placeholder texts are not filled, nor are
impossible numbers (see :func:`filled_fields`); an unknown source is the least
trusted; a null time is the least recent; last ties go to the smaller id; a
record repeated under one id is one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import known

LEAST_TRUST = 2**31 - 1
SALTS = 64


def filled_fields(first_year: int = 1900) -> dict[str, Column]:
    """Rules for the fields of a person record: what counts as filled."""
    return {
        "name": known(F.col("name")) & F.col("name").rlike(r"\p{L}"),
        "birth_year": F.coalesce(F.col("birth_year").between(F.lit(first_year), F.year(F.current_date())), F.lit(False)),
        "country": known(F.col("country")) & F.col("country").rlike(r"\p{L}"),
        "img_count": F.coalesce(F.col("img_count") > 0, F.lit(False)),
        "best_img_key": known(F.col("best_img_key")),
    }


def with_fill(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``has`` (array of 0/1 per field) and ``n_filled``."""
    has = F.array(*[r.cast("int") for r in rules.values()])
    return records.withColumn("has", has).withColumn("n_filled", F.aggregate("has", F.lit(0), lambda a, x: a + x))


def _order() -> list[Column]:
    return [F.col("n_filled").desc(), F.col("trust_rank"), F.col("updated_at").desc_nulls_last(), F.col("rec_id")]


def leaders(members: DataFrame) -> DataFrame:
    """The first record of each ``group_id`` by completeness, trust and recency."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)))
    first = salted.withColumn("_no", F.row_number().over(Window.partitionBy("group_id", "_salt").orderBy(*_order()))).where("_no = 1")
    return first.withColumn("_no", F.row_number().over(Window.partitionBy("group_id").orderBy(*_order()))).where("_no = 1").drop("_no", "_salt")


def group_bests(members: DataFrame, fields: list[str]) -> DataFrame:
    """Per group: size, what any member fills, best trust, latest time and how many records have it."""
    latest = members.groupBy("group_id", "updated_at").agg(
        F.count("*").alias("n"), F.min("trust_rank").alias("trust"), *[F.max(F.col("has")[i]).alias(f"any_{f}") for i, f in enumerate(fields)]
    )
    return latest.groupBy("group_id").agg(
        F.sum("n").alias("n_members"),
        F.min("trust").alias("best_trust"),
        F.max(F.struct("updated_at", "n")).alias("last"),
        F.array(*[F.max(f"any_{f}") for f in fields]).alias("any_has"),
    )


def unbeaten(members: DataFrame, fields: list[str]) -> DataFrame:
    """Leaders that no other member beats in any field, in time or in trust; groups of two or more."""
    b = group_bests(members, fields)
    # a case keeps its own columns only by name, so extra ones cannot clash
    top = leaders(members.select("group_id", "rec_id", "has", "n_filled", "trust_rank", "updated_at")).join(b, "group_id")
    return top.where((F.col("n_members") >= 2) & (F.col("has") == F.col("any_has")) & F.col("updated_at").isNotNull() & (F.col("updated_at") == F.col("last.updated_at")) & (F.col("last.n") == 1) & (F.col("trust_rank") == F.col("best_trust")))


def built_records(members: DataFrame, fields: list[str]) -> DataFrame:
    """One record per group: each field from the most trusted, then most recent record that fills it."""
    def best(i: int, f: str) -> Column:
        rank = F.struct((-F.col("trust_rank")).alias("t"), F.col("updated_at").alias("u"), (-F.col("rec_id")).alias("r"), F.col(f).alias("value"))
        return F.max(F.when(F.col("has")[i] == 1, rank)).getField("value").alias(f)

    built = members.groupBy("group_id").agg(F.count("*").alias("n_members"), *[best(i, f) for i, f in enumerate(fields)])
    return built.join(leaders(members).select("group_id", F.col("rec_id").alias("lead_rec_id")), "group_id")
