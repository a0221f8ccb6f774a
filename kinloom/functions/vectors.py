"""Column expressions on ``array`` vectors, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if a side is null or the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str, eps: float = 1e-9) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def angular_margin(cosine: Column, margin: float, scale: float) -> Column:
    """``scale * cos(acos(c) + margin)``."""
    return F.cos(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) + margin) * scale


def cosine_margin(cosine: Column, margin: float, scale: float) -> Column:
    return (cosine - margin) * scale


def learning_rate(step: Column, base: float, warm_up: int, total: int, power: float = 2.0) -> Column:
    """Linear warm-up, then polynomial decay to zero."""
    decay = F.pow(1 - (step - warm_up) / F.lit(float(total - warm_up)), F.lit(power)) * base
    return F.when(step < warm_up, step * (base / warm_up)).otherwise(decay)
