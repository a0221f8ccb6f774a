"""Geometry of faces and perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The five landmark places of an aligned 112 x 112 face (eyes, nose, mouth corners).
TEMPLATE_112 = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def box_area(box: Column) -> Column:
    """Area of ``x1 y1 x2 y2``; boxes turned inside out have none."""
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def expanded_crop(box: Column, width: Column, height: Column, share: float = 0.5) -> Column:
    """The box grown by ``share`` of its sides around its centre, cut at the picture, as whole pixels."""
    dx, dy = (box[2] - box[0]) * share / 2, (box[3] - box[1]) * share / 2
    return F.struct(
        F.greatest(F.lit(0), (box[0] - dx).cast("int")).alias("x1"),
        F.greatest(F.lit(0), (box[1] - dy).cast("int")).alias("y1"),
        F.least(width, (box[2] + dx).cast("int")).alias("x2"),
        F.least(height, (box[3] + dy).cast("int")).alias("y2"),
    )


def alignment(landmark: Column) -> Column:
    """Least-squares similarity transform of ten landmark numbers to the template: ``a, b, tx, ty`` with u = a x - b y + tx, v = b x + a y + ty."""
    n = len(TEMPLATE_112)
    xs, ys = [landmark[2 * i] for i in range(n)], [landmark[2 * i + 1] for i in range(n)]
    us, vs = [F.lit(u) for u, _ in TEMPLATE_112], [F.lit(v) for _, v in TEMPLATE_112]

    def mean(c: list[Column]) -> Column:
        return sum(c[1:], c[0]) / n

    mx, my, mu, mv = mean(xs), mean(ys), mean(us), mean(vs)
    size = mean([(x - mx) * (x - mx) + (y - my) * (y - my) for x, y in zip(xs, ys, strict=True)])
    a = F.try_divide(mean([(x - mx) * (u - mu) + (y - my) * (v - mv) for x, y, u, v in zip(xs, ys, us, vs, strict=True)]), size)
    b = F.try_divide(mean([(x - mx) * (v - mv) - (y - my) * (u - mu) for x, y, u, v in zip(xs, ys, us, vs, strict=True)]), size)
    return F.struct(a.alias("a"), b.alias("b"), (mu - a * mx + b * my).alias("tx"), (mv - b * mx - a * my).alias("ty"))


def perceptual_hash(pixels: np.ndarray, side: int = 8) -> str:
    """64-bit hash of a square grey picture: signs of its lowest cosine coefficients against their median, in hex."""
    n = pixels.shape[0]
    k = np.cos(np.pi * np.outer(np.arange(side), np.arange(n) + 0.5) / n)
    low = k @ pixels.astype(np.float64) @ k.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


@F.pandas_udf(StringType())
def grey_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Perceptual hash of pictures given as flat square arrays of grey values; null for null or other shapes."""
    for x in batches:
        out = []
        for v in x:
            n = 0 if v is None else int(round(len(v) ** 0.5))
            out.append(perceptual_hash(np.asarray(v, float).reshape(n, n)) if n >= 8 and n * n == len(v) else None)
        yield pd.Series(out, dtype=object)
