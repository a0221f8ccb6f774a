"""Verification metrics over scored pairs ``pair_id, genuine (0/1), score``.

Cumulative counts come from one range-partitioned pass (see ``ordered``), so no
metric needs all pairs in one task. A pair is accepted when its score reaches the
threshold. Ties: curves group equal scores; row-wise rules order equal scores by
pair id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.ordered import with_row_number, with_running


def _totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.sum("genuine").alias("n_genuine"), F.sum(1 - F.col("genuine")).alias("n_impostor"))


def cumulative(pairs: DataFrame) -> DataFrame:
    """Per pair, in descending score: running accepts, ``far`` and ``frr`` with the threshold at its score."""
    run = with_running(pairs, [F.col("score").desc(), F.col("pair_id")], {"tp": F.col("genuine").cast("long"), "fp": (1 - F.col("genuine")).cast("long")})
    return run.join(F.broadcast(_totals(pairs))).select("pair_id", "score", "tp", "fp", (F.col("fp") / F.col("n_impostor")).alias("far"), ((F.col("n_genuine") - F.col("tp")) / F.col("n_genuine")).alias("frr"))


def roc(pairs: DataFrame) -> DataFrame:
    """``score, fpr, tpr`` per distinct threshold."""
    per = pairs.groupBy("score").agg(F.sum("genuine").alias("g"), F.sum(1 - F.col("genuine")).alias("i"))
    run = with_running(per, [F.col("score").desc()], {"tp": F.col("g"), "fp": F.col("i")})
    return run.join(F.broadcast(_totals(pairs))).select("score", (F.col("fp") / F.col("n_impostor")).alias("fpr"), (F.col("tp") / F.col("n_genuine")).alias("tpr"), "g", "i", "tp", "fp", "n_genuine", "n_impostor")


def auc(curve: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids; each threshold's strip needs its own counts alone."""
    strip = (F.col("i") / F.col("n_impostor")) * (F.col("tp") - F.col("g") / 2) / F.col("n_genuine")
    return curve.agg(F.sum(strip).alias("auc"))


def eer(curve: DataFrame) -> DataFrame:
    """Equal error rate: mean of both rates where they are nearest; ties to the higher threshold."""
    fnr = 1 - F.col("tpr")
    best = curve.agg(F.min(F.struct(F.abs(F.col("fpr") - fnr).alias("gap"), (-F.col("score")).alias("s"), ((F.col("fpr") + fnr) / 2).alias("eer"))).alias("b"))
    return best.select(F.col("b.eer").alias("eer"), (-F.col("b.s")).alias("threshold"))


def nearest_rate(curve: DataFrame, targets: list[float], rate: str, value: Column, name: str) -> DataFrame:
    """Per target the row whose ``rate`` is nearest; ties to the higher threshold."""
    cols = [F.min(F.struct(F.abs(F.col(rate) - t).alias("gap"), (-F.col("score")).alias("s"), value.alias("v"))).alias(f"t{i}") for i, t in enumerate(targets)]
    one = curve.agg(*cols)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (-F.col(f"t{i}.s")).alias("threshold"), F.col(f"t{i}.v").alias(name)) for i, t in enumerate(targets)]))
    return one.select(rows.alias("r")).select("r.*")


def constrained(cum: DataFrame, targets: list[float], rate: str, other: str, first: bool) -> DataFrame:
    """Per target: the last row (or ``first``) in descending score with ``rate`` <= target, and its other rate; without one, the first (last) row."""
    order = F.struct(F.col("score"), -F.col("pair_id"))
    pick, fall = (F.max, F.min) if first else (F.min, F.max)
    s = F.struct(order.alias("o"), F.col("score").alias("threshold"), F.col(other).alias("v"))
    one = cum.agg(fall(s).alias("none"), *[pick(F.when(F.col(rate) <= t, s)).alias(f"t{i}") for i, t in enumerate(targets)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(F.col(f"t{i}"), F.col("none")).alias("x")) for i, t in enumerate(targets)]))
    return one.select(rows.alias("r")).select("r.target", "r.x.threshold", F.col("r.x.v").alias(other))


def rates_at(pairs: DataFrame, threshold: float) -> DataFrame:
    accept = F.col("score") >= threshold
    return pairs.agg((F.count_if(accept & (F.col("genuine") == 0)) / F.count_if(F.col("genuine") == 0)).alias("far"), (F.count_if(~accept & (F.col("genuine") == 1)) / F.count_if(F.col("genuine") == 1)).alias("frr"))


def gray_zone(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Accept at ``high`` and over, reject at ``low`` and under, review between."""
    zone = F.when(F.col("score") >= high, "accept").when(F.col("score") <= low, "reject").otherwise("review")
    return pairs.groupBy(zone.alias("zone"), "genuine").agg(F.count("*").alias("n"))


def worst_cases(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per template its worst pair: lowest genuine, highest impostor score; each pair counts for both; ties to the smaller other."""
    both = pairs.select(F.col(a).alias("template"), F.col(b).alias("other"), "genuine", "score").unionByName(pairs.select(F.col(b).alias("template"), F.col(a).alias("other"), "genuine", "score"))
    badness = F.struct(F.when(F.col("genuine") == 1, F.col("score")).otherwise(-F.col("score")).alias("s"), "other", "score")
    w = both.groupBy("template", "genuine").agg(F.min(badness).alias("w"))
    return w.select("template", "genuine", "w.other", "w.score")


def threshold_at_rate(scores: DataFrame, rate: float, n_all: Column, order: list[Column]) -> DataFrame:
    """Score of the best-but-(N·rate) pair, N·rate rounded half to even and at least 1; ``lower_bound`` where there are too few candidates."""
    ranked = with_row_number(scores, order, "place")
    want = ranked.agg(F.max("place").alias("have"), F.greatest(F.lit(1), F.bround(n_all * rate)).cast("long").alias("want"))
    return ranked.join(F.broadcast(want), F.col("place") == F.least("want", "have")).select(F.col("score").alias("threshold"), F.col("place").alias("rank"), (F.col("want") > F.col("have")).alias("lower_bound"))


def folds(pairs: DataFrame, k: int) -> DataFrame:
    """Unshuffled folds by pair id; the first ``n % k`` folds have one row more."""
    n = pairs.agg(F.count("*").alias("n"))
    p = with_row_number(pairs, [F.col("pair_id")], "place").join(F.broadcast(n))
    size, extra, z = F.floor(F.col("n") / k), F.col("n") % k, F.col("place") - 1
    big = extra * (size + 1)
    return p.withColumn("fold", F.when(z < big, F.floor(z / (size + 1))).otherwise(extra + F.floor((z - big) / F.greatest(size, F.lit(1)))).cast("int")).drop("n", "place")


def _by_threshold(folded: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per fold and threshold: accepts of genuine and impostor pairs and totals (distance below the threshold accepts).

    Pairs are first counted per fold and threshold cell, so the thresholds meet counts, not pairs.
    """
    cell = F.lit(0)
    step, lo = thresholds[1] - thresholds[0], thresholds[0]
    # first threshold that exceeds the distance
    guess = F.greatest(F.lit(0), F.least(F.lit(len(thresholds)), F.floor((F.col("dist") - lo) / step) - 1)).cast("int")
    arr = F.array(*[F.lit(t) for t in thresholds])
    cell = F.aggregate(F.sequence(F.lit(0), F.lit(3)), guess, lambda c, _: F.when((c < len(thresholds)) & (F.try_element_at(arr, c + 1) <= F.col("dist")), c + 1).otherwise(c))
    counts = folded.withColumn("cell", cell).groupBy("fold", "cell").agg(F.sum("genuine").alias("g"), F.sum(1 - F.col("genuine")).alias("i"))
    total = counts.groupBy("fold").agg(F.sum("g").alias("all_g"), F.sum("i").alias("all_i"))
    grid = total.select("fold", "all_g", "all_i", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("cell")).join(counts, ["fold", "cell"], "left")
    w = Window.partitionBy("fold").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("fold", "cell", F.element_at(arr, F.col("cell") + 1).alias("t"), "all_g", "all_i", F.coalesce(F.sum("g").over(w), F.lit(0)).alias("tp"), F.coalesce(F.sum("i").over(w), F.lit(0)).alias("fp"))


def kfold_accuracy(folded: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per fold: the threshold best on the other folds (first on ties) and its accuracy on the fold."""
    t = _by_threshold(folded, thresholds).withColumn("right", F.col("tp") + F.col("all_i") - F.col("fp"))
    every = t.groupBy("cell").agg(F.sum("right").alias("all_right"))
    s = t.join(every, "cell").withColumn("train", F.col("all_right") - F.col("right"))
    best = s.groupBy("fold").agg(F.max(F.struct("train", (-F.col("cell")).alias("c"), "t", (F.col("right") / (F.col("all_g") + F.col("all_i"))).alias("accuracy"))).alias("b"))
    return best.select("fold", F.col("b.t").alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def kfold_val(folded: DataFrame, thresholds: list[float], far_target: float) -> DataFrame:
    """Per fold: threshold interpolated on the other folds where their far reaches the target (0 if never), and the fold's val and far there."""
    t = _by_threshold(folded, thresholds)
    every = t.groupBy("cell").agg(F.sum("fp").alias("sum_fp"), F.sum("all_i").alias("sum_i"))
    s = t.join(every, "cell").withColumn("far", (F.col("sum_fp") - F.col("fp")) / (F.col("sum_i") - F.col("all_i")))
    # far does not fall with the threshold: the last cell under the target and the first at or over it
    edge = s.groupBy("fold").agg(F.max(F.when(F.col("far") < far_target, F.struct("cell", "far", "t"))).alias("lo"), F.min(F.when(F.col("far") >= far_target, F.struct("cell", "far", "t"))).alias("hi"))
    at = F.when(F.col("hi").isNull(), F.lit(0.0)).when(F.col("lo").isNull(), F.col("hi.t")).otherwise(F.col("lo.t") + (F.col("hi.t") - F.col("lo.t")) * (far_target - F.col("lo.far")) / (F.col("hi.far") - F.col("lo.far")))
    cut_at = edge.select("fold", at.alias("threshold"))
    return folded.join(F.broadcast(cut_at), "fold").groupBy("fold").agg(
        F.first("threshold").alias("threshold"),
        (F.sum(F.when((F.col("genuine") == 1) & (F.col("dist") < F.col("threshold")), 1).otherwise(0)) / F.sum("genuine")).alias("val"),
        (F.sum(F.when((F.col("genuine") == 0) & (F.col("dist") < F.col("threshold")), 1).otherwise(0)) / F.sum(1 - F.col("genuine"))).alias("far"),
    )
