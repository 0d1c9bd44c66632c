"""Bands of metrics by a Poisson bootstrap in one pass, and what is read from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus and multipliers of the generator that turns a row's key and a replicate into a uniform number, in whole-number arithmetic.
PRIME, STEPS = 2_147_483_647, (1_103_515_245, 48_271, 69_621)
#: Shares of a Poisson variable of mean 1 that are at most 0, 1, ...; weights beyond seven have less than one in a million.
POISSON = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.99991675885)
# Least errors of the bands of calibration quality, and what they recommend.
QUALITY = [(0.05, "excellent"), (0.10, "good"), (0.15, "fair")]
RECOMMENDATIONS = {
    "excellent": "Model probabilities are reliable for clinical decision-making",
    "good": "Model probabilities are generally reliable; verify high-stakes predictions",
    "fair": "Model tends to be overconfident; apply clinical judgment",
    "poor": "Model is poorly calibrated; do not rely on probability estimates",
}


def with_poisson_weight(df: DataFrame, key: str, replicate: str, name: str = "weight", seed: int = 0) -> DataFrame:
    """``df`` with how often a row (by its whole-number ``key``) is drawn in a replicate: the same in every run and on every executor.

    Squares mix the numbers, as multiples alone would only shift one replicate against another. Each step is a column of its own, so
    none is computed twice.
    """
    prime, b = F.lit(PRIME), F.col(replicate).cast("long")
    x, z = F.col("_x"), F.col("_z")
    staged = df.withColumn("_x", F.pmod(F.pmod(F.col(key).cast("long"), prime) * STEPS[0] + b * 12_345 + seed + 1, prime))
    staged = staged.withColumn("_z", (x * x + b + 1) % prime * STEPS[1] % prime).withColumn("_u", (z * z + x) % prime * STEPS[2] % prime / F.lit(float(PRIME)))
    weight = F.lit(len(POISSON))
    for n, share in reversed(list(enumerate(POISSON))):
        weight = F.when(F.col("_u") <= share, n).otherwise(weight)
    return staged.withColumn(name, weight).drop("_x", "_z", "_u")


def _replicates(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Every row once for each replicate that draws it, and as replicate -1 the rows themselves; aggregated before any shuffle."""
    drawn = df.select("*", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("_b"))
    return with_poisson_weight(drawn, key, "_b", "_w", seed).withColumn("_w", F.when(F.col("_b") < 0, 1).otherwise(F.col("_w"))).where("_w > 0")


def _band(per: DataFrame, metric: str, replicates: int, level: float) -> DataFrame:
    """One row: the metric of the rows and its order statistics over the replicates."""
    low, high = math.floor((1 - level) / 2 * replicates + 1e-9), math.ceil((1 + level) / 2 * replicates - 1e-9) - 1
    drawn = F.array_sort(F.collect_list(F.when(F.col("_b") >= 0, F.col(metric))))
    at = lambda k: F.get("_d", F.least(F.lit(k), F.size("_d") - 1))
    whole = per.agg(F.max(F.when(F.col("_b") < 0, F.col(metric))).alias(metric), drawn.alias("_d"))
    return whole.select(F.round(metric, 6).alias(metric), F.round(at(low), 6).alias("lower"), F.round(at(high), 6).alias("upper"))


def calibration_quality(ece: Column) -> Column:
    out = F.lit("poor")
    for most, name in reversed(QUALITY):
        out = F.when(ece < most, name).otherwise(out)
    return out


def recommendation(quality: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv]), quality)


def ece_band(df: DataFrame, key: str, score: str, label: str, bins: int = 10, replicates: int = 100, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row ``ece, lower, upper, quality, recommendation``: the expected calibration error with its bootstrap band.

    Each replicate draws a row as often as ``with_poisson_weight`` says, so all are counted in one scan, by bin and replicate, before
    the shuffle. Rows with a null score or label are left out; no rows give nulls.
    """
    rows = df.select(F.col(key), F.col(score).cast("double").alias("_p"), F.col(label).cast("double").alias("_y")).where("_p is not null and _y is not null")
    binned = _replicates(rows, key, replicates, seed).withColumn("_bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    each = binned.groupBy("_b", "_bin").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_p")).alias("p"), F.sum(F.col("_w") * F.col("_y")).alias("y"))
    per = each.groupBy("_b").agg((F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
    quality = F.when(F.col("ece").isNotNull(), calibration_quality(F.col("ece")))
    return _band(per, "ece", replicates, level).withColumn("quality", quality).withColumn("recommendation", recommendation(F.col("quality")))


def mean_band(df: DataFrame, key: str, value: str, replicates: int = 100, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row ``mean, lower, upper, std_dev, uncertainty``: a mean (such as coverage, of 0 and 1) with its bootstrap band; its width below 0.1 is low, below 0.25 medium, else high uncertainty."""
    rows = df.select(F.col(key), F.col(value).cast("double").alias("_v")).where("_v is not null")
    per = _replicates(rows, key, replicates, seed).groupBy("_b").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))
    spread = per.agg(F.round(F.stddev_pop(F.when(F.col("_b") >= 0, F.col("mean"))), 6).alias("std_dev"))
    width = F.col("upper") - F.col("lower")
    return _band(per, "mean", replicates, level).join(F.broadcast(spread)).withColumn("uncertainty", F.when(width < 0.1, "low").when(width < 0.25, "medium").when(width.isNotNull(), "high"))


def dominant_share(answers: DataFrame, key: str, cluster: str) -> DataFrame:
    """``key, n, n_clusters, dominant_share``: how large a part of a key's answers its commonest meaning has."""
    sizes = answers.where(F.col(cluster).isNotNull()).groupBy(key, cluster).agg(F.count("*").alias("n"))
    return sizes.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("n_clusters"), F.round(F.max("n") / F.sum("n"), 6).alias("dominant_share"))


def evidence_match(confidence: Column, evidence: Column) -> Column:
    """``overconfident``, ``underconfident`` or ``appropriate``: stated confidence against the range that the evidence's strength supports."""
    low = F.when(evidence > 0.8, 0.7).when(evidence > 0.5, 0.4).otherwise(0.0)
    high = F.when(evidence > 0.8, 1.0).when(evidence > 0.5, 0.8).otherwise(0.5)
    return F.when(confidence > high, "overconfident").when(confidence < low, "underconfident").when(confidence.isNotNull() & evidence.isNotNull(), "appropriate")
