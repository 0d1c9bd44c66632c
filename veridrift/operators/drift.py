"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPSILON = 1e-4
#: Value ranges within which cumulative counts are taken side by side.
_RANGES = 1024


def psi(df: DataFrame, feature: str, value: str, is_current: Column, bins: int = 10) -> DataFrame:
    """``feature, psi``: population stability index over equal bins of the combined range; 0 if a side is empty or all values are equal."""
    rows = df.where(F.col(value).isNotNull()).select(feature, F.col(value).cast("double").alias("v"), is_current.alias("cur"))
    span = rows.groupBy(feature).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if("cur").alias("n_cur"), F.count_if(~F.col("cur")).alias("n_ref"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)).cast("int"), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(span, feature).groupBy(feature, place.alias("bin")).agg(F.count_if("cur").alias("c"), F.count_if(~F.col("cur")).alias("r"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = grid.join(counts, [feature, "bin"], "left").fillna(0, ["c", "r"])
    pc = (F.col("c") + _EPSILON) / (F.col("n_cur") + _EPSILON * bins)
    pr = (F.col("r") + _EPSILON) / (F.col("n_ref") + _EPSILON * bins)
    flat = (F.col("hi") == F.col("lo")) | (F.col("n_cur") == 0) | (F.col("n_ref") == 0)
    return both.groupBy(feature).agg(F.sum(F.when(flat, 0.0).otherwise((pc - pr) * F.log(pc / pr))).alias("psi"))


def ks(df: DataFrame, feature: str, value: str, is_current: Column) -> DataFrame:
    """``feature, ks, p_value, n_ref, n_cur``: the Kolmogorov-Smirnov statistic; 0 and 1 if a side is empty.

    Rows are counted by distinct value first. Running counts are taken within value ranges, and
    ranges add up over at most ``_RANGES`` rows of a feature, so no task sorts all its values.
    """
    rows = df.where(F.col(value).isNotNull()).select(feature, F.col(value).cast("double").alias("v"), is_current.alias("cur"))
    span = rows.groupBy(feature).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if("cur").alias("n_cur"), F.count_if(~F.col("cur")).alias("n_ref"))
    counted = rows.groupBy(feature, "v").agg(F.count_if("cur").alias("c"), F.count_if(~F.col("cur")).alias("r")).join(span, feature)
    part = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * _RANGES), F.lit(_RANGES - 1)), F.lit(0)).cast("int")
    counted = counted.withColumn("part", part)
    before = Window.partitionBy(feature).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy(feature, "part").agg(F.sum("c").alias("pc"), F.sum("r").alias("pr"))
    offsets = parts.select(feature, "part", F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy(feature, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.join(offsets, [feature, "part"]).select(feature, "n_cur", "n_ref", (F.col("c0") + F.sum("c").over(inside)).alias("cc"), (F.col("r0") + F.sum("r").over(inside)).alias("cr"))
    gap = F.abs(F.try_divide(F.col("cc"), F.col("n_cur")) - F.try_divide(F.col("cr"), F.col("n_ref")))
    top = running.groupBy(feature, "n_ref", "n_cur").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))
    en = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    lam = (en + 0.12 + F.try_divide(F.lit(0.11), en)) * F.col("ks")
    p = F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.exp(-2 * lam * lam))))
    return top.select(feature, "ks", p.alias("p_value"), "n_ref", "n_cur")


def severity(psi_value: Column) -> Column:
    return F.when(psi_value >= 0.5, "critical").when(psi_value >= 0.3, "high").when(psi_value >= 0.2, "medium").otherwise("low")


def feature_severity(psi_value: Column) -> Column:
    """Severity of a single feature's check, which has a low band of its own from 0.1."""
    return F.when(psi_value >= 0.2, severity(psi_value)).when(psi_value >= 0.1, "low").otherwise("none")


def drift_report(df: DataFrame, feature: str, value: str, is_current: Column, psi_cut: float = 0.2, ks_cut: float = 0.1) -> DataFrame:
    """``feature, psi, ks, drifted, severity`` of each feature; severity is ``none`` where nothing drifted."""
    both = psi(df, feature, value, is_current).join(ks(df, feature, value, is_current), feature)
    drifted = (F.col("psi") >= psi_cut) | (F.col("ks") >= ks_cut)
    return both.select(feature, F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), drifted.alias("drifted"), F.when(drifted, severity(F.col("psi"))).otherwise("none").alias("severity"))


def feature_stats(df: DataFrame, feature: str, value: str) -> DataFrame:
    """``feature, n, mean, std, min, max``; the sample deviation, 0 for a single value."""
    v = F.col(value)
    return df.groupBy(feature).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def alert_text(feature: Column, level: Column) -> Column:
    return F.when(level != "none", F.concat(F.upper(level), F.lit(" drift in "), feature))
