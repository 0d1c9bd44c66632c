"""Coverage of prediction intervals over count windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, key: str, order: list, covered: Column, window: int = 100, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """``df`` with ``seq``, the coverage of the last ``window`` outcomes and of all so far, the gap to the target, and whether it has degraded (from half a window on)."""
    by = Window.partitionBy(key).orderBy(*order)
    c = covered.cast("double")
    last = by.rowsBetween(-(window - 1), 0)
    out = df.withColumn("seq", F.row_number().over(by)).withColumn("rolling_coverage", F.avg(c).over(last)).withColumn("overall_coverage", F.avg(c).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.least(F.col("seq"), F.lit(window))
    return out.withColumn("coverage_gap", F.lit(target) - F.col("rolling_coverage")).withColumn("degraded", (seen >= window // 2) & (F.col("rolling_coverage") < target - tolerance))


def tumbling(df: DataFrame, key: str, order: list, covered: Column, window: int = 100, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Snapshots of ``window`` outcomes each: ``key, window_id, first_seq, last_seq, n, coverage, degraded``."""
    numbered = df.select(key, covered.cast("double").alias("c"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("seq"))
    per = numbered.groupBy(key, F.floor((F.col("seq") - 1) / window).alias("window_id"))
    return per.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("coverage")).withColumn("degraded", (F.col("n") >= window // 2) & (F.col("coverage") < target - tolerance))


def gap_severity(gap: Column, n: Column, window: int, tolerance: float = 0.05) -> Column:
    return F.when(n < window // 2, "none").when(gap <= 0, "none").when(gap < tolerance, "low").when(gap < 2 * tolerance, "medium").when(gap < 3 * tolerance, "high").otherwise("critical")


def drift(df: DataFrame, key: str, order: list, covered: Column, window: int = 100, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Coverage drift of each key over its most recent window: ``key, n, coverage, gap, severity, significant``."""
    newest = [o.desc() if isinstance(o, Column) else F.col(o).desc() for o in order]
    recent = df.select(key, covered.cast("double").alias("c"), F.row_number().over(Window.partitionBy(key).orderBy(*newest)).alias("rn")).where(F.col("rn") <= window)
    per = recent.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("coverage"))
    gap = F.round(F.lit(target) - F.col("coverage"), 6)
    level = gap_severity(F.col("gap"), F.col("n"), window, tolerance)
    return per.withColumn("gap", gap).withColumn("severity", level).withColumn("significant", F.col("severity").isin("medium", "high", "critical"))


def calibration_stats(predictions: DataFrame, outcomes: DataFrame, key: str, target: float = 0.9) -> DataFrame:
    """``key, n_predictions, n_outcomes, coverage, mean_width, alert`` of interval predictions joined with their outcomes by ``prediction_id``; unknown outcomes are ignored, no outcomes give coverage 1 and width 0."""
    met = predictions.join(outcomes.select("prediction_id", "outcome"), "prediction_id", "left")
    inside = F.when(F.col("outcome").isNotNull(), F.col("outcome").between(F.col("lower"), F.col("upper")).cast("double"))
    width = F.when(F.col("outcome").isNotNull(), F.col("upper") - F.col("lower"))
    per = met.groupBy(key).agg(F.count("*").alias("n_predictions"), F.count("outcome").alias("n_outcomes"), F.round(F.coalesce(F.avg(inside), F.lit(1.0)), 6).alias("coverage"), F.round(F.coalesce(F.avg(width), F.lit(0.0)), 6).alias("mean_width"))
    gap = F.lit(target) - F.col("coverage")
    return per.withColumn("alert", F.when(gap > 0.1, "critical").when(gap > 0.05, "warning").otherwise("none"))


def coverage_alerts(stats: DataFrame, window: int = 100, target: float = 0.9, cut: float = 0.05) -> DataFrame:
    """Alerts of keys in ``calibration_stats`` whose coverage has dropped: ``key.., severity, message, recommendation``; none before half a window of outcomes."""
    gap = F.lit(target) - F.col("coverage")
    hit = stats.where((F.col("n_outcomes") >= window // 2) & (gap > cut))
    worse = gap > 2 * cut
    message = F.format_string(f"Coverage dropped to %.1f%% (target: {target * 100:.1f}%%)", F.col("coverage") * 100)
    return hit.withColumns({"severity": F.when(worse, "critical").otherwise("warning"), "message": message, "recommendation": F.when(worse, "URGENT: Recalibrate model immediately").otherwise("Consider recalibration within 1 week")})


def newest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The n most recent rows."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)
