"""Conformal prediction, calibration by bins, and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, stored

#: Buckets of one pass of a distributed selection, and rows that are few enough to sort.
_BUCKETS, _FEW = 1024, 4096


def rank_for(q: float, n: int) -> int:
    """The 1-based rank of the conformal quantile: ceil(min(1, q (1 + 1/n)) n), within 1 to n."""
    return max(1, min(math.ceil(min(1.0, q * (1 + 1 / n)) * n), n))


def kth_smallest(df: DataFrame, value: str, k: int) -> float:
    """The k-th smallest value (from 1), by histogram passes that narrow the range until few distinct values are left.

    No pass sorts or gathers the rows: each aggregates at most ``_BUCKETS`` counts.
    """
    left = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    low, high = left.agg(F.min("v"), F.max("v")).first()
    while True:
        if low == high:
            return low
        width = (high - low) / _BUCKETS
        few = left.where(F.col("v").between(low, high))
        distinct = few.groupBy("v").agg(F.count("*").alias("n"))
        rows = distinct.orderBy("v").limit(_FEW + 1).collect()
        if len(rows) <= _FEW or not width:
            for row in rows:
                if k <= row.n:
                    return row.v
                k -= row.n
            return high
        bucket = F.least(F.floor((F.col("v") - low) / width), F.lit(_BUCKETS - 1))
        counts = few.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for row in sorted(counts, key=lambda r: r.b):
            if k <= row.n:
                low, high = row.low, row.high
                break
            k -= row.n


def conformal_threshold(df: DataFrame, score: str, target: float = 0.9) -> DataFrame:
    """One row: ``threshold, n, coverage, min_score, max_score, mean_score`` of nonconformity scores. Empty input: an error."""
    n, low, high, mean = df.agg(F.count(score), F.min(score), F.max(score), F.avg(score)).first()
    if not n:
        raise ValueError("no scores to calibrate on")
    threshold = kth_smallest(df, score, rank_for(target, n))
    covered = df.agg(F.avg((F.col(score) <= threshold).cast("double")).alias("coverage"))
    return covered.select(F.lit(float(threshold)).alias("threshold"), F.lit(n).cast("long").alias("n"), "coverage", F.lit(float(low)).alias("min_score"), F.lit(float(high)).alias("max_score"), F.lit(float(mean)).alias("mean_score"))


#: Buckets of one pass over all groups, distinct values of a group that are few enough to gather, and groups whose ranges are broadcast.
_GROUP_BUCKETS, _GROUP_FEW, _MANY_GROUPS = 512, 1024, 50_000


def _picked(column: str, place: Column) -> Column:
    """Of entries in order, with ``n`` rows each: the one that holds the row ``place`` (from 1), and how many rows are before it."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("i"), none.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["hit"].isNull() & (acc["before"] + x["n"] >= place)
        return F.struct(F.when(acc["hit"].isNull() & ~here, acc["before"] + x["n"]).otherwise(acc["before"]).alias("before"), (acc["i"] + 1).alias("i"), F.when(here, acc["i"]).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(F.col(column), start, step)


def grouped_kth(df: DataFrame, group: str, value: str, rank: Column) -> DataFrame:
    """``group, n, value``: in each group the value of a rank (from 1, an expression over ``n``), for all groups at once.

    Equal values of a group are counted first. Each pass counts the values in every group's
    buckets and narrows the group's range to the bucket that holds its rank, until it has few distinct values left,
    which are gathered. No group is sorted or held by a task, and the driver sees one number a pass. Null values are left out;
    a null group is a group.
    """
    values = stored(df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    state = values.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
    state, kept = stored(state.withColumn("k", rank.cast("long")).withColumn("all", F.col("n"))), [values]
    while True:
        kept.append(state)
        n_groups, most = state.agg(F.count("*"), F.max(F.when(F.col("low") < F.col("high"), F.col("left")))).first()
        within = F.col("v").between(F.col("low"), F.col("high")) & F.col("g").eqNullSafe(F.col("_g"))
        ranges = state.withColumnRenamed("g", "_g")
        ranges = F.broadcast(ranges) if n_groups <= _MANY_GROUPS else ranges
        if most is None or most <= _GROUP_FEW:
            break
        met = values.join(ranges, within)
        width = (F.col("high") - F.col("low")) / _GROUP_BUCKETS
        bucket = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(_GROUP_BUCKETS - 1))).otherwise(0)
        counts = met.groupBy("g", "k", "all", bucket.alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
        entries = counts.groupBy("g", "k", "all").agg(F.array_sort(F.collect_list(F.struct("b", "n", "left", "low", "high"))).alias("e"))
        picked = entries.withColumn("p", _picked("e", F.col("k"))).withColumn("x", F.element_at("e", F.col("p.hit") + 1))
        state = stored(picked.select("g", F.col("x.n").alias("n"), F.col("x.left").alias("left"), F.col("x.low").alias("low"), F.col("x.high").alias("high"), (F.col("k") - F.col("p.before")).alias("k"), "all"))
    last = values.join(ranges, within).groupBy("g", "k", "all").agg(F.array_sort(F.collect_list(F.struct("v", F.col("c").alias("n")))).alias("e"))
    out = stored(last.select(F.col("g").alias(group), F.col("all").alias("n"), F.element_at("e", _picked("e", F.col("k"))["hit"] + 1)["v"].alias(value)))
    discard(*kept)
    return out


def grouped_threshold(df: DataFrame, group: str, score: str, target: float = 0.9) -> DataFrame:
    """``group, n, threshold``: the conformal quantile within each group."""
    n = F.col("n")
    rank = F.greatest(F.lit(1), F.least(F.ceil(F.least(F.lit(1.0), F.lit(target) * (1 + 1 / n)) * n), n))
    return grouped_kth(df, group, score, rank).withColumnRenamed(score, "threshold")


def softmax(values: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def true_class_score(probabilities: Column, label: Column) -> Column:
    """1 minus the probability of the true class (0-based); 1 if it has none."""
    return 1 - F.coalesce(F.try_element_at(probabilities, label.cast("int") + 1), F.lit(0.0))


def ranked_classes(probabilities: Column) -> Column:
    """``struct(p, label)`` of all classes, most probable first, ties in class order."""
    entries = F.transform(probabilities, lambda p, i: F.struct((-p).alias("np"), i.alias("label")))
    return F.transform(F.array_sort(entries), lambda e: F.struct((-e["np"]).alias("p"), e["label"].alias("label")))


def prediction_set(probabilities: Column, threshold: Column) -> Column:
    """Classes whose score 1 - p is within the threshold, most probable first."""
    return F.transform(F.filter(ranked_classes(probabilities), lambda e: 1 - e["p"] <= threshold), lambda e: e["label"])


def mass_before(probabilities: Column, label: Column) -> Column:
    """Probability ranked before the true class; all of it if there is no such class."""
    ranked = ranked_classes(probabilities)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("met"))
    return F.aggregate(ranked, state, lambda a, e: F.struct(F.when(a["met"] | (e["label"] == label), a["sum"]).otherwise(a["sum"] + e["p"]).alias("sum"), (a["met"] | (e["label"] == label)).alias("met")), lambda a: a["sum"])


def adaptive_set(probabilities: Column, threshold: Column, penalty: float = 0.0) -> Column:
    """Classes in order of probability until their mass, less ``penalty`` for each taken, reaches the threshold."""
    ranked = ranked_classes(probabilities)
    state = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("taken"), F.lit(False).alias("done"))

    def step(a: Column, e: Column) -> Column:
        total = F.when(a["done"], a["sum"]).otherwise(a["sum"] + e["p"])
        taken = F.when(a["done"], a["taken"]).otherwise(F.array_append(a["taken"], e["label"]))
        return F.struct(total.alias("sum"), taken.alias("taken"), (a["done"] | (total - F.size(taken) * penalty >= threshold)).alias("done"))

    return F.aggregate(ranked, state, step, lambda a: a["taken"])


def interval_score(lower: Column, upper: Column, actual: Column) -> Column:
    return F.greatest(lower - actual, actual - upper)


def conformal_interval(lower: Column, upper: Column, threshold: Column) -> Column:
    """The interval widened by the threshold, narrowed if that is negative."""
    return F.struct((lower - threshold).alias("lower"), (upper + threshold).alias("upper"))


# Bands of risk scores.
LEVEL_BANDS = [("BRIEF", 0.0, 0.2), ("STANDARD", 0.2, 0.5), ("DETAILED", 0.5, 0.8), ("CRITICAL", 0.8, 1.01)]


def clamped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def score_level(score: Column) -> Column:
    out = F.lit(LEVEL_BANDS[-1][0])
    for name, low, high in reversed(LEVEL_BANDS[:-1]):
        out = F.when((score >= low) & (score < high), name).otherwise(out)
    return out


def level_set(score: Column, threshold: Column) -> Column:
    """Every band that the open interval of ``threshold`` around the clamped score meets, and the score's own."""
    s = clamped(score)
    low, high = F.greatest(F.lit(0.0), s - threshold), F.least(F.lit(1.0), s + threshold)
    return F.array_compact(F.array(*[F.when(((low < b) & (high > a)) | (score_level(s) == name), name) for name, a, b in LEVEL_BANDS]))


def level_confidence(score: Column, threshold: Column) -> Column:
    s = clamped(score)
    return F.round(clamped(1 - F.abs(s - F.bround(s)) / F.greatest(threshold, F.lit(1e-9))), 6)


def fit_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """``bin, low, high, n, value``: mean label of each equal-width bin by its edges, the last closed; empty bins take their middle."""
    s, width = F.col(score).cast("double"), 1.0 / bins
    place = F.lit(0)
    for i in range(1, bins):
        place = F.when(s >= i * width, i).otherwise(place)
    edges = df.sparkSession.createDataFrame([(i, i * width, (i + 1) * width) for i in range(bins)], "bin int, low double, high double")
    counted = df.where(s.between(0.0, 1.0)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("mean"))
    return edges.join(F.broadcast(counted), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", (F.col("low") + F.col("high")) / 2), 10).alias("value"))


def apply_bins(df: DataFrame, fitted: DataFrame, score: str, least: int = 1, bins: int = 10) -> DataFrame:
    """``df`` with ``calibrated``: the value of the bin that floor(score * bins) names, or the clamped score where it had fewer than ``least`` rows."""
    s = clamped(F.col(score))
    keyed = df.withColumn("_bin", F.least((s * bins).cast("int"), F.lit(bins - 1)))
    table = F.broadcast(fitted.select(F.col("bin").alias("_bin"), F.col("n").alias("_n"), F.col("value").alias("_value")))
    return keyed.join(table, "_bin", "left").withColumn("calibrated", F.when(F.coalesce("_n", F.lit(0)) >= least, F.col("_value")).otherwise(s)).drop("_bin", "_n", "_value")


def _binned(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    s = clamped(F.col(score).cast("double"))
    return df.groupBy(F.least(F.floor(s * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))


def expected_calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row ``ece``; 0 for no rows."""
    per = _binned(df, score, label, bins)
    return per.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))), F.sum("n")), F.lit(0.0)), 6).alias("ece"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``brier``; 0 for no rows."""
    return df.agg(F.round(F.coalesce(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))), F.lit(0.0)), 6).alias("brier"))


def reliability_curve(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """``bin, mean_predicted, mean_observed, n`` for every bin; empty bins lie on the diagonal."""
    middle = (F.col("bin") + 0.5) / bins
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(_binned(df, score, label, bins)), "bin", "left").select("bin", F.round(F.coalesce("p", middle), 6).alias("mean_predicted"), F.round(F.coalesce("y", middle), 6).alias("mean_observed"), F.coalesce("n", F.lit(0)).alias("n"))


def coverage_rate(df: DataFrame, sets: str, label: str) -> DataFrame:
    """One row ``coverage, mean_size, n``; 0 for no rows."""
    return df.agg(F.coalesce(F.avg(F.array_contains(sets, F.col(label)).cast("double")), F.lit(0.0)).alias("coverage"), F.coalesce(F.avg(F.size(sets).cast("double")), F.lit(0.0)).alias("mean_size"), F.count("*").alias("n"))
