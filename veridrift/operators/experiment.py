"""Point estimates against conformal sets on the same cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import entropy_band
from ..functions.text import let
from .calibration import adaptive_set, conformal_threshold, mass_before, ranked_classes
from .entropy import verdict_cluster

# Risk classes in the order in which ties are broken.
CLASSES = ["low", "medium", "high", "critical"]


def case_status(available: Column, expected: Column) -> Column:
    """Status of a case against the record; without a record nothing is found."""
    return F.when(~available, "not_found").when(expected.isin("verified", "contradiction", "not_found"), expected).otherwise("not_checkable")


def point_risk(status: Column, entropy_level: Column) -> Column:
    contradicted = F.when(entropy_level == "low", "critical").when(entropy_level == "medium", "high").otherwise("medium")
    missing = F.when(entropy_level == "high", "high").otherwise("medium")
    return F.when(status == "verified", "low").when(status == "contradiction", contradicted).when(status == "not_found", missing).otherwise(entropy_level)


def point_review(risk: Column, status: Column) -> Column:
    """Every contradiction is reviewed, whatever its risk."""
    return (status == "contradiction") | risk.isin("high", "critical")


def response_entropy(responses: Column) -> Column:
    """Entropy of an array of responses over verdict keywords, natural, over the log of the clusters but 1 at least, four digits."""
    def over(labels: Column) -> Column:
        n, k = F.size(labels).cast("double"), F.size(F.array_distinct(labels)).cast("double")
        counts = F.transform(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x)))
        raw = F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log(c / n + 1e-10))
        return F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), raw) / F.greatest(F.log(k), F.lit(1.0)), 4))

    return let(F.transform(responses, lambda r: verdict_cluster(r)), over)


def run(cases: DataFrame, calibrate: Column, target: float = 0.9) -> DataFrame:
    """Both assessments of each case that is not used to calibrate.

    ``cases``: case_id, available, expected_status, responses, probabilities (over ``CLASSES``),
    true_label. Adds ``status, entropy, entropy_level, point_risk, point_review, class_set,
    set_size, truth_in_set, top_class, set_review``.
    """
    names = F.array(*[F.lit(c) for c in CLASSES])
    staged = cases.withColumn("_truth", (F.array_position(names, F.col("true_label")) - 1).cast("int"))
    model = conformal_threshold(staged.where(calibrate).withColumn("_s", mass_before(F.col("probabilities"), F.col("_truth"))), "_s", target).select(F.col("threshold").alias("_threshold"))
    rows = staged.where(~calibrate).join(F.broadcast(model))  # one row
    rows = rows.withColumn("status", case_status(F.col("available"), F.col("expected_status"))).withColumn("entropy", response_entropy(F.col("responses")))
    rows = rows.withColumn("entropy_level", entropy_band(F.col("entropy")))
    rows = rows.withColumn("point_risk", point_risk(F.col("status"), F.col("entropy_level")))
    rows = rows.withColumn("point_review", point_review(F.col("point_risk"), F.col("status")))
    rows = rows.withColumn("_set", adaptive_set(F.col("probabilities"), F.col("_threshold")))
    rows = rows.withColumn("class_set", F.transform("_set", lambda i: F.element_at(names, i + 1))).withColumn("set_size", F.size("_set"))
    rows = rows.withColumn("truth_in_set", F.array_contains("class_set", F.col("true_label")))
    rows = rows.withColumn("top_class", F.element_at(names, F.element_at(ranked_classes(F.col("probabilities")), 1)["label"] + 1))
    review = (F.col("set_size") >= 3) | F.arrays_overlap("class_set", F.array(F.lit("high"), F.lit("critical")))
    return rows.withColumn("set_review", review).drop("_truth", "_threshold", "_set")


def summary(results: DataFrame) -> DataFrame:
    """One row: coverage, mean set size, reviews either way, and agreement of the two."""
    return results.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("truth_in_set").cast("double")), 6).alias("coverage"),
        F.round(F.avg("set_size"), 6).alias("mean_set_size"),
        F.count_if("point_review").alias("point_reviews"),
        F.count_if("set_review").alias("set_reviews"),
        F.count_if(F.col("point_risk") == F.col("top_class")).alias("agree"),
    )


def distributions(results: DataFrame) -> DataFrame:
    """``measure, value, n``: how many cases have each status, point risk, set size and review, counted before the shuffle."""
    measures = {"status": F.col("status"), "point_risk": F.col("point_risk"), "set_size": F.col("set_size").cast("string"), "point_review": F.col("point_review").cast("string"), "set_review": F.col("set_review").cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in measures.items()]))
    return results.select(pairs.alias("m")).groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))
