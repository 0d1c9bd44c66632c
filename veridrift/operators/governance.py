"""Governance of responses: claims of a domain rolled up to a verdict, a review level and reasons to escalate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import DomainPack, is_narrow, reliability
from ..functions.risk import needs_entropy, rank
from ..functions.scan import Scanner
from ..sources.shared import spread


def domain_claims(df: DataFrame, key: str, text: str, pack: DomainPack) -> DataFrame:
    """``key, pos, claim_id, claim_type, claim_text, start, stop, context, risk``: all claims of a domain, each text read once by one of three tasks a core.

    Claims come in the order of the pack's rules and, within one, of their place; ids count them. ``start`` and ``stop`` are the match's
    place in the text (null for claims that are lines). Null texts have no claims.
    """
    rules, prefix = pack.rules, pack.prefix
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                owners, rows = [], []
                for i, value in enumerate(some.column("text").to_pylist()):
                    for pos, claim in enumerate(scanner.claims(value) if value else ()):
                        owners.append(i)
                        rows.append((pos, f"{prefix}_{pos:03d}_{claim[0]}", *claim))
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.record_batch([some.column("key").take(pa.array(owners, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["key", "pos", "claim_id", "claim_type", "claim_text", "start", "stop", "context"])

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key")
    found = rows.mapInArrow(run, f"key {kind}, pos int, claim_id string, claim_type string, claim_text string, start int, stop int, context string")
    return found.withColumnRenamed("key", key).withColumn("risk", pack.claim_risk(F.col("claim_type")))


def response_verdict(results: DataFrame, key: str, pack: DomainPack, entropy: str = "entropy") -> DataFrame:
    """A response's verdict from its claims (``passed, risk, warnings, flagged, entropy``).

    All claims must pass and none be flagged; confidence is the share that passes, risk the
    worst, critical if a claim is flagged. A response without claims is not in the input and
    counts as passed with low risk where it is joined back.
    """
    flagged = F.max(F.col("flagged").cast("int")) == 1
    per = results.groupBy(key).agg(
        F.count("*").alias("total_claims"),
        F.count_if("passed").alias("verified_claims"),
        F.max_by("risk", rank(F.col("risk"))).alias("_worst"),
        flagged.alias("flagged"),
        F.array_sort(F.flatten(F.collect_list("warnings"))).alias("warnings"),
        F.max(F.coalesce(entropy, F.lit(0.0))).alias("entropy"),
    )
    per = per.withColumn("risk", F.when(F.col("flagged"), "critical").otherwise(F.col("_worst"))).withColumn("confidence", F.col("verified_claims") / F.col("total_claims"))
    per = per.withColumn("passed", (F.col("verified_claims") == F.col("total_claims")) & ~F.col("flagged"))
    reasons = pack.escalation_reasons(F.col("risk"), F.col("confidence"), F.col("passed"), F.col("warnings"), F.col("flagged"))
    return per.drop("_worst").withColumn("review_level", pack.review_level(F.col("risk"), F.col("entropy"), F.col("flagged"))).withColumn("escalation", reasons)


def generative_summary(claims: DataFrame, key: str, threshold: float = 0.5, unverified_share: float = 0.3) -> DataFrame:
    """Source-first governance of generated text from ``status, entropy`` of its claims: counts, overall risk, mean entropy of what was checked, and checks saved."""
    s, h = F.col("status"), F.col("entropy")
    sure = (s == "contradicted") & (h < threshold)
    per = claims.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(s == "verified").alias("verified"),
        F.count_if(s == "contradicted").alias("contradicted"),
        F.count_if(~s.isin("verified", "contradicted")).alias("unverified"),
        F.count_if(sure).alias("confident_hallucinators"),
        F.round(F.avg(F.when(needs_entropy(s), h)), 6).alias("mean_entropy"),
        F.round(F.count_if(~needs_entropy(s)) / F.count("*"), 6).alias("compute_savings"),
    )
    risk = (
        F.when(F.col("confident_hallucinators") > 0, "critical")
        .when(F.col("contradicted") > 0, "high_risk")
        .when(F.col("unverified") > F.col("total") * unverified_share, "medium_risk")
        .when(F.col("unverified") > 0, "low_risk")
        .otherwise("safe")
    )
    return per.withColumn("risk", risk)


def predictive_summary(predictions: DataFrame, thresholds: tuple[float, float, float] = (0.3, 0.5, 0.8), most_missing: float = 0.2) -> DataFrame:
    """Reliability and action of interval predictions (``lower, upper, point, n_inputs, n_missing, n_invalid, drifted``); action goes by the upper bound."""
    elevated, urgent, critical = thresholds
    acceptable = (F.col("n_invalid") == 0) & (F.try_divide(F.col("n_missing").cast("double"), F.col("n_inputs")) <= most_missing)
    level = reliability(F.coalesce(acceptable, F.lit(False)), F.col("drifted"), F.col("n_missing"), is_narrow(F.col("lower"), F.col("upper"), F.col("point")))
    action = F.when(F.col("upper") >= critical, "critical").when(F.col("upper") >= urgent, "urgent").when(F.col("upper") >= elevated, "elevated").otherwise("routine")
    return predictions.withColumn("reliability", level).withColumn("action", F.when(level == "rejected", "routine").otherwise(action))


def capped_history(predictions: DataFrame, key: str, order: str, capacity: int = 10_000) -> DataFrame:
    """The newest ``capacity`` predictions of each key; the oldest leave first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return predictions.withColumn("_n", place).where(F.col("_n") <= capacity).drop("_n")


def escalated(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.size("escalation") > 0).withColumn("escalation_reason", F.array_join("escalation", "; "))
