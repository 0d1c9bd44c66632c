"""Roll-ups of claims to documents, notes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import CHECK_SECONDS, CONTRADICTION_SECONDS, ENTROPY_SECONDS, TIER_SECONDS, manual_seconds, needs_entropy, note_risk, rank, worst


def _share(part: Column, whole: Column, empty: float, digits: int | None = None) -> Column:
    out = F.coalesce(F.try_divide(part * 100.0, whole), F.lit(empty))
    return out if digits is None else F.round(out, digits)


def status_summary(claims: DataFrame, key: str, status: str = "status", empty_keys: DataFrame | None = None, empty_rate: float = 0.0) -> DataFrame:
    """Counts by status, verification rate and share of entropy checks saved, in percent. Keys of ``empty_keys`` without claims get ``empty_rate``."""
    s = F.col(status)
    per = claims.groupBy(key).agg(
        F.count("*").alias("total"),
        *[F.count_if(s == v).alias(v) for v in ("verified", "contradicted", "partial", "not_found")],
        F.count_if(needs_entropy(s)).alias("needs_entropy"),
    )
    if empty_keys is not None:
        per = empty_keys.select(key).distinct().join(per, key, "left").fillna(0)
    saved = F.when(F.col("total") == 0, empty_rate).otherwise((1 - F.try_divide(F.col("needs_entropy").cast("double"), F.col("total"))) * 100)
    return per.withColumn("verification_rate", _share(F.col("verified"), F.col("total"), empty_rate)).withColumn("compute_saved", saved)


def risk_rollup(claims: DataFrame, key: str, level: str = "risk") -> DataFrame:
    """``key, risk, n_claims, n_worst``: the worst level of a document and how many claims have it."""
    per = claims.groupBy(key, level).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(worst(F.col(level)).alias("risk"), F.sum("n").alias("n_claims"), F.max_by("n", rank(F.col(level))).alias("n_worst"))


def note_rollup(claims: DataFrame, key: str) -> DataFrame:
    """Risk of a note from its claims' ``status``, ``entropy`` and ``priority``."""
    s, h = F.col("status"), F.col("entropy")
    per = claims.groupBy(key).agg(
        F.count("*").alias("n_claims"),
        F.count_if((s == "contradicted") & (h < 0.3)).alias("confident_hallucinators"),
        F.count_if(s == "contradicted").alias("contradicted"),
        F.count_if(h >= 0.6).alias("high_entropy"),
        F.count_if(s == "not_found").alias("not_found"),
        F.count_if(F.col("priority") > 40).alias("high_priority"),
    )
    return per.withColumn("risk", note_risk(F.col("confident_hallucinators"), F.col("contradicted"), F.col("high_entropy"), F.col("not_found")))


def review_burden(results: DataFrame, tier: str = "review_tier", by: list[str] | None = None) -> DataFrame:
    """Tier counts, estimated seconds, and time saved against detailed review of everything, in percent."""
    t = F.col(tier)
    per = (results.groupBy(*by) if by else results.groupBy()).agg(F.count("*").alias("total_claims"), *[F.count_if(t == name).alias(f"{name}_review") for name in TIER_SECONDS])
    seconds = sum((F.col(f"{name}_review") * s for name, s in TIER_SECONDS.items()), F.lit(0))
    per = per.withColumn("estimated_review_seconds", seconds)
    full = F.col("total_claims") * TIER_SECONDS["detailed"]
    return per.withColumn("time_saved_percent", _share(full - F.col("estimated_review_seconds"), full, 0.0, 1)).withColumn("brief_percent", _share(F.col("brief_review"), F.col("total_claims"), 0.0, 1))


def time_saved(claims: DataFrame, claim_type: str, status: str, by: list[str] | None = None) -> DataFrame:
    """Seconds of manual verification by claim type against automated checks and reviews of contradictions; never below 0."""
    contradicted = F.count_if(F.col(status) == "contradiction")
    grouped = claims.groupBy(*by) if by else claims.groupBy()
    per = grouped.agg(F.sum(manual_seconds(F.col(claim_type))).alias("manual_seconds"), (F.count("*") * CHECK_SECONDS + contradicted * (ENTROPY_SECONDS + CONTRADICTION_SECONDS)).alias("automated_seconds"))
    return per.withColumn("saved_seconds", F.round(F.greatest(F.lit(0.0), F.col("manual_seconds") - F.col("automated_seconds")), 1))


def faithfulness_summary(results: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    from ..functions.text import faithfulness_level

    level = faithfulness_level(F.col(score))
    grouped = results.groupBy(*by) if by else results.groupBy()
    names = ["faithful", "partially_faithful", "likely_hallucinated", "hallucinated"]
    per = grouped.agg(F.count("*").alias("total"), *[F.count_if(level == n).alias(n) for n in names], F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.coalesce(F.min(score), F.lit(0.0)).alias("min_score"))
    return per.withColumn("needs_review", F.col("likely_hallucinated") + F.col("hallucinated"))


def review_queue(claims: DataFrame, priority: str, tie: str, top: int = 20) -> DataFrame:
    """The ``top`` claims by priority with their rank; only the best of each partition are compared."""
    best = claims.orderBy(F.desc(priority), tie).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(priority), tie)))


def note_queue(claims: DataFrame, note: str, priority: str, tie: str) -> DataFrame:
    """Claims with their rank within the note."""
    return claims.withColumn("rank", F.row_number().over(Window.partitionBy(note).orderBy(F.desc(priority), tie)))


def recommendations(claims: DataFrame, key: str) -> DataFrame:
    """Messages of a document, in order: critical claims, contradictions, unsupported claims, or that all is well."""
    critical = F.collect_list(F.when(F.col("risk") == "critical", F.col("claim_text")))
    per = claims.groupBy(key).agg(F.array_sort(critical).alias("_critical"), F.count_if(F.col("status") == "contradiction").alias("_no"), F.count_if(F.col("status") == "not_found").alias("_missing"))
    messages = F.array_compact(
        F.array(
            F.when(F.size("_critical") > 0, F.concat(F.lit("CRITICAL: verify "), F.array_join("_critical", "; "))),
            F.when(F.col("_no") > 0, F.format_string("%d claims contradict the record", "_no")),
            F.when(F.col("_missing") > 0, F.format_string("%d claims have no support", "_missing")),
        )
    )
    return per.select(key, F.when(F.size(messages) > 0, messages).otherwise(F.array(F.lit("Routine review is sufficient"))).alias("recommendations"))


# What is recommended, with the number of claims.
CRITICAL_CLAIMS = "🚨 CRITICAL: %d claim(s) are confident but contradict EHR. Verify with patient before signing."
HIGH_CLAIMS = "⚠️ HIGH RISK: %d claim(s) need careful review."
FABRICATED_CLAIMS = "🔍 HHEM ALERT: %d claim(s) not in EHR and not supported by transcript. Likely fabricated."
NEW_CLAIMS = "ℹ️ NEW INFO: %d claim(s) not in EHR but supported by transcript. EHR may need updating."
OPEN_CLAIMS = "ℹ️ UNRESOLVED: %d claim(s) not in EHR, partially supported by transcript. Review recommended."
ALL_WELL = "✅ All claims verified or low risk. Safe for routine review."


def document_recommendations(claims: DataFrame, key: str, order: str = "claim_id") -> DataFrame:
    """``key, overall_risk, recommendations`` from ``claim_text, status, risk, faithfulness, faithfulness_score`` of a document's claims.

    Messages come in the order of urgency; critical and fabricated claims are listed below theirs, in ``order``. A document whose
    worst risk is low (or minimal) is safe. Texts of claims with neither are not gathered.
    """
    missing, level = F.col("status") == "not_found", F.col("faithfulness")
    fabricated, backed = missing & level.isin("likely_hallucinated", "hallucinated"), missing & (level == "faithful")
    listed = lambda condition, text: F.array_sort(F.collect_list(F.when(condition, F.struct(F.col(order).alias("o"), text.alias("t")))))
    shown = F.concat(F.lit("   • "), "claim_text")
    per = claims.groupBy(key).agg(
        worst(F.col("risk")).alias("overall_risk"),
        listed(F.col("risk") == "critical", shown).alias("_critical"),
        F.count_if(F.col("risk") == "high").alias("_high"),
        listed(fabricated, F.concat(shown, F.format_string(" (HHEM=%.2f)", "faithfulness_score"))).alias("_made"),
        F.count_if(backed).alias("_new"),
        F.count_if(missing & ~F.coalesce(fabricated, F.lit(False)) & ~F.coalesce(backed, F.lit(False))).alias("_open"),
    )
    none = F.array().cast("array<string>")
    say = lambda n, text, more=none: F.when(n > 0, F.concat(F.array(F.format_string(text, n)), more)).otherwise(none)
    texts = lambda c: F.transform(c, lambda x: x["t"])
    messages = F.concat(
        say(F.size("_critical"), CRITICAL_CLAIMS, texts("_critical")),
        say(F.col("_high"), HIGH_CLAIMS),
        say(F.size("_made"), FABRICATED_CLAIMS, texts("_made")),
        say(F.col("_new"), NEW_CLAIMS),
        say(F.col("_open"), OPEN_CLAIMS),
        F.when(F.col("overall_risk").isin("minimal", "low"), F.array(F.lit(ALL_WELL))).otherwise(none),
    )
    return per.select(key, "overall_risk", messages.alias("recommendations"))


def claim_summary(claims: DataFrame, key: str) -> DataFrame:
    """``key, total_claims, by_type`` (a map), ``high, medium, low, high_risk_claims`` (ids, sorted) of a note's claims."""
    kinds = claims.groupBy(key, "claim_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")], F.collect_list(F.when(F.col("risk") == "high", F.col("claim_id"))).alias("ids"))
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("claim_type").isNotNull(), F.struct("claim_type", "n")))))
    return kinds.groupBy(key).agg(F.sum("n").alias("total_claims"), by_type.alias("by_type"), *[F.sum(r).alias(r) for r in ("high", "medium", "low")], F.array_sort(F.flatten(F.collect_list("ids"))).alias("high_risk_claims"))
