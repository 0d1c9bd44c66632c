"""Decision tables: claim risk, review level, priority, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

# Ordered levels, least first.
RISK_ORDER = ["minimal", "low", "medium", "high", "critical"]
# Drugs that raise a predicted risk.
HIGH_RISK_DRUGS = ["digoxin", "warfarin", "insulin", "morphine", "heparin", "chemotherapy", "blood transfusion", "anaphylaxis"]
# Seconds of manual verification by claim type, and of automated checks and reviews.
MANUAL_SECONDS = {"medication": 45, "allergy": 30, "diagnosis": 60, "procedure": 90, "vital_sign": 20, "lab_result": 40, "demographic": 15, "symptom": 25, "measurement": 30, "plan": 45, "history": 50, "other": 35}
CHECK_SECONDS, ENTROPY_SECONDS, CONTRADICTION_SECONDS = 0.5, 3.0, 60.0
TIER_SECONDS = {"brief": 20, "standard": 90, "detailed": 240}


def rank(level: Column) -> Column:
    """Place of a level in ``RISK_ORDER``, from 1; 0 if unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in RISK_ORDER]), F.lower(level)).cast("int"), F.lit(0))


def worst(level: Column, empty: str = "minimal") -> Column:
    """Aggregate: the highest level of a group."""
    return F.coalesce(F.max_by(level, rank(level)), F.lit(empty))


def entropy_band(h: Column, low: float = 0.3, high: float = 0.6) -> Column:
    return F.when(h < low, "low").when(h < high, "medium").otherwise("high")


def first_pass_risk(status: Column, faithfulness: Column, entropy_level: Column) -> Column:
    """Risk of a claim checked against records first, then the source, then by entropy."""
    not_found = F.when(faithfulness == "faithful", "low").when(faithfulness.isin("likely_hallucinated", "hallucinated"), "high").otherwise("medium")
    contradicted = F.when(entropy_level == "high", "medium").when(entropy_level == "medium", "high").when(faithfulness == "faithful", "high").otherwise("critical")
    return F.when(status.isin("verified", "not_checkable"), "low").when(status == "not_found", not_found).when(status == "contradiction", contradicted).otherwise("medium")


def review_priority(risk: Column) -> Column:
    return F.when(risk == "critical", "urgent").when(risk == "high", "elevated").otherwise("routine")


def priority_score(status: Column, entropy: Column, confidence: Column, tier: Column, claim_risk: Column, flags: Column) -> Column:
    """Additive score for the review queue; a null entropy adds nothing."""
    by_status = F.when(status == "contradicted", 50 + F.when(entropy < 0.3, 100).when(entropy > 0.7, 20).otherwise(0)).when(status == "not_found", 30).when(status == "partial", 10).otherwise(0)
    by_entropy = F.when(status != "contradicted", F.coalesce(entropy * 15, F.lit(0.0))).otherwise(0.0)
    by_tier = F.when(tier == "detailed", 15).when(tier == "standard", 5).otherwise(0)
    total = by_status + by_entropy + (1 - confidence) * 20 + by_tier + F.when(claim_risk == "high", 10).otherwise(0) + flags * 3
    return F.round(F.round(total, 6), 2)  # what only sums of doubles have put below a half counts as a half


def confident_hallucinator(entropy: Column, verified: Column, contradicted: Column, threshold: float = 0.3) -> Column:
    """``struct(detected, risk)`` from confidence (low entropy) against what the record says."""
    sure = entropy < threshold
    risk = (
        F.when(sure & contradicted, "critical")
        .when(sure & verified, "low")
        .when(sure, "medium")
        .when(contradicted, "high")
        .when(verified, "medium")
        .otherwise("high")
    )
    return F.struct((sure & contradicted).alias("detected"), risk.alias("risk"))


def review_level(risk: Column, entropy: Column, cut: float = 0.5) -> Column:
    return F.when(risk.isin("critical", "high"), "detailed").when((risk == "medium") & (entropy > cut), "standard").otherwise("brief")


def note_risk(confident_contradictions: Column, contradictions: Column, high_entropy: Column, not_found: Column) -> Column:
    """Risk of a note from counts over its claims."""
    return F.when(confident_contradictions > 0, "critical").when((contradictions > 0) | (high_entropy >= 2), "high").when((high_entropy > 0) | (not_found >= 3), "medium").otherwise("low")


def supplied_or_half(entropy: Column) -> Column:
    """An entropy of 0 or null counts as 0.5."""
    return F.coalesce(F.nullif(entropy, F.lit(0.0)), F.lit(0.5))


def predicted_risk(status: Column, faithfulness: Column, entropy: Column, claim: Column) -> Column:
    """``struct(risk_score, review_level, confidence)`` of the rule-based risk predictor."""
    s = F.lower(status)
    faithful, unsure = F.coalesce(faithfulness >= 0.5, F.lit(False)), F.coalesce(entropy >= 0.6, F.lit(False))
    score = (
        F.when(s == "verified", 0.05)
        .when(s == "not_checkable", 0.10)
        .when(s == "not_found", F.when(faithful, 0.15).otherwise(0.85))
        .when(s == "contradiction", F.when(unsure, 0.50).when(faithful, 0.80).otherwise(0.95))
        .otherwise(0.5)
    )
    level = (
        F.when(s.isin("verified", "not_checkable"), "BRIEF")
        .when(s == "not_found", F.when(faithful, "STANDARD").otherwise("DETAILED"))
        .when(s == "contradiction", F.when(unsure, "STANDARD").when(faithful, "DETAILED").otherwise("CRITICAL"))
        .otherwise("STANDARD")
    )
    bumped = F.when(any_of(F.lower(claim), HIGH_RISK_DRUGS), F.least(F.lit(1.0), score + 0.05)).otherwise(score)
    return F.struct(F.round(bumped, 4).alias("risk_score"), level.alias("review_level"), F.lit(0.95).alias("confidence"))


def diagnostic_risk(concerns: Column, drifted: Column, set_size: Column) -> Column:
    return F.when(concerns >= 3, "invalid").when(drifted | (set_size > 5), "uncertain").when(concerns > 0, "high").when(set_size > 2, "moderate").otherwise("low")


def action_level(score: Column, elevated: Column, urgent: Column, critical: Column) -> Column:
    return F.when(score >= critical, "critical").when(score >= urgent, "urgent").when(score >= elevated, "elevated").otherwise("routine")


def manual_seconds(claim_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MANUAL_SECONDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(claim_type)), F.lit(35))


def needs_entropy(status: Column) -> Column:
    return status != "verified"


def should_run_entropy(status: Column, verified: bool = False, contradicted: bool = True, not_found: bool = True) -> Column:
    """Whether a claim's entropy is computed, as set for each status; other statuses (null too) always are."""
    return F.when(status == "verified", verified).when(status == "contradicted", contradicted).when(status == "not_found", not_found).otherwise(True)


def log_score(entropy: Column, uncertainty: Column, confidence: Column) -> Column:
    """The first of these that is neither null nor 0; the last as it is."""
    return F.coalesce(F.nullif(entropy, F.lit(0.0)), F.nullif(uncertainty, F.lit(0.0)), confidence)


def attention_concerns(coverage: Column, entropy: Column, edge: Column, unexpected: Column, has_region: Column, min_coverage: float = 0.5, max_unexpected: float = 0.4) -> Column:
    """Concerns about where a model looked, in the order in which they are checked."""
    return F.array_compact(
        F.array(
            F.when(has_region & (coverage < min_coverage), "wrong_region"),
            F.when(entropy > 0.9, "too_diffuse"),
            F.when(entropy < 0.1, "too_focused"),
            F.when(edge > 0.3, "edge_artifact"),
            F.when(unexpected > max_unexpected, "wrong_region"),
        )
    )
