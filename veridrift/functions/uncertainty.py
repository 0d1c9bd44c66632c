"""Uncertainty of a text or claim from its wording, its samples and its entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, count_of

# Words that hedge, negate, or name medical risk.
HEDGES = ["maybe", "perhaps", "possibly", "might", "could", "uncertain", "unclear", "approximately", "roughly", "seems", "appears", "likely", "unlikely"]
NEGATIONS = ["not", "n't", "never", "no", "none", "neither"]
MEDICAL_RISK = ["diagnosis", "cancer", "malignant", "surgery", "dose", "medication", "allergy", "contraindicated", "emergency", "critical", "fatal", "prognosis", "terminal", "metastasis", "overdose"]
# Words of stated confidence; high is tried before low, low before medium.
HIGH_CONFIDENCE = ["certain", "definitely", "clearly", "absolutely"]
LOW_CONFIDENCE = ["possibly", "might", "uncertain", "unsure", "unclear"]
MEDIUM_CONFIDENCE = ["likely", "probably", "appears", "seems"]
# Claim types by inherent risk, and the default stated confidence.
HIGH_RISK_TYPES = ["medication", "allergy", "dosage", "procedure", "diagnosis", "contraindication", "drug_interaction"]
LOW_RISK_TYPES = ["demographics", "visit_date", "provider_name", "chief_complaint_timing"]
STATED_DEFAULT = 0.7


def wording_parts(text: Column) -> Column:
    """``struct(hedging, question, negation)``, each from 0 to 1."""
    t = F.lower(text)
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.struct(
        F.least(F.lit(1.0), count_of(t, HEDGES) * 0.15).alias("hedging"),
        F.least(F.lit(1.0), marks * 0.2).alias("question"),
        F.least(F.lit(1.0), count_of(t, NEGATIONS) * 0.1).alias("negation"),
    )


def wording_uncertainty(text: Column) -> Column:
    """Mean of hedging, questions and negation."""
    p = wording_parts(text)
    return (p["hedging"] + p["question"] + p["negation"]) / 3.0


def calibration_curve(raw: Column) -> Column:
    """Raises low uncertainty, lowers very high uncertainty."""
    return F.when(raw < 0.3, raw * 1.3).when(raw > 0.7, 0.7 + (raw - 0.7) * 0.8).otherwise(raw)


def combined_uncertainty(ensemble: Column, wording: Column) -> Column:
    return calibration_curve(ensemble * 0.7 + wording * 0.3)


def ensemble_uncertainty(embeddings: Column) -> Column:
    """Mean variance of each dimension over an array of embeddings, times 1000, 1 at most."""
    n = F.size(embeddings)
    dims = F.transform(
        F.sequence(F.lit(0), F.size(F.element_at(embeddings, 1)) - 1),
        lambda j: F.aggregate(embeddings, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, e: F.struct((a["s"] + e[j]).alias("s"), (a["q"] + e[j] * e[j]).alias("q")), lambda a: a["q"] / n - (a["s"] / n) * (a["s"] / n)),
    )
    return F.least(F.lit(1.0), F.aggregate(dims, F.lit(0.0), lambda a, v: a + v) / F.size(dims) * 1000)


def medical_adjusted(base: Column, text: Column) -> Column:
    return F.least(F.lit(1.0), base + F.least(F.lit(0.2), count_of(F.lower(text), MEDICAL_RISK) * 0.05))


def stated_confidence(response: Column) -> Column:
    """Stated confidence: a percentage, else high, low or medium by words, else null."""
    t = F.lower(response)
    percent = F.nullif(F.regexp_extract(t, r"(\d{1,3})%?\s*(?:confident|certain|sure)", 1), F.lit("")).cast("int")
    return (
        F.when(percent.isNotNull(), F.least(percent / 100.0, F.lit(1.0)))
        .when(any_of(t, HIGH_CONFIDENCE), 0.9)
        .when(any_of(t, LOW_CONFIDENCE), 0.4)
        .when(any_of(t, MEDIUM_CONFIDENCE), 0.7)
    )


def calibrated_confidence(stated: Column, consistency: Column, entropy: Column) -> Column:
    left = F.greatest(F.lit(0.0), 1 - entropy / 2)
    return F.round(consistency * 0.4 + stated * left * 0.3 + left * 0.3, 3)


def claim_risk(claim_type: Column) -> Column:
    t = F.lower(claim_type)
    return F.when(t.isin(HIGH_RISK_TYPES), "high").when(t.isin(LOW_RISK_TYPES), "low").otherwise("standard")


def review_tier(confidence: Column, risk: Column) -> Column:
    high = F.when(confidence >= 0.9, "standard").otherwise("detailed")
    return F.when(risk == "high", high).when(confidence >= 0.85, "brief").when(confidence >= 0.6, "standard").otherwise("detailed")


def uncertainty_flags(entropy: Column, consistency: Column, risk: Column, confidence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(entropy > 1.0, "HIGH_ENTROPY"),
            F.when(consistency < 0.6, "LOW_CONSISTENCY"),
            F.when(risk == "high", "HIGH_RISK_CLAIM"),
            F.when(confidence < 0.5, "LOW_CONFIDENCE"),
        )
    )


def quantified(claim_type: Column, first_response: Column, consistency: Column, entropy: Column, stated: Column | None = None) -> Column:
    """``struct(confidence, consistency, calibrated_confidence, review_tier, flags)`` of a claim."""
    known = stated_confidence(first_response) if stated is None else F.coalesce(stated, stated_confidence(first_response))
    confidence = F.coalesce(known, F.lit(STATED_DEFAULT))
    calibrated, risk = calibrated_confidence(confidence, consistency, entropy), claim_risk(claim_type)
    return F.struct(
        confidence.alias("confidence"),
        consistency.alias("consistency"),
        calibrated.alias("calibrated_confidence"),
        review_tier(calibrated, risk).alias("review_tier"),
        uncertainty_flags(entropy, consistency, risk, calibrated).alias("flags"),
    )


def interpretation(uncertainty: Column) -> Column:
    """Five bands of uncertainty."""
    return F.when(uncertainty < 0.2, "very_low").when(uncertainty < 0.4, "low").when(uncertainty < 0.6, "moderate").when(uncertainty < 0.8, "high").otherwise("very_high")
