"""What a review dashboard shows: bands, rows, explanations and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds to check a claim by hand, of any other type, by the service, and to look into a contradiction.
MANUAL_SECONDS = {"medication": 45, "allergy": 30, "vital_sign": 20, "lab_result": 40, "diagnosis": 60, "procedure": 90, "demographic": 15}
OTHER_SECONDS, SERVICE_SECONDS, CONTRADICTION_SECONDS = 35, 2, 60
# Question for each claim type, with a place for the claim.
QUESTIONS = {
    "medication": "Did the patient or provider mention that the patient takes %s?",
    "allergy": "Did the patient or provider mention an allergy to %s?",
    "diagnosis": "Was %s discussed as a diagnosis or condition the patient has?",
    "procedure": "Was %s mentioned as a procedure the patient had or will have?",
    "vital_sign": "Was the vital sign '%s' mentioned in the conversation?",
    "lab_result": "Was the lab result '%s' discussed?",
}
OTHER_QUESTION = "Was the following mentioned in the transcript: '%s'?"
# Explanation by level of faithfulness.
EXPLANATIONS = {
    "faithful": "Claim is well-supported by source",
    "partially_faithful": "Claim partially supported — review recommended",
    "likely_hallucinated": "Claim weakly supported — likely hallucination",
}
UNSUPPORTED = "Claim not supported by source — hallucination detected"
# Kind of a dashboard row by the note's risk.
ROW_TYPES = {"CRITICAL": "HALLUCINATION_DETECTED", "HIGH": "HIGH_UNCERTAINTY", "MEDIUM": "STANDARD", "LOW": "STANDARD"}


def _lookup(key: Column, table: dict, otherwise) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(otherwise))


def manual_seconds(claim_type: Column) -> Column:
    return _lookup(claim_type, MANUAL_SECONDS, OTHER_SECONDS)


def question(claim_type: Column, claim: Column) -> Column:
    """A yes/no question that asks the transcript for the claim; a null claim has none."""
    return F.replace(_lookup(claim_type, QUESTIONS, OTHER_QUESTION), F.lit("%s"), claim)


def explanation(level: Column, score: Column, mock: bool = False) -> Column:
    """Sentence on a faithfulness score; ``mock`` marks scores that no model gave."""
    text = F.concat(F.lit("[MOCK] " if mock else ""), _lookup(level, EXPLANATIONS, UNSUPPORTED))
    return F.concat(text, F.format_string(" (score=%.2f)", score))


def risk_band(contradictions: Column, unverified: Column, entropy: Column) -> Column:
    """High with any contradiction or an entropy above 1, medium above 0.5 or with more than two unverified claims; no claims checked (null counts): unknown."""
    h = F.coalesce(entropy, F.lit(0.0))
    checked = contradictions.isNotNull() & unverified.isNotNull()
    return F.when(~checked, "UNKNOWN").when((contradictions > 0) | (h > 1.0), "HIGH RISK").when((h > 0.5) | (unverified > 2), "MEDIUM RISK").otherwise("LOW RISK")


def entropy_text(entropy: Column) -> Column:
    """The entropy with its band, a dash if null."""
    name = F.when(entropy <= 0.3, "Low").when(entropy <= 0.6, "Medium").otherwise("High")
    return F.when(entropy.isNull(), "—").otherwise(F.concat(name, F.format_string(" (%.2f)", entropy)))


def row_type(risk: Column) -> Column:
    return _lookup(risk, ROW_TYPES, "STANDARD")


def row_status(risk: Column) -> Column:
    return F.when(risk == "LOW", "Ready").otherwise("Review Required")


def row_review(detailed: Column, standard: Column) -> Column:
    """The deepest review that any claim of the note needs."""
    return F.when(detailed > 0, "Detailed").when(standard > 0, "Standard").otherwise("Brief")


def api_risk_label(entropy: Column) -> Column:
    """Label of an entropy in answers of the service."""
    return F.when(entropy < 0.3, "LOW").when(entropy < 0.7, "MEDIUM").otherwise("HIGH")


def point_estimate(outputs: Column) -> Column:
    """Main value of a model's named outputs (a map): the first known name that is present, else the first value, else 0.5."""
    named = [F.try_element_at(outputs, F.lit(k)) for k in ("risk_score", "probability", "prediction", "score", "risk")]
    return F.coalesce(*named, F.try_element_at(F.map_values(outputs), F.lit(1)), F.lit(0.5))


def coverage_verdict(target: Column, empirical: Column, tolerance: float = 0.01) -> Column:
    """``struct(coverage_gap, is_valid)``: valid from ``tolerance`` below the target on."""
    return F.struct((target - empirical).alias("coverage_gap"), (empirical >= target - tolerance).alias("is_valid"))
