"""Training rows for a risk predictor: validation, formatting and hash-based error injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.medication import DOSE

# Valid statuses and levels; dose multipliers; frequencies and what each is changed to.
STATUSES = ["verified", "contradiction", "not_found", "not_checkable"]
LEVELS = ["BRIEF", "STANDARD", "DETAILED", "CRITICAL"]
DOSE_MULTIPLIERS = [0.5, 2.0, 5.0, 10.0]
FREQUENCY_SWAPS = {
    "daily": "BID",
    "once daily": "BID",
    "BID": "TID",
    "twice daily": "TID",
    "TID": "QID",
    "three times daily": "QID",
    "QID": "daily",
    "four times daily": "daily",
    "at bedtime": "BID",
    "nightly": "BID",
    "every 12 hours": "every 8 hours",
    "every 8 hours": "every 6 hours",
    "every 6 hours": "every 4 hours",
    "every 4 hours": "every 12 hours",
    "weekly": "daily",
    "once weekly": "daily",
    "PRN": "TID",
    "as needed": "TID",
}
SIMILAR_DRUGS = {
    "metformin": "metoprolol",
    "metoprolol": "metformin",
    "lisinopril": "losartan",
    "losartan": "lisinopril",
    "amlodipine": "amiodarone",
    "amiodarone": "amlodipine",
    "atorvastatin": "rosuvastatin",
    "rosuvastatin": "atorvastatin",
    "omeprazole": "esomeprazole",
    "esomeprazole": "omeprazole",
    "sertraline": "citalopram",
    "citalopram": "sertraline",
    "gabapentin": "pregabalin",
    "pregabalin": "gabapentin",
    "warfarin": "apixaban",
    "apixaban": "warfarin",
    "hydrochlorothiazide": "furosemide",
    "furosemide": "hydrochlorothiazide",
    "prednisone": "prednisolone",
    "prednisolone": "prednisone",
    "insulin glargine": "insulin lispro",
    "insulin lispro": "insulin glargine",
}
ABNORMAL_VITALS = {
    "BP": ["185/110", "210/120", "85/50", "220/140"],
    "HR": ["145", "38", "180", "28"],
    "temp": ["39.5°C", "40.2°C", "34.8°C", "41.0°C"],
    "SpO2": ["78%", "82%", "70%", "65%"],
    "RR": ["32", "6", "40", "4"],
}
VITAL_FORMS = {
    "BP": r"\b\d{2,3}/\d{2,3}\b",
    "HR": r"(?i)\b(?:HR|heart rate|pulse)\s*(?:of|at|:)?\s*(\d{2,3})\s*(?:bpm)?",
    "temp": r"\b(\d{2}\.\d)°?[CF]?\b",
    "SpO2": r"(?i)\b(?:SpO2|O2 sat|oxygen sat(?:uration)?)\s*(?:of|at|:)?\s*(\d{2,3})%?",
    "RR": r"(?i)\b(?:RR|respiratory rate)\s*(?:of|at|:)?\s*(\d{1,2})\b",
}
VITAL_LABELS = {"BP": "Blood pressure", "HR": "Heart rate", "temp": "Temperature", "SpO2": "SpO2", "RR": "Respiratory rate"}
FAKE_ALLERGIES = ["penicillin", "sulfa", "codeine", "aspirin", "iodine", "latex", "cephalosporins", "fluoroquinolones", "NSAIDs", "tetracycline", "erythromycin", "vancomycin"]
FAKE_SYMPTOMS = [
    "chest pain",
    "shortness of breath",
    "syncope",
    "hemoptysis",
    "severe headache",
    "vision changes",
    "numbness in left arm",
    "palpitations",
    "diaphoresis",
    "altered mental status",
    "abdominal rigidity",
    "melena",
]
ERROR_TYPES = ["wrong_dose", "wrong_frequency", "wrong_medication", "contradicts_ehr", "hallucinated_allergy", "hallucinated_symptom", "wrong_vital"]
COMPATIBLE = {
    "medication": ["wrong_dose", "wrong_frequency", "wrong_medication", "contradicts_ehr"],
    "allergy": ["hallucinated_allergy", "contradicts_ehr"],
    "diagnosis": ["hallucinated_symptom", "contradicts_ehr"],
    "vital_sign": ["wrong_vital"],
}
REQUIRED = ["claim_type", "claim_text", "source_sentence", "ehr_status", "risk_score", "review_level"]


def first_error() -> Column:
    """The first reason why a training row is invalid, else null."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing required field: {c}")) for c in REQUIRED]
    outside = lambda c: (F.col(c) < 0.0) | (F.col(c) > 1.0)
    return F.coalesce(
        *missing,
        F.when(~F.col("ehr_status").isin(STATUSES), F.concat(F.lit("invalid ehr_status: "), F.col("ehr_status"))),
        F.when(~F.col("review_level").isin(LEVELS), F.concat(F.lit("invalid review_level: "), F.col("review_level"))),
        F.when(outside("risk_score"), F.lit("risk_score out of range")),
        F.when(outside("hhem_score"), F.lit("hhem_score out of range")),
        F.when(outside("semantic_entropy"), F.lit("semantic_entropy out of range")),
    )


def validated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error", first_error())


def prepared(rows: DataFrame) -> DataFrame:
    """Valid rows with ``text``: prompt and target in one string."""
    number = lambda c: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(c)))
    prompt = F.concat_ws("\n", F.concat(F.lit("Claim type: "), F.col("claim_type")), F.concat(F.lit("Claim: "), F.col("claim_text")), F.concat(F.lit("Source: "), F.col("source_sentence")), F.concat(F.lit("Record: "), F.col("ehr_status")), F.concat(F.lit("Faithfulness: "), number("hhem_score")), F.concat(F.lit("Entropy: "), number("semantic_entropy")))
    target = F.to_json(F.struct("risk_score", "review_level"))
    return validated(rows).where("error is null").drop("error").withColumn("text", F.concat_ws("\n", prompt, target))


def picked(key: Column, seed: int, n: int) -> Column:
    """A reproducible choice from 0 to n - 1 for each key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")


def wrong_dose(claim: Column, choice: Column) -> Column:
    """The claim with its first dose multiplied by the chosen factor; unchanged without a dose."""
    number = F.regexp_extract(claim, DOSE, 1)
    factor = F.element_at(F.array(*[F.lit(m) for m in DOSE_MULTIPLIERS]), choice + 1)
    new = F.nullif(number, F.lit("")).cast("double") * factor
    text = F.when(new == F.floor(new), new.cast("long").cast("string")).otherwise(new.cast("string"))
    at = F.regexp_instr(claim, F.lit(DOSE))
    return F.when(number == "", claim).otherwise(F.overlay(claim, text, at, F.length(number)))


def _swapped(claim: Column, table: dict[str, str], keep_case: bool = False) -> Column:
    """The claim with the first key of the table that it contains replaced by its value."""
    out = claim
    for old, new in reversed(table.items()):
        at = F.instr(F.lower(claim), F.lit(old.lower()))
        text: Column = F.lit(new)
        if keep_case:
            first = F.substring(claim, at, 1)
            text = F.when((first == F.upper(first)) & (first != F.lower(first)), F.lit(new.capitalize())).otherwise(new)
        out = F.when(at > 0, F.overlay(claim, text, at, F.lit(len(old)))).otherwise(out)
    return out


def wrong_frequency(claim: Column) -> Column:
    return _swapped(claim, FREQUENCY_SWAPS)


def wrong_medication(claim: Column) -> Column:
    """The claim with a known drug swapped for one that is easily mistaken for it, in its case."""
    return _swapped(claim, SIMILAR_DRUGS, keep_case=True)


def _choice(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))) + 1)


def contradicts_record(claim: Column, medications: Column, choice: Column) -> Column:
    """One of the record's medications at two, five or ten times its dose; the claim if there is none."""
    n = F.size(F.coalesce(medications, F.array().cast("array<string>")))
    own = F.try_element_at(medications, F.pmod(choice, F.greatest(n, F.lit(1))) + 1)
    return F.coalesce(wrong_dose(own, F.pmod(choice, F.lit(3)) + 1), claim)


def hallucinated_allergy(allergies: Column, choice: Column) -> Column:
    """An allergy that the record lacks (any, if it has them all)."""
    known = F.transform(F.coalesce(allergies, F.array().cast("array<string>")), lambda a: F.lower(a))
    every = F.array(*[F.lit(a) for a in FAKE_ALLERGIES])
    open_ = F.filter(every, lambda a: ~F.array_contains(known, F.lower(a)))
    pool = F.when(F.size(open_) > 0, open_).otherwise(every)
    return F.concat(F.lit("Patient allergic to "), F.element_at(pool, F.pmod(choice, F.size(pool)) + 1))


def hallucinated_symptom(choice: Column) -> Column:
    return F.concat(F.lit("Patient reports "), _choice(FAKE_SYMPTOMS, choice))


def wrong_vital(claim: Column, choice: Column) -> Column:
    """The first vital sign found replaced by an abnormal value with its label; without one, an abnormal vital sign in place of the claim."""
    labels = list(ABNORMAL_VITALS)
    stated = {k: F.concat(F.lit(f"{VITAL_LABELS[k]} "), _choice(ABNORMAL_VITALS[k], choice)) for k in labels}
    out = F.element_at(F.array(*stated.values()), F.pmod(choice, F.lit(len(labels))) + 1)
    for k in reversed(labels):
        found = F.regexp_substr(claim, F.lit(VITAL_FORMS[k]))
        out = F.when(found.isNotNull(), F.overlay(claim, stated[k], F.instr(claim, found), F.length(found))).otherwise(out)
    return out


def inject_errors(claims: DataFrame, key: str, claim: str, rate: float, seed: int = 42, claim_type: str = "claim_type", medications: str | None = None, allergies: str | None = None) -> DataFrame:
    """``claims`` with ``error_type`` (null: left alone) and ``injected_text``, for about ``rate`` of the rows; the same rows for the same seed.

    The kind of error is one that fits the claim's type; an unknown type takes any.
    """
    none = F.lit(None).cast("array<string>")
    meds, alls = (F.col(c) if c else none for c in (medications, allergies))
    c, pick = F.col(claim), picked(F.col(key), seed + 2, 1000)
    fitting = F.array(*[F.lit(e) for e in ERROR_TYPES])
    for kind, names in reversed(COMPATIBLE.items()):
        fitting = F.when(F.col(claim_type) == kind, F.array(*[F.lit(e) for e in names])).otherwise(fitting)
    chosen = picked(F.col(key), seed, 10_000) < int(rate * 10_000)
    error = F.when(chosen, F.element_at(fitting, F.pmod(picked(F.col(key), seed + 1, 1000), F.size(fitting)) + 1))
    e = F.col("error_type")
    text = (
        F.when(e == "wrong_dose", wrong_dose(c, F.pmod(pick, F.lit(len(DOSE_MULTIPLIERS)))))
        .when(e == "wrong_frequency", wrong_frequency(c))
        .when(e == "wrong_medication", wrong_medication(c))
        .when(e == "contradicts_ehr", contradicts_record(c, meds, pick))
        .when(e == "hallucinated_allergy", hallucinated_allergy(alls, pick))
        .when(e == "hallucinated_symptom", hallucinated_symptom(pick))
        .when(e == "wrong_vital", wrong_vital(c, pick))
        .otherwise(c)
    )
    return claims.withColumn("error_type", error).withColumn("injected_text", text)


def _around(middle: float, spread: float, key: Column, seed: int) -> Column:
    """A reproducible value about the middle, within 0 to 1: the sum of three uniform hashes as noise."""
    noise = sum((picked(key, seed + i, 2001) / 1000.0 - 1 for i in range(3)), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), middle + noise * spread)), 4)


def simulated_signals(rows: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """``rows`` with the checks' likely signals for the injected error: ``ehr_status, hhem_score, semantic_entropy, risk_score, review_level``."""
    e, k = F.col("error_type"), F.col(key)
    invented, vital = e.isin("hallucinated_allergy", "hallucinated_symptom"), e == "wrong_vital"

    def pick(right: Column, made_up: Column, sign: Column, wrong: Column) -> Column:
        return F.when(e.isNull(), right).when(invented, made_up).when(vital, sign).otherwise(wrong)

    nothing = F.lit(None).cast("double")
    return rows.withColumns(
        {
            "ehr_status": pick(F.lit("verified"), F.lit("not_found"), F.lit("contradiction"), F.lit("contradiction")),
            "hhem_score": pick(nothing, _around(0.30, 0.05, k, seed), _around(0.25, 0.05, k, seed), _around(0.20, 0.05, k, seed)),
            "semantic_entropy": pick(nothing, _around(0.50, 0.05, k, seed + 10), _around(0.12, 0.04, k, seed + 10), _around(0.15, 0.05, k, seed + 10)),
            "risk_score": pick(_around(0.05, 0.01, k, seed + 20), _around(0.80, 0.03, k, seed + 20), _around(0.92, 0.02, k, seed + 20), _around(0.90, 0.03, k, seed + 20)),
            "review_level": pick(F.lit("BRIEF"), F.lit("DETAILED"), F.lit("CRITICAL"), F.lit("CRITICAL")),
        }
    )
