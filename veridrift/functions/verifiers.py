"""Verifiers of the three domains: a claim of a type against its source, by one dispatcher for each domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains, medication
from .text import any_of, context_window, shared_words, words

# Allergens that healthcare claims are checked for, in the order in which they are tried.
ALLERGENS = [
    "penicillin", "amoxicillin", "sulfa", "sulfamethoxazole", "codeine", "morphine", "hydrocodone", "oxycodone", "latex", "iodine", "contrast", "shellfish", "aspirin", "nsaid", "ibuprofen", "naproxen",
    "ace inhibitor", "lisinopril", "enalapril", "statin", "atorvastatin", "simvastatin", "metformin", "insulin",
]
NUMBER_TOLERANCE = 0.01


def _verdict(passed: Column | bool, confidence: Column | float, risk: Column | str, status: Column | str, warnings: Column | None = None, flagged: Column | bool = False) -> Column:
    """``struct(passed, confidence, risk, status, warnings, flagged)``; unknown conditions are false."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(lit(passed), F.lit(False)).alias("passed"),
        lit(confidence).cast("double").alias("confidence"),
        lit(risk).alias("risk"),
        lit(status).alias("status"),
        (none if warnings is None else F.coalesce(warnings, none)).alias("warnings"),
        F.coalesce(lit(flagged), F.lit(False)).alias("flagged"),
    )


def _warned(condition: Column, *said: str) -> Column:
    return F.when(condition, F.array(*[F.lit(s) for s in said]))


def generic(claim: Column, source: Column) -> Column:
    """Contained, or by more than 0.7 of the claim's words."""
    c, s = F.lower(claim), F.lower(source)
    own = words(claim)
    share = F.when(F.size(own) > 0, shared_words(own, words(source)) / F.size(own)).otherwise(0.0)
    inside = F.contains(s, c)
    found = inside | (share > 0.7)
    return _verdict(found, F.when(inside, 1.0).when(share > 0.7, share).otherwise(0.0), F.when(found, "low").otherwise("medium"), F.when(inside, "verified").when(share > 0.7, "partial").otherwise("not_found"), _warned(~found, "unverified"))


def medication_claim(claim: Column, transcript: Column) -> Column:
    """Name in the transcript, and the dose said near it; doses take a point or a comma."""
    t, own = F.lower(transcript), medication.components(claim)
    number = lambda c, group: F.nullif(F.replace(F.regexp_extract(c, r"(?i)(\d+(?:[.,]\d+)?)\s*(mg|mcg|g|ml|units?|iu|meq)", group), F.lit(","), F.lit(".")), F.lit("")).cast("double")
    at = F.instr(t, own["name"]) - 1
    near, claimed = number(context_window(t, at, 50, 100), 1), number(claim, 1)
    both = near.isNotNull() & (F.coalesce(claimed, F.lit(0.0)) != 0)
    missing = own["name"].isNull() | (at < 0)
    status = F.when(missing, "not_found").when(both & (near == claimed), "verified").when(both, "contradicted").otherwise("partial")
    confidence = F.when(status == "verified", 1.0).when(status == "contradicted", 0.3).when(status == "partial", 0.6).otherwise(0.0)
    risk = F.when(status == "verified", "low").when(status == "contradicted", "critical").when(status == "partial", "medium").otherwise("high")
    warning = F.when(own["name"].isNull(), "no medication name").when(status == "not_found", "medication not found").when(status == "contradicted", "dose mismatch").when(status == "partial", "dose not confirmed")
    return _verdict(status == "verified", confidence, risk, status, F.when(warning.isNotNull(), F.array(warning)))


def allergy_claim(claim: Column, transcript: Column) -> Column:
    """None-known statements by what the transcript denies, else the first allergen that the claim names."""
    t, c = F.lower(transcript), F.lower(claim)
    none = any_of(c, ["nkda", "no known"])
    denied = none & F.contains(t, F.lit("no")) & F.contains(t, F.lit("allerg"))
    nothing = none & F.contains(t, F.lit("none"))
    first = F.try_element_at(F.filter(F.array(*[F.lit(a) for a in ALLERGENS]), lambda a: F.contains(c, a)), F.lit(1))
    said = F.coalesce(F.contains(t, first), F.lit(False))
    found = denied | nothing | said
    risk = F.when(found, "low").when(first.isNotNull(), "critical").otherwise("high")
    warning = F.when(first.isNotNull(), F.concat(F.lit("allergy not mentioned: "), first)).otherwise("allergy unverified")
    return _verdict(found, F.when(denied, 1.0).when(nothing, 0.9).when(said, 1.0).otherwise(0.0), risk, F.when(found, "verified").otherwise("not_found"), F.when(~found, F.array(warning)))


def exam_claim(claim: Column, transcript: Column) -> Column:
    """Murmurs and edema by the transcript's words; other findings need a look."""
    t, c = F.lower(transcript), F.lower(claim)
    known = (F.contains(c, F.lit("murmur")) & F.contains(t, F.lit("murmur"))) | (F.contains(c, F.lit("edema")) & any_of(t, ["edema", "swelling"]))
    return _verdict(known, F.when(known, 0.8).otherwise(0.5), F.when(known, "low").otherwise("medium"), F.when(known, "verified").otherwise("partial"), _warned(~known, "exam finding unverified"))


def healthcare(claim_type: Column, claim: Column, transcript: Column) -> Column:
    """A healthcare claim against the transcript. Vital signs are measured, so they pass with half confidence."""
    vital = _verdict(True, 0.5, "low", "partial")
    return (
        F.when(claim_type.isin("medication", "dosage"), medication_claim(claim, transcript))
        .when(claim_type == "allergy", allergy_claim(claim, transcript))
        .when(claim_type == "vital_sign", vital)
        .when(claim_type == "exam_finding", exam_claim(claim, transcript))
        .otherwise(generic(claim, transcript))
    )


def case_citation(got: Column) -> Column:
    """From ``case_check``."""
    return _verdict(got["passed"], got["confidence"], got["risk"], got["status"], got["warnings"], got["fabricated"])


def statute_known(parts: Column, claim: Column, source: Column) -> Column:
    """Title before section, the section by name, or the whole citation; only citations of the federal codes have parts to look for."""
    return parts["title"].isNotNull() & parts["section"].isNotNull() & domains.statute_check(parts, claim, source)


def statute_citation(known: Column) -> Column:
    return _verdict(known, F.when(known, 0.9).otherwise(0.0), F.when(known, "low").otherwise("high"), F.when(known, "verified").otherwise("not_found"), _warned(~known, "statute unverified"))


def clause(claim: Column, kind: Column, source: Column) -> Column:
    """The claim's whole text in the source, or at least the clause's own words (``kind``)."""
    s = F.lower(source)
    whole = F.contains(s, F.lower(claim))
    named = F.coalesce((kind != "") & F.contains(s, F.lower(kind)), F.lit(False))
    status = F.when(whole, "verified").when(named, "partial").otherwise("not_found")
    warnings = F.when(status == "partial", F.array(F.lit("exact text unverified"))).when(status == "not_found", F.array(F.lit("clause not found")))
    return _verdict(whole | named, F.when(whole, 1.0).when(named, 0.7).otherwise(0.0), F.when(whole, "low").when(named, "medium").otherwise("high"), status, warnings)


def limitation(known: Column) -> Column:
    return _verdict(known, F.when(known, 0.8).otherwise(0.0), F.when(known, "low").otherwise("medium"), F.when(known, "verified").otherwise("not_found"), _warned(~known, "limitation period unverified"))


def period(matched: Column) -> Column:
    """The number that a limitation period names, null without one."""
    return F.nullif(F.regexp_extract(matched, r"(\d+)", 1), F.lit(""))


def legal(claim_type: Column, claim: Column, source: Column, matched: Column, case: Column | None = None, known: Column | None = None) -> Column:
    """A legal claim against its source. ``matched``: the words that the pattern found within a claim that has context.

    ``case`` (``case_check``) and ``known`` (whether the source has the statute or the limitation period): for callers that have them as columns.
    Spark works out an expression anew wherever a branch of the verdict names it, but a column once.
    """
    case = domains.case_check(domains.case_parts(claim), source) if case is None else case
    statute = statute_known(domains.statute_parts(claim), claim, source) if known is None else known
    limited = domains.limitation_check(period(matched), source) if known is None else known
    review = _verdict(False, 0.5, "medium", "needs_review", F.array(F.lit("legal analysis needed")))
    return (
        F.when(claim_type == "case_citation", case_citation(case))
        .when(claim_type == "statute_reference", statute_citation(statute))
        .when(claim_type == "contract_clause", clause(claim, matched, source))
        .when(claim_type == "jurisdiction", review)
        .when(claim_type == "limitation_period", limitation(limited))
        .otherwise(generic(claim, source))
    )


def _number(value: Column, known: Column, source: Column, by_text: float, missing: Column) -> Column:
    """A claimed number within a hundredth of one that is on record, or written in the source."""
    near = F.exists(F.map_values(F.coalesce(known, F.create_map().cast("map<string,double>"))), lambda v: F.abs(v - value) <= F.abs(value * NUMBER_TOLERANCE))
    written = F.contains(source, value.cast("string"))
    recorded, told = F.coalesce(near, F.lit(False)), F.coalesce(written, F.lit(False))
    status = F.when(recorded, "verified").when(told, "verified_text").otherwise("not_found")
    return F.struct(status.alias("status"), F.when(recorded, 0.95).when(told, by_text).otherwise(0.0).alias("confidence"), F.when(status == "not_found", missing).alias("warnings"))


def performance(claim: Column, returns: Column, source: Column) -> Column:
    parts = domains.return_parts(claim)
    unclear = F.array_compact(F.array(F.when(parts["return_type"] == "unknown", "return type not specified"), F.when(parts["net_or_gross"].isNull(), "net or gross not specified")))
    got = _number(parts["return_value"], returns, source, 0.85, F.when(F.size(unclear) > 0, unclear).otherwise(F.array(F.lit("performance unverified"))))
    known = got["status"] != "not_found"
    return _verdict(known, got["confidence"], F.when(known, "low").otherwise("critical"), got["status"], F.when(got["status"] == "verified_text", F.array(F.lit("confirm data source"))).otherwise(got["warnings"]))


def fee(claim: Column, fees: Column, source: Column) -> Column:
    got = _number(domains.fee_parts(claim)["fee_amount"], fees, source, 0.8, F.array(F.lit("fee unverified")))
    known = got["status"] != "not_found"
    return _verdict(known, got["confidence"], F.when(known, "low").otherwise("high"), got["status"], got["warnings"])


def risk_rating(claim: Column, matched: Column, source: Column) -> Column:
    s = F.lower(source)
    whole = F.contains(s, F.lower(claim))
    named = F.coalesce((matched != "") & F.contains(s, F.lower(matched)), F.lit(False))
    status = F.when(whole, "verified").when(named, "partial").otherwise("not_found")
    return _verdict(whole | named, F.when(whole, 0.9).when(named, 0.7).otherwise(0.0), F.when(whole, "low").when(named, "medium").otherwise("high"), status, _warned(status == "not_found", "risk rating unverified"))


def forward_looking(response: Column) -> Column:
    told = domains.has_disclaimer(response)
    status = F.when(told, "compliant").otherwise("missing_disclaimer")
    return _verdict(told, F.when(told, 0.7).otherwise(0.0), F.when(told, "medium").otherwise("high"), status, F.array(F.when(told, "verify disclaimer").otherwise("add disclaimer")))


def finance(claim_type: Column, claim: Column, source: Column, matched: Column, response: Column, returns: Column, fees: Column) -> Column:
    """A financial claim against numbers on record (maps), the source, or the response's own disclaimers. Suitability always needs an adviser, guarantees are prohibited."""
    suitable = _verdict(False, 0.5, "high", "needs_review", F.array(F.lit("advisor review needed")))
    prohibited = _verdict(False, 0.0, "critical", "prohibited", F.array(F.lit("guarantee language"), F.lit("remove or qualify")), True)
    return (
        F.when(claim_type == "performance_figure", performance(claim, returns, source))
        .when(claim_type == "fee_disclosure", fee(claim, fees, source))
        .when(claim_type == "risk_rating", risk_rating(claim, matched, source))
        .when(claim_type == "suitability", suitable)
        .when(claim_type == "forward_looking", forward_looking(response))
        .when(claim_type == "guaranteed_return", prohibited)
        .otherwise(generic(claim, source))
    )
