"""Patterns and rules of the healthcare, legal and finance domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, normalized

# Patterns of personal health information, first hit decides.
PHI = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{10}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "date": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
}
# Legal advice and privilege, guarantees, outlooks and their disclaimer.
UNAUTHORIZED_PRACTICE = [r"you should\s+(?:file|sue|bring action)", r"I advise you to", r"my legal (?:advice|opinion) is", r"as your (?:attorney|lawyer)"]
PRIVILEGE = r"privileged|confidential.*communication|attorney-client"
GUARANTEES = [
    r"(?:guarantee(?:d|s)?|certain|assured|promise(?:d|s)?)\s+(?:return|yield|gain|profit|income)",
    r"(?:risk[- ]?free|no\s+risk|safe)\s+(?:return|yield|investment|income)",
    r"(?:can'?t|cannot|won'?t)\s+lose",
]
FORWARD_LOOKING = [
    r"(?:expect(?:ed|s)?|project(?:ed|ion|s)?|forecast(?:ed|s)?|anticipat(?:ed?|ing)|estimat(?:ed?|ing)|predict(?:ed|ion|s)?)\s+(?:to\s+)?(?:return|grow|increase|decrease|yield|gain)",
    r"(?:will|should|could|may|might)\s+(?:return|grow|increase|decrease|yield|gain|perform)",
    r"(?:target|price\s+target|projected)\s+(?:of\s+)?\$?\s*([\d,]+(?:\.\d+)?)",
    r"(?:in|over|within)\s+(?:the\s+)?(?:next|coming)\s+(?:\d+\s+)?(?:year|month|quarter|week)",
    r"(?:outlook|view|prospects?)\s+(?:is|are|remains?)\s+(?:positive|negative|neutral|bullish|bearish)",
]
NO_GUARANTEE = r"past performance.*(?:not|no).*guarantee"
DISCLAIMERS = [NO_GUARANTEE, r"forward.looking.*subject to", r"(?:may|could|might).*not.*achieve", r"no assurance", r"projections.*(?:not|no).*guarantee"]
CHERRY_PICKING = r"(?:best|top|highest)\s+(?:performing|return)"
# Case names that are often made up.
GENERIC_CASES = ["smith v. jones", "doe v. ", "abc v. ", "xyz corp"]
USC = r"(?i)(\d+)\s+U\.?S\.?C\.?\s*§?\s*(\d+[a-z]?)(?:\(([^)]+)\))?"
CFR = r"(?i)(\d+)\s+C\.?F\.?R\.?\s*§?\s*([\d\.]+)"
CASE = r"(?i)([A-Z][A-Za-z'\-\.\s]+(?:\s+v\.?\s+[A-Z][A-Za-z'\-\.\s]+)?),?\s*(\d+)\s+([A-Za-z\.\s]+\d*[a-z]*)\s+(\d+)(?:\s*\(([^)]*?)(\d{4})\))?"


def _any_pattern(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(f"(?i){p}"))
    return out


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def phi_kind(text: Column) -> Column:
    """The first kind of personal health information found, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PHI.items()):
        out = F.when(F.rlike(text, F.lit(pattern)), kind).otherwise(out)
    return out


def redacted(text: Column) -> Column:
    """The text with each such hit replaced by a mark of its kind.

    Addresses are sought only in texts with an at sign, which the marks before neither add nor take: their pattern begins again at
    every word, and in an unbroken run of words and points each time goes to the run's end.
    """
    addressed = F.contains(text, F.lit("@"))
    for kind, pattern in PHI.items():
        masked = F.regexp_replace(text, pattern, f"[{kind.upper()}]")
        text = F.when(addressed, masked).otherwise(text) if kind == "email" else masked
    return text


def legal_flags(text: Column) -> Column:
    return F.array_compact(F.array(F.when(_any_pattern(text, UNAUTHORIZED_PRACTICE), "UNAUTHORIZED_PRACTICE"), F.when(F.rlike(text, F.lit(f"(?i){PRIVILEGE}")), "PRIVILEGE")))


def finance_flags(text: Column) -> Column:
    forward = _any_pattern(text, FORWARD_LOOKING)
    return F.array_compact(
        F.array(
            F.when(_any_pattern(text, GUARANTEES), "PROHIBITED_GUARANTEE"),
            F.when(forward & ~F.rlike(text, F.lit(f"(?i){NO_GUARANTEE}")), "MISSING_DISCLAIMER"),
            F.when(F.rlike(text, F.lit(f"(?i){CHERRY_PICKING}")), "CHERRY_PICKING"),
        )
    )


def case_parts(text: Column) -> Column:
    """``struct(case_name, volume, reporter, page, court, year)``."""
    names = ["case_name", "volume", "reporter", "page", "court"]
    return F.struct(*[_part(text, CASE, i + 1).alias(n) for i, n in enumerate(names)], _part(text, CASE, 6).cast("int").alias("year"))


def statute_parts(text: Column) -> Column:
    """``struct(title, code, section, subsection)`` of a federal code or regulation."""
    usc, cfr = F.rlike(text, F.lit(USC)), F.rlike(text, F.lit(CFR))
    return F.struct(
        F.when(usc, _part(text, USC, 1)).when(cfr, _part(text, CFR, 1)).alias("title"),
        F.when(usc, "U.S.C.").when(cfr, "C.F.R.").alias("code"),
        F.when(usc, _part(text, USC, 2)).when(cfr, _part(text, CFR, 2)).alias("section"),
        F.when(usc, _part(text, USC, 3)).alias("subsection"),
    )


def return_parts(text: Column) -> Column:
    """``struct(return_value, return_type, net_or_gross)`` of a performance claim."""
    kind = F.when(F.rlike(text, F.lit(r"(?i)annual(?:ized)?")), "annualized").when(F.rlike(text, F.lit("(?i)YTD|year-to-date")), "YTD").when(F.rlike(text, F.lit("(?i)cumulative|total")), "cumulative").otherwise("unknown")
    basis = F.when(F.rlike(text, F.lit(r"(?i)\bnet\b")), "net").when(F.rlike(text, F.lit(r"(?i)\bgross\b")), "gross")
    return F.struct(_part(text, r"([+-]?\d+(?:\.\d+)?)\s*%", 1).cast("double").alias("return_value"), kind.alias("return_type"), basis.alias("net_or_gross"))


def fee_parts(text: Column) -> Column:
    """``struct(fee_amount, fee_type)`` of a fee claim, basis points as a percentage."""
    points = _part(text, r"(?i)(\d+)\s*(?:bps|basis\s+points?)", 1).cast("double") / 100
    kind = F.when(F.rlike(text, F.lit(r"(?i)expense\s+ratio")), "expense_ratio").when(F.rlike(text, F.lit("(?i)management")), "management_fee").when(F.rlike(text, F.lit("(?i)load")), "load").when(F.rlike(text, F.lit("(?i)commission")), "commission").otherwise("unknown")
    return F.struct(F.coalesce(points, _part(text, r"(\d+(?:\.\d+)?)\s*%", 1).cast("double")).alias("fee_amount"), kind.alias("fee_type"))


def case_check(parts: Column, source: Column) -> Column:
    """``struct(passed, confidence, risk, status, fabricated, warnings)`` of a case citation against its source."""
    s, name = F.lower(source), F.lower(parts["case_name"])
    known = F.coalesce(F.contains(s, name), F.lit(False))
    details = known & F.coalesce(F.contains(source, parts["volume"]) & F.contains(source, parts["page"]), F.lit(False))
    made_up = ~known & F.coalesce((parts["volume"].cast("long") > 1000) | (parts["page"].cast("long") > 5000), F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(known & ~details, "details_unverified"),
            F.when(~known & (parts["year"] >= 2023), "recent_case"),
            F.when(made_up, "unusual_numbers"),
            F.when(~known & any_of(F.coalesce(name, F.lit("")), GENERIC_CASES), "generic_name"),
        )
    )
    return F.struct(
        details.alias("passed"),
        F.when(details, 0.95).when(known, 0.5).otherwise(0.0).alias("confidence"),
        F.when(details, "low").when(known, "high").otherwise("critical").alias("risk"),
        F.when(details, "verified").when(known, "partial").otherwise("not_found").alias("status"),
        made_up.alias("fabricated"),
        warnings.alias("warnings"),
    )


def statute_check(parts: Column, claim: Column, source: Column) -> Column:
    """Whether the source has the title before the section, the section by name, or the whole citation."""
    s = F.lower(source)
    pattern = F.concat(F.lit("(?s)"), parts["title"], F.lit(".*"), F.regexp_replace(parts["section"], r"([.\\])", r"\\$1"))
    return F.coalesce(F.rlike(s, pattern) | F.contains(s, F.concat(F.lit("section "), parts["section"])) | F.contains(s, F.lower(claim)), F.lit(False))


def limitation_check(period: Column, source: Column) -> Column:
    s, p = F.lower(source), period.cast("string")
    return F.coalesce(F.contains(s, F.concat(p, F.lit(" year"))) | F.contains(s, F.concat(p, F.lit("-year"))) | F.contains(s, F.concat(F.lit("within "), p)), F.lit(False))


def has_disclaimer(text: Column) -> Column:
    return _any_pattern(text, DISCLAIMERS)


def transcript_check(claim_type: Column, claim: Column, transcript: Column) -> Column:
    """``struct(status, score, needs_entropy)`` of a clinical claim against the transcript of the encounter."""
    from .medication import TRANSCRIPT_ALLERGENS, components
    from .text import collapsed, context_window

    t, c = collapsed(transcript), collapsed(claim)
    med = components(claim)
    at = F.instr(t, med["name"]) - 1
    said = F.nullif(F.regexp_extract(context_window(t, at, 50, 100), r"(\d+(?:\.\d+)?)\s*(?:mg|milligrams?)?", 1), F.lit("")).cast("double")
    both = said.isNotNull() & (F.coalesce(med["dose"], F.lit(0.0)) != 0)
    medication = F.when(med["name"].isNull() | (at < 0), "not_found").when(both & (said == med["dose"]), "verified").when(both, "contradicted").otherwise("partial")
    none_claimed = any_of(c, ["nkda", "no known"])
    denied = none_claimed & F.contains(t, F.lit("no")) & F.contains(t, F.lit("allerg"))
    nothing = none_claimed & F.contains(t, F.lit("none"))
    named = F.filter(F.array(*[F.lit(a) for a in TRANSCRIPT_ALLERGENS]), lambda a: F.contains(c, a))
    first = F.try_element_at(named, F.lit(1))
    allergy = F.when(denied | nothing | F.coalesce(F.contains(t, first), F.lit(False)), "verified").otherwise("not_found")
    murmur = F.contains(c, F.lit("murmur")) & F.contains(t, F.lit("murmur"))
    edema = F.contains(c, F.lit("edema")) & any_of(t, ["edema", "swelling"])
    exam = F.when(murmur | edema, "verified").otherwise("partial")
    direct = F.when(F.contains(t, c), "verified").otherwise("not_found")
    status = F.when(claim_type == "medication", medication).when(claim_type == "allergy", allergy).when(claim_type == "vital_sign", "partial").when(claim_type == "exam_finding", exam).otherwise(direct)
    score = (
        F.when(claim_type == "medication", F.when(status == "verified", 1.0).when(status == "contradicted", 0.3).when(status == "partial", 0.6).otherwise(0.0))
        .when(claim_type == "allergy", F.when(denied, 1.0).when(nothing, 0.9).when(status == "verified", 1.0).otherwise(0.0))
        .when(claim_type == "vital_sign", 0.5)
        .when(claim_type == "exam_finding", F.when(status == "verified", 0.8).otherwise(0.5))
        .otherwise(F.when(status == "verified", 1.0).otherwise(0.0))
    )
    return F.struct(status.alias("status"), score.alias("score"), ((status != "verified") & (claim_type != "vital_sign")).alias("needs_entropy"))


def record_check(claim_type: Column, medication: Column, allergy: Column, none_claimed: Column, has_allergies: Column) -> Column:
    """Status of a claim against the patient's record, from the results of the medication and allergy matches."""
    by_medication = F.when(medication["kind"] == "dose_mismatch", "contradicted").when(medication["matches"], "verified").otherwise("not_in_ehr")
    by_allergy = F.when(allergy["matches"], "verified").when(none_claimed & has_allergies, "contradicted").otherwise("not_in_ehr")
    return F.when(claim_type == "medication", by_medication).when(claim_type == "allergy", by_allergy).otherwise("ehr_unavailable")


def none_known(claim: Column) -> Column:
    return any_of(normalized(claim), ["nkda", "no known"])
