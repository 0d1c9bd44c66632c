"""Analyses of notes from their text to a review queue, composed of the operators for each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains, packs, verifiers
from ..functions.risk import entropy_band, supplied_or_half
from ..functions.text import faithfulness, faithfulness_level
from . import analysis, entropy, extraction, governance, verification

_KEY = "_claim_key"


def _keyed(claims: DataFrame, note: str) -> DataFrame:
    return claims.withColumn(_KEY, F.concat_ws("/", F.col(note).cast("string"), "claim_id"))


def entropies(claims: DataFrame, responses: DataFrame, note: str, cluster: Column) -> DataFrame:
    """Entropy of the sampled ``responses`` (note, ``claim_id, response``) of the claims that need it, by ``cluster`` of a response; others are not looked at."""
    asked = _keyed(responses, note).join(claims.select(_KEY).distinct(), _KEY, "left_semi")
    found = entropy.semantic_entropy(entropy.cluster_sizes(asked.where(F.col("response").isNotNull()), _KEY, cluster), _KEY)
    return found.select(_KEY, F.col("entropy_of_n").alias("entropy"))


def analyze(sections: DataFrame, transcripts: DataFrame, patients: DataFrame, note_patients: DataFrame, responses: DataFrame, confidences: DataFrame, note: str = "note_id", patient: str = "patient_id") -> DataFrame:
    """The claims of notes with ``status, entropy, confidence, review_tier, flag, priority`` (``analyze_notes``), from the notes' text on.

    Claims are extracted from ``sections`` (note, ``section_pos, section, text``), checked against the note's transcript and the patient's
    ``medications`` and ``allergies``, whose verdict overrides; contradicted and missing claims get the entropy of their ``responses``; claims that
    are not verified their ``confidence`` and ``interpretation`` from ``confidences`` (note, ``claim_id``). A note without a patient
    keeps the transcript's verdict. A claim without responses has entropy 0.5, as one without confidence.
    """
    claims = _keyed(extraction.note_claims(sections, note), note)
    spoken = verification.against_transcript(claims, transcripts, note)
    known = verification.against_records(claims.join(note_patients.select(note, patient), note, "left"), patients, patient)
    checked = verification.merge_results(spoken, known, _KEY).drop("ehr_status")
    h = entropies(checked.where(F.col("status").isin("contradicted", "not_found")), responses, note, entropy.exact_cluster(F.col("response")))
    told = _keyed(confidences, note).select(_KEY, "confidence", "interpretation")
    joined = checked.join(h, _KEY, "left").join(told, _KEY, "left").withColumnRenamed("risk", "claim_risk")
    return analysis.analyze_notes(joined.withColumn("interpretation", F.coalesce("interpretation", F.lit("")))).drop(_KEY)


def validate(claims: DataFrame, facts: DataFrame, transcripts: DataFrame, responses: DataFrame, note: str = "note_id", patient: str = "patient_id") -> DataFrame:
    """Records first, then faithfulness, then entropy: claims with ``status, matched, faithfulness, entropy, entropy_level, risk, priority``.

    ``claims``: note, patient, ``claim_id, claim_type, claim_text``. Facts decide first (``first_pass``); what they lack or contradict is weighed
    by the transcript's words; only contradictions are asked for entropy, over the yes and no of their ``responses`` (0 and none at all count as 0.5).
    """
    keyed = _keyed(claims, note)
    first = verification.first_pass(keyed.withColumn("claim_id", F.col(_KEY)), facts, patient).select(F.col("claim_id").alias(_KEY), "status", "matched")
    met = keyed.join(first, _KEY).join(transcripts.select(note, "transcript"), note, "left")
    weighed = F.col("status").isin("not_found", "contradiction")
    level = F.when(weighed, faithfulness_level(faithfulness(F.col("claim_text"), F.coalesce("transcript", F.lit("")))))
    scored = met.withColumn("faithfulness", level)
    asked = scored.where("status = 'contradiction'")
    h = entropies(asked, responses, note, entropy.yes_no_cluster(F.col("response")))
    scored = scored.join(h, _KEY, "left").withColumn("entropy", F.when(F.col("status") == "contradiction", F.coalesce("entropy", F.lit(0.5))))
    banded = scored.withColumn("entropy_level", F.when(F.col("entropy").isNotNull(), entropy_band(F.col("entropy"))))
    return analysis.validate_first_pass(banded).select(note, patient, "claim_id", "claim_type", "claim_text", "status", "matched", "faithfulness", "entropy", "entropy_level", "risk", "priority")


def verify_responses(responses: DataFrame, sources: DataFrame, domain: str, key: str, text: str = "text", numbers: bool = False) -> DataFrame:
    """The claims of responses with ``status, passed, confidence, claim_risk, warnings, flagged`` from their domain's verifiers.

    Claims are found by ``domain_claims`` in one scan and checked against the key's ``source`` (``sources``: key, ``source`` and,
    with ``numbers``, maps ``returns`` and ``fees``). A key without a source is checked against an empty one.
    """
    found = governance.domain_claims(responses, key, text, packs.PACKS[domain])  # checked with their context
    columns = [F.col("source"), *([F.col("returns"), F.col("fees")] if numbers else [])]
    met = found.join(sources.select(key, *columns), key, "left").join(responses.select(key, F.col(text).alias("_response")), key)
    source = F.coalesce("source", F.lit(""))
    kind, claim, matched, none = F.col("claim_type"), F.col("context"), F.col("claim_text"), F.lit(None).cast("map<string,double>")
    if domain == "healthcare":
        verdict = verifiers.healthcare(kind, claim, source)
    elif domain == "legal":
        of = lambda t, c: F.when(kind == t, c)
        met = met.withColumns({"_case": domains.case_parts(of("case_citation", claim)), "_statute": domains.statute_parts(of("statute_reference", claim)), "_period": verifiers.period(of("limitation_period", matched))})
        known = F.when(kind == "limitation_period", domains.limitation_check(F.col("_period"), source)).otherwise(verifiers.statute_known(F.col("_statute"), claim, source))
        met = met.withColumns({"_case": domains.case_check(F.col("_case"), source), "_known": known})
        verdict = verifiers.legal(kind, claim, source, matched, F.col("_case"), F.col("_known"))
    else:
        returns, fees = (F.col("returns"), F.col("fees")) if numbers else (none, none)
        verdict = verifiers.finance(kind, claim, source, matched, F.col("_response"), returns, fees)
    out = met.withColumn("_v", verdict)
    return out.select(key, "pos", "claim_id", "claim_type", "claim_text", "context", "_v.status", "_v.passed", "_v.confidence", F.col("_v.risk").alias("claim_risk"), "_v.warnings", "_v.flagged")


def govern_responses(verified: DataFrame, key: str, domain: str, entropies: DataFrame | None = None) -> DataFrame:
    """One verdict for each response of ``verify_responses``: counts, worst risk, review level and reasons to escalate; ``entropies`` (key, ``entropy``), where none is sampled 0.5."""
    h = verified.withColumn("entropy", F.lit(0.5)) if entropies is None else verified.join(entropies.select(key, "entropy"), key, "left").withColumn("entropy", supplied_or_half(F.col("entropy")))
    return governance.response_verdict(h.withColumnRenamed("claim_risk", "risk"), key, packs.PACKS[domain])
