"""Analyses from a note's text to its queue: golden cases and verifiers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridrift.functions import verifiers
from veridrift.operators import extraction, notes

CLAIMS = [
    ("Metoprolol 50mg BID", "medication", "verified", "low"), ("Lisinopril 10mg daily", "medication", "verified", "low"), ("Penicillin allergy", "allergy", "verified", "low"), ("Hypertension", "diagnosis", "verified", "low"),
    ("Atrial fibrillation", "diagnosis", "verified", "low"), ("Aspirin 81mg daily", "medication", "not_found", "low"), ("Migraine headaches", "diagnosis", "not_found", "low"), ("Gabapentin 300mg TID", "medication", "not_found", "high"),
    ("Type 2 diabetes", "diagnosis", "not_found", "high"), ("Warfarin 5mg daily", "medication", "contradiction", None),
]
TRANSCRIPT = (
    "Doctor: Good morning. Let me review your medications. You're taking metoprolol 50mg twice daily and lisinopril 10mg daily, correct? Patient: Yes. I also started taking aspirin 81mg daily on my own. "
    "Doctor: Any allergies? Patient: I'm allergic to penicillin. Doctor: Your records show hypertension and atrial fibrillation. Patient: I've also been getting migraine headaches recently. I've been taking warfarin 5mg daily."
)
FACTS = [("MedicationStatement", "metoprolol", "50mg"), ("MedicationStatement", "lisinopril", "10mg"), ("MedicationStatement", "warfarin", "2.5mg"), ("AllergyIntolerance", "penicillin", None), ("Condition", "Hypertension", "I10"), ("Condition", "Atrial fibrillation", "I48.91")]
SURE = ["Yes, the patient mentioned taking warfarin", "Yes, warfarin was discussed", "Yes, the patient confirmed warfarin", "Yes, mentioned", "Yes, the patient stated so"]
UNSURE = ["Yes, warfarin was mentioned", "No, it was not clearly discussed", "The transcript is unclear about it", "No, the specific medication was not mentioned", "Yes, the patient discussed it briefly"]


@pytest.mark.parametrize(("said", "risk"), [(SURE, "high"), (UNSURE, "medium")])
def test_records_first_validation(spark, said, risk):
    import json

    model = spark.createDataFrame([("n1", json.dumps([{"claim_text": c, "claim_type": k, "source_sentence": ""} for c, k, *_ in CLAIMS]))], "note_id string, answer string")
    claims = extraction.response_claims(model, "note_id", F.col("answer")).withColumn("patient_id", F.lit("P1"))
    facts = spark.createDataFrame([("P1", kind, i, name, detail, True) for i, (kind, name, detail) in enumerate(FACTS)], "patient_id string, resource_type string, pos int, name string, detail string, active boolean")
    responses = spark.createDataFrame([("n1", "claim_010", s) for s in said] + [("n1", "claim_001", "No")], "note_id string, claim_id string, response string")
    rows = notes.validate(claims, facts, spark.createDataFrame([("n1", TRANSCRIPT)], "note_id string, transcript string"), responses).collect()
    got = {r.claim_text: r for r in rows}
    assert len(rows) == 10 and {c: got[c].status for c, *_ in CLAIMS} == {c: s for c, _, s, _ in CLAIMS}
    assert {c: got[c].risk for c, *_ in CLAIMS} == {c: r or risk for c, _, _, r in CLAIMS}
    assert sum(r.faithfulness is not None for r in rows) == 5 and sum(r.faithfulness in ("hallucinated", "likely_hallucinated") for r in rows) == 2
    assert [r.claim_text for r in rows if r.entropy is not None] == ["Warfarin 5mg daily"] and (got["Warfarin 5mg daily"].entropy < 0.3) == (said is SURE)


def test_notes_from_text_to_queue(spark):
    sections = spark.createDataFrame([(1, 0, "medications", "- aspirin 81 mg daily\n- warfarin 5 mg daily\n- zinc 10 mg"), (1, 1, "exam", "Allergic to penicillin."), (2, 0, "medications", "- aspirin 81 mg daily")], "note_id long, section_pos int, section string, text string")
    transcripts = spark.createDataFrame([(2, "takes aspirin 81 mg")], "note_id long, transcript string")
    patients = spark.createDataFrame([("p", ["aspirin 81 mg", "warfarin 2 mg"], ["penicillin (rash)"])], "patient_id string, medications array<string>, allergies array<string>")
    responses = spark.createDataFrame([(1, "claim_001_medication", r) for r in ("5 mg", "5  MG", "5 mg ")] + [(1, "claim_002_medication", r) for r in "abcd"] + [(1, "claim_000_medication", "x")], "note_id long, claim_id string, response string")
    told = spark.createDataFrame([(1, "claim_001_medication", 0.9, "High - sure"), (1, "claim_002_medication", 0.2, "Low - check")], "note_id long, claim_id string, confidence double, interpretation string")
    rows = notes.analyze(sections, transcripts, patients, spark.createDataFrame([(1, "p")], "note_id long, patient_id string"), responses, told).collect()
    got = {(r.note_id, r.claim_text): r for r in rows}
    assert {k: r.status for k, r in got.items()} == {(1, "aspirin 81 mg daily"): "verified", (1, "warfarin 5 mg daily"): "contradicted", (1, "zinc 10 mg"): "not_found", (1, "penicillin"): "verified", (2, "aspirin 81 mg daily"): "verified"}
    w, z = got[1, "warfarin 5 mg daily"], got[1, "zinc 10 mg"]
    assert (w.entropy, w.entropy_risk, w.confidence, w.review_tier, w.flag) == (0.0, "LOW", 0.9, "brief", "High")
    assert (z.entropy, z.entropy_risk, z.confidence, z.review_tier) == (1.0, "HIGH", 0.2, "detailed") and w.priority > z.priority > got[1, "penicillin"].priority


HEALTH = [
    ("medication", "aspirin 81 mg", "takes aspirin 81 mg", "verified", "low"), ("medication", "aspirin 81,5 mg", "aspirin 81.5 mg", "verified", "low"), ("medication", "aspirin 81 mg", "aspirin 100 mg", "contradicted", "critical"),
    ("medication", "aspirin 81 mg", "aspirin", "partial", "medium"), ("medication", "aspirin 81 mg", "nothing", "not_found", "high"), ("medication", "81 mg", "81 mg", "not_found", "high"), ("allergy", "NKDA", "no allergies", "verified", "low"),
    ("allergy", "no known allergies", "none", "verified", "low"), ("allergy", "latex rash", "latex", "verified", "low"), ("allergy", "latex rash", "x", "not_found", "critical"), ("allergy", "bees", "x", "not_found", "high"),
    ("vital_sign", "hr: 70", "", "partial", "low"), ("exam_finding", "edema", "swelling of legs", "verified", "low"), ("exam_finding", "rash", "rash", "partial", "medium"), ("plan", "rest at home", "rest at home now", "verified", "low"),
    ("plan", "a b c d", "d c b a", "partial", "low"), ("plan", "a b c d", "a", "not_found", "medium"), ("plan", None, "a", "not_found", "medium"),
]
LEGAL = [
    ("case_citation", "Ring v. Widget, 347 U.S. 483 (Cir 1954)", "in Ring v. Widget, 347 U.S. 483", "verified", "low"), ("case_citation", "Ring v. Widget, 347 U.S. 483 (Cir 1954)", "ring v. widget", "partial", "high"),
    ("case_citation", "Ring v. Widget, 3470 U.S. 483", "", "not_found", "critical"), ("statute_reference", "42 U.S.C. § 1983", "see title 42, section 1983", "verified", "low"), ("statute_reference", "42 U.S.C. § 1983", "none", "not_found", "high"),
    ("statute_reference", "Cal. Civ. Code § 9", "Cal. Civ. Code § 9", "not_found", "high"), ("contract_clause", "the governing law is X", "the governing law is X", "verified", "low"), ("contract_clause", "governing law", "Governing Law", "verified", "low"),
    ("jurisdiction", "venue", "venue", "needs_review", "medium"), ("limitation_period", "statute of limitations is 3 years", "a 3-year limit", "verified", "low"), ("limitation_period", "statute of limitations is 3 years", "x", "not_found", "medium"), ("other", "a", "a", "verified", "low"),
]


def test_healthcare_and_legal_verifiers(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(HEALTH)], "i int, k string, c string, s string, status string, risk string")
    for r in rows.select("*", verifiers.healthcare(F.col("k"), F.col("c"), F.col("s")).alias("v")).collect():
        assert (r.v.status, r.v.risk, r.v.passed) == (r.status, r.risk, r.v.passed and r.status in ("verified", "partial")), r
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(LEGAL)], "i int, k string, c string, s string, status string, risk string")
    got = rows.select("*", verifiers.legal(F.col("k"), F.col("c"), F.col("s"), F.col("c")).alias("v")).collect()
    assert [(r.v.status, r.v.risk) for r in got] == [(r.status, r.risk) for r in got]
    assert [r.v.flagged for r in got][2] and "unusual_numbers" in got[2].v.warnings


def test_finance_verifiers(spark):
    cases = [
        ("performance_figure", "annualized net return of 10%", "", "", "verified", "low"), ("performance_figure", "return of 7.5%", "it made 7.5%", "", "verified_text", "low"), ("performance_figure", "return of 9%", "", "", "not_found", "critical"),
        ("fee_disclosure", "25 bps", "", "", "verified", "low"), ("fee_disclosure", "expense ratio of 2%", "", "", "not_found", "high"), ("risk_rating", "a low risk fund", "Low risk only", "", "partial", "medium"), ("suitability", "x", "x", "", "needs_review", "high"),
        ("forward_looking", "will grow", "", "will grow; no assurance", "compliant", "medium"), ("forward_looking", "will grow", "", "will grow", "missing_disclaimer", "high"), ("guaranteed_return", "x", "x", "", "prohibited", "critical"), ("tax", "a b", "a b", "", "verified", "low"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k string, c string, s string, r string, status string, risk string")
    known = F.create_map(F.lit("1y"), F.lit(10.05)), F.create_map(F.lit("mgmt"), F.lit(0.25))
    matched = F.when(F.col("k") == "risk_rating", "low risk").otherwise("")
    got = rows.select("*", verifiers.finance(F.col("k"), F.col("c"), F.col("s"), matched, F.col("r"), *known).alias("v")).orderBy("i").collect()
    assert [(r.v.status, r.v.risk) for r in got] == [(r.status, r.risk) for r in got]
    assert got[2].v.warnings == ["return type not specified", "net or gross not specified"] and got[9].v.flagged


def test_responses_from_text_to_verdict(spark):
    said = spark.createDataFrame([(1, "It returned 10% and will grow. No assurance."), (2, "Guaranteed income."), (3, "nothing to claim")], "k long, text string")
    sources = spark.createDataFrame([(1, "", {"1y": 10.0}, {})], "k long, source string, returns map<string,double>, fees map<string,double>")
    checked = notes.verify_responses(said, sources, "finance", "k", numbers=True)
    assert {(r.k, r.claim_type, r.status) for r in checked.collect()} == {(1, "performance_figure", "verified"), (1, "forward_looking", "compliant"), (2, "guaranteed_return", "prohibited")}
    verdicts = {r.k: r for r in notes.govern_responses(checked, "k", "finance").collect()}
    assert verdicts[1].passed and not verdicts[2].passed and verdicts[2].risk == "critical" and verdicts[2].review_level == "detailed" and verdicts[2].escalation


def test_legal_responses_of_odd_rows(spark):
    cite = "Ring v. Widget, 347 U.S. 483"
    said = spark.createDataFrame([(1, f"{cite}; 42 U.S.C. § 1983; statute of limitations is 3 years"), (1, f"{cite}; 42 U.S.C. § 1983; statute of limitations is 3 years"), (2, f"{cite}; governing law; subject matter jurisdiction"), (3, None), (4, ""), (None, cite)], "k long, text string")
    sources = spark.createDataFrame([(1, f"title 42 section 1983, within 3 years of {cite}"), (2, None), (None, cite)], "k long, source string")
    checked = notes.verify_responses(said, sources, "legal", "k")
    got = Counter((r.k, r.claim_type, r.status, r.confidence, r.claim_risk, tuple(r.warnings)) for r in checked.collect())
    assert got == {
        (1, "case_citation", "verified", 0.95, "low", ()): 4,  # a response that comes twice is joined with itself
        (1, "statute_reference", "verified", 0.9, "low", ()): 4,
        (1, "limitation_period", "verified", 0.8, "low", ()): 4,
        (2, "case_citation", "not_found", 0.0, "critical", ()): 1,
        (2, "contract_clause", "not_found", 0.0, "high", ("clause not found",)): 1,
        (2, "jurisdiction", "needs_review", 0.5, "medium", ("legal analysis needed",)): 1,
    }


def test_citations_are_matched_once(spark):
    said = spark.createDataFrame([(1, "Ring v. Widget, 347 U.S. 483")], "k long, text string")
    plan = notes.verify_responses(said, said.select("k", F.col("text").alias("source")), "legal", "k")._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert plan.toString().count("regexp_extract(") <= 30  # six parts of a case, a period, and parts of a statute in two codes
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
