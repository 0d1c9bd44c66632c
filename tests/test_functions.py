"""Column functions on small rows, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from veridrift.functions import clinical, domains, medication, risk, text, uncertainty


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalized_and_collapsed(spark):
    got = values(spark, [(" \tAb  C\n",), ("",), (None,)], "t string", text.normalized("t"), text.collapsed("t"))
    assert got == [("ab  c", "ab c"), ("", ""), (None, None)]


@pytest.mark.parametrize(
    "given,value,unit",
    [
        ("Acetaminophen 500mg PRN", 500.0, "mg"),
        ("Metoprolol 100 mg BID", 100.0, "mg"),
        ("Lisinopril 2.5 mg daily", 2.5, "mg"),
        ("digoxin 5 mcg/kg", 5.0, "mcg/kg"),
        ("saline 1,000 mL", 1000.0, "ml"),
        ("insulin 10 unit", 10.0, "units"),
        ("x 3 micrograms", 3.0, "mcg"),
        ("aspirin", None, None),
    ],
)
def test_dose(spark, given, value, unit):
    assert values(spark, [(given,)], "t string", medication.dose(F.col("t"))) == [((value, unit),)]


def test_doses_match_within_a_tenth_and_across_units(spark):
    rows = [("a 500 mg", "a 0.5 g"), ("a 100 mg", "a 111 mg"), ("a 100 mg", "a 112 mg"), ("a", "a 5 mg"), ("a 0 mg", "a 0 mg")]
    got = values(spark, rows, "a string, b string", medication.doses_match(medication.dose(F.col("a")), medication.dose(F.col("b"))))
    assert [g[0] for g in got] == [True, True, False, True, True]


def test_drug_names_and_brands(spark):
    rows = [("amLODIPine (Norvasc) 5mg",), ("metoprolol tartrate 25mg",), ("Tylenol 500 mg",), ("(x)",)]
    got = values(spark, rows, "t string", medication.drug_name(F.col("t")), medication.generic_name(medication.drug_name(F.col("t"))))
    assert got == [("amlodipine", "amlodipine"), ("metoprolol", "metoprolol"), ("tylenol", "acetaminophen"), ("", "")]


@pytest.mark.parametrize(
    "claim,records,kind,matched",
    [
        ("Lipitor 20 mg", ["aspirin 81 mg", "atorvastatin 20 mg", "atorvastatin 20 mg daily"], "exact", "atorvastatin 20 mg"),
        ("warfarin 10 mg", ["warfarin 5 mg"], "dose_mismatch", "warfarin 5 mg"),
        ("warfarin 10 mg", ["warfarin 5 mg", "warfarin"], "name_only", "warfarin"),
        ("warfarin 10 mg", ["warfarin", "warfarin 5 mg"], "dose_mismatch", "warfarin 5 mg"),
        ("warfarin", ["warfarin 5 mg"], "name_only", "warfarin 5 mg"),
        ("warfarin 5 mg", [], "not_found", None),
        ("warfarin 5 mg", None, "not_found", None),
        ("warfarin 5 mg", ["", "5 mg"], "not_found", None),
        ("", ["warfarin"], "no_name", None),
    ],
)
def test_medication_match(spark, claim, records, kind, matched):
    got = values(spark, [(claim, records)], "c string, r array<string>", medication.medication_match(F.col("c"), F.col("r")))[0][0]
    assert (got["kind"], got["matched"], got["matches"]) == (kind, matched, kind in ("exact", "name_only"))


@pytest.mark.parametrize(
    "claim,records,matched",
    [
        ("allergic to Penicillin", ["Sulfa", "penicillin V"], "penicillin V"),
        ("NKDA", ["No known allergies"], "No known allergies"),
        ("NKDA", ["penicillin"], None),
        ("NKDA", [], None),
        ("allergic to cats", ["cats"], None),
    ],
)
def test_allergy_match(spark, claim, records, matched):
    got = values(spark, [(claim, records)], "c string, r array<string>", medication.allergy_match(F.col("c"), F.col("r")))[0][0]
    assert (got["matches"], got["matched"]) == (matched is not None, matched)


def test_similarity_and_faithfulness(spark):
    rows = [("aspirin daily", "takes aspirin daily now"), ("aspirin daily", "aspirin weekly"), ("aspirin", "nothing"), ("", "x")]
    got = values(spark, rows, "a string, b string", text.similarity("a", "b"), F.round(text.faithfulness("a", "b"), 4), text.faithfulness_level(text.faithfulness("a", "b")))
    assert got == [(1.0, 0.95, "faithful"), (0.5, 0.625, "partially_faithful"), (0.0, 0.15, "hallucinated"), (1.0, 0.95, "faithful")]
    assert values(spark, rows[:1], "a string, b string", text.faithfulness("a", "b", {"Aspirin": 0.1})) == [(0.1,)]


def test_overlap_of_larger_is_false_for_empty(spark):
    assert values(spark, [("a b c d", "a b"), ("", "")], "a string, b string", text.overlap_of_larger("a", "b")) == [(0.5,), (0.0,)]


@pytest.mark.parametrize("given,stated", [("I am 85% confident", 0.85), ("300% sure", 1.0), ("definitely", 0.9), ("it might be uncertain", 0.9), ("it might be", 0.4), ("probably", 0.7), ("hm", None)])
def test_stated_confidence(spark, given, stated):
    assert values(spark, [(given,)], "t string", uncertainty.stated_confidence(F.col("t"))) == [(stated,)]


def test_wording_and_calibration(spark):
    got = values(spark, [("Maybe it could be? not sure",)], "t string", uncertainty.wording_parts(F.col("t")))[0][0]
    assert (round(got["hedging"], 2), round(got["question"], 2), round(got["negation"], 2)) == (0.3, 0.2, 0.2)
    got = values(spark, [(0.2,), (0.5,), (0.8,)], "u double", F.round(uncertainty.calibration_curve(F.col("u")), 4), uncertainty.interpretation(F.col("u")))
    assert got == [(0.26, "low"), (0.5, "moderate"), (0.78, "very_high")]


def test_confidence_tiers(spark):
    got = values(spark, [(0.95, "high"), (0.85, "high"), (0.85, "low"), (0.6, "low"), (0.5, "low")], "c double, r string", uncertainty.review_tier(F.col("c"), F.col("r")))
    assert [g[0] for g in got] == ["standard", "detailed", "brief", "standard", "detailed"]
    assert values(spark, [(0.7, 1.0, 0.0), (0.9, 0.5, 3.0)], "s double, c double, h double", uncertainty.calibrated_confidence(F.col("s"), F.col("c"), F.col("h"))) == [(0.91,), (0.2,)]


def test_ensemble_uncertainty(spark):
    got = values(spark, [([[1.0, 2.0], [1.0, 2.0]],), ([[0.0, 0.0], [0.02, 0.0]],)], "e array<array<double>>", F.round(uncertainty.ensemble_uncertainty(F.col("e")), 6))
    assert got == [(0.0,), (0.05,)]


@pytest.mark.parametrize(
    "status,faithful,entropy,expected",
    [
        ("verified", None, None, "low"),
        ("not_checkable", None, None, "low"),
        ("not_found", "faithful", None, "low"),
        ("not_found", "partially_faithful", None, "medium"),
        ("not_found", "hallucinated", None, "high"),
        ("not_found", None, None, "medium"),
        ("contradiction", "faithful", "low", "high"),
        ("contradiction", "hallucinated", "low", "critical"),
        ("contradiction", None, "medium", "high"),
        ("contradiction", "hallucinated", "high", "medium"),
    ],
)
def test_first_pass_risk(spark, status, faithful, entropy, expected):
    got = values(spark, [(status, faithful, entropy)], "s string, f string, e string", risk.first_pass_risk(F.col("s"), F.col("f"), F.col("e")))
    assert got == [(expected,)]


def test_priority_score(spark):
    rows = [("contradicted", 0.1, 0.5, "detailed", "high", 2), ("contradicted", 0.8, 1.0, "brief", "low", 0), ("not_found", None, 0.5, "standard", "low", 1), ("verified", 0.4, 1.0, "brief", "low", 0)]
    got = values(spark, rows, "s string, h double, c double, t string, r string, f int", risk.priority_score(*[F.col(x) for x in "shctrf"]))
    assert [g[0] for g in got] == [191.0, 70.0, 48.0, 6.0]


def test_confident_hallucinator(spark):
    rows = [(0.1, False, True), (0.1, True, False), (0.1, False, False), (0.5, False, True), (0.5, True, False), (0.5, False, False)]
    got = [r[0] for r in values(spark, rows, "h double, v boolean, c boolean", risk.confident_hallucinator(F.col("h"), F.col("v"), F.col("c")))]
    assert [g["risk"] for g in got] == ["critical", "low", "medium", "high", "medium", "high"]
    assert [g["detected"] for g in got] == [True] + [False] * 5


def test_predicted_risk(spark):
    rows = [("VERIFIED", None, None, "x"), ("not_found", 0.6, None, "x"), ("not_found", None, None, "x"), ("contradiction", 0.9, 0.7, "x"), ("contradiction", 0.9, 0.1, "x"), ("contradiction", 0.1, None, "warfarin 5mg"), ("odd", None, None, "x")]
    got = [r[0] for r in values(spark, rows, "s string, f double, h double, c string", risk.predicted_risk(*[F.col(x) for x in "sfhc"]))]
    assert [(g["risk_score"], g["review_level"]) for g in got] == [(0.05, "BRIEF"), (0.15, "STANDARD"), (0.85, "DETAILED"), (0.5, "STANDARD"), (0.8, "DETAILED"), (1.0, "CRITICAL"), (0.5, "STANDARD")]


def test_clinical_scores(spark):
    vitals = {k: F.col(k) for k in ("respiratory_rate", "oxygen_saturation", "temperature", "systolic_bp", "heart_rate", "level_of_consciousness")}
    rows = [(16.0, 98.0, 37.0, 120.0, 75.0, 15.0), (24.0, 93.0, 38.9, 90.0, 110.0, 14.0), (None, None, None, None, None, None)]
    schema = "respiratory_rate double, oxygen_saturation double, temperature double, systolic_bp double, heart_rate double, level_of_consciousness double"
    assert [r[0] for r in values(spark, rows, schema, clinical.news(vitals))] == [0, 12, 0]
    got = values(spark, [(24, 90, True), (21, 101, False)], "r int, s int, a boolean", clinical.qsofa(F.col("r"), F.col("s"), F.col("a")))
    assert got == [(3,), (0,)]
    assert values(spark, [("sepsis", 0.4), ("mortality", 0.05), ("odd", 1.0)], "k string, s double", clinical.action_for(F.col("k"), F.col("s"))) == [("urgent",), ("routine",), (None,)]


def test_phi(spark):
    rows = [("SSN 123-45-6789",), ("call 5551234567",), ("mail a@b.co",), ("on 1/2/2024",), ("none",)]
    got = values(spark, rows, "t string", domains.phi_kind(F.col("t")), domains.redacted(F.col("t")))
    assert got == [("ssn", "SSN [SSN]"), ("phone", "call [PHONE]"), ("email", "mail [EMAIL]"), ("date", "on [DATE]"), (None, "none")]


def test_redaction_seeks_addresses_where_an_at_sign_is(spark):
    long = "a." * 20000
    rows = [(None,), ("",), ("@",), ("a@b",), ("x@y.org, 123-45-6789@b.co, 5551234567@c.de; 1/2/2024",), ("\u00e9.a@b.co +a@b.co|",), ("1/2/24 5551234567 123-45-6789",), (long,)]
    got = [r[0] for r in values(spark, rows, "t string", domains.redacted(F.col("t")))]
    assert got == [None, "", "@", "a@b", "[EMAIL], [SSN]@b.co, [PHONE]@c.de; [DATE]", "\u00e9[EMAIL] +[EMAIL]|", "[DATE] [PHONE] [SSN]", long]
    plan = spark.createDataFrame(rows, "t string").select(domains.redacted(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "WHEN Contains(t#" in plan  # in an unbroken run the pattern's cost grows with the square of its length


def test_compliance(spark):
    rows = [("guaranteed return of 5%",), ("it will grow",), ("it will grow. Past performance does not guarantee results",), ("I advise you to wait; privileged",)]
    got = values(spark, rows, "t string", domains.finance_flags(F.col("t")), domains.legal_flags(F.col("t")))
    assert got == [(["PROHIBITED_GUARANTEE"], []), (["MISSING_DISCLAIMER"], []), ([], []), ([], ["UNAUTHORIZED_PRACTICE", "PRIVILEGE"])]


def test_citations(spark):
    cite = "Brown v. Board of Education, 347 U.S. 483 (1954)"
    rows = [(cite, f"as held in {cite}"), (cite, "Brown v. Board of Education"), ("Smith v. Jones, 1200 F.3d 77 (2024)", "nothing")]
    got = [r[0] for r in values(spark, rows, "c string, s string", domains.case_check(domains.case_parts(F.col("c")), F.col("s")))]
    assert [(g["status"], g["risk"], g["fabricated"]) for g in got] == [("verified", "low", False), ("partial", "high", False), ("not_found", "critical", True)]
    assert got[2]["warnings"] == ["recent_case", "unusual_numbers", "generic_name"]
    parts = values(spark, [("see 42 U.S.C. § 1983(b)",), ("17 C.F.R. § 240.10",), ("none",)], "t string", domains.statute_parts(F.col("t")))
    assert [tuple(p[0]) for p in parts] == [("42", "U.S.C.", "1983", "b"), ("17", "C.F.R.", "240.10", None), (None, None, None, None)]


def test_finance_parts(spark):
    rows = [("annualized net return of 12.5%",), ("YTD gross -3%",), ("total 4%",), ("up 2%",)]
    assert [tuple(r[0]) for r in values(spark, rows, "t string", domains.return_parts(F.col("t")))] == [(12.5, "annualized", "net"), (-3.0, "YTD", "gross"), (4.0, "cumulative", None), (2.0, "unknown", None)]
    rows = [("expense ratio of 0.75%",), ("management fee 25 bps",), ("load of 5%",), ("none",)]
    assert [tuple(r[0]) for r in values(spark, rows, "t string", domains.fee_parts(F.col("t")))] == [(0.75, "expense_ratio"), (0.25, "management_fee"), (5.0, "load"), (None, "unknown")]


@pytest.mark.parametrize(
    "kind,claim,said,status,score,needs",
    [
        ("medication", "aspirin 81 mg", "You take aspirin 81 mg daily", "verified", 1.0, False),
        ("medication", "aspirin 81 mg", "You take aspirin 325 mg", "contradicted", 0.3, True),
        ("medication", "aspirin 81 mg", "You take aspirin", "partial", 0.6, True),
        ("medication", "aspirin 81 mg", "nothing", "not_found", 0.0, True),
        ("allergy", "NKDA", "no allergies", "verified", 1.0, False),
        ("allergy", "NKDA", "none", "verified", 0.9, False),
        ("allergy", "penicillin", "penicillin rash", "verified", 1.0, False),
        ("allergy", "penicillin", "fine", "not_found", 0.0, True),
        ("vital_sign", "BP 120/80", "", "partial", 0.5, False),
        ("exam_finding", "edema", "some swelling", "verified", 0.8, False),
        ("exam_finding", "rash", "some swelling", "partial", 0.5, True),
        ("other", "walks daily", "he WALKS  daily", "verified", 1.0, False),
    ],
)
def test_transcript_check(spark, kind, claim, said, status, score, needs):
    got = values(spark, [(kind, claim, said)], "k string, c string, s string", domains.transcript_check(F.col("k"), F.col("c"), F.col("s")))[0][0]
    assert tuple(got) == (status, score, needs)
