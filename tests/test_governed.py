"""Governed predictions and diagnostics, recommendations and the small rules beside them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from veridrift.functions import imaging, risk, text
from veridrift.functions import dashboard, domains
from veridrift.operators import analysis, audit, calibration, coverage, drift, experiment, extraction, predictive, rollup, verification
from veridrift.sources import scenarios, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_inputs_of_predictions(spark):
    rows = [("a", {"hr": 80.0, "bp": 120.0}), ("b", {"hr": 900.0, "bp": 120.0}), ("c", {"bp": None}), ("d", None), ("e", {"hr": 80.0, "bp": 1.0, "x": 5.0})]
    df = spark.createDataFrame(rows, "k string, i map<string,double>")
    ranges = {"hr": (20, 300), "x": (0, 1)}
    got = {r.k: tuple(r.v) for r in df.select("k", predictive.input_summary(F.col("i"), ["hr", "bp"], ranges, most_missing=0.5).alias("v")).collect()}
    assert got == {"a": (2, 2, 0, 0, True, []), "b": (2, 1, 1, 0, False, ["hr out of range"]), "c": (2, 0, 0, 2, False, []), "d": (2, 0, 0, 2, False, []), "e": (3, 2, 1, 0, False, ["x out of range"])}
    strict = {r.k: r.v for r in df.select("k", predictive.input_summary(F.col("i"), ["hr"], {}, reject_on_missing=True, most_missing=1.0).alias("v")).collect()}
    assert strict["c"].issues == ["Missing required input: hr"] and strict["a"].acceptable


def test_predictions_with_and_without_quantiles(spark):
    rows = [(1, {"hr": 80.0}, {"probability": 0.75}, None, None, False), (2, {"hr": 80.0}, {"other": 0.3}, 0.28, 0.32, False), (3, None, {}, None, None, False), (4, {"hr": 80.0}, {}, 0.1, 0.9, True)]
    df = spark.createDataFrame(rows, "k long, inputs map<string,double>, outputs map<string,double>, lower double, upper double, drifted boolean")
    got = {r.k: r for r in predictive.analyze_predictions(df, ["k"], ["hr"], {}).collect()}
    assert (got[1].lower, got[1].upper, got[1].guarantee, got[1].action) == (pytest.approx(0.65), pytest.approx(0.85), 0.0, "critical")
    assert got[1].recommended_action == "CRITICAL: Risk interval [0.65, 0.85]. Immediate clinical review required."
    assert (got[2].reliability, got[2].action, got[4].reliability) == ("reliable", "elevated", "unreliable")
    assert (got[3].reliability, got[3].lower, got[3].tracking_id, got[3].action) == ("rejected", None, None, "routine")
    assert [got[k].tracking_id for k in (1, 2, 4)] == ["PRED-000001", "PRED-000002", "PRED-000003"]
    calibrated = {r.k: r for r in predictive.analyze_predictions(df, ["k"], ["hr"], {}, threshold=0.02).collect()}
    assert calibrated[2].upper == pytest.approx(0.34) and calibrated[2].guarantee == 0.9


def test_diagnostics_from_scores(spark):
    shape = "patient_id string, study_id long, study_date date, p array<double>, concerns array<string>, site long, indication string, symptoms array<string>"
    rows = [("a", 1, date(2024, 1, 5), [0.95, 0.05], [], 0, "", []), ("a", 2, date(2024, 1, 9), [0.05, 0.95], None, 0, "", []), ("b", 3, date(2024, 1, 5), [0.5, 0.5], ["edge_artifact"] * 3, 0, "", []), ("b", 4, date(2024, 1, 5), [0.9, 0.1], None, 1, "", [])]
    priors = spark.createDataFrame([("a", 1, date(2024, 1, 5), ["nodule"])], "patient_id string, study_id long, study_date date, findings array<string>")
    drifted = spark.createDataFrame([(1, True)], "site long, significant boolean")
    got = {r.study_id: r for r in predictive.analyze_diagnostics(spark.createDataFrame(rows, shape), 0.3, ["nodule", "mass"], priors, drifted, "site").collect()}
    assert [(got[i].risk, got[i].review_level, got[i].change) for i in (1, 2, 3, 4)] == [("low", "none", "unknown"), ("low", "standard", "new"), ("invalid", "reject", "unknown"), ("uncertain", "detailed", "unknown")]


def test_messages_of_documents(spark):
    shape = "k string, claim_id string, claim_text string, status string, risk string, faithfulness string, faithfulness_score double"
    rows = [("d", "2", "b", "contradiction", "critical", None, None), ("d", "1", "a", "contradiction", "critical", None, None), ("d", "3", "c", "not_found", "high", "hallucinated", 0.15), ("d", "4", "x", "not_found", "low", "faithful", 0.9), ("d", "5", "y", "not_found", "medium", None, None), ("e", "1", "z", "verified", "low", None, None)]
    got = {r.k: r for r in rollup.document_recommendations(spark.createDataFrame(rows, shape), "k").collect()}
    assert got["d"].recommendations == [rollup.CRITICAL_CLAIMS % 2, "   • a", "   • b", rollup.HIGH_CLAIMS % 1, rollup.FABRICATED_CLAIMS % 1, "   • c (HHEM=0.15)", rollup.NEW_CLAIMS % 1, rollup.OPEN_CLAIMS % 1]
    assert got["e"].recommendations == [rollup.ALL_WELL] and got["d"].overall_risk == "critical"
    claims = spark.createDataFrame([("n", "c2", "a", "high"), ("n", "c1", "a", "high"), ("n", "c3", None, "low")], "k string, claim_id string, claim_type string, risk string")
    assert [tuple(r) for r in rollup.claim_summary(claims, "k").collect()] == [("n", 3, {"a": 2}, 2, 0, 1, ["c1", "c2"])]


def test_alerts_bands_and_switches(spark):
    stats = spark.createDataFrame([("a", 60, 0.7), ("b", 60, 0.83), ("c", 40, 0.1), ("d", 60, 0.9)], "k string, n_outcomes int, coverage double")
    assert {(r.k, r.severity, r.message) for r in coverage.coverage_alerts(stats).collect()} == {("a", "critical", "Coverage dropped to 70.0% (target: 90.0%)"), ("b", "warning", "Coverage dropped to 83.0% (target: 90.0%)")}
    values = spark.createDataFrame([(v,) for v in (0.05, 0.1, 0.25, 0.3, 0.6)], "v double").select(drift.feature_severity(F.col("v")).alias("s")).collect()
    assert [r.s for r in values] == ["none", "low", "medium", "high", "critical"]
    assert one(spark, drift.alert_text(F.lit("age"), F.lit("high"))) == "HIGH drift in age" and one(spark, drift.alert_text(F.lit("age"), F.lit("none"))) is None
    asked = spark.createDataFrame([("verified",), ("contradicted",), ("not_found",), ("partial",), (None,)], "s string").select(risk.should_run_entropy(F.col("s"), not_found=False).alias("v")).collect()
    assert [r.v for r in asked] == [False, True, False, True, True]
    results = spark.createDataFrame([("verified", "low", 1, False, False), ("verified", "high", 3, True, True)], "status string, point_risk string, set_size int, point_review boolean, set_review boolean")
    counted = {(r.measure, r.value): r.n for r in experiment.distributions(results).collect()}
    assert counted["status", "verified"] == 2 and counted["set_size", "3"] == 1 and counted["set_review", "true"] == 1


def test_rules_of_keys_without_rows(spark):
    rules = spark.createDataFrame([("hr", "required", None, None, None, False, "critical")], "input string, kind string, low double, high double, expected string, allow boolean, severity string")
    values = spark.createDataFrame([(1, "hr", "80")], "k long, input string, value string")
    got = verification.check_rules(values, rules, "k", keys=spark.createDataFrame([(1,), (2,)], "k long")).collect()
    assert {(r.k, r.is_valid, tuple(r.failures)) for r in got} == {(1, True, ()), (2, False, ("hr:missing",))}


def test_projections_of_claims_and_documents(spark):
    claims = spark.createDataFrame([("1", "n", "Aspirin  81 mg", "high", "x"), ("2", "n", "aspirin 81 MG", "low", "y"), ("3", "n", "zinc", None, "z")], "claim_id string, note string, claim_text string, risk string, other string")
    assert [r.claim_id for r in extraction.distinct_claims(claims, "note", "claim_text", "claim_id").orderBy("claim_id").collect()] == ["1", "3"]
    assert {r.claim_id for r in analysis.without_low_risk(claims).collect()} == {"1", "3"} and analysis.without_low_risk(claims, keep_low=True).count() == 3
    assert {r.claim_id for r in analysis.residual(claims, claims.where("claim_id = '1'"), claims.where("claim_id = '1'"), key="claim_id").collect()} == {"2", "3"}
    assert one(spark, analysis.source_text(F.lit(""), F.array(F.lit("a"), F.lit("b")))) == "a b" and one(spark, analysis.source_text(F.lit("s"), F.array(F.lit("a")))) == "s"
    docs = spark.createDataFrame([("cerner_1", "ai_scribe"), ("cerner_2", "nurse")], "document_id string, author_type string")
    assert [r.document_id for r in analysis.ai_documents(docs).collect()] == ["cerner_1"] and analysis.single_document(docs, "2").count() == analysis.single_document(docs, "cerner_2").count() == 1
    assert tuple(audit.author_counts(docs).first()) == (2, 1, 0.5)
    entries = spark.createDataFrame([("n", "1", ["a"], "brief"), ("n", "2", [], "detailed")], "note string, claim_id string, flags array<string>, review_tier string")
    entry = audit.audit_entry(entries, "note").first()
    assert ([f.claim_id for f in entry.flagged], entry.needs_review, entry.n_claims) == (["1"], 1, 2)
    checked = spark.createDataFrame([("t", "medication", "verified", "m", 0.9, "e", 1)], "claim_text string, claim_type string, status string, ehr_match string, confidence double, explanation string, extra int")
    assert "extra" not in analysis.record_results(checked).columns


def test_texts_scores_and_estimates(spark):
    assert one(spark, text.preview(F.lit("abcdef"), 3)) == "abc..." and one(spark, text.preview(F.lit("abc"), 3)) == "abc"
    assert one(spark, calibration.level_confidence(F.lit(0.9), F.lit(0.2))) == 0.5
    assert one(spark, dashboard.point_estimate(F.create_map(F.lit("x"), F.lit(0.2), F.lit("score"), F.lit(0.7)))) == 0.7
    assert tuple(one(spark, dashboard.coverage_verdict(F.lit(0.9), F.lit(0.895)))) == (pytest.approx(0.005), True)
    assert one(spark, imaging.study_age_days(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 31)))) == 30 and one(spark, imaging.study_age_days(F.lit(None).cast("date"), F.lit(date(2024, 1, 31)))) == 365
    regions = F.array(F.struct(F.lit("lung").alias("name"), F.array(F.lit("nodule")).alias("expected_for")))
    assert one(spark, imaging.expected_region(regions, F.lit("nodule"))).name == "lung" and one(spark, imaging.expected_region(regions, F.lit("x"))) is None
    assert one(spark, imaging.score_description(F.lit(7), "NEWS")).startswith("High risk") and one(spark, imaging.score_description(F.lit(1), "qSOFA")) == "Low risk of sepsis" and one(spark, imaging.score_description(F.lit(3), "SOFA")) == "Score: 3"
    assert one(spark, risk.action_level(F.lit(0.6), F.lit(0.3), F.lit(0.5), F.lit(0.8))) == "urgent" and one(spark, risk.supplied_or_half(F.lit(0.0))) == 0.5
    assert one(spark, domains.has_disclaimer(F.lit("There is no assurance"))) and not one(spark, domains.has_disclaimer(F.lit("x")))


def test_stand_in_tables_and_logs(spark, tmp_path):
    assert {r.study_id for r in scenarios.prior_studies(spark).collect()} == {"XR-2023-001", "XR-2022-045"}
    assert scenarios.image_metadata(spark.createDataFrame([("s",)], "study_id string")).first().modality == "CR"
    said = one(spark, scenarios.paraphrases(F.lit("Patient is on aspirin"), 3))
    assert said == ["Patient is on aspirin", "Patient is on aspirin, as documented", "The patient is prescribed aspirin"]
    patients = spark.createDataFrame([("12742400",), ("1",), ("12724066",)], "patient_id string")
    assert {r.patient_id for r in scenarios.search_patients(patients).collect()} == {"12742400", "12724066"} and scenarios.search_patients(patients, count=1).count() == 1
    writers.write_run_metadata(spark, f"{tmp_path}/run", {"alpha": 0.1}, {"n": 3})
    assert spark.read.json(f"{tmp_path}/run").first().results.n == 3
    writers.append_model_log(spark.createDataFrame([("t" * 2000, 0.0, 0.4, 0.9)], "text string, entropy double, uncertainty double, confidence double"), f"{tmp_path}/log")
    row = spark.read.parquet(f"{tmp_path}/log").first()
    assert len(row.text) == 1000 and row.score == 0.4
