"""Operators on small tables."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridrift.operators import audit, calibration, coverage, documents, drift, entropy, extraction, rollup, training, verification
from veridrift.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n,q,rank", [(20, 0.9, 19), (100, 0.9, 91), (1, 0.9, 1), (5, 0.99, 5), (87, 0.9, 80)])
def test_conformal_rank(n, q, rank):
    assert calibration.rank_for(q, n) == rank


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.integers(0, 39))
@settings(max_examples=12, deadline=None)
def test_kth_smallest(spark, values, at):
    k = at % len(values) + 1
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert calibration.kth_smallest(df, "v", k) == sorted(values)[k - 1]


def test_kth_smallest_narrows_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(calibration, "_FEW", 3)
    df = spark.range(5000).select((F.col("id") * F.col("id") % 4001).cast("double").alias("v"))
    want = sorted(float(i * i % 4001) for i in range(5000))
    assert [calibration.kth_smallest(df, "v", k) for k in (1, 777, 5000)] == [want[0], want[776], want[4999]]


def test_threshold_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        calibration.conformal_threshold(spark.createDataFrame([], "s double"), "s")


def test_coverage_of_calibration_rows(spark):
    df = spark.range(500).select(((F.col("id") * 37 % 500) / 500.0).alias("s"))
    got = calibration.conformal_threshold(df, "s", 0.9).first()
    assert got.coverage >= 0.9 and got.n == 500


def test_sets(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],), ([0.2, 0.4, 0.4],)], "p array<double>")
    sets = lambda c: [r[0] for r in df.select(c).collect()]
    assert sets(calibration.prediction_set(F.col("p"), F.lit(0.7))) == [[0, 1], [1, 2]]
    assert sets(calibration.adaptive_set(F.col("p"), F.lit(0.6))) == [[0, 1], [1, 2]]
    assert sets(calibration.adaptive_set(F.col("p"), F.lit(0.5))) == [[0], [1, 2]]
    assert sets(calibration.adaptive_set(F.col("p"), F.lit(0.5), penalty=0.1)) == [[0, 1], [1, 2]]
    assert sets(F.round(calibration.mass_before(F.col("p"), F.lit(2)), 6)) == [0.8, 0.4]
    assert sets(F.round(calibration.mass_before(F.col("p"), F.lit(9)), 6)) == [1.0, 1.0]
    assert sets(calibration.true_class_score(F.col("p"), F.lit(9))) == [1.0, 1.0]


def test_levels(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.55,), (1.0,), (1.7,)], "s double")
    got = rows(df.select("s", calibration.score_level(F.col("s")), calibration.level_set(F.col("s"), F.lit(0.1))))
    assert got == [(0.0, "BRIEF", ["BRIEF"]), (0.2, "STANDARD", ["BRIEF", "STANDARD"]), (0.55, "DETAILED", ["STANDARD", "DETAILED"]), (1.0, "CRITICAL", ["CRITICAL"]), (1.7, "CRITICAL", ["CRITICAL"])]


def test_bins_differ_between_fit_and_lookup(spark):
    df = spark.createDataFrame([(0.3, 1), (1.0, 0)], "p double, y int")
    fitted = calibration.fit_bins(df, "p", "y")
    assert {r.bin: r.n for r in fitted.collect() if r.n} == {2: 1, 9: 1}
    assert calibration.apply_bins(df, fitted, "p").where("p = 0.3").first().calibrated == 0.3  # bin 3 is empty


def test_ece_drops_after_binning_and_empty_is_zero(spark):
    df = spark.range(800).select((F.col("id") % 100 / 100.0).alias("p"), ((F.col("id") * 13 % 100) < F.col("id") % 100 * 0.5).cast("int").alias("y"))
    before = calibration.expected_calibration_error(df, "p", "y").first().ece
    after = calibration.expected_calibration_error(calibration.apply_bins(df, calibration.fit_bins(df, "p", "y"), "p").select(F.col("calibrated").alias("p"), "y"), "p", "y").first().ece
    assert after < before
    empty = df.limit(0)
    assert calibration.expected_calibration_error(empty, "p", "y").first().ece == 0.0 and calibration.brier(empty, "p", "y").first().brier == 0.0
    assert calibration.reliability_curve(empty, "p", "y").count() == 10


def test_entropy_of_two_two_one(spark):
    df = spark.createDataFrame([(1, c) for c in "aabbc"] + [(2, "a")] * 5, "item int, r string")
    got = {r.item: r for r in entropy.semantic_entropy(entropy.cluster_sizes(df, "item", F.col("r")), "item", requested=5).collect()}
    assert got[1].entropy_bits == pytest.approx(1.521928, abs=1e-6) and got[1].entropy_of_k == pytest.approx(0.96023, abs=1e-5)
    assert got[1].entropy_of_requested == pytest.approx(1.521928 / math.log2(5), abs=1e-6)
    assert (got[2].entropy_bits, got[2].entropy_of_n, got[2].entropy_of_k) == (0.0, 0.0, 0.0)


def test_clusters(spark):
    df = spark.createDataFrame([("Yes it was mentioned",), ("not mentioned",), ("hm",), ("known",), ("incorrect",)], "r string")
    assert [r[0] for r in df.select(entropy.yes_no_cluster(F.col("r"))).collect()] == ["yes", "no", "unclear", "no", "unclear"]
    assert df.select(entropy.verdict_cluster(F.col("r")), entropy.verdict_cluster(F.col("r"), strict=True)).collect()[4] == ("verified", "contradiction")
    items = spark.createDataFrame([(1, i) for i in range(4)], "item int, pos int")
    pairs = spark.createDataFrame([(1, a, b) for a, b in [(0, 2), (2, 0), (2, 3), (3, 2), (1, 0)]], "item int, premise int, hypothesis int")
    got = {r.pos: r.cluster_id for r in entropy.entailment_clusters(items, pairs, "item", "pos").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 2}  # 3 matches 2, but only first members count


def test_psi_and_ks(spark):
    same = spark.range(200).select(F.lit("f").alias("f"), (F.col("id") % 50).cast("double").alias("v"), (F.col("id") < 100).alias("cur"))
    assert drift.psi(same, "f", "v", F.col("cur")).first().psi == pytest.approx(0, abs=1e-9)
    assert drift.ks(same, "f", "v", F.col("cur")).first().ks == 0.0
    moved = spark.range(200).select(F.lit("f").alias("f"), F.when(F.col("id") < 100, F.col("id")).otherwise(F.col("id") + 100).cast("double").alias("v"), (F.col("id") < 100).alias("cur"))
    assert drift.ks(moved, "f", "v", F.col("cur")).first().ks == 1.0
    report = drift.drift_report(moved, "f", "v", F.col("cur")).first()
    assert report.drifted and report.severity == "critical"
    one_side = same.where("cur")
    assert drift.psi(one_side, "f", "v", F.col("cur")).first().psi == 0.0
    flat = same.withColumn("v", F.lit(1.0))
    assert drift.psi(flat, "f", "v", F.col("cur")).first().psi == 0.0 and drift.ks(flat, "f", "v", F.col("cur")).first().ks == 0.0


def test_ks_equals_brute_force(spark):
    values = [((i * 7919) % 101 / 10.0, i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame([("f", v, c) for v, c in values], "f string, v double, cur boolean")
    a, b = [v for v, c in values if c], [v for v, c in values if not c]
    want = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t, _ in values)
    assert drift.ks(df, "f", "v", F.col("cur")).first().ks == pytest.approx(want, abs=1e-12)


def test_rolling_coverage(spark):
    df = spark.createDataFrame([("m", i, i % 4 != 0) for i in range(20)], "k string, seq_in int, ok boolean")
    got = {r.seq_in: r for r in coverage.rolling(df, "k", ["seq_in"], F.col("ok"), window=4).collect()}
    assert got[0].rolling_coverage == 0.0 and got[3].rolling_coverage == 0.75 and got[19].rolling_coverage == 0.75
    assert not got[0].degraded and got[19].degraded
    windows = coverage.tumbling(df, "k", ["seq_in"], F.col("ok"), window=8).orderBy("window_id").collect()
    assert [w.n for w in windows] == [8, 8, 4]
    assert coverage.drift(df, "k", ["seq_in"], F.col("ok"), window=8).first().severity == "high"


def test_calibration_stats_without_outcomes(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 1.0), ("b", 2, 0.0, 1.0)], "k string, prediction_id int, lower double, upper double")
    o = spark.createDataFrame([(1, 5.0), (99, 0.5)], "prediction_id int, outcome double")
    got = {r.k: r for r in coverage.calibration_stats(p, o, "k").collect()}
    assert (got["a"].coverage, got["a"].n_outcomes, got["a"].alert) == (0.0, 1, "critical")
    assert (got["b"].coverage, got["b"].mean_width, got["b"].alert) == (1.0, 0.0, "none")


GOLDEN = [
    ("c1", "Metoprolol 50 mg BID", "medication"),
    ("c2", "Lisinopril 10 mg daily", "medication"),
    ("c3", "Warfarin 10 mg daily", "medication"),
    ("c4", "Allergic to Penicillin", "allergy"),
    ("c5", "Hypertension", "diagnosis"),
    ("c6", "Atrial fibrillation", "diagnosis"),
    ("c7", "Aspirin 81 mg", "medication"),
    ("c8", "Diabetes", "diagnosis"),
    ("c9", "Allergic to shellfish", "allergy"),
    ("c10", "Colonoscopy", "procedure"),
]
FACTS = [
    ("MedicationStatement", 0, "Metoprolol", "50 mg"),
    ("MedicationStatement", 1, "Lisinopril", "10 mg"),
    ("MedicationStatement", 2, "Warfarin", "5 mg"),
    ("AllergyIntolerance", 0, "Penicillin", None),
    ("Condition", 0, "Hypertension", None),
    ("Condition", 1, "Atrial fibrillation", None),
]


def test_ten_claims_against_the_record(spark):
    claims = spark.createDataFrame([("p", *c) for c in GOLDEN], "patient_id string, claim_id string, claim_text string, claim_type string")
    facts = spark.createDataFrame([("p", *f, True) for f in FACTS], "patient_id string, resource_type string, pos int, name string, detail string, active boolean")
    got = {r.claim_id: r.status for r in verification.first_pass(claims, facts).collect()}
    counts = {s: list(got.values()).count(s) for s in set(got.values())}
    assert counts == {"verified": 5, "not_found": 4, "contradiction": 1} and got["c3"] == "contradiction"


def test_no_allergies_claimed(spark):
    claims = spark.createDataFrame([("p", "a", "NKDA", "allergy"), ("q", "b", "NKDA", "allergy"), ("q", "c", "?", "odd")], "patient_id string, claim_id string, claim_text string, claim_type string")
    facts = spark.createDataFrame([("p", "AllergyIntolerance", 0, "Latex", None, True), ("q", "AllergyIntolerance", 0, "Latex", None, False)], "patient_id string, resource_type string, pos int, name string, detail string, active boolean")
    assert {r.claim_id: r.status for r in verification.first_pass(claims, facts).collect()} == {"a": "contradiction", "b": "verified", "c": "not_checkable"}


def test_records_transcript_and_merge(spark):
    claims = spark.createDataFrame([("p", "n", "1", "medication", "aspirin 81 mg"), ("x", "n", "2", "medication", "aspirin"), ("p", "n", "3", "allergy", "NKDA"), ("p", "m", "4", "plan", "rest")], "patient_id string, note_id string, claim_id string, claim_type string, claim_text string")
    patients = spark.createDataFrame([("p", ["Aspirin 325 mg"], ["latex"])], "patient_id string, medications array<string>, allergies array<string>")
    records = verification.against_records(claims, patients)
    assert {r.claim_id: r.ehr_status for r in records.collect()} == {"1": "contradicted", "2": "ehr_unavailable", "3": "contradicted", "4": "ehr_unavailable"}
    said = spark.createDataFrame([("n", "takes aspirin 81 mg")], "note_id string, transcript string")
    checked = verification.against_transcript(claims, said)
    assert {r.claim_id: r.status for r in checked.collect()} == {"1": "verified", "2": "partial", "3": "not_found", "4": "not_found"}
    merged = {r.claim_id: r.status for r in verification.merge_results(checked, records).collect()}
    assert merged == {"1": "contradicted", "2": "partial", "3": "contradicted", "4": "not_found"}


def test_latest_prior_is_strictly_before(spark):
    now = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("b", 1, "z")], "k string, t int, v string")
    before = spark.createDataFrame([("a", 3, 30), ("a", 4, 40), ("b", 1, 10)], "k string, t int, w int")
    got = {r.v: (r.prior_at, r.prior and r.prior.w) for r in verification.latest_prior(now, before, "k", "t").collect()}
    assert got == {"x": (4, 40), "y": (None, None), "z": (None, None)}


def test_finding_changes(spark):
    now = spark.createDataFrame([("p", ["Small nodule", "edema"]), ("q", ["edema"])], "patient_id string, findings array<string>")
    old = spark.createDataFrame([("p", "2020", ["fracture"]), ("p", "2021", ["nodule", "effusion"])], "patient_id string, study_date string, findings array<string>")
    got = {r.patient_id: r for r in verification.finding_changes(now, old).collect()}
    assert (got["p"].stable, got["p"].new, got["p"].resolved) == (["Small nodule"], ["edema"], ["effusion"])
    assert (got["q"].stable, got["q"].new, got["q"].resolved) == ([], ["edema"], [])


def test_injections_detected(spark):
    fake = spark.createDataFrame([("n", 1, "Heparin"), ("n", 2, "Fever"), ("m", 3, "x")], "note_id string, id int, fake_claim string")
    claims = spark.createDataFrame([("n", "heparin 5 mg", "not_found"), ("n", "fever", "verified")], "note_id string, claim_text string, status string")
    assert {r.id: r.detected for r in verification.detected_injections(fake, claims).collect()} == {1: True, 2: False, 3: False}


def test_numeric_match(spark):
    claims = spark.createDataFrame([(1, "f", 100.0), (2, "f", 50.0), (3, "g", 1.0)], "claim_id int, k string, value double")
    facts = spark.createDataFrame([("f", 0, 9, 101.0), ("f", 1, 8, 100.0)], "k string, pos int, fact_id int, fact_value double")
    assert {r.claim_id: r.fact_id for r in verification.numeric_match(claims, facts, "k").collect()} == {1: 9, 2: None, 3: None}


def test_rule_violations(spark):
    values = spark.createDataFrame([(1, "hr", 300.0), (1, "t", None), (2, "hr", 70.0)], "k int, input string, value double")
    rules = spark.createDataFrame([("hr", 30.0, 250.0, "error", True), ("t", 30.0, 45.0, "warning", True)], "input string, low double, high double, severity string, required boolean")
    assert rows(verification.rule_violations(values, rules, "k")) == [(1, 2, 1, 1, "hr,t"), (2, 1, 0, 0, "")]


NOTE = "Allergies: penicillin. NKDA. latex (mild rash) BP: 120/80 HR 72 SpO2 98% temp 37.5 RR 16. murmur at apex. no gallops"


def test_note_claims(spark):
    sections = spark.createDataFrame([("n", 0, "Medications", "- aspirin 81 mg\n• x\nplain\n  - statin 20 mg"), ("n", 1, "Exam", NOTE), ("n", 2, "History", "- asthma"), ("n", 3, "Empty", None)], "note_id string, section_pos int, section string, text string")
    got = [(r.claim_id, r.claim_text) for r in extraction.note_claims(sections).orderBy("pos").collect()]
    texts = [t for _, t in got]
    assert got[0] == ("claim_000_medication", "aspirin 81 mg") and texts[1] == "statin 20 mg"
    for t in ("penicillin", "NKDA", "latex mild rash", "blood_pressure: 120/80", "heart_rate: 72", "oxygen_sat: 98", "temperature: 37.5", "respiratory_rate: 16", "murmur at apex", "no gallops", "asthma"):
        assert t in texts
    assert got[-1] == (f"claim_{len(got) - 1:03d}_diagnosis", "asthma")


def test_pattern_claims_keep_the_surest(spark):
    df = spark.createDataFrame([(1, "call 555-1234 or  555-1234 or abc"), (2, None)], "k int, t string")
    got = extraction.pattern_claims(df, "k", "t", {"phone": r"(\d{3})-(\d{4})", "digits": r"\d{3}"}, before=5, after=3).collect()
    assert [(r.k, r.pos, r.claim_type, r.claim_text, r.start, r.stop) for r in got] == [(1, 0, "phone", "555-1234", 5, 13), (1, 1, "digits", "555", 18, 21), (1, 2, "digits", "123", 22, 25)]


def test_response_claims(spark):
    arr = json.dumps([{"claim_text": "a", "claim_type": "t", "source_sentence": "s"}])
    df = spark.createDataFrame([(1, arr), (2, f"here: {arr} ok"), (3, "none")], "k int, r string")
    assert rows(extraction.response_claims(df, "k", "r")) == [(1, "claim_001", "a", "t", "s"), (2, "claim_001", "a", "t", "s")]
    answers = spark.createDataFrame([('{"risk_score": 1.4, "review_level": "brief"}',), ("risk_score: 0.25, level Critical",), ("?",)], "r string")
    assert [tuple(r[0]) for r in answers.select(extraction.predictor_response(F.col("r"))).collect()] == [(1.0, "BRIEF"), (0.25, "CRITICAL"), (0.5, "STANDARD")]


def test_sentence_around(spark):
    df = spark.createDataFrame([("One. Two is here! Three",)], "t string")
    assert df.select(extraction.sentence_around(F.col("t"), F.lit(9), F.lit(11))).first()[0] == "Two is here!"


def test_rollups(spark):
    claims = spark.createDataFrame([("d", "verified", 0.1, 5.0, "low", "a"), ("d", "contradicted", 0.1, 160.0, "critical", "b"), ("e", "not_found", 0.9, 30.0, "medium", "c")], "k string, status string, entropy double, priority double, risk string, claim_text string")
    got = {r.k: r for r in rollup.note_rollup(claims, "k").collect()}
    assert (got["d"].risk, got["e"].risk, got["d"].high_priority) == ("critical", "medium", 1)
    assert rows(rollup.risk_rollup(claims, "k")) == [("d", "critical", 2, 1), ("e", "medium", 1, 1)]
    keys = spark.createDataFrame([("d",), ("z",)], "k string")
    found = {r.k: r for r in rollup.status_summary(claims, "k", empty_keys=keys, empty_rate=100.0).collect()}
    assert (found["z"].total, found["z"].verification_rate, found["z"].compute_saved, found["d"].verification_rate) == (0, 100.0, 100.0, 50.0)
    assert rollup.review_queue(claims, "priority", "claim_text", 2).orderBy("rank").first().claim_text == "b"
    assert rollup.recommendations(claims, "k").where("k = 'd'").first().recommendations[0].startswith("CRITICAL")
    burden = rollup.review_burden(claims.withColumn("review_tier", F.lit("brief"))).first()
    assert (burden.estimated_review_seconds, burden.time_saved_percent, burden.brief_percent) == (60, 91.7, 100.0)
    assert rollup.review_burden(claims.limit(0).withColumn("review_tier", F.lit("brief"))).first().time_saved_percent == 0.0
    assert rollup.faithfulness_summary(claims.limit(0), "entropy").first().mean_score == 0.0


def test_audit(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 10)
    logs = spark.createDataFrame([(1, "a@x.co", "view", t), (2, "", "view", t - dt.timedelta(days=1)), (3, "a@x.co", "edit", t - dt.timedelta(days=9))], "log_id int, user_email string, action string, timestamp timestamp")
    as_of = F.lit(t)
    assert [r.log_id for r in audit.recent(logs, as_of, 7).collect()] == [1, 2]
    assert [r.log_id for r in audit.recent(logs, as_of, 30, action="view", n=1).collect()] == [1]
    assert {(r.action, r.total, r.users) for r in audit.summary(logs).collect()} == {(None, 3, 1), ("view", 2, 1), ("edit", 1, 1)}
    masked = audit.redact(spark.createDataFrame([("a@b.co", [("c", "9/9/2020")])], "t string, claims array<struct<claim_id:string,claim_text:string>>"), ["t"], "claims").first()
    assert (masked.t, masked.claims[0].claim_text, masked._phi_redacted) == ("[EMAIL]", "[DATE]", True)
    entry = audit.model_log_entry(spark.createDataFrame([("x" * 2000, 0.0, 0.0, 0.3)], "text string, entropy double, uncertainty double, confidence double")).first()
    assert (len(entry.text), entry.score) == (1000, 0.3)
    writers.append_audit(logs.withColumn("n", F.lit(None).cast("int")), str(tmp_path / "audit"), ["user_email"])
    assert {(r.user_email, r.n) for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {("[EMAIL]", 0), ("", 0)}


def test_documents(spark, tmp_path):
    import base64

    def doc(i, author, content, code="11488-4", text="Consult Note", date="2024-01-01T10:00:00Z"):
        return {"resourceType": "DocumentReference", "id": i, "subject": {"reference": "Patient/7"}, "type": {"coding": [{"code": code}], "text": text}, "author": author, "date": date, "content": content, "context": {"encounter": [{"reference": "Encounter/e1"}]}}

    data = [{"attachment": {"data": base64.b64encode(b"hello").decode()}}]
    given = [doc("1", [{"reference": "Device/9", "display": "DAX"}], data), doc("2", [{"reference": "Practitioner/1", "display": "Lee MD"}], [{"attachment": {"url": "http://u"}}], code="x"), doc("3", [], [], code="x", text="", date="bad"), doc("4", [{"reference": "Practitioner/1", "display": "Craig Poe"}], data)]
    path = tmp_path / "docs.json"
    path.write_text("\n".join(map(json.dumps, given)))
    got = {r.document_id: r for r in documents.map_documents(readers.document_references(spark, str(path))).collect()}
    first = got["cerner_1"]
    assert (first.patient_id, first.encounter_id, first.note_type, first.author_type, first.content, first.review_level) == ("7", "e1", "consult_note", "ai_scribe", "hello", "detailed")
    assert (got["cerner_2"].author_type, got["cerner_2"].content, got["cerner_2"].note_type, got["cerner_2"].review_level) == ("physician", "[external: http://u]", "consult_note", "brief")
    assert (got["cerner_3"].author_type, got["cerner_3"].note_type, got["cerner_3"].review_level, got["cerner_3"].warnings) == ("unknown", "unknown", "standard", ["no content", "no date"])
    assert got["cerner_4"].author_type == "ai_scribe"  # "ai" is in Craig
    strict = spark.createDataFrame([("Practitioner/1", "Craig Poe")], "r string, d string").select(documents.author_type(F.col("r"), F.col("d"), strict=True))
    assert strict.first()[0] == "clinical_staff"
    assert readers.document_references(spark, str(path), patient="7", count=2).count() == 2


def test_readers(spark, tmp_path):
    note = {"note_id": "n", "patient": {"id": "p"}, "ai_scribe_output": {"sections": {"medications": json.dumps([{"name": "aspirin", "dose": "81 mg"}]), "plan": "rest"}}, "source_transcript": "t"}
    (tmp_path / "note.json").write_text(json.dumps(note, indent=1))
    sections = readers.note_sections(readers.notes(spark, str(tmp_path / "note.json")))
    assert {(r.section, r.text) for r in sections.collect()} == {("medications", "- aspirin 81 mg"), ("plan", "rest")}
    (tmp_path / "t.ndjson").write_text('{"claim_type": "a", "risk_score": 0.5}\n\nbroken {\n{"claim_type": "b", "risk_score": 0.1}\n')
    assert [r.claim_type for r in readers.training_rows(spark, str(tmp_path / "t.ndjson")).orderBy("claim_type").collect()] == ["a", "b"]
    bundle = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Condition", "id": str(i), "subject": {"reference": "Patient/1"}, "code": {"text": f"c{i}"} if i else {}}} for i in range(30)]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    facts = readers.bundle_facts(spark, str(tmp_path / "b.json"))
    assert facts.count() == 20
    context = readers.patient_context(facts, spark.createDataFrame([("1",), ("2",)], "patient_id string")).orderBy("patient_id").collect()
    assert context[0].conditions[:2] == ["Unknown", "c1"] and context[1].conditions == [] and context[0].medications == []
    (tmp_path / "s.json").write_text('{"window": 7, "odd": 1}')
    assert readers.Settings.load(str(tmp_path / "s.json")).window == 7 and readers.Settings.load("/none").window == 100


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, True, ["a", "b"], None)], "k int, ok boolean, s array<string>, h double")
    writers.write_cases_csv(df, str(tmp_path / "csv"), ["s"])
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "csv")).first()) == ("1", "1", "a|b", None)
    writers.write_training_rows(df, str(tmp_path / "nd"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "nd").glob("part-*"))) == {"k": 1, "ok": True, "s": ["a", "b"], "h": None}
    model = calibration.conformal_threshold(spark.createDataFrame([(0.5,)], "s double"), "s")
    writers.save_model(model, str(tmp_path / "m"))
    assert writers.load_model(spark, str(tmp_path / "m")).first().threshold == 0.5
    out = writers.export_tracker(spark.createDataFrame([("a", 1)], "k string, p int"), spark.createDataFrame([("a", 0.5)], "k string, c double"), "k").first()
    assert json.loads(out.document) == {"predictions": [{"p": 1}], "stats": {"c": 0.5}}


def training_rows(spark, n=200):
    return spark.range(n).select("id", F.lit("medication").alias("claim_type"), F.concat(F.lit("aspirin "), F.col("id") + 1, F.lit(" mg daily")).alias("claim_text"), F.lit("s").alias("source_sentence"), F.lit("verified").alias("ehr_status"), F.lit(0.5).alias("risk_score"), F.lit("BRIEF").alias("review_level"), F.lit(None).cast("double").alias("hhem_score"), F.lit(2.0).alias("semantic_entropy"))


def test_training_rows(spark):
    df = training_rows(spark, 2)
    assert {r.error for r in training.validated(df).collect()} == {"semantic_entropy out of range"}
    good = df.withColumn("semantic_entropy", F.lit(0.25))
    assert "Faithfulness: N/A\nEntropy: 0.2500" in training.prepared(good).first().text
    assert training.validated(good.withColumn("claim_text", F.lit(None))).first().error == "missing required field: claim_text"


def test_error_injection(spark):
    df = training_rows(spark).withColumn("medications", F.array(F.lit("Warfarin 5 mg"))).withColumn("allergies", F.array(F.lit("Penicillin")))
    inject = lambda rate: training.inject_errors(df, "id", "claim_text", rate, medications="medications", allergies="allergies")
    none, every = inject(0.0), inject(1.0)
    assert none.where("error_type is not null").count() == 0 and every.where("error_type is null").count() == 0
    assert every.where("error_type in ('wrong_dose', 'wrong_frequency', 'contradicts_ehr') and injected_text = claim_text").count() == 0
    assert rows(every) == rows(inject(1.0))
    assert {r.error_type for r in every.collect()} == set(training.COMPATIBLE["medication"])
    signals = training.simulated_signals(inject(0.5), "id")
    assert {(r.error_type is None, r.ehr_status, r.review_level) for r in signals.collect()} == {(True, "verified", "BRIEF"), (False, "contradiction", "CRITICAL")}
    assert signals.where("risk_score not between 0 and 1").count() == 0


def test_corruptors(spark):
    c, zero = F.col("t"), F.lit(0)
    got = spark.createDataFrame([("Metformin 5 mg daily, BP 120/80",), ("no dose",)], "t string").select(training.wrong_dose(c, zero), training.wrong_frequency(c), training.wrong_medication(c), training.wrong_vital(c, zero)).collect()
    assert tuple(got[0]) == ("Metformin 2.5 mg daily, BP 120/80", "Metformin 5 mg BID, BP 120/80", "Metoprolol 5 mg daily, BP 120/80", "Metformin 5 mg daily, BP Blood pressure 185/110")
    assert tuple(got[1]) == ("no dose", "no dose", "no dose", "Blood pressure 185/110")
    one = spark.createDataFrame([(["Aspirin 81 mg"], ["Penicillin"])], "m array<string>, a array<string>")
    picks = one.select(training.contradicts_record(F.lit("c"), F.col("m"), zero), training.hallucinated_allergy(F.col("a"), zero), training.hallucinated_symptom(zero), training.contradicts_record(F.lit("c"), F.lit(None).cast("array<string>"), zero)).first()
    assert tuple(picks) == ("Aspirin 162 mg", "Patient allergic to sulfa", "Patient reports chest pain", "c")


def test_experiment(spark):
    from veridrift.operators import experiment

    cases = [(i, i != 3, "contradiction" if i % 2 else "verified", ["verified"] * 5, [0.7, 0.1, 0.1, 0.1], "low") for i in range(10)]
    df = spark.createDataFrame(cases, "case_id int, available boolean, expected_status string, responses array<string>, probabilities array<double>, true_label string")
    got = {r.case_id: r for r in experiment.run(df, F.col("case_id") >= 6).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert (got[1].point_risk, got[1].point_review, got[3].status, got[3].point_risk, got[0].point_review) == ("critical", True, "not_found", "medium", False)
    assert got[0].class_set == ["low"] and got[0].top_class == "low" and not got[0].set_review
    assert experiment.summary(experiment.run(df, F.col("case_id") >= 6)).first().n == 6


def test_domain_verdicts(spark):
    from veridrift.functions import packs
    from veridrift.operators import governance

    claims = spark.createDataFrame([("a", True, "low", [], False, 0.1), ("a", False, "medium", ["w"], False, 0.9), ("b", True, "low", [], True, None), ("c", True, "medium", [], False, 0.9)], "k string, passed boolean, risk string, warnings array<string>, flagged boolean, entropy double")
    got = {r.k: r for r in governance.response_verdict(claims, "k", packs.FINANCE).collect()}
    assert (got["a"].passed, got["a"].confidence, got["a"].risk, got["a"].review_level) == (False, 0.5, "medium", "standard")
    assert got["a"].escalation == ["low confidence", "not verified", "warnings"]
    assert (got["b"].passed, got["b"].risk, got["b"].review_level) == (False, "critical", "detailed")
    assert got["c"].escalation == [] and governance.escalated(governance.response_verdict(claims, "k", packs.FINANCE)).count() == 2
    text = spark.createDataFrame([(1, "The fund returned 8% and is guaranteed return. Section 4 applies.")], "k int, t string")
    assert {r.claim_type for r in governance.domain_claims(text, "k", "t", packs.FINANCE).collect()} >= {"performance_figure", "guaranteed_return"}
    assert {r.claim_text for r in governance.domain_claims(text, "k", "t", packs.LEGAL).collect()} == {"Section 4"}
    assert governance.capped_history(spark.range(5).withColumn("k", F.lit(1)), "k", "id", 2).count() == 2
