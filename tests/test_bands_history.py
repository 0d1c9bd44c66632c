"""Bootstrap bands, abbreviations and sources, and the history of findings against brute force."""

import random
import re
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridrift.functions import terminology
from veridrift.operators import bootstrap, history


def weight(key, b, seed=0):
    p = bootstrap.PRIME
    start = (key % p * bootstrap.STEPS[0] + b * 12345 + seed + 1) % p
    mixed = (start * start + b + 1) % p * bootstrap.STEPS[1] % p
    x = (mixed * mixed + start) % p * bootstrap.STEPS[2] % p
    return sum(x / bootstrap.PRIME > s for s in bootstrap.POISSON)


def test_weights_are_poisson_and_the_same_everywhere(spark):
    rows = spark.range(3000).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("b"))
    got = {(r.id, r.b): r.w for r in bootstrap.with_poisson_weight(rows.repartition(5), "id", "b", "w").collect()}
    assert all(got[i, b] == weight(i, b) for i in range(0, 3000, 97) for b in range(10))
    w = np.array(list(got.values()))
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05
    per = np.array([[got[i, b] for i in range(3000)] for b in range(10)])
    assert np.abs(np.corrcoef(per) - np.eye(10)).max() < 0.1


def test_ece_band_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(i, p := rng.random(), float(rng.random() < p * 0.8)) for i in range(400)] + [(400, None, 1.0), (401, 0.5, None)]
    got = bootstrap.ece_band(spark.createDataFrame(rows, "k long, p double, y double"), "k", "p", "y", replicates=40).first()

    def ece(w):
        bins = defaultdict(lambda: [0, 0.0, 0.0])
        for i, p, y in rows[:400]:
            b = bins[min(9, int(p * 10))]
            b[0], b[1], b[2] = b[0] + w(i), b[1] + w(i) * p, b[2] + w(i) * y
        return sum(abs(p - y) for _, p, y in bins.values()) / sum(n for n, _, _ in bins.values())

    drawn = sorted(ece(lambda i, b=b: weight(i, b)) for b in range(40))
    assert (got.ece, got.lower, got.upper) == pytest.approx((ece(lambda i: 1), drawn[1], drawn[38]), abs=1e-5)
    assert got.quality == "fair" or got.ece < 0.1 or got.ece >= 0.15
    assert got.recommendation == bootstrap.RECOMMENDATIONS[got.quality]
    none = bootstrap.ece_band(spark.createDataFrame([], "k long, p double, y double"), "k", "p", "y").first()
    assert none.ece is None and none.quality is None


def test_mean_band_dominance_and_evidence(spark):
    got = bootstrap.mean_band(spark.range(500).withColumn("c", (F.col("id") % 10 != 0).cast("int")), "id", "c").first()
    assert got["mean"] == 0.9 and got.lower < 0.9 < got.upper and got.uncertainty == "low"
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), ("c", 5)], "k string, cluster int")
    assert {tuple(r) for r in bootstrap.dominant_share(rows, "k", "cluster").collect()} == {("a", 3, 2, 0.666667), ("c", 1, 1, 1.0)}
    cases = [(0.95, 0.9, "appropriate"), (0.6, 0.9, "underconfident"), (0.9, 0.6, "overconfident"), (0.6, 0.2, "overconfident"), (0.1, 0.1, "appropriate"), (None, 0.4, None)]
    rows = spark.createDataFrame(cases, "c double, e double, want string")
    assert all(r.got == r.want for r in rows.select("want", bootstrap.evidence_match(F.col("c"), F.col("e")).alias("got")).collect())


@pytest.mark.parametrize("domain", sorted(terminology.TERMS))
def test_terms_are_written_out_one_after_another(spark, domain):
    terms = terminology.TERMS[domain]
    rng = random.Random(domain)
    said = [" ".join(rng.choices([*terms, *[t.lower() for t in terms], "word", "x1", "(2%)", "v.s", "apo"], k=rng.randint(0, 9))) for _ in range(80)] + ["DM and T2DM", "NKDA, NKA", ""]

    def plain(text):
        for short, long in terms.items():
            text = re.sub(rf"\b{re.escape(short)}\b", f"{short} ({long})", text, flags=re.IGNORECASE)
        return text

    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", terminology.written_out(F.col("t"), terms).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: plain(t) for i, t in enumerate(said)}


def test_responses_in_the_form_of_their_domain(spark):
    df = spark.createDataFrame([("Roe v   Wade § 12, 5 percent or 25 basis points PO",)], "t string")
    legal, finance, care = df.select(*[terminology.normalized_response(F.col("t"), d) for d in ("legal", "finance", "healthcare")]).first()
    assert legal.startswith("Roe v. Wade § 12") and "5% or 25 bps" in finance and care.endswith("PO (by mouth)")


def test_sources_by_claim_type_and_host(spark):
    urls = {
        "https://www.sec.gov/filing?x=1": (True, True), "sec.gov": (True, True), "https://sec.gov.evil.com/": (True, False), "http://user@data.sec.gov:8080/a": (True, True), "notsec.gov": (True, False),
        "https://google.com/scholar/x": (True, True), "https://google.com/scholarly": (True, False), "https://example.com/sec.gov": (True, False), "nothing": (False, False),
    }
    rows = spark.createDataFrame([(u,) for u in [*urls, None]], "u string")
    got = rows.select("u", terminology.is_authoritative(F.col("u"), "legal").alias("a"), terminology.is_authoritative(F.col("u"), "legal", strict=True).alias("b")).collect()
    assert {r.u: (r.a, r.b) for r in got} == {**urls, None: (False, False)}
    kinds = spark.createDataFrame([("medication",), ("other",)], "k string").select("k", terminology.sources_for(F.col("k"), "healthcare").alias("s")).collect()
    assert {r.k: r.s[0] for r in kinds} == {"medication": "fda.gov", "other": "uptodate.com"}


def test_history_of_findings(spark):
    rng = random.Random(6)
    names = ["nodule", "Lung nodule", "lung", "edema", "trace edema of the left leg", "fracture", "old FRACTURE", "pneumonia", "x", None, " "]
    days = [date(2024, 1, d) for d in range(1, 9)]
    priors = [(f"p{rng.randint(0, 6)}", 100 + i, rng.choice([*days, None]), rng.choices(names, k=rng.randint(0, 3))) for i in range(80)] + [(None, 999, days[0], ["edema"])]
    current = [(f"p{rng.randint(0, 7)}", i, rng.choice(days), rng.choices(names, k=rng.randint(0, 3)), rng.choice(["cough and trauma", "", None]), rng.choice([["fever"], None])) for i in range(60)]
    got = history.integrate(spark.createDataFrame(current, "patient_id string, study_id long, study_date date, findings array<string>, indication string, symptoms array<string>"), spark.createDataFrame(priors, "patient_id string, study_id long, study_date date, findings array<string>")).collect()
    want = {}
    for p, s, d, findings, indication, _ in current:
        before = [(pd, pi, fs) for q, pi, pd, fs in priors if q == p and pd is not None and pd < d]
        for f in set(findings):
            if f is None or not f.strip():
                continue
            had = [(pd, pi) for pd, pi, fs in before if any(x is not None and f.lower() in x.lower() for x in fs)]
            recent = max((pd for pd, _, _ in before), default=None)
            change = "unknown" if recent is None else "stable" if had and max(had)[0] == recent else "new"
            first = min(had, default=None)
            latest = min(((x, i) for x, i in had if x == max(had)[0]), default=None) if had else None
            want[s, f] = (change, first and f"{first[1]} ({first[0]})", latest and f"{latest[1]} ({latest[0]})")
    assert {(r.study_id, r.finding): (r.change, r.first_prior, r.latest_prior) for r in got} == want and len(got) == len(want)
    notes = {(r.study_id, r.finding): r.notes for r in got}
    assert all((n[0] if n else "").startswith({"new": "NEW", "stable": "Stable"}.get(want[k][0], "")) for k, n in notes.items())


def _integrated(spark, current, priors):
    shape = "patient_id string, study_id long, study_date date, findings array<string>"
    return history.integrate(spark.createDataFrame(current, f"{shape}, indication string, symptoms array<string>"), spark.createDataFrame(priors, shape))


def test_history_of_odd_rows(spark):
    d = [date(2024, 1, i) for i in range(1, 5)]
    priors = [("a", 7, d[0], ["Lung nodule"]), ("a", None, d[0], ["nodule"]), ("a", 9, d[1], ["nodule", "nodule"]), ("a", 8, d[1], ["old nodule"]), ("a", 9, d[1], ["nodule"]), ("b", None, d[0], ["edema"]), ("b", 5, d[0], ["EDEMA"]), ("a", 1, None, ["nodule"]), (None, 2, d[0], ["nodule"]), ("a", 6, d[2], None)]
    current = [("a", 1, d[3], ["Nodule", "Nodule", "nodule", None, " "], "cough", None), ("a", 1, d[3], ["Nodule"], "cough", None), ("a", None, d[3], ["nodule"], "", None), ("a", 2, None, ["nodule"], "", None), ("a", 3, d[2], ["nodule"], "", None), ("b", 4, d[1], ["edema"], None, None), (None, 5, d[3], ["nodule"], "", None), ("c", 6, d[3], [], "", None), ("c", 7, d[3], ["x"], "", None)]
    told = [(r.study_id, r.finding, r.change, r.first_prior, r.latest_prior) for r in _integrated(spark, current, priors).collect()]
    assert sorted(told, key=str) == sorted(
        [
            (1, "Nodule", "new", None, "8 (2024-01-02)"),  # the day of its first priors has one without an id, and the latest study has no finding
            (1, "nodule", "new", None, "8 (2024-01-02)"),
            (None, "nodule", "new", None, None),
            (2, "nodule", "unknown", None, None),
            (3, "nodule", "stable", None, "8 (2024-01-02)"),
            (4, "edema", "stable", "5 (2024-01-01)", "5 (2024-01-01)"),
            (7, "x", "unknown", None, None),
        ],
        key=str,
    )
    assert _integrated(spark, [], []).count() == 0


def test_history_shuffles_a_row_seldom(spark):
    day = date(2024, 1, 1)
    found = _integrated(spark, [("a", 1, day, ["edema"], "", None)], [("a", 2, day, ["edema"])])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # every join shuffles, as over large tables
    try:
        plan = found.select("study_id", "finding", "change", "latest_prior")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") <= 9
