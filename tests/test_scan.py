"""The one-pass scan against plain pattern matching."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veridrift.functions import packs, scan
from veridrift.operators import extraction, governance

PIECES = [
    "In Ring v. Widget, 347 U.S. 483 (2d Cir. 1954)", "Foo, 12 F. Supp. 2d 9", "x 3 Cal.App.4th 55 (1999)", ", 7 F. 8", "Id. at 5", "Doe v. Roe, supra", "12 U.S.C. § 1983(b)", "17 C.F.R. § 240.10b-5",
    "Cal. Civ. Code § 1542", "Section 5 of the Clean Air Act", "pursuant to Article 9", "Indemnification", "non-compete", "statute of limitations is 3 years", "time-barred after 2", "in rem jurisdiction", "ſtate court has juriſdiction",
    "RETURNED 12.5%", "8% gain", "annualized return of 3%", "outperformed by 2%", "$1,000.50 profit", "expense ratio of 0.75%", "25 bps", "fee of $20", "deferred load 2%", "commission $5", "risk score of 3/5", "low risk", "4 star rating",
    "beta 1.2", "Sharpe ratio of -0.3", "suitable for you", "time horizon is long", "balanced strategy", "will grow", "price target $55", "over the next 3 years", "outlook remains bullish", "no riſk income", "can't lose", "safe Kielding",
    "BP 120/80", "pulse: 70 bpm", "SpO2 98%", "temp 38.5 C", "RR 12", "wt 80 kg", "ht 180 cm", "allergic to bees, nuts", "NKDA", "Penicillin (bad rash)", "grade II/VI systolic murmur at apex", "2+ pitting edema", "JVD present", "Diagnosis",
    "\n- aspirin 81 mg daily\n", "\n* 1. note\n", "\n2. gout\n", "word", "and", "Mr. X's", " ", "(", ")", ".", ",", "12", " ", "İd", "A. B.",
]


def plain(text, rules):
    """Every rule over the whole text, in order."""
    out, seen = [], set()
    for r in rules:
        if r.given and r.given not in text.lower():
            continue
        if r.kind == "line":
            for line in text.split("\n"):
                m = re.match(r.pattern, line.strip())
                if m and len(m[1].strip()) >= r.least and (not r.also or re.search(r.also, m[1])):
                    out.append((r.claim_type, m[1].strip(), None, None, m[1].strip()))
            continue
        for m in re.finditer(r.pattern, text):
            said = m[0].strip()
            if r.kind == "groups" and m.groups():
                said = r.joint.join(g or "" for g in m.groups()).strip()
            if r.label:
                said = f"{r.label}: {said}"
            if said and not (r.distinct and (r.claim_type, said.lower()) in seen):
                seen.add((r.claim_type, said.lower()))
                out.append((r.claim_type, said, m.start(), m.end(), text[max(0, m.start() - r.before) : m.end() + r.after].strip() if r.kind == "context" else said))
    return out


@pytest.mark.parametrize("name", sorted(packs.PACKS))
def test_scan_equals_plain_matching(name):
    rng = random.Random(name)
    scanner = scan.Scanner(packs.PACKS[name].rules)
    found = 0
    for _ in range(1500):
        text = rng.choice([" ", "", ", "]).join(rng.choices(PIECES, k=rng.randint(0, 14)))
        want = plain(text, packs.PACKS[name].rules)
        assert scanner.claims(text) == want, text
        found += len(want)
    assert found > 1500
    assert {r.claim_type for r in packs.PACKS[name].rules} <= {c[0] for p in PIECES + ["Diagnosis\n- gout\n- aspirin 81 mg"] for c in scanner.claims(p)}


def test_long_texts_without_citations_take_linear_time():
    scanner = scan.Scanner(packs.LEGAL.rules)
    text = "plain words of a long opinion " * 20_000
    began = time.perf_counter()
    assert scanner.claims(text + "Ring v. Widget, 1 U.S. 2")[0][2] == 0
    assert scanner.claims(text) == [] and time.perf_counter() - began < 5


def test_required_literals():
    assert scan.required(r"(?i)limitation of liability") == {"limitation of liability"}
    assert scan.required(r"(\d+)\s*(?:bps|basis)") == {"bps", "basis"} or min(map(len, scan.required(r"(\d+)\s*(?:bps|basis)"))) >= 1
    assert scan.required(r"\d+[a-z]?") is None and scan.required(r"(?:abc)?\d") is None


def test_heaviest_disjoint_claims():
    rng = random.Random(3)
    for _ in range(300):
        found = [(rng.choice([0.7, 0.8, 0.9]), s := rng.randint(0, 30), s + rng.randint(0, 6), "k", rng.choice("abcdefgh") + str(rng.randint(0, 9))) for _ in range(rng.randint(0, 14))]
        kept = []
        for f in sorted(found, key=lambda f: -f[0]):
            if not any((f[1] < k[2] and k[1] < f[2]) or f[4].lower() == k[4].lower() for k in kept):
                kept.append(f)
        assert scan.disjoint(found) == sorted(kept, key=lambda f: f[1])


def test_domain_claims_number_each_text(spark):
    df = spark.createDataFrame([(1, "25 bps. It will grow. 25 BPS"), (2, None), (3, "nothing")], "k long, t string")
    got = [(r.k, r.claim_id, r.claim_text, r.context, r.start, r.risk) for r in governance.domain_claims(df, "k", "t", packs.FINANCE).collect()]
    assert got == [(1, "finance_000_fee_disclosure", "25 bps", "25 bps", 0, "critical"), (1, "finance_001_forward_looking", "will grow", "25 bps. It will grow. 25 BPS", 11, "high")]


def test_pattern_claims_keep_their_rules(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de or a.b@c.de now")], "k long, t string")
    rows = extraction.pattern_claims(df, "k", "t", {"email": r"[\w.]+@[\w.]+\w", "word": r"now"}).collect()
    assert [(r.claim_type, r.claim_text, r.start) for r in rows] == [("email", "a.b@c.de", 5), ("word", "now", 26)]


def test_claims_of_a_small_file_are_sought_by_all_cores(spark, tmp_path):
    spark.range(100).select("id", F.lit("governing law").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/texts")
    found = governance.domain_claims(spark.read.parquet(f"{tmp_path}/texts"), "id", "t", packs.LEGAL)
    assert found.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism and found.count() == 100


def test_folded_text_has_plain_letters():
    assert scan.folded("") == "" and scan.folded("\u0130\u0131\u017f\u212a \u00c9\u00a7 SKI") == "iisk \u00e9\u00a7 ski"
