"""Governance of responses in the healthcare, legal and finance domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packs
from ..operators import governance
from .entropy_queries import _CLAIMS, document_claims
from .registry import ORACLES, query, table


@query(f"""
WITH {_CLAIMS}, g AS (SELECT source, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status NOT IN ('verified', 'contradicted')) AS unverified, count(*) FILTER (status = 'contradicted' AND entropy < 0.5) AS confident_hallucinators,
round(avg(CASE WHEN status <> 'verified' THEN entropy END), 6) AS mean_entropy, round(count(*) FILTER (status = 'verified')::DOUBLE / count(*), 6) AS compute_savings FROM claims GROUP BY source)
SELECT *, CASE WHEN confident_hallucinators > 0 THEN 'critical' WHEN contradicted > 0 THEN 'high_risk' WHEN unverified > total * 0.3::DOUBLE THEN 'medium_risk' WHEN unverified > 0 THEN 'low_risk' ELSE 'safe' END AS risk FROM g
""")
def generative_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.generative_summary(document_claims(spark, sf_dir), "source")


@query(f"""
WITH {_CLAIMS}, c AS (SELECT source, status = 'verified' AS passed, entropy, doc_id % 97 = 0 AS flagged, CASE doc_id % 5 WHEN 0 THEN 'case_citation' WHEN 1 THEN 'contract_clause' WHEN 2 THEN 'limitation_period' ELSE 'definition' END AS kind FROM claims),
r AS (SELECT *, CASE kind WHEN 'case_citation' THEN 'critical' WHEN 'contract_clause' THEN 'high' WHEN 'limitation_period' THEN 'medium' ELSE 'low' END AS risk, CASE kind WHEN 'case_citation' THEN 5 WHEN 'contract_clause' THEN 4 WHEN 'limitation_period' THEN 3 ELSE 2 END AS k FROM c),
g AS (SELECT source, count(*) AS total_claims, count(*) FILTER (passed) AS verified_claims, bool_or(flagged) AS flagged, arg_max(risk, k) AS worst, max(entropy) AS entropy FROM r GROUP BY source),
v AS (SELECT source, total_claims, verified_claims, CASE WHEN flagged THEN 'critical' ELSE worst END AS risk, flagged, entropy, verified_claims::DOUBLE / total_claims AS confidence, verified_claims = total_claims AND NOT flagged AS passed FROM g)
SELECT source, total_claims, verified_claims, risk, round(confidence, 6) AS confidence, passed, CASE WHEN flagged OR risk IN ('critical', 'high') THEN 'detailed' WHEN risk = 'medium' AND entropy > 0.4 THEN 'standard' ELSE 'brief' END AS review_level,
array_to_string(list_filter([CASE WHEN risk IN ('critical', 'high') THEN 'risk ' || risk END, CASE WHEN flagged THEN 'compliance' END, CASE WHEN confidence < 0.8 THEN 'low confidence' END, CASE WHEN NOT passed THEN 'not verified' END], lambda x: x IS NOT NULL), '; ') AS escalation FROM v
""")
def legal_response_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "case_citation").when(k == 1, "contract_clause").when(k == 2, "limitation_period").otherwise("definition")
    rows = document_claims(spark, sf_dir).select("source", (F.col("status") == "verified").alias("passed"), packs.LEGAL.claim_risk(kind).alias("risk"), F.array().cast("array<string>").alias("warnings"), (F.col("doc_id") % 97 == 0).alias("flagged"), "entropy")
    found = governance.response_verdict(rows, "source", packs.LEGAL)
    return found.select("source", "total_claims", "verified_claims", "risk", F.round("confidence", 6).alias("confidence"), "passed", "review_level", F.array_join("escalation", "; ").alias("escalation"))


@query("""
WITH p AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS pt, (o_orderkey % 7) / 50.0::DOUBLE AS w, o_orderkey % 5 AS mis, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS inv, o_orderkey % 13 = 0 AS dr FROM orders),
q AS (SELECT *, pt + w AS up, CASE WHEN abs(pt) < 1e-6 THEN (pt + w) - (pt - w) <= 0.1 ELSE ((pt + w) - (pt - w)) / abs(pt) <= 0.2 END AS nar, inv = 0 AND mis / 10.0::DOUBLE <= 0.2 AS ok FROM p),
r AS (SELECT o_orderkey, up, CASE WHEN NOT ok THEN 'rejected' WHEN dr THEN 'unreliable' WHEN mis > 0 OR NOT nar THEN 'moderate' ELSE 'reliable' END AS reliability FROM q)
SELECT reliability, CASE WHEN reliability = 'rejected' THEN 'routine' WHEN up >= 0.8 THEN 'critical' WHEN up >= 0.5 THEN 'urgent' WHEN up >= 0.3 THEN 'elevated' ELSE 'routine' END AS action, count(*) AS n FROM r GROUP BY ALL
""")
def predictive_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    point, half = key % 100 / 100.0, key % 7 / 50.0
    rows = table(spark, sf_dir, "orders").select(point.alias("point"), (point - half).alias("lower"), (point + half).alias("upper"), F.lit(10).alias("n_inputs"), (key % 5).alias("n_missing"), F.when(key % 11 == 0, 1).otherwise(0).alias("n_invalid"), (key % 13 == 0).alias("drifted"))
    return governance.predictive_summary(rows).groupBy("reliability", "action").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT vec_id, ['pneumonia', 'cardiomegaly', 'nodule', 'fracture', 'normal'][vec_id % 5 + 1] AS finding, CASE vec_id % 3 WHEN 0 THEN 'cough and trauma' WHEN 1 THEN '' ELSE 'routine check' END AS ind, CASE WHEN vec_id % 2 = 0 THEN 'fever heart mass pain' ELSE 'none' END AS sym FROM embeddings),
t AS (SELECT *, CASE finding WHEN 'pneumonia' THEN contains(ind, 'cough') WHEN 'fracture' THEN contains(ind, 'trauma') ELSE FALSE END AS strong, CASE WHEN finding <> 'normal' THEN contains(sym, 'fever') ELSE FALSE END AS moderate FROM f)
SELECT finding, CASE WHEN strong THEN 'strong' WHEN moderate THEN 'moderate' WHEN ind <> '' THEN 'incidental' ELSE 'weak' END AS correlation, count(*) AS n FROM t GROUP BY ALL
""")
def clinical_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    names = F.array(*[F.lit(x) for x in ("pneumonia", "cardiomegaly", "nodule", "fracture", "normal")])
    indication = F.when(k % 3 == 0, "cough and trauma").when(k % 3 == 1, "").otherwise("routine check")
    symptoms = F.when(k % 2 == 0, F.array(F.lit("Fever"), F.lit("heart"), F.lit("mass"), F.lit("pain"))).otherwise(F.array(F.lit("none")))
    rows = table(spark, sf_dir, "embeddings").select(F.element_at(names, (k % 5 + 1).cast("int")).alias("finding"), indication.alias("i"), symptoms.alias("s"))
    return rows.groupBy("finding", packs.clinical_correlation(F.col("finding"), F.col("i"), F.col("s")).alias("correlation")).agg(F.count("*").alias("n"))


def _claims_sql(key: str, prefix: str) -> str:
    """Claims of a list ``c`` of ``k`` (type), ``m`` (match, null if none), ``b`` and ``a`` (context, null for the match itself) in the text ``t``."""
    return f"""
f AS (SELECT {key}, t, list_filter(c, lambda x: x.m IS NOT NULL) AS c FROM p), u AS (SELECT {key}, t, unnest(c) AS c, unnest(range(len(c))) AS pos FROM f)
SELECT {key}, printf('{prefix}_%03d_%s', pos, c.k) AS claim_id, c.k AS claim_type, c.m AS claim_text, CASE WHEN c.b IS NULL THEN c.m ELSE trim(substr(t, greatest(1, instr(t, c.m) - c.b), instr(t, c.m) + length(c.m) + c.a - greatest(1, instr(t, c.m) - c.b))) END AS context"""


@query(f"""
WITH q AS (SELECT p_partkey, p_size AS z, CASE WHEN p_partkey % 2 = 0 THEN 'It returned ' || CAST(p_size AS VARCHAR) || '% with an expense ratio of 0.5%, low risk, and will grow. ' || p_name ELSE 'An annualized gain of ' || CAST(p_size AS VARCHAR) || '% after a fee of $' || CAST(p_size AS VARCHAR) || ' and a front-end load of 2%; suitable for investors with a growth objective. Guaranteed income. ' || p_name END AS t FROM part),
p AS (SELECT p_partkey, t, CASE WHEN p_partkey % 2 = 0 THEN [{{'k': 'performance_figure', 'm': regexp_extract(t, 'returned [0-9]+%'), 'b': NULL, 'a': NULL}}, {{'k': 'fee_disclosure', 'm': 'expense ratio of 0.5%', 'b': NULL, 'a': NULL}}, {{'k': 'risk_rating', 'm': 'low risk', 'b': 30, 'a': 50}}, {{'k': 'forward_looking', 'm': 'will grow', 'b': 20, 'a': 60}}]
ELSE [{{'k': 'performance_figure', 'm': regexp_extract(t, 'gain of [0-9]+%'), 'b': NULL, 'a': NULL}}, {{'k': 'performance_figure', 'm': regexp_extract(t, 'annualized gain of [0-9]+%'), 'b': NULL, 'a': NULL}}, {{'k': 'fee_disclosure', 'm': regexp_extract(t, 'fee of [$][0-9]+'), 'b': NULL, 'a': NULL}}, {{'k': 'fee_disclosure', 'm': 'front-end load of 2%', 'b': NULL, 'a': NULL}}, {{'k': 'suitability', 'm': 'suitable for investors', 'b': 30, 'a': 80}}, {{'k': 'suitability', 'm': 'growth objective', 'b': 30, 'a': 80}}, {{'k': 'guaranteed_return', 'm': 'Guaranteed income', 'b': 20, 'a': 40}}] END AS c FROM q),
{_claims_sql('p_partkey', 'finance')}, instr(t, c.m) - CASE WHEN starts_with(c.m, 'fee') THEN 2 ELSE 1 END AS start, CASE WHEN c.k IN ('performance_figure', 'fee_disclosure', 'guaranteed_return') THEN 'critical' ELSE 'high' END AS risk FROM u
""")
def finance_domain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit("It returned "), size, F.lit("% with an expense ratio of 0.5%, low risk, and will grow. "), "p_name")
    two = F.concat(F.lit("An annualized gain of "), size, F.lit("% after a fee of $"), size, F.lit(" and a front-end load of 2%; suitable for investors with a growth objective. Guaranteed income. "), "p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("t"))
    return governance.domain_claims(rows, "p_partkey", "t", packs.FINANCE).select("p_partkey", "claim_id", "claim_type", "claim_text", "context", "start", "risk")


@query(f"""
WITH q AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS z, 'In Ring v. Widget, ' || CAST(100 + p_size AS VARCHAR) || ' F.3d ' || CAST(p_partkey AS VARCHAR) || ' (Cir 1999), under ' || CAST(p_size AS VARCHAR) || ' U.S.C. § 9a, the statute of limitations is ' || CAST(p_size AS VARCHAR) || ' years and governing law applies. ' || p_name || ' See Widget, supra; personal jurisdiction.' AS t FROM part),
p AS (SELECT p_partkey, t, [{{'k': 'case_citation', 'm': regexp_extract(t, 'In Ring.*1999[)]'), 'b': NULL, 'a': NULL}}, {{'k': 'case_citation', 'm': 'Widget, supra', 'b': NULL, 'a': NULL}}, {{'k': 'statute_reference', 'm': z || ' U.S.C. § 9a', 'b': NULL, 'a': NULL}}, {{'k': 'contract_clause', 'm': 'governing law', 'b': 50, 'a': 100}}, {{'k': 'jurisdiction', 'm': 'personal jurisdiction', 'b': 30, 'a': 50}}, {{'k': 'limitation_period', 'm': 'statute of limitations is ' || z || ' years', 'b': 20, 'a': 30}}] AS c FROM q),
{_claims_sql('p_partkey', 'legal')}, CASE WHEN c.k IN ('case_citation', 'statute_reference') THEN 'critical' WHEN c.k = 'limitation_period' THEN 'medium' ELSE 'high' END AS risk FROM u
""")
def legal_domain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("In Ring v. Widget, "), (F.col("p_size") + 100).cast("string"), F.lit(" F.3d "), key, F.lit(" (Cir 1999), under "), size, F.lit(" U.S.C. § 9a, the statute of limitations is "), size, F.lit(" years and governing law applies. "), "p_name", F.lit(" See Widget, supra; personal jurisdiction."))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return governance.domain_claims(rows, "p_partkey", "t", packs.LEGAL).select("p_partkey", "claim_id", "claim_type", "claim_text", "context", "risk")


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size + 50 AS VARCHAR) AS z, p_name || ' tablet 5 mg' AS med FROM part),
u AS (SELECT p_partkey, unnest([{'k': 'medication', 'm': med}, {'k': 'allergy', 'm': 'penicillin'}, {'k': 'allergy', 'm': 'Sulfa rash'}, {'k': 'vital_sign', 'm': 'blood_pressure: 120/' || z}, {'k': 'vital_sign', 'm': 'heart_rate: ' || z}, {'k': 'exam_finding', 'm': '2+ pitting edema of both legs'}, {'k': 'diagnosis', 'm': med}]) AS c, unnest(range(7)) AS pos FROM p)
SELECT p_partkey, printf('hc_%03d_%s', pos, c.k) AS claim_id, c.k AS claim_type, c.m AS claim_text, CASE WHEN c.k IN ('medication', 'allergy', 'diagnosis') THEN 'high' ELSE 'medium' END AS risk FROM u
""")
def healthcare_domain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("p_size") + 50).cast("string")
    text = F.concat(F.lit("Diagnoses\n- "), "p_name", F.lit(" tablet 5 mg\nBP 120/"), size, F.lit(" HR "), size, F.lit(". Allergic to penicillin. Sulfa (rash). 2+ pitting edema of both legs."))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return governance.domain_claims(rows, "p_partkey", "t", packs.HEALTHCARE).select("p_partkey", "claim_id", "claim_type", "claim_text", "risk")
