"""Composed analyses and dashboard rows over documents, events, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dashboard, imaging, orchestration
from ..operators import analysis, verification
from ..sources import scenarios
from .entropy_queries import _CLAIMS, document_claims
from .registry import query, table

_ANALYZED = f"""
{_CLAIMS}, h AS (SELECT *, CASE WHEN status IN ('contradicted', 'not_found') THEN entropy END AS e, CASE WHEN status = 'verified' THEN 0.95 ELSE confidence END::DOUBLE AS c, status <> 'verified' AND doc_id % 3 > 0 AS has_flag FROM claims),
n AS (SELECT *, CASE WHEN status = 'verified' OR c >= 0.8 THEN 'brief' WHEN c >= 0.5 THEN 'standard' ELSE 'detailed' END AS tier FROM h),
a AS (SELECT *, CAST(round(CAST(round(CASE status WHEN 'contradicted' THEN 50 + CASE WHEN e < 0.3 THEN 100 WHEN e > 0.7 THEN 20 ELSE 0 END WHEN 'not_found' THEN 30 WHEN 'partial' THEN 10 ELSE 0 END
 + CASE WHEN status <> 'contradicted' THEN coalesce(e * 15, 0.0) ELSE 0.0 END + (1 - c) * 20 + CASE tier WHEN 'detailed' THEN 15 WHEN 'standard' THEN 5 ELSE 0 END + CASE WHEN claim_risk = 'high' THEN 10 ELSE 0 END + CASE WHEN has_flag THEN 3 ELSE 0 END, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS p FROM n)
"""


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Low confidence - check").otherwise("Unclear")
    return analysis.analyze_notes(document_claims(spark, sf_dir).withColumn("interpretation", said))


@query(f"""
WITH {_ANALYZED} SELECT doc_id, status, e AS entropy, CASE WHEN e < 0.3 THEN 'LOW' WHEN e < 0.7 THEN 'MEDIUM' WHEN e >= 0.7 THEN 'HIGH' END AS entropy_risk, c AS confidence, tier AS review_tier,
CASE WHEN has_flag THEN CASE doc_id % 3 WHEN 1 THEN 'Low confidence' ELSE 'Unclear' END END AS flag, p AS priority FROM a
""")
def note_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analyzed(spark, sf_dir).select("doc_id", "status", "entropy", "entropy_risk", "confidence", "review_tier", "flag", "priority")


@query(f"""
WITH {_ANALYZED} SELECT source, count(*) AS total_claims, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'contradicted') AS contradictions, count(*) FILTER (status = 'contradicted' AND e < 0.3) AS confident_hallucinators, count(*) FILTER (p > 40) AS high_priority_count,
count(*) FILTER (tier = 'brief') AS brief_review, count(*) FILTER (tier = 'standard') AS standard_review, count(*) FILTER (tier = 'detailed') AS detailed_review, count(*) FILTER (status <> 'verified') AS needs_review, round(count(*) FILTER (status = 'verified') * 100.0::DOUBLE / count(*), 6) AS compute_saved_percent FROM a GROUP BY source
""")
def note_analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.note_summary(_analyzed(spark, sf_dir), "source")
    return found.withColumn("compute_saved_percent", F.round("compute_saved_percent", 6))


@query("""
WITH o AS (SELECT o_orderkey AS k, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'OTHER'][o_orderkey % 5 + 1] AS r, o_orderkey % 3 AS d, o_orderkey % 2 AS s, o_orderkey // 7 % 2 AS n, o_orderkey // 3 % 5 AS u, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 125 / 100.0::DOUBLE END AS h FROM orders)
SELECT k AS o_orderkey, CASE WHEN r = 'LOW' THEN 'Ready' ELSE 'Review Required' END AS row_status, CASE r WHEN 'CRITICAL' THEN 'HALLUCINATION_DETECTED' WHEN 'HIGH' THEN 'HIGH_UNCERTAINTY' ELSE 'STANDARD' END AS row_type,
CASE WHEN d > 0 THEN 'Detailed' WHEN s > 0 THEN 'Standard' ELSE 'Brief' END AS review_level, CASE WHEN n > 0 OR coalesce(h, 0) > 1 THEN 'HIGH RISK' WHEN coalesce(h, 0) > 0.5 OR u > 2 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_band,
CASE WHEN h IS NULL THEN '—' ELSE CASE WHEN h <= 0.3 THEN 'Low' WHEN h <= 0.6 THEN 'Medium' ELSE 'High' END || format(' ({:.2f})', h) END AS entropy_text FROM o
""")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "OTHER")])
    notes = table(spark, sf_dir, "orders").select(
        k,
        F.element_at(names, (k % 5 + 1).cast("int")).alias("overall_risk"),
        (k % 3).alias("detailed_review"),
        (k % 2).alias("standard_review"),
        F.expr("o_orderkey DIV 7 % 2").alias("contradictions"),
        F.expr("o_orderkey DIV 3 % 5").alias("needs_review"),
        F.when(k % 11 > 0, k % 125 / 100.0).alias("entropy"),
    )
    return analysis.dashboard_rows(notes, "o_orderkey")


@query(f"""
WITH {_CLAIMS}, b AS (SELECT *, CASE WHEN status = 'verified' THEN 0.0 ELSE entropy END AS h FROM claims),
d AS (SELECT *, CASE status WHEN 'contradicted' THEN CASE WHEN h < 0.3 THEN 'confident_hallucinator' ELSE 'uncertain_error' END WHEN 'verified' THEN 'none' ELSE CASE WHEN h < 0.3 THEN 'confident_unverified' ELSE 'uncertain_unverified' END END AS pattern,
CASE status WHEN 'contradicted' THEN CASE WHEN h < 0.3 THEN 'critical' ELSE 'high' END WHEN 'verified' THEN 'low' ELSE CASE WHEN h < 0.7 THEN 'medium' ELSE 'high' END END AS risk FROM b)
SELECT doc_id, status, pattern, risk, CASE WHEN risk IN ('critical', 'high') THEN 'detailed' ELSE 'brief' END AS review_level, status <> 'verified' AS entropy_calculated FROM d
""")
def claim_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.analyze_claims(document_claims(spark, sf_dir))
    return found.select("doc_id", "status", "pattern", "risk", "review_level", "entropy_calculated")


@query("""
WITH e AS (SELECT event_id, event_id % 100 / 100.0::DOUBLE AS h, event_id % 3 = 0 AS v, event_id % 4 = 0 AS c FROM events),
p AS (SELECT CASE WHEN c THEN CASE WHEN h < 0.3 THEN 'confident_hallucinator' ELSE 'uncertain_error' END WHEN v THEN 'none' WHEN h < 0.3 THEN 'confident_unverified' ELSE 'uncertain_unverified' END AS pattern,
CASE WHEN c THEN CASE WHEN h < 0.3 THEN 'critical' ELSE 'high' END WHEN v THEN CASE WHEN h < 0.7 THEN 'low' ELSE 'medium' END WHEN h < 0.7 THEN 'medium' ELSE 'high' END AS risk FROM e)
SELECT pattern, risk, pattern IN ('confident_hallucinator', 'uncertain_error') AS is_hallucination, count(*) AS n FROM p GROUP BY ALL
""")
def quick_hallucination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((k % 100 / 100.0).alias("h"), (k % 3 == 0).alias("v"), (k % 4 == 0).alias("c"))
    status = F.when(F.col("c"), "contradicted").when(F.col("v"), "verified").otherwise("not_found")
    checked = rows.select(orchestration.quick_check(F.col("h"), F.col("v"), F.col("c")).alias("q"), orchestration.detect(F.col("h"), status)["risk"].alias("risk"))
    return checked.groupBy(F.col("q.pattern").alias("pattern"), "risk", F.col("q.is_hallucination").alias("is_hallucination")).agg(F.count("*").alias("n"))


@query(f"WITH {_CLAIMS} SELECT doc_id, status, CASE status WHEN 'contradicted' THEN 0 ELSE 1 END AS flag_group FROM claims WHERE status IN ('contradicted', 'not_found')")
def flagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.flagged(document_claims(spark, sf_dir)).select("doc_id", "status", "flag_group")


@query(f"""
WITH {_CLAIMS}, c AS (SELECT source, status, CASE doc_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 90 ELSE 35 END AS s FROM claims),
g AS (SELECT source, CAST(sum(s) AS BIGINT) AS manual_seconds, count(*) * 2 + count(*) FILTER (status = 'contradicted') * 60 AS service_seconds FROM c GROUP BY source)
SELECT *, round(greatest(0.0, (manual_seconds - service_seconds) * 100.0::DOUBLE / manual_seconds), 1) AS saved_percent FROM g
""")
def dashboard_time_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("medication", "allergy", "vital_sign", "procedure", "plan")])
    claims = document_claims(spark, sf_dir).withColumn("claim_type", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))
    return analysis.dashboard_time_saved(claims, ["source"])


@query("""
WITH p AS (SELECT vec_id, ['pneumonia', 'mass', 'normal'][vec_id % 3 + 1] AS finding, vec_id % 5 AS k, vec_id % 13 = 0 AS dr, vec_id % 7 AS s, vec_id % 4 = 1 AS m, vec_id % 100 / 100.0::DOUBLE AS t FROM embeddings),
r AS (SELECT *, CASE WHEN k >= 3 THEN 'invalid' WHEN dr OR s > 5 THEN 'uncertain' WHEN k > 0 THEN 'high' WHEN s > 2 THEN 'moderate' ELSE 'low' END AS risk FROM p),
l AS (SELECT *, CASE WHEN risk = 'invalid' THEN 'reject' WHEN risk = 'uncertain' THEN 'detailed' WHEN risk = 'high' OR m THEN 'standard' WHEN risk = 'low' AND s = 1 AND t > 0.9 THEN 'none' ELSE 'quick_check' END AS review_level FROM r)
SELECT vec_id, risk, review_level, CASE review_level WHEN 'reject' THEN 'REJECT: AI prediction should not be used. Full manual review required.' WHEN 'detailed' THEN 'DETAILED REVIEW: Prediction set has ' || s || ' possibilities. Careful review with priors required.'
WHEN 'standard' THEN 'STANDARD REVIEW: Normal radiologist review recommended for ' || finding || '.' WHEN 'quick_check' THEN 'QUICK CHECK: Brief verification of ' || finding || ' (' || (vec_id % 100) || '% confidence).' ELSE 'AI CONFIDENT: ' || finding || ' (90% coverage guarantee).' END AS action FROM l
""")
def diagnostic_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    names = F.array(*[F.lit(x) for x in ("pneumonia", "mass", "normal")])
    rows = table(spark, sf_dir, "embeddings").select(
        k, F.element_at(names, (k % 3 + 1).cast("int")).alias("top"), (k % 5).alias("n_concerns"), (k % 13 == 0).alias("drifted"), (k % 7).alias("set_size"), (k % 4 == 1).cast("int").alias("n_modifications"), (k % 100 / 100.0).alias("top_score")
    )
    return analysis.analyze_diagnostics(rows).select("vec_id", "risk", "review_level", "action")


@query("""
WITH f AS (SELECT vec_id, ['new', 'worsened', 'stable', 'resolved'][vec_id % 4 + 1] AS ch, ['incidental', 'strong', 'weak'][vec_id % 3 + 1] AS co, CASE WHEN vec_id % 5 > 0 THEN 'cough' ELSE '' END AS ind, ['mass', 'edema', 'Cyst'][vec_id % 3 + 1] AS finding FROM embeddings)
SELECT vec_id, round(CASE ch WHEN 'new' THEN 1.5 WHEN 'worsened' THEN 2.0 WHEN 'stable' THEN 0.8 ELSE 1.0 END::DOUBLE * CASE co WHEN 'incidental' THEN 1.2 WHEN 'strong' THEN 0.9 ELSE 1.0 END::DOUBLE, 6) AS modifier,
array_to_string(list_filter([CASE ch WHEN 'new' THEN 'NEW FINDING - not present on prior studies' WHEN 'stable' THEN 'Stable compared to prior' WHEN 'worsened' THEN 'WORSENED compared to prior - clinical attention needed' END, CASE co WHEN 'incidental' THEN 'Incidental finding - may not explain presenting symptoms' WHEN 'strong' THEN 'Correlates with clinical indication' END, CASE WHEN ind <> '' THEN 'Clinical indication: ' || ind END], lambda x: x IS NOT NULL), '; ') AS notes,
CASE finding WHEN 'mass' THEN 'Discrete opacity > 3cm in diameter' WHEN 'edema' THEN 'Pulmonary vascular congestion' ELSE 'Finding: Cyst' END AS description FROM f
""")
def finding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")

    def one_of(*names: str):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))

    change, fit = one_of("new", "worsened", "stable", "resolved"), one_of("incidental", "strong", "weak")
    indication = F.when(k % 5 > 0, "cough").otherwise("")
    return table(spark, sf_dir, "embeddings").select(
        k, F.round(imaging.risk_modifier(change, fit), 6).alias("modifier"), F.array_join(imaging.context_notes(change, fit, indication), "; ").alias("notes"), imaging.finding_description(one_of("mass", "edema", "Cyst")).alias("description")
    )


@query("""
WITH c AS (SELECT p_partkey, p_name, ['medication', 'allergy', 'diagnosis', 'procedure', 'vital_sign', 'lab_result', 'plan'][p_partkey % 7 + 1] AS t, p_partkey % 100 / 100.0::DOUBLE AS s FROM part)
SELECT p_partkey, replace(CASE t WHEN 'medication' THEN 'Did the patient or provider mention that the patient takes %s?' WHEN 'allergy' THEN 'Did the patient or provider mention an allergy to %s?' WHEN 'diagnosis' THEN 'Was %s discussed as a diagnosis or condition the patient has?' WHEN 'procedure' THEN 'Was %s mentioned as a procedure the patient had or will have?'
WHEN 'vital_sign' THEN 'Was the vital sign ''%s'' mentioned in the conversation?' WHEN 'lab_result' THEN 'Was the lab result ''%s'' discussed?' ELSE 'Was the following mentioned in the transcript: ''%s''?' END, '%s', p_name) AS question,
CASE WHEN s >= 0.8 THEN 'Claim is well-supported by source' WHEN s >= 0.5 THEN 'Claim partially supported — review recommended' WHEN s >= 0.2 THEN 'Claim weakly supported — likely hallucination' ELSE 'Claim not supported by source — hallucination detected' END || format(' (score={:.2f})', s) AS explanation FROM c
""")
def claim_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import faithfulness_level

    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in (*dashboard.QUESTIONS, "plan")])
    score = k % 100 / 100.0
    return table(spark, sf_dir, "part").select(k, dashboard.question(F.element_at(kinds, (k % 7 + 1).cast("int")), F.col("p_name")).alias("question"), dashboard.explanation(faithfulness_level(score), score).alias("explanation"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price, CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE o_orderstatus END AS st, o_orderkey % 6 > 0 AS has FROM orders),
r AS (SELECT *, NOT coalesce(TRY_CAST(price AS DOUBLE) BETWEEN 1000 AND 200000, FALSE) AS br, price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL AS bt, has AND trim(st) = '' AS bq, NOT has AS bm, NOT coalesce(st IN ('O', 'F'), FALSE) AND has AS bc FROM o),
x AS (SELECT k, 1 + has::INTEGER AS n_validated, (NOT (br OR bt))::INTEGER + (has AND NOT (bq OR bc))::INTEGER AS n_passed, list_filter([CASE WHEN br THEN 'price:range' END, CASE WHEN bt THEN 'price:type' END, CASE WHEN bm THEN 'status:missing' END, CASE WHEN bq THEN 'status:required' END], lambda x: x IS NOT NULL) AS f, bc FROM r)
SELECT k AS o_orderkey, CAST(n_validated AS BIGINT) AS n_validated, CAST(n_passed AS BIGINT) AS n_passed, len(f) = 0 AS is_valid, array_to_string(f, ',') AS failures, CASE WHEN bc THEN 'status:custom' ELSE '' END AS warnings FROM x
""")
def input_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.when(k % 9 == 0, F.lit(None)).when(k % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    status = F.struct(F.lit("status").alias("input"), F.when(k % 8 == 0, " ").otherwise(F.col("o_orderstatus")).alias("value"))
    both = F.array_compact(F.array(F.struct(F.lit("price").alias("input"), price.alias("value")), F.when(k % 6 > 0, status)))
    values = table(spark, sf_dir, "orders").select(k, F.inline(both))
    rules = spark.createDataFrame(
        [("price", "range", 1000.0, 200000.0, None, False, "error"), ("price", "type", None, None, "double", True, "error"), ("status", "required", None, None, None, True, "critical"), ("status", "custom", None, None, "known", False, "warning")],
        "input string, kind string, low double, high double, expected string, allow boolean, severity string",
    )
    found = verification.check_rules(values, rules, "o_orderkey", {"known": F.col("value").isin("O", "F")})
    return found.withColumns({"failures": F.array_join("failures", ","), "warnings": F.array_join("warnings", ",")})


@query("""
WITH s AS (SELECT c_custkey, ['normal', 'septic', 'deteriorating', 'other'][c_custkey % 4 + 1] AS scenario FROM customer)
SELECT c_custkey, scenario, CASE scenario WHEN 'septic' THEN 110 WHEN 'deteriorating' THEN 95 ELSE 75 END::DOUBLE AS heart_rate, CASE scenario WHEN 'septic' THEN 4.2 WHEN 'deteriorating' THEN 2.5 ELSE 1.0 END::DOUBLE AS lactate, 7 AS n_vitals, 3 AS n_labs FROM s
""")
def record_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("normal", "septic", "deteriorating", "other")])
    found = scenarios.snapshots(table(spark, sf_dir, "customer").select(k, F.element_at(names, (k % 4 + 1).cast("int")).alias("scenario")), "c_custkey")
    return found.select(k, "scenario", F.col("vitals.heart_rate").alias("heart_rate"), F.col("labs.lactate").alias("lactate"), F.size("vitals").alias("n_vitals"), F.size("labs").alias("n_labs"))
