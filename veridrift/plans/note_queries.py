"""Notes and responses from their text to verdicts: extraction, verification, entropy and tiers in one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import calibration, coverage, notes, numbering, predictive, rollup
from .calibration_queries import _SOFT, softmax_rows
from .claim_queries import _CLAIM, _OWNER, _PATIENT, _RECORD, _medication_claims
from .registry import query, table

_ROLES = """
s AS (SELECT conv_id, role, count(*)::DOUBLE AS c FROM conversations WHERE role IS NOT NULL GROUP BY ALL), t AS (SELECT conv_id, sum(c) AS n, sum(c * log2(c)) AS ss FROM s GROUP BY conv_id),
h AS (SELECT conv_id, round(CASE WHEN n > 1 THEN greatest(0.0, log2(n) - ss / n) / log2(n) ELSE 0.0 END, 6) AS e FROM t)
"""


def _note_sections(parts: DataFrame) -> DataFrame:
    """A note for each patient whose medication section lists the patient's parts, in order."""
    lines = F.array_sort(F.collect_list(F.struct("claim_id", F.concat(F.lit("- "), "claim_text").alias("line"))))
    per = parts.groupBy("patient_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return per.select(F.col("patient_id").alias("note_id"), F.lit(0).alias("section_pos"), F.lit("medications").alias("section"), "text")


@query(f"""
WITH {_ROLES}, c AS (SELECT p_partkey, p_size, {_PATIENT} AS patient, row_number() OVER (PARTITION BY {_PATIENT} ORDER BY p_partkey) - 1 AS pos, split_part(p_name, ' ', 1) AS name, p_size::DOUBLE AS dose, {_CLAIM} AS claim FROM part),
r AS (SELECT {_OWNER} AS patient, {_RECORD} AS record, split_part(p_name, ' ', 1) AS name, (p_size + (p_partkey // 10) % 4)::DOUBLE AS dose FROM part),
m AS (SELECT c.p_partkey, bool_or(abs(c.dose - r.dose) / r.dose <= 0.1) AS fits FROM c JOIN r ON c.patient = r.patient AND (contains(c.name, r.name) OR contains(r.name, c.name)) GROUP BY ALL),
v AS (SELECT c.*, CASE WHEN m.fits THEN 'verified' WHEN m.fits IS NOT NULL THEN 'contradicted' ELSE 'not_found' END AS status FROM c LEFT JOIN m ON c.p_partkey = m.p_partkey),
a AS (SELECT v.*, CASE WHEN status <> 'verified' THEN coalesce(h.e, 0.5) END AS entropy, CASE WHEN status = 'verified' THEN 0.95 ELSE p_size / 50.0::DOUBLE END AS confidence FROM v LEFT JOIN h ON h.conv_id = p_partkey % 100),
b AS (SELECT *, CASE WHEN status = 'verified' OR confidence >= 0.8 THEN 'brief' WHEN confidence >= 0.5 THEN 'standard' ELSE 'detailed' END AS review_tier FROM a)
SELECT patient AS note_id, printf('claim_%03d_medication', pos) AS claim_id, claim AS claim_text, status, entropy, CASE WHEN entropy < 0.3 THEN 'LOW' WHEN entropy < 0.7 THEN 'MEDIUM' WHEN entropy IS NOT NULL THEN 'HIGH' END AS entropy_risk, round(confidence, 6) AS confidence, review_tier,
CAST(round(CAST(round(CASE WHEN status = 'contradicted' THEN 50 + CASE WHEN entropy < 0.3 THEN 100 WHEN entropy > 0.7 THEN 20 ELSE 0 END WHEN status = 'not_found' THEN 30 ELSE 0 END + CASE WHEN status <> 'contradicted' THEN coalesce(entropy * 15, 0.0) ELSE 0.0 END + (1 - confidence) * 20
 + CASE review_tier WHEN 'detailed' THEN 15 WHEN 'standard' THEN 5 ELSE 0 END + 10 + CASE WHEN status <> 'verified' AND p_size < 25 THEN 3 ELSE 0 END, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS priority FROM b
""")
def analyzed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, records = _medication_claims(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sections = _note_sections(claims)
    # a claim's id is its place among its note's parts: places over the whole table, less the first of the note
    placed = numbering.numbered(claims.select("patient_id", F.col("claim_id").alias("p_partkey")), ["patient_id", "p_partkey"], "at")
    firsts = placed.groupBy("patient_id").agg(F.min("at").alias("first"))
    named = placed.join(firsts, "patient_id").select(F.col("patient_id").alias("note_id"), "p_partkey", F.format_string("claim_%03d_medication", F.col("at") - F.col("first")).alias("claim_id"))
    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("response"))
    responses = named.withColumn("conv_id", F.col("p_partkey") % 100).join(said, "conv_id").select("note_id", "claim_id", "response")
    told = named.join(parts, "p_partkey").select("note_id", "claim_id", (F.col("p_size") / 50.0).alias("confidence"), F.when(F.col("p_size") < 25, "Low - check").otherwise("").alias("interpretation"))
    none = spark.createDataFrame([], "note_id long, transcript string")
    found = notes.analyze(sections, none, records, sections.select("note_id", F.col("note_id").alias("patient_id")), responses, told)
    return found.select("note_id", "claim_id", "claim_text", "status", "entropy", "entropy_risk", F.round("confidence", 6).alias("confidence"), "review_tier", "priority")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_partkey % 3 AS k, p_partkey % 5 AS j FROM part)
SELECT p_partkey, 'performance_figure' AS claim_type, CASE WHEN k = 0 THEN 'verified' ELSE 'not_found' END AS status, CASE WHEN k = 0 THEN 'low' ELSE 'critical' END AS claim_risk FROM p
UNION ALL SELECT p_partkey, 'fee_disclosure', CASE WHEN j = 0 THEN 'verified_text' ELSE 'not_found' END, CASE WHEN j = 0 THEN 'low' ELSE 'high' END FROM p
UNION ALL SELECT p_partkey, 'risk_rating', CASE WHEN j = 1 THEN 'partial' ELSE 'not_found' END, CASE WHEN j = 1 THEN 'medium' ELSE 'high' END FROM p
UNION ALL SELECT p_partkey, 'forward_looking', CASE WHEN p_size > 25 THEN 'compliant' ELSE 'missing_disclaimer' END, CASE WHEN p_size > 25 THEN 'medium' ELSE 'high' END FROM p
""")
def verified_finance_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j, size = F.col("p_partkey") % 3, F.col("p_partkey") % 5, F.col("p_size")
    parts = table(spark, sf_dir, "part")
    text = F.concat(F.lit("It returned "), size.cast("string"), F.lit("% with an expense ratio of 0.5%, low risk, and will grow"), F.when(size > 25, "; there is no assurance.").otherwise("."))
    source = F.when(j == 0, "The ratio is 0.5 of assets").when(j == 1, "A fund of low risk").otherwise("")
    sources = parts.select("p_partkey", source.alias("source"), F.create_map(F.lit("1y"), size * (1 + k * 0.02)).alias("returns"), F.create_map().cast("map<string,double>").alias("fees"))
    found = notes.verify_responses(parts.select("p_partkey", text.alias("text")), sources, "finance", "p_partkey", numbers=True)
    return found.select("p_partkey", "claim_type", "status", "claim_risk")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 AS k FROM part)
SELECT p_partkey, 3 AS total_claims, CASE WHEN k = 0 THEN 3 WHEN k = 1 THEN 2 ELSE 0 END AS verified_claims, CASE WHEN k = 0 THEN 'low' WHEN k = 1 THEN 'high' ELSE 'critical' END AS risk, k = 0 AS passed, k >= 2 AND (p_partkey > 5000 OR k = 3) AS flagged, CASE WHEN k = 0 THEN 'brief' ELSE 'detailed' END AS review_level FROM p
""")
def governed_legal_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("p_partkey"), F.col("p_partkey") % 4
    volume = F.when(k == 3, F.lit("2000")).otherwise(F.lit("200"))
    cite = F.concat(F.lit("Ring v. Widget, "), volume, F.lit(" U.S. "), key.cast("string"))
    text = F.concat(cite, F.lit("; 42 U.S.C. § 1983; statute of limitations is 3 years"))
    parts = table(spark, sf_dir, "part")
    source = F.when(k == 0, F.concat(F.lit("title 42 section 1983, within 3 years of "), cite)).when(k == 1, F.concat(F.lit("a 3-year limit in "), cite)).otherwise("")
    checked = notes.verify_responses(parts.select("p_partkey", text.alias("text")), parts.select("p_partkey", source.alias("source")), "legal", "p_partkey")
    verdicts = notes.govern_responses(checked, "p_partkey", "legal")
    return verdicts.select("p_partkey", F.col("total_claims").cast("int").alias("total_claims"), F.col("verified_claims").cast("int").alias("verified_claims"), "risk", "passed", "flagged", "review_level")


@query("""
WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 100) / 100.0::DOUBLE AS pt, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 7) / 50.0::DOUBLE END AS w, o_custkey % 9 = 0 AS no_hr, CASE WHEN o_orderkey % 11 = 0 THEN 400.0 ELSE 80.0 END AS hr, o_orderstatus = 'P' AS dr FROM orders),
q AS (SELECT *, coalesce(round(pt - w, 9), pt - 0.1::DOUBLE) - 0.05::DOUBLE AS lo, coalesce(round(pt + w, 9), pt + 0.1::DOUBLE) + 0.05::DOUBLE AS hi, NOT (hr > 300 AND NOT no_hr) AND NOT no_hr AS ok FROM p),
r AS (SELECT *, CASE WHEN NOT ok THEN 'rejected' WHEN dr THEN 'unreliable' WHEN NOT CASE WHEN abs(pt) < 1e-6 THEN hi - lo <= 0.1 ELSE (hi - lo) / abs(pt) <= 0.2 END THEN 'moderate' ELSE 'reliable' END AS reliability FROM q)
SELECT k, reliability, CASE WHEN NOT ok THEN 'routine' WHEN hi >= 0.8 THEN 'critical' WHEN hi >= 0.5 THEN 'urgent' WHEN hi >= 0.3 THEN 'elevated' ELSE 'routine' END AS action, CASE WHEN ok THEN round(lo, 6) END AS lower, CASE WHEN ok THEN round(hi, 6) END AS upper,
CASE WHEN ok THEN printf('PRED-%06d', row_number() OVER (PARTITION BY ok ORDER BY k)) END AS tracking_id, CASE WHEN no_hr THEN 1 ELSE 0 END AS n_missing, CASE WHEN hr > 300 AND NOT no_hr THEN 1 ELSE 0 END AS n_invalid FROM r
""")
def governed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, point = F.col("o_orderkey"), F.col("o_orderkey") % 100 / 100.0
    half = F.when(key % 4 != 0, key % 7 / 50.0)
    rate = F.when(F.col("o_custkey") % 9 != 0, F.when(key % 11 == 0, 400.0).otherwise(80.0))
    rows = table(spark, sf_dir, "orders").select(
        key.alias("k"), F.create_map(F.lit("heart_rate"), rate, F.lit("age"), F.lit(50.0)).alias("inputs"), F.create_map(F.lit("probability"), point).alias("outputs"),
        F.round(point - half, 9).alias("lower"), F.round(point + half, 9).alias("upper"), (F.col("o_orderstatus") == "P").alias("drifted"),
    )
    found = predictive.analyze_predictions(rows, ["k"], ["heart_rate"], {"heart_rate": (20, 300)}, threshold=0.05)
    rounded = found.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})
    return rounded.select("k", "reliability", "action", "lower", "upper", "tracking_id", "validation.n_missing", "validation.n_invalid")


@query(f"""
WITH {_SOFT}, s AS (SELECT vec_id, 1 - pc AS s FROM rk WHERE c = label), th AS (SELECT s + 1e-9 AS t FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM s) WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n))),
b AS (SELECT vec_id, count(*) FILTER (1 - pc <= t) AS set_size, max(c) FILTER (r = 1) AS top FROM rk, th GROUP BY vec_id),
e AS (SELECT event_id % 3 AS site, CASE WHEN value <= 60 THEN 1.0 ELSE 0.0 END AS c, row_number() OVER (PARTITION BY event_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events), d AS (SELECT site, count(*) >= 50 AND round(0.9 - round(avg(c), 6), 6) >= 0.05 AS drifted FROM e WHERE rn <= 100 GROUP BY site),
p AS (SELECT b.*, lag(top) OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS last, drifted FROM b JOIN d ON site = vec_id % 3)
SELECT vec_id AS study_id, CAST(set_size AS INT) AS set_size, 'c' || top AS top, CASE WHEN last IS NULL THEN 'unknown' WHEN last = top THEN 'stable' ELSE 'new' END AS change, drifted, CASE WHEN drifted OR set_size > 5 THEN 'uncertain' WHEN set_size > 2 THEN 'moderate' ELSE 'low' END AS risk,
CASE WHEN drifted OR set_size > 5 THEN 'detailed' WHEN last <> top THEN 'standard' ELSE 'quick_check' END AS review_level FROM p
""")
def diagnostics_from_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = softmax_rows(spark, sf_dir)
    threshold = calibration.conformal_threshold(rows.withColumn("s", calibration.true_class_score(F.col("p"), F.col("label"))), "s", 0.9).first().threshold + 1e-9
    classes = [f"c{i}" for i in range(10)]
    studies = rows.select((F.col("vec_id") % 20).alias("patient_id"), F.col("vec_id").alias("study_id"), F.timestamp_seconds("vec_id").alias("study_date"), "p", F.lit(None).cast("array<string>").alias("concerns"), (F.col("vec_id") % 3).alias("site"), F.lit("").alias("indication"), F.array().cast("array<string>").alias("symptoms"))
    top = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(F.col("p"), F.array_max("p")).cast("int"))
    priors = studies.select("patient_id", "study_id", "study_date", F.array(top).alias("findings"))
    events = table(spark, sf_dir, "events").withColumn("site", F.col("event_id") % 3)
    drifted = coverage.drift(events, "site", ["ts", "event_id"], F.col("value") <= 60)
    found = predictive.analyze_diagnostics(studies, threshold, classes, priors, drifted, "site")
    return found.select("study_id", "set_size", "top", "change", "drifted", "risk", "review_level")


_COUNTED = "count(*) FILTER (r = 'critical') AS nc, count(*) FILTER (r = 'high') AS nh, count(*) FILTER (s = 'not_found' AND f = 'hallucinated') AS nf, count(*) FILTER (s = 'not_found' AND f = 'faithful') AS nn, count(*) FILTER (s = 'not_found' AND f = 'partially_faithful') AS no"


@query(f"""
WITH c AS (SELECT d.source, d.doc_id, d.lang, CASE WHEN l.quality = 1 THEN 'verified' WHEN l.toxic = 1 THEN 'contradiction' ELSE 'not_found' END AS s, CASE d.lang WHEN 'en' THEN 'hallucinated' WHEN 'de' THEN 'faithful' ELSE 'partially_faithful' END AS f FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, CASE WHEN s = 'verified' THEN 'low' WHEN s = 'contradiction' THEN 'critical' WHEN f = 'hallucinated' THEN 'high' WHEN f = 'faithful' THEN 'low' ELSE 'medium' END AS r FROM c),
g AS (SELECT source, {_COUNTED}, string_agg('   • ' || lang, chr(10) ORDER BY doc_id) FILTER (r = 'critical') AS lc, string_agg('   • ' || lang || ' (HHEM=0.15)', chr(10) ORDER BY doc_id) FILTER (s = 'not_found' AND f = 'hallucinated') AS lf, max(CASE r WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS w FROM r GROUP BY source)
SELECT source, ['low', 'medium', 'high', 'critical'][w] AS overall_risk, sha256(array_to_string(list_filter([CASE WHEN nc > 0 THEN replace('{rollup.CRITICAL_CLAIMS}', '%d', nc::VARCHAR) || chr(10) || lc END, CASE WHEN nh > 0 THEN replace('{rollup.HIGH_CLAIMS}', '%d', nh::VARCHAR) END,
CASE WHEN nf > 0 THEN replace('{rollup.FABRICATED_CLAIMS}', '%d', nf::VARCHAR) || chr(10) || lf END, CASE WHEN nn > 0 THEN replace('{rollup.NEW_CLAIMS}', '%d', nn::VARCHAR) END, CASE WHEN no > 0 THEN replace('{rollup.OPEN_CLAIMS}', '%d', no::VARCHAR) END, CASE WHEN w = 1 THEN '{rollup.ALL_WELL}' END], lambda x: x IS NOT NULL), chr(10))) AS messages_sha256 FROM g
""")
def recommendations_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("claim_text")).join(labels, "doc_id")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "contradiction").otherwise("not_found")
    level = F.when(F.col("claim_text") == "en", "hallucinated").when(F.col("claim_text") == "de", "faithful").otherwise("partially_faithful")
    claims = docs.withColumns({"status": status, "faithfulness": level, "faithfulness_score": F.lit(0.15)})
    claims = claims.withColumn("risk", risk.first_pass_risk(F.col("status"), F.col("faithfulness"), F.lit("low"))).withColumn("risk", F.when(F.col("status") == "contradiction", "critical").otherwise(F.col("risk")))
    found = rollup.document_recommendations(claims, "source", "doc_id")
    return found.select("source", "overall_risk", F.sha2(F.array_join("recommendations", "\n"), 256).alias("messages_sha256"))


@query("""
WITH s AS (SELECT user_id % 40 AS k, count(*) AS n, avg(CASE WHEN value <= 60 THEN 1.0 ELSE 0.0 END) AS c FROM events GROUP BY 1), a AS (SELECT k, round(c, 6) AS coverage, 0.9 - round(c, 6) AS gap, n FROM s)
SELECT k, coverage, CASE WHEN gap > 0.1 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN gap > 0.1 THEN 'URGENT: Recalibrate model immediately' ELSE 'Consider recalibration within 1 week' END AS recommendation FROM a WHERE n >= 50 AND gap > 0.05
""")
def coverage_alerts_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    predictions = events.select((F.col("user_id") % 40).alias("k"), F.col("event_id").alias("prediction_id"), F.lit(0.0).alias("lower"), F.lit(60.0).alias("upper"))
    stats = coverage.calibration_stats(predictions, events.select(F.col("event_id").alias("prediction_id"), F.col("value").alias("outcome")), "k")
    return coverage.coverage_alerts(stats).select("k", "coverage", "severity", "recommendation")
