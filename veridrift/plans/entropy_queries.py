"""Semantic entropy, consistency, hallucination risk and review queues over events, conversations and labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk, uncertainty
from ..functions.text import STOP_WORDS, faithfulness, faithfulness_level
from ..operators import entropy, rollup
from .registry import query, table

_SIZES = """
c AS (SELECT user_id, event_type, count(*) AS s FROM events GROUP BY user_id, event_type),
t AS (SELECT user_id, CAST(sum(s) AS BIGINT) AS n, count(*) AS k, sum(s * log2(s)) AS ss, list(s) AS sizes FROM c GROUP BY user_id)
"""


def _user_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = entropy.cluster_sizes(table(spark, sf_dir, "events"), "user_id", F.col("event_type"))
    return entropy.semantic_entropy(sizes, "user_id", requested=20)


@query(f"WITH {_SIZES} SELECT user_id, n AS n_responses, k AS n_clusters, round(greatest(0.0, log2(n) - ss / n), 6) AS entropy_bits FROM t")
def semantic_entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_entropy(spark, sf_dir).select("user_id", "n_responses", "n_clusters", "entropy_bits")


@query(f"""
WITH {_SIZES},
e AS (SELECT *, greatest(0.0, log2(n) - ss / n) AS bits, list_sum(list_transform(sizes, lambda x: -(x / n) * ln(x / n + 1e-10))) AS nat, CASE WHEN k > 1 THEN ln(k) ELSE 1.0 END AS over_k FROM t)
SELECT user_id, round(CASE WHEN n > 1 THEN bits / log2(n) ELSE 0.0 END, 6) AS entropy_of_n, round(least(1.0, bits / log2(20)), 6) AS entropy_of_requested,
round(least(1.0, greatest(0.0, nat / over_k)), 6) AS entropy_of_k, round(greatest(0.0, nat) / greatest(over_k, 1.0), 4) AS entropy_floored FROM e
""")
def entropy_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_entropy(spark, sf_dir).select("user_id", "entropy_of_n", "entropy_of_requested", "entropy_of_k", "entropy_floored")


def _any(words: list[str], t: str = "t") -> str:
    return "(" + " OR ".join(f"contains({t}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"""
WITH r AS (SELECT conv_id, lower(text) AS t FROM conversations),
l AS (SELECT conv_id, CASE WHEN {_any(["yes", "mentioned", "discussed", "confirmed", "stated"])} AND NOT {_any(["not", "no", "didn't", "wasn't", "unclear"])} THEN 'yes' WHEN {_any(["no", "not", "didn't", "wasn't", "never"])} THEN 'no' ELSE 'unclear' END AS c,
CASE WHEN {_any(["verified", "confirmed", "correct"])} THEN 'verified' WHEN {_any(["contradiction", "incorrect", "error"])} THEN 'contradiction' WHEN {_any(["uncertain", "cannot", "review"])} THEN 'uncertain' ELSE 'other' END AS v FROM r)
SELECT 'yes_no' AS scheme, conv_id, c AS cluster, count(*) AS size FROM l GROUP BY conv_id, c UNION ALL SELECT 'verdict', conv_id, v, count(*) FROM l GROUP BY conv_id, v
""")
def entropy_keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    schemes = {"yes_no": entropy.yes_no_cluster(F.col("text")), "verdict": entropy.verdict_cluster(F.col("text"))}
    parts = [entropy.cluster_sizes(talks, "conv_id", c).select(F.lit(name).alias("scheme"), "conv_id", "cluster", "size") for name, c in schemes.items()]
    return parts[0].union(parts[1])


@query("WITH c AS (SELECT user_id, event_type, count(*) AS s FROM events GROUP BY user_id, event_type) SELECT user_id, round(max(s) / sum(s), 6) AS consistency, CAST(sum(s) AS BIGINT) AS n_responses FROM c GROUP BY user_id")
def consistency_modal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entropy.consistency(table(spark, sf_dir, "events"), "user_id", F.col("event_type"))
    return found.select("user_id", F.round("consistency", 6).alias("consistency"), "n_responses")


@query("""
WITH r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS norm FROM conversations),
f AS (SELECT conv_id, norm, min(turn) AS first FROM r GROUP BY conv_id, norm),
d AS (SELECT conv_id, norm, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS cluster_id FROM f)
SELECT r.conv_id, r.turn, CAST(d.cluster_id AS INTEGER) AS cluster_id FROM r JOIN d ON r.conv_id = d.conv_id AND r.norm = d.norm
""")
def exact_match_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return entropy.first_seen_clusters(talks, "conv_id", "turn", entropy.exact_cluster(F.col("text"))).select("conv_id", "turn", "cluster_id")


_CLAIMS = """
claims AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, CASE WHEN l.quality = 1 THEN 'verified' WHEN l.toxic = 1 THEN 'contradicted' WHEN d.doc_id % 5 = 0 THEN 'partial' ELSE 'not_found' END AS status,
((d.doc_id * 37) % 1000) / 1000.0::DOUBLE AS entropy, ((d.doc_id * 53) % 1000) / 1000.0::DOUBLE AS confidence, CASE WHEN l.toxic = 1 THEN 'high' ELSE 'standard' END AS claim_risk FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tiered AS (SELECT *, CASE WHEN claim_risk = 'high' THEN CASE WHEN confidence >= 0.9 THEN 'standard' ELSE 'detailed' END WHEN confidence >= 0.85 THEN 'brief' WHEN confidence >= 0.6 THEN 'standard' ELSE 'detailed' END AS review_tier FROM claims),
scored AS (SELECT *, CAST(round(CAST(round((CASE WHEN status = 'contradicted' THEN 50 + CASE WHEN entropy < 0.3 THEN 100 WHEN entropy > 0.7 THEN 20 ELSE 0 END WHEN status = 'not_found' THEN 30 WHEN status = 'partial' THEN 10 ELSE 0 END)
 + CASE WHEN status <> 'contradicted' THEN entropy * 15 ELSE 0.0 END + (1 - confidence) * 20 + CASE review_tier WHEN 'detailed' THEN 15 WHEN 'standard' THEN 5 ELSE 0 END + CASE WHEN claim_risk = 'high' THEN 10 ELSE 0 END + (doc_id % 3) * 3, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS priority FROM tiered)
"""


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each labelled document: status from its labels, entropy and confidence from its id."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "contradicted").when(F.col("doc_id") % 5 == 0, "partial").otherwise("not_found")
    claims = docs.join(labels, "doc_id").withColumns({"status": status, "entropy": (F.col("doc_id") * 37 % 1000) / 1000.0, "confidence": (F.col("doc_id") * 53 % 1000) / 1000.0, "claim_risk": F.when(F.col("toxic") == 1, "high").otherwise("standard")})
    tiered = claims.withColumn("review_tier", uncertainty.review_tier(F.col("confidence"), F.col("claim_risk")))
    return tiered.withColumn("priority", risk.priority_score(F.col("status"), F.col("entropy"), F.col("confidence"), F.col("review_tier"), F.col("claim_risk"), F.col("doc_id") % 3))


@query(f"WITH {_CLAIMS} SELECT doc_id, status, priority, CAST(row_number() OVER (ORDER BY priority DESC, doc_id) AS INTEGER) AS rank FROM scored ORDER BY priority DESC, doc_id LIMIT 20")
def review_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.review_queue(document_claims(spark, sf_dir).select("doc_id", "status", "priority"), "priority", "doc_id", 20)


@query(f"WITH {_CLAIMS} SELECT source, doc_id, priority, CAST(row_number() OVER (PARTITION BY source ORDER BY priority DESC, doc_id) AS INTEGER) AS rank FROM scored")
def review_queue_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.note_queue(document_claims(spark, sf_dir).select("source", "doc_id", "priority"), "source", "priority", "doc_id")


@query(f"""
WITH {_CLAIMS}, b AS (SELECT source, count(*) AS total_claims, count(*) FILTER (review_tier = 'brief') AS brief_review, count(*) FILTER (review_tier = 'standard') AS standard_review, count(*) FILTER (review_tier = 'detailed') AS detailed_review FROM tiered GROUP BY source)
SELECT *, brief_review * 20 + standard_review * 90 + detailed_review * 240 AS estimated_review_seconds, round((total_claims * 240 - (brief_review * 20 + standard_review * 90 + detailed_review * 240)) * 100.0::DOUBLE / (total_claims * 240), 1) AS time_saved_percent, round(brief_review * 100.0::DOUBLE / total_claims, 1) AS brief_percent FROM b
""")
def review_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.review_burden(document_claims(spark, sf_dir), by=["source"])


@query(f"""
WITH {_CLAIMS}, n AS (SELECT source, count(*) AS n_claims, count(*) FILTER (status = 'contradicted' AND entropy < 0.3) AS confident_hallucinators, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (entropy >= 0.6) AS high_entropy, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (priority > 40) AS high_priority FROM scored GROUP BY source)
SELECT *, CASE WHEN confident_hallucinators > 0 THEN 'critical' WHEN contradicted > 0 OR high_entropy >= 2 THEN 'high' WHEN high_entropy > 0 OR not_found >= 3 THEN 'medium' ELSE 'low' END AS risk FROM n
""")
def note_risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.note_rollup(document_claims(spark, sf_dir), "source")


@query(f"""
WITH {_CLAIMS}, s AS (SELECT source, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status <> 'verified') AS needs_entropy FROM claims GROUP BY source),
a AS (SELECT DISTINCT source FROM documents)
SELECT a.source, coalesce(total, 0) AS total, coalesce(verified, 0) AS verified, coalesce(contradicted, 0) AS contradicted, coalesce(partial, 0) AS partial, coalesce(not_found, 0) AS not_found, coalesce(needs_entropy, 0) AS needs_entropy,
round(CASE WHEN coalesce(total, 0) = 0 THEN 100.0 ELSE verified * 100.0::DOUBLE / total END, 6) AS verification_rate, round(CASE WHEN coalesce(total, 0) = 0 THEN 100.0 ELSE (1 - needs_entropy::DOUBLE / total) * 100 END, 6) AS compute_saved FROM a LEFT JOIN s ON a.source = s.source
""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.status_summary(document_claims(spark, sf_dir), "source", empty_keys=table(spark, sf_dir, "documents"), empty_rate=100.0)
    return found.withColumns({c: F.round(c, 6) for c in ("verification_rate", "compute_saved")})


@query(f"""
WITH {_SIZES}, e AS (SELECT user_id, round(CASE WHEN n > 1 THEN greatest(0.0, log2(n) - ss / n) / log2(n) ELSE 0.0 END, 6) AS h FROM t),
m AS (SELECT user_id, h, user_id % 3 = 0 AS verified, user_id % 3 = 1 AS contradicted, h < 0.5 AS sure FROM e)
SELECT user_id, h AS entropy, sure AND contradicted AS detected, CASE WHEN sure AND contradicted THEN 'critical' WHEN sure AND verified THEN 'low' WHEN sure THEN 'medium' WHEN contradicted THEN 'high' WHEN verified THEN 'medium' ELSE 'high' END AS risk,
CASE WHEN sure AND contradicted THEN 'detailed' WHEN (NOT sure AND contradicted) OR (NOT sure AND NOT verified) THEN 'detailed' WHEN (sure AND NOT verified OR NOT sure AND verified) AND h > 0.5 THEN 'standard' ELSE 'brief' END AS review_level FROM m
""")
def confident_hallucinator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _user_entropy(spark, sf_dir).select("user_id", F.col("entropy_of_n").alias("entropy"))
    found = users.withColumn("m", risk.confident_hallucinator(F.col("entropy"), F.col("user_id") % 3 == 0, F.col("user_id") % 3 == 1, threshold=0.5))
    return found.select("user_id", "entropy", "m.detected", "m.risk", risk.review_level(F.col("m.risk"), F.col("entropy")).alias("review_level"))


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
r AS (SELECT *, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'minimal' END AS risk, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS k FROM s)
SELECT user_id, arg_max(risk, k) AS risk, CAST(sum(n) AS BIGINT) AS n_claims, CAST(arg_max(n, k) AS BIGINT) AS n_worst FROM r GROUP BY user_id
""")
def risk_rollup_weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "signup", "medium").when(kind == "click", "low").otherwise("minimal")
    return rollup.risk_rollup(table(spark, sf_dir, "events").select("user_id", level.alias("risk")), "user_id")


@query("""
WITH t AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 30 WHEN 'signup' THEN 60 WHEN 'purchase' THEN 90 ELSE 35 END AS secs, event_type = 'error' AS bad FROM events)
SELECT user_id, CAST(sum(secs) AS BIGINT) AS manual_seconds, count(*) * 0.5::DOUBLE + count(*) FILTER (bad) * 63.0::DOUBLE AS automated_seconds, round(greatest(0.0, sum(secs) - (count(*) * 0.5::DOUBLE + count(*) FILTER (bad) * 63.0::DOUBLE)), 1) AS saved_seconds FROM t GROUP BY user_id
""")
def time_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    claim_type = F.when(kind == "view", "medication").when(kind == "click", "allergy").when(kind == "signup", "diagnosis").when(kind == "purchase", "procedure").otherwise("none")
    claims = table(spark, sf_dir, "events").select("user_id", claim_type.alias("claim_type"), F.when(kind == "error", "contradiction").otherwise("verified").alias("status"))
    return rollup.time_saved(claims, "claim_type", "status", by=["user_id"])


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS claim, b.text AS source FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
w AS (SELECT *, list_filter({_WORDS.format('claim')}, lambda x: NOT list_contains([{_STOP}], x)) AS wc, list_filter({_WORDS.format('source')}, lambda x: NOT list_contains([{_STOP}], x)) AS ws,
contains(regexp_replace(regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), regexp_replace(regexp_replace(lower(claim), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS inside FROM p),
s AS (SELECT *, CASE WHEN len(wc) > 0 THEN len(list_intersect(wc, ws))::DOUBLE / len(wc) ELSE 0.0 END AS o FROM w),
f AS (SELECT conv_id, turn, round(CASE WHEN inside THEN 0.95 WHEN o > 0 THEN 0.4 + o * 0.45 ELSE 0.15 END, 6) AS score FROM s)
SELECT *, CASE WHEN score >= 0.8 THEN 'faithful' WHEN score >= 0.5 THEN 'partially_faithful' WHEN score >= 0.2 THEN 'likely_hallucinated' ELSE 'hallucinated' END AS level FROM f
""")
def hhem_mock_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    claims = talks.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("claim"))
    before = talks.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    scored = claims.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(faithfulness(F.col("claim"), F.col("source")), 6).alias("score"))
    return scored.withColumn("level", faithfulness_level(F.col("score")))


@query("""
WITH p AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_found' WHEN 2 THEN 'contradiction' ELSE 'not_checkable' END AS status, (p_partkey * 29 % 1000) / 1000.0::DOUBLE AS f, (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS h FROM part),
q AS (SELECT *, CASE WHEN f >= 0.8 THEN 'faithful' WHEN f >= 0.5 THEN 'partially_faithful' WHEN f >= 0.2 THEN 'likely_hallucinated' ELSE 'hallucinated' END AS fl, CASE WHEN h < 0.3 THEN 'low' WHEN h < 0.6 THEN 'medium' ELSE 'high' END AS el FROM p),
r AS (SELECT *, CASE WHEN status IN ('verified', 'not_checkable') THEN 'low' WHEN status = 'not_found' THEN CASE WHEN fl = 'faithful' THEN 'low' WHEN fl IN ('likely_hallucinated', 'hallucinated') THEN 'high' ELSE 'medium' END
WHEN el = 'high' THEN 'medium' WHEN el = 'medium' THEN 'high' WHEN fl = 'faithful' THEN 'high' ELSE 'critical' END AS risk FROM q)
SELECT status, risk, CASE risk WHEN 'critical' THEN 'urgent' WHEN 'high' THEN 'elevated' ELSE 'routine' END AS priority, count(*) AS n FROM r GROUP BY ALL
""")
def ehr_first_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    status = F.when(size == 0, "verified").when(size == 1, "not_found").when(size == 2, "contradiction").otherwise("not_checkable")
    level = risk.first_pass_risk(F.col("status"), faithfulness_level((F.col("p_partkey") * 29 % 1000) / 1000.0), risk.entropy_band((F.col("p_partkey") * 37 % 1000) / 1000.0))
    claims = table(spark, sf_dir, "part").withColumn("status", status).withColumn("risk", level)
    return claims.withColumn("priority", risk.review_priority(F.col("risk"))).groupBy("status", "risk", "priority").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_found' WHEN 2 THEN 'contradiction' ELSE 'not_checkable' END AS s, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 29 % 1000) / 1000.0::DOUBLE END AS f, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 37 % 1000) / 1000.0::DOUBLE END AS h, CASE WHEN p_partkey % 11 = 0 THEN 'warfarin 5 mg' ELSE p_name END AS claim FROM part)
SELECT p_partkey, round(least(1.0, CASE s WHEN 'verified' THEN 0.05 WHEN 'not_checkable' THEN 0.10 WHEN 'not_found' THEN CASE WHEN f >= 0.5 THEN 0.15 ELSE 0.85 END ELSE CASE WHEN h >= 0.6 THEN 0.5 WHEN f >= 0.5 THEN 0.8 ELSE 0.95 END END::DOUBLE + CASE WHEN contains(claim, 'warfarin') THEN 0.05 ELSE 0.0 END::DOUBLE), 4) AS risk_score,
CASE WHEN s IN ('verified', 'not_checkable') THEN 'BRIEF' WHEN s = 'not_found' THEN CASE WHEN f >= 0.5 THEN 'STANDARD' ELSE 'DETAILED' END ELSE CASE WHEN h >= 0.6 THEN 'STANDARD' WHEN f >= 0.5 THEN 'DETAILED' ELSE 'CRITICAL' END END AS review_level FROM p
""")
def rule_based_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size") % 4, F.col("p_partkey")
    status = F.when(size == 0, "verified").when(size == 1, "not_found").when(size == 2, "contradiction").otherwise("not_checkable")
    faithful = F.when(key % 7 != 0, (key * 29 % 1000) / 1000.0)
    h = F.when(key % 5 != 0, (key * 37 % 1000) / 1000.0)
    claim = F.when(key % 11 == 0, "warfarin 5 mg").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", risk.predicted_risk(status, faithful, h, claim).alias("r")).select("p_partkey", "r.risk_score", "r.review_level")


@query(f"""
WITH {_SIZES}, e AS (SELECT user_id, greatest(0.0, log2(n) - ss / n) AS h, round((SELECT max(x) FROM unnest(sizes) u(x)) / n, 6) AS cons FROM t),
q AS (SELECT user_id, round(h, 6) AS h, cons, greatest(0.0, 1 - round(h, 6) / 2) AS ef FROM e),
cc AS (SELECT *, round(cons * 0.4::DOUBLE + 0.7::DOUBLE * ef * 0.3::DOUBLE + ef * 0.3::DOUBLE, 3) AS calibrated_confidence, user_id % 2 = 0 AS high FROM q)
SELECT user_id, calibrated_confidence, CASE WHEN high THEN CASE WHEN calibrated_confidence >= 0.9 THEN 'standard' ELSE 'detailed' END WHEN calibrated_confidence >= 0.85 THEN 'brief' WHEN calibrated_confidence >= 0.6 THEN 'standard' ELSE 'detailed' END AS review_tier,
array_to_string(list_filter([CASE WHEN h > 1.0 THEN 'HIGH_ENTROPY' END, CASE WHEN cons < 0.6 THEN 'LOW_CONSISTENCY' END, CASE WHEN high THEN 'HIGH_RISK_CLAIM' END, CASE WHEN calibrated_confidence < 0.5 THEN 'LOW_CONFIDENCE' END], lambda x: x IS NOT NULL), ',') AS flags FROM cc
""")
def quantified_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _user_entropy(spark, sf_dir).join(consistency_modal_share(spark, sf_dir).select("user_id", "consistency"), "user_id")
    kind = F.when(F.col("user_id") % 2 == 0, "medication").otherwise("symptom")
    u = uncertainty.quantified(kind, F.lit("no statement"), F.col("consistency"), F.col("entropy_bits"))
    return users.select("user_id", u.alias("u")).select("user_id", "u.calibrated_confidence", "u.review_tier", F.array_join("u.flags", ",").alias("flags"))
