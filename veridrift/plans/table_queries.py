"""Positions over whole tables, stores of streams and bands: operators whose inputs are tables as they are."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import table_functions, terminology
from ..operators import bootstrap, history, numbering, stages
from ..sources import ledger, records
from ..sources.shared import shared_path, stored
from ..streaming import monitors, outcome_store
from .governance_queries import ORACLES
from .registry import query, table


@query("SELECT o_orderkey, printf('PRED-%06d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS prediction_id FROM orders")
def prediction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return numbering.sequential_ids(orders, ["o_orderdate", "o_orderkey"], "PRED-%06d", "prediction_id", start=1).select("o_orderkey", "prediction_id")


@query("""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS slot, count(*) OVER () AS n FROM benchmark)
SELECT doc_id, pos, item_id FROM d JOIN b ON pos % n = slot
""")
def cycled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, contexts = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "benchmark").select("item_id")
    return numbering.cycled(notes, ["doc_id"], contexts, ["item_id"]).select("doc_id", "pos", "item_id")


@query("""
WITH l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels), e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
SELECT pos, doc_id, quality, vec_id FROM l JOIN e USING (pos)
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, vectors = table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "embeddings").select("vec_id")
    return numbering.zipped(labels, ["doc_id"], vectors, ["vec_id"]).select("pos", "doc_id", "quality", "vec_id")


@query("""
WITH e AS (SELECT event_id, event_id % 4 AS k, event_type, value, count(*) FILTER (event_type = 'view') OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS np FROM events),
o AS (SELECT *, event_id - 4 * (event_id % 24 + 1) AS target FROM e WHERE event_type = 'purchase')
SELECT CAST(o.k AS VARCHAR) AS key, CAST(o.target AS VARCHAR) AS prediction_id, o.value AS outcome, CASE WHEN p.event_id IS NULL OR o.np - p.np >= 8 THEN 'ignored' WHEN o.value BETWEEN p.value * 0.5 AND p.value * 1.5 THEN 'covered' ELSE 'missed' END AS result
FROM o LEFT JOIN e p ON p.event_id = o.target AND p.event_type = 'view'
""")
def streaming_outcome_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = outcome_store.store_session(spark)
    shape = table(spark, sf_dir, "events").schema
    events = session.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("event_type in ('view', 'purchase')")
    event, seen, value = F.col("event_id"), F.col("event_type") == "view", F.col("value").cast("double")
    rows = events.select((event % 4).alias("model"), F.when(seen, "prediction").otherwise("outcome").alias("kind"), F.when(seen, event).otherwise(event - 4 * (event % 24 + 1)).cast("string").alias("prediction_id"), (value * 0.5).alias("lower"), (value * 1.5).alias("upper"), value.alias("outcome"), "event_id")
    answers = outcome_store.outcome_answers(rows, "model", ["event_id"], capacity=8)
    path = shared_path(spark)
    monitors.run_once(answers, path)
    return spark.read.schema(answers.schema).parquet(path)


@query("""
WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CASE o_orderkey % 3 WHEN 0 THEN 'Condition' WHEN 1 THEN 'MedicationRequest' ELSE 'AllergyIntolerance' END AS resource_type, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name FROM orders)
SELECT patient_id, resource_type, id, name FROM f WHERE patient_id IN (SELECT patient_id FROM f WHERE id IN (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders GROUP BY o_orderstatus)) AND resource_type = 'MedicationRequest'
""")
def landed_patient_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, orders = F.col("o_orderkey") % 3, table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_custkey").alias("patient_id"), F.when(kind == 0, "Condition").when(kind == 1, "MedicationRequest").otherwise("AllergyIntolerance").alias("resource_type"), F.col("o_orderkey").alias("id"), F.lit(0).alias("pos"), F.col("o_orderpriority").alias("name"), F.lit(None).alias("detail"), F.lit(True).alias("active"))
    path = shared_path(spark)
    records.land_records(facts, path)
    session = records.records_session(spark)
    ids = [str(r[0]) for r in orders.groupBy("o_orderstatus").agg(F.min("o_orderkey")).select("min(o_orderkey)").collect()]  # one for each of a few states
    patients = [r.patient_id for r in records.records(session, path).where(F.col("id").isin(ids)).select("patient_id").distinct().collect()]
    return records.records(session, path).where(F.col("patient_id").isin(patients) & (F.col("resource_type") == "MedicationRequest")).select("patient_id", "resource_type", "id", "name")


@query("""
SELECT user_id, event_type AS action, count(*) AS n, count(*) FILTER (resource_id IS NULL) AS unnamed FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, CASE WHEN event_id % 2 = 0 THEN event_id END AS resource_id FROM events) GROUP BY ALL
""")
def streaming_activity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    entries = raw.select("user_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("resource_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    path = shared_path(spark)
    ledger.activity_sink(entries, path).awaitTermination()
    ledger.commit_batch(table(spark, sf_dir, "events").limit(1), path, 0)  # the batch comes again and changes nothing
    return ledger.committed(spark, path).groupBy("user_id", "action").agg(F.count("*").alias("n"), F.count_if(F.col("resource_id").isNull()).alias("unnamed"))


_RATIO = "len(list_distinct(w))::DOUBLE / len(w)"
_DIVERSE = "d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"


def _diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, p, y``: the share of a labelled document's words that are distinct, and its quality."""
    ws = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")
    docs = table(spark, sf_dir, "documents").select("doc_id", ws.alias("w")).where(F.size("w") > 0)
    shares = docs.select("doc_id", (F.size(F.array_distinct("w")) / F.size("w")).alias("p"))  # ahead of the join, so that no words are shuffled
    return shares.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "p", F.col("quality").alias("y"))


def _weight_sql(key: str) -> str:
    """Columns up to ``pw``: the same whole-number generator and Poisson steps for replicate ``b``."""
    p, (one, two, three) = bootstrap.PRIME, bootstrap.STEPS
    steps = " + ".join(f"CAST(u > {share}::DOUBLE AS INT)" for share in bootstrap.POISSON)
    return f"(({key} % {p}) * {one} + b * 12345 + 1) % {p} AS x, ((x * x + b + 1) % {p}) * {two} % {p} AS z, (((z * z + x) % {p}) * {three} % {p}) / {p}.0::DOUBLE AS u, {steps} AS pw"


@query(f"""
WITH {_DIVERSE}, r AS (SELECT d.doc_id, {_RATIO} AS p, quality AS y FROM d JOIN labels USING (doc_id) WHERE len(w) > 0),
w AS (SELECT b, p, y, least(floor(p * 10), 9) AS bin, {_weight_sql('doc_id')}, CASE WHEN b < 0 THEN 1 ELSE pw END AS w FROM r, range(-1, 100) t(b)),
g AS (SELECT b, bin, sum(w) AS n, sum(w * p) AS p, sum(w * y) AS y FROM w WHERE w > 0 GROUP BY b, bin), e AS (SELECT b, sum(abs(p - y)) / sum(n) AS ece FROM g GROUP BY b),
l AS (SELECT max(ece) FILTER (b < 0) AS ece, list_sort(list(ece) FILTER (b >= 0)) AS s FROM e)
SELECT round(ece, 6) AS ece, round(s[3], 6) AS lower, round(s[98], 6) AS upper, CASE WHEN ece < 0.05 THEN 'excellent' WHEN ece < 0.1 THEN 'good' WHEN ece < 0.15 THEN 'fair' ELSE 'poor' END AS quality FROM l
""")
def ece_with_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.ece_band(_diversity(spark, sf_dir), "doc_id", "p", "y").drop("recommendation")


@query(f"""
WITH w AS (SELECT b, CAST(value <= 20 AS INT) AS v, {_weight_sql('event_id')}, CASE WHEN b < 0 THEN 1 ELSE pw END AS w FROM events, range(-1, 100) t(b)), e AS (SELECT b, sum(w * v)::DOUBLE / sum(w) AS m FROM w GROUP BY b),
l AS (SELECT max(m) FILTER (b < 0) AS m, list_sort(list(m) FILTER (b >= 0)) AS s, stddev_pop(m) FILTER (b >= 0) AS sd FROM e)
SELECT round(m, 6) AS mean, round(s[3], 6) AS lower, round(s[98], 6) AS upper, round(sd, 6) AS std_dev, CASE WHEN s[98] - s[3] < 0.1 THEN 'low' WHEN s[98] - s[3] < 0.25 THEN 'medium' ELSE 'high' END AS uncertainty FROM l
""")
def coverage_with_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") <= 20).cast("int").alias("covered"))
    return bootstrap.mean_band(rows, "event_id", "covered")


@query("WITH s AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters, round(max(n)::DOUBLE / sum(n), 6) AS dominant_share FROM s GROUP BY source")
def dominant_language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.dominant_share(table(spark, sf_dir, "documents"), "source", "lang")


@query(f"""
WITH {_DIVERSE}, r AS (SELECT d.doc_id, {_RATIO} AS p, CASE WHEN quality = 1 THEN 0.9 WHEN toxic = 1 THEN 0.2 ELSE 0.6 END AS e FROM d JOIN labels USING (doc_id) WHERE len(w) > 0)
SELECT CASE WHEN p > CASE WHEN e > 0.8 THEN 1.0 WHEN e > 0.5 THEN 0.8 ELSE 0.5 END THEN 'overconfident' WHEN p < CASE WHEN e > 0.8 THEN 0.7 WHEN e > 0.5 THEN 0.4 ELSE 0 END THEN 'underconfident' ELSE 'appropriate' END AS calibration, count(*) AS n FROM r GROUP BY ALL
""")
def evidence_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = _diversity(spark, sf_dir).join(labels, "doc_id")
    evidence = F.when(F.col("y") == 1, 0.9).when(F.col("toxic") == 1, 0.2).otherwise(0.6)
    return rows.groupBy(bootstrap.evidence_match(F.col("p"), evidence).alias("calibration")).agg(F.count("*").alias("n"))


def _written_out_sql(text: str, terms: dict[str, str]) -> str:
    for short, long in terms.items():
        text = f"regexp_replace({text}, '(?i)\\b{re.escape(short)}\\b', '{short} ({long})', 'g')"
    return text


@query(f"""
WITH t AS (SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) || ' mg po ' || CASE p_partkey % 3 WHEN 0 THEN 'BID prn, NKDA' WHEN 1 THEN 'q8h via neb' ELSE 'when needed' END AS t FROM part)
SELECT p_partkey, {_written_out_sql('t', terminology.HEALTHCARE_TERMS)} AS written FROM t
""")
def terms_written_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg po "), F.when(k == 0, "BID prn, NKDA").when(k == 1, "q8h via neb").otherwise("when needed"))
    return table(spark, sf_dir, "part").select("p_partkey", terminology.normalized_response(text, "healthcare").alias("written"))


_KNOWN = ", ".join(f"'{s}'" for s in sorted({s for kinds in terminology.SOURCES["legal"].values() for s in kinds}))


@query(f"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://www.sec.gov/') WHEN 2 THEN replace(url, '://', '://sec.gov.') ELSE 'https://google.com/scholar/' || CAST(page_id AS VARCHAR) END AS u FROM pages)
SELECT page_id, len(list_filter([{_KNOWN}], lambda s: contains(lower(u), s))) > 0 AS named, page_id % 4 IN (1, 3) AS authoritative FROM p
""")
def authoritative_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 4, F.col("url")
    source = F.when(k == 0, url).when(k == 1, F.regexp_replace(url, "://", "://www.sec.gov/")).when(k == 2, F.regexp_replace(url, "://", "://sec.gov.")).otherwise(F.concat(F.lit("https://google.com/scholar/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", terminology.is_authoritative(source, "legal").alias("named"), terminology.is_authoritative(source, "legal", strict=True).alias("authoritative"))


@query("""
WITH o AS (SELECT o_custkey AS p, o_orderkey AS s, o_orderdate AS d, unnest([CASE o_orderstatus WHEN 'F' THEN 'Nodule' WHEN 'O' THEN 'lung nodule' ELSE 'fracture' END, lower(o_orderpriority)]) AS f, CASE WHEN o_totalprice < 200000 THEN 'cough after trauma' ELSE '' END AS i FROM orders),
h AS (SELECT a.s, a.f, min(struct_pack(d := b.d, s := b.s)) AS first, max(struct_pack(d := b.d, s := -b.s)) AS latest FROM o a JOIN o b ON a.p = b.p AND b.d < a.d AND contains(lower(b.f), lower(a.f)) GROUP BY ALL),
r AS (SELECT a.s, max(b.d) AS d FROM o a JOIN o b ON a.p = b.p AND b.d < a.d GROUP BY a.s),
m AS (SELECT o.s, o.f, o.i, h.first, h.latest, CASE WHEN r.d IS NULL THEN 'unknown' WHEN h.latest.d = r.d THEN 'stable' ELSE 'new' END AS change, CASE WHEN o.f = 'fracture' AND o.i <> '' THEN 'strong' WHEN o.i <> '' THEN 'incidental' ELSE 'weak' END AS correlation FROM o LEFT JOIN h ON o.s = h.s AND o.f = h.f LEFT JOIN r ON o.s = r.s)
SELECT s AS study_id, f AS finding, change, correlation, CAST(first.s AS VARCHAR) || ' (' || strftime(first.d, '%Y-%m-%d') || ')' AS first_prior, CAST(-latest.s AS VARCHAR) || ' (' || strftime(latest.d, '%Y-%m-%d') || ')' AS latest_prior,
round(CASE change WHEN 'new' THEN 1.5 WHEN 'stable' THEN 0.8 ELSE 1.0 END::DOUBLE * CASE correlation WHEN 'incidental' THEN 1.2 WHEN 'strong' THEN 0.9 ELSE 1.0 END::DOUBLE, 6) AS risk_modifier FROM m
""")
def finding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    findings = F.array(F.when(status == "F", "Nodule").when(status == "O", "lung nodule").otherwise("fracture"), F.lower("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").alias("study_date"), findings.alias("findings"), F.when(F.col("o_totalprice") < 200_000, "cough after trauma").otherwise("").alias("indication"), F.array().cast("array<string>").alias("symptoms"))
    found = history.integrate(orders, orders.select("patient_id", "study_id", "study_date", "findings"))
    return found.select("study_id", "finding", "change", "correlation", "first_prior", "latest_prior", "risk_modifier")


@query(f"""
WITH {_DIVERSE}, r AS (SELECT d.doc_id, {_RATIO} AS p, quality AS y FROM d JOIN labels USING (doc_id) WHERE len(w) > 0),
s AS (SELECT abs(p - y) AS s, row_number() OVER (ORDER BY abs(p - y)) AS rn, count(*) OVER () AS n FROM r), th AS (SELECT s AS t FROM s WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n))),
k AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(y) AS m FROM r GROUP BY 1)
SELECT doc_id, round(greatest(0.0, p - t), 6) AS lower, round(least(1.0, p + t), 6) AS upper, round(CASE WHEN n >= 5 THEN round(m, 10) ELSE p END, 6) AS calibrated FROM r JOIN k ON k.bin = least(CAST(floor(p * 10) AS INT), 9), th
""")
def fitted_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_diversity(spark, sf_dir))  # every pass of the fit reads numbers, the texts are read once
    chosen = [stages.stage("conformal", inputCol="p", labelCol="y", target=0.9), stages.stage("histogram", inputCol="p", labelCol="y", bins=10, least=5)]
    path = shared_path(spark)
    Pipeline(stages=chosen).fit(rows).save(path)
    told = PipelineModel.load(path).transform(rows)
    return told.select("doc_id", F.round("interval.lower", 6).alias("lower"), F.round("interval.upper", 6).alias("upper"), F.round("calibrated", 6).alias("calibrated"))


@query(ORACLES["healthcare_domain_claims"].replace("SELECT p_partkey, printf", "SELECT p_partkey, CAST(pos AS INT) AS pos, printf").split(", CASE WHEN c.k IN ('medication'")[0] + " FROM u")
def lateral_domain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = spark.newSession()
    table_functions.register(session)
    size = "CAST(p_size + 50 AS STRING)"
    text = f"concat('Diagnoses\\n- ', p_name, ' tablet 5 mg\\nBP 120/', {size}, ' HR ', {size}, '. Allergic to penicillin. Sulfa (rash). 2+ pitting edema of both legs.')"
    table(session, sf_dir, "part").selectExpr("p_partkey", f"{text} AS t").createOrReplaceTempView("notes")
    return session.sql("SELECT p_partkey, c.pos, c.claim_id, c.claim_type, c.claim_text FROM notes, LATERAL domain_claims(t, 'healthcare') AS c")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), g AS (SELECT *, max(CASE WHEN length(line) < 60 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS at FROM l),
s AS (SELECT g.doc_id, g.n, coalesce(regexp_replace(lower(k.line), '^\\s+|\\s+$', '', 'g'), 'general') AS section FROM g LEFT JOIN l k ON k.doc_id = g.doc_id AND k.n = g.at WHERE length(g.line) >= 60)
SELECT doc_id, section, CAST(count(*) AS INT) AS n_lines, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY min(n)) - 1 AS INT) AS pos FROM s GROUP BY doc_id, section
""")
def lateral_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = spark.newSession()
    table_functions.register(session)
    table(session, sf_dir, "documents").createOrReplaceTempView("documents")
    return session.sql("SELECT doc_id, s.section, s.n_lines, s.pos FROM documents, LATERAL text_sections(text, 60) AS s")
