"""Conformal calibration, binning, drift and coverage over labelled documents, embeddings, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clinical, risk
from ..operators import calibration, coverage, drift, verification
from .registry import query, table

_PAIRS = "pairs AS (SELECT d.doc_id, d.lang, ((d.doc_id * 37) % 1000) / 1000.0::DOUBLE AS p, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_THRESHOLD = f"""{_PAIRS}, ab AS (SELECT doc_id, lang, p, y, abs(p - y) AS s FROM pairs), nn AS (SELECT count(*) AS n FROM ab),
rk AS (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM ab),
th AS (SELECT s AS t FROM rk, nn WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n)))"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction from each labelled document's id, and its quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "lang", ((F.col("doc_id") * 37 % 1000) / 1000.0).alias("p"), F.col("quality").alias("y"))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_labels(spark, sf_dir).withColumn("s", F.abs(F.col("p") - F.col("y")))


@query(f"WITH {_THRESHOLD} SELECT t AS threshold, n, round((SELECT avg(CASE WHEN s <= t THEN 1.0 ELSE 0.0 END) FROM ab), 6) AS coverage, round((SELECT avg(s) FROM ab), 6) AS mean_score FROM th, nn")
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibration.conformal_threshold(_residuals(spark, sf_dir), "s", 0.9)
    return found.select("threshold", "n", F.round("coverage", 6).alias("coverage"), F.round("mean_score", 6).alias("mean_score"))


@query(f"""
WITH {_PAIRS}, ab AS (SELECT lang, abs(p - y) AS s FROM pairs), r AS (SELECT lang, s, row_number() OVER (PARTITION BY lang ORDER BY s) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM ab)
SELECT lang, n, s AS threshold FROM r WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n))
""")
def conformal_threshold_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.grouped_threshold(_residuals(spark, sf_dir), "lang", "s", 0.9)


@query(f"""
WITH {_THRESHOLD}, b AS (SELECT doc_id, p, greatest(0.0, p - t) AS lo, least(1.0, p + t) AS hi, CASE WHEN p < 0.2 THEN 'BRIEF' WHEN p < 0.5 THEN 'STANDARD' WHEN p < 0.8 THEN 'DETAILED' ELSE 'CRITICAL' END AS own FROM ab, th)
SELECT doc_id, own AS level, array_to_string(list_filter([CASE WHEN (lo < 0.2 AND hi > 0.0) OR own = 'BRIEF' THEN 'BRIEF' END, CASE WHEN (lo < 0.5 AND hi > 0.2) OR own = 'STANDARD' THEN 'STANDARD' END, CASE WHEN (lo < 0.8 AND hi > 0.5) OR own = 'DETAILED' THEN 'DETAILED' END, CASE WHEN (lo < 1.01 AND hi > 0.8) OR own = 'CRITICAL' THEN 'CRITICAL' END], lambda x: x IS NOT NULL), '|') AS levels FROM b
""")
def conformal_level_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = calibration.conformal_threshold(_residuals(spark, sf_dir), "s", 0.9).select("threshold")
    rows = scored_labels(spark, sf_dir).join(F.broadcast(model))  # one row
    return rows.select("doc_id", calibration.score_level(F.col("p")).alias("level"), F.array_join(calibration.level_set(F.col("p"), F.col("threshold")), "|").alias("levels"))


_SOFT = """soft AS (SELECT vec_id, label, [exp(x::DOUBLE - m) FOR x IN z] AS e FROM (SELECT vec_id, label, embedding[1:10] AS z, list_max([x::DOUBLE FOR x IN embedding[1:10]]) AS m FROM embeddings) q),
pr AS (SELECT vec_id, label, [x / list_sum(e) FOR x IN e] AS p FROM soft),
cl AS (SELECT vec_id, label, unnest(p) AS pc, unnest(range(10)) AS c FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pc DESC, c) AS r, sum(pc) OVER (PARTITION BY vec_id ORDER BY pc DESC, c) AS cum FROM cl)"""


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, p``: softmax of an embedding's first ten components."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", calibration.softmax(F.slice("embedding", 1, 10)).alias("p"))


@query(f"""
WITH {_SOFT}, s AS (SELECT vec_id, 1 - pc AS s FROM rk WHERE c = label), n AS (SELECT count(*) AS n FROM s),
th AS (SELECT s AS t FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM s), n WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n)))
SELECT vec_id, label, count(*) FILTER (1 - pc <= t + 1e-12) AS set_size, bool_or(c = label AND 1 - pc <= t + 1e-12) AS covered FROM rk, th GROUP BY vec_id, label
""")
def softmax_conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = softmax_rows(spark, sf_dir).withColumn("s", calibration.true_class_score(F.col("p"), F.col("label")))
    model = calibration.conformal_threshold(rows, "s", 0.9).select((F.col("threshold") + 1e-12).alias("threshold"))  # engines sum softmax in different orders
    sets = rows.join(F.broadcast(model)).withColumn("set", calibration.prediction_set(F.col("p"), F.col("threshold")))
    return sets.select("vec_id", "label", F.size("set").cast("long").alias("set_size"), F.array_contains("set", F.col("label")).alias("covered"))


@query(f"""
WITH {_SOFT}, s AS (SELECT vec_id, cum - pc AS s FROM rk WHERE c = label), n AS (SELECT count(*) AS n FROM s),
th AS (SELECT s + 1e-9 AS t FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM s), n WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n)))
SELECT rk.vec_id, rk.label, count(*) FILTER (cum - pc < t) AS set_size, round(max(cum - pc) FILTER (c = label), 6) AS mass_before FROM rk, th GROUP BY rk.vec_id, rk.label
""")
def aps_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = softmax_rows(spark, sf_dir).withColumn("s", calibration.mass_before(F.col("p"), F.col("label")))
    model = calibration.conformal_threshold(rows, "s", 0.9).select((F.col("threshold") + 1e-9).alias("threshold"))  # clear of rounding at the threshold itself
    sets = rows.join(F.broadcast(model)).withColumn("set", calibration.adaptive_set(F.col("p"), F.col("threshold")))
    return sets.select("vec_id", "label", F.size("set").cast("long").alias("set_size"), F.round(F.greatest(F.col("s"), F.lit(0.0)), 6).alias("mass_before"))


@query(f"WITH {_SOFT} SELECT vec_id, CAST(c AS INTEGER) AS top_class, round(pc, 6) AS p, c = label AS correct FROM rk WHERE r = 1")
def top_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = softmax_rows(spark, sf_dir).withColumn("best", F.element_at(calibration.ranked_classes(F.col("p")), 1))
    return ranked.select("vec_id", F.col("best.label").alias("top_class"), F.round("best.p", 6).alias("p"), (F.col("best.label") == F.col("label")).alias("correct"))


@query("""
WITH r AS (SELECT l_returnflag, l_extendedprice * 0.9::DOUBLE AS lo, l_extendedprice * 1.05::DOUBLE AS hi, l_extendedprice * (0.85::DOUBLE + (l_orderkey % 30) / 100.0::DOUBLE) AS y FROM lineitem),
s AS (SELECT l_returnflag, lo, hi, y, greatest(lo - y, y - hi) AS s FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM s),
t AS (SELECT l_returnflag, n, s AS threshold FROM n WHERE rn = greatest(1, least(ceil(least(1.0::DOUBLE, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) * n), n)))
SELECT t.l_returnflag, any_value(t.n) AS n, round(any_value(t.threshold), 4) AS threshold, round(avg(CASE WHEN y >= lo - t.threshold AND y <= hi + t.threshold THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(hi - lo + 2 * t.threshold), 2) AS mean_width FROM s JOIN t ON s.l_returnflag = t.l_returnflag GROUP BY t.l_returnflag
""")
def cqr_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (price * 0.9).alias("lo"), (price * 1.05).alias("hi"), (price * (0.85 + F.col("l_orderkey") % 30 / 100.0)).alias("y"))
    rows = rows.withColumn("s", calibration.interval_score(F.col("lo"), F.col("hi"), F.col("y")))
    model = calibration.grouped_threshold(rows, "l_returnflag", "s", 0.9)
    met = rows.join(model, "l_returnflag").withColumn("i", calibration.conformal_interval(F.col("lo"), F.col("hi"), F.col("threshold")))
    return met.groupBy("l_returnflag").agg(
        F.first("n").alias("n"),
        F.round(F.first("threshold"), 4).alias("threshold"),
        F.round(F.avg(((F.col("y") >= F.col("i.lower")) & (F.col("y") <= F.col("i.upper"))).cast("double")), 4).alias("coverage"),
        F.round(F.avg(F.col("i.upper") - F.col("i.lower")), 2).alias("mean_width"),
    )


_BINS = f"""{_PAIRS}, e AS (SELECT CAST(i AS INTEGER) AS bin, i * 0.1::DOUBLE AS low, (i + 1) * 0.1::DOUBLE AS high FROM range(10) t(i)),
k AS (SELECT e.bin, count(*) AS n, avg(y) AS m FROM pairs JOIN e ON (p >= low OR bin = 0) AND (p < high OR bin = 9) GROUP BY e.bin),
fit AS (SELECT e.bin, low, high, coalesce(n, 0) AS n, round(coalesce(m, (low + high) / 2), 10) AS value FROM e LEFT JOIN k ON e.bin = k.bin)"""


@query(f"WITH {_BINS} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n, value FROM fit")
def histogram_binning_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = calibration.fit_bins(scored_labels(spark, sf_dir), "p", "y", 10)
    return fitted.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n", "value")


@query(f"WITH {_BINS} SELECT doc_id, CASE WHEN n >= 5 THEN value ELSE p END AS calibrated FROM pairs JOIN fit ON fit.bin = least(CAST(floor(p * 10) AS INTEGER), 9)")
def histogram_binning_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_labels(spark, sf_dir)
    return calibration.apply_bins(rows, calibration.fit_bins(rows, "p", "y", 10), "p", least=5).select("doc_id", "calibrated")


@query(f"WITH {_PAIRS}, b AS (SELECT count(*) AS n, avg(p) AS p, avg(y) AS y FROM pairs GROUP BY least(CAST(floor(p * 10) AS INTEGER), 9)) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.expected_calibration_error(scored_labels(spark, sf_dir), "p", "y")


@query(f"WITH {_PAIRS} SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM pairs")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.brier(scored_labels(spark, sf_dir), "p", "y")


@query(f"""
WITH {_PAIRS}, b AS (SELECT least(CAST(floor(p * 20) AS INTEGER), 19) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM pairs GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(coalesce(p, (i + 0.5::DOUBLE) / 20), 6) AS mean_predicted, round(coalesce(y, (i + 0.5::DOUBLE) / 20), 6) AS mean_observed, coalesce(n, 0) AS n FROM range(20) t(i) LEFT JOIN b ON b.bin = i
""")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reliability_curve(scored_labels(spark, sf_dir), "p", "y", 20)


@query("WITH e AS (SELECT vec_id, label, range(0, CAST(vec_id % 10 AS BIGINT) + 1) AS s FROM embeddings) SELECT round(avg(CASE WHEN list_contains(s, label) THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(len(s)), 6) AS mean_size, count(*) AS n FROM e")
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.sequence(F.lit(0), (F.col("vec_id") % 10).cast("int")).alias("set"))
    found = calibration.coverage_rate(rows, "set", "label")
    return found.select(F.round("coverage", 6).alias("coverage"), F.round("mean_size", 6).alias("mean_size"), "n")


_SIDES = "ev AS (SELECT event_type, value AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events WHERE value IS NOT NULL)"
_PSI = f"""{_SIDES}, sp AS (SELECT event_type, min(v) AS lo, max(v) AS hi, count(*) FILTER (cur) AS nc, count(*) FILTER (NOT cur) AS nr FROM ev GROUP BY event_type),
ct AS (SELECT ev.event_type, least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin, count(*) FILTER (cur) AS c, count(*) FILTER (NOT cur) AS r FROM ev JOIN sp ON ev.event_type = sp.event_type GROUP BY 1, 2),
gr AS (SELECT sp.*, CAST(i AS INTEGER) AS bin FROM sp, range(10) t(i)),
pq AS (SELECT gr.event_type, (coalesce(c, 0) + 1e-4) / (nc + 1e-3) AS pc, (coalesce(r, 0) + 1e-4) / (nr + 1e-3) AS pr FROM gr LEFT JOIN ct ON gr.event_type = ct.event_type AND gr.bin = ct.bin),
psi AS (SELECT event_type, sum((pc - pr) * ln(pc / pr)) AS psi FROM pq GROUP BY event_type)"""
_KS = """vals AS (SELECT event_type, v, count(*) FILTER (cur) AS c, count(*) FILTER (NOT cur) AS r FROM ev GROUP BY event_type, v),
run AS (SELECT event_type, sum(c) OVER w AS cc, sum(r) OVER w AS cr FROM vals WINDOW w AS (PARTITION BY event_type ORDER BY v)),
ks AS (SELECT run.event_type, max(abs(cc / nc - cr / nr)) AS ks, any_value(nr) AS n_ref, any_value(nc) AS n_cur FROM run JOIN sp ON run.event_type = sp.event_type GROUP BY run.event_type)"""


def _current():
    return F.col("ts") >= F.expr("timestamp_ntz'2024-01-16 00:00:00'")


@query(f"WITH {_PSI} SELECT event_type, round(psi, 6) AS psi FROM psi")
def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi(table(spark, sf_dir, "events"), "event_type", "value", _current()).select("event_type", F.round("psi", 6).alias("psi"))


@query(f"""
WITH {_PSI}, {_KS}, l AS (SELECT *, sqrt(n_ref * n_cur / (n_ref + n_cur)) AS en FROM ks)
SELECT event_type, round(ks, 6) AS ks, round(least(1.0, greatest(0.0, 2 * exp(-2 * pow((en + 0.12 + 0.11 / en) * ks, 2)))), 6) AS p_value, n_ref, n_cur FROM l
""")
def ks_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.ks(table(spark, sf_dir, "events"), "event_type", "value", _current())
    return found.select("event_type", F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"), "n_ref", "n_cur")


@query(f"""
WITH {_PSI}, {_KS} SELECT psi.event_type, round(psi, 6) AS psi, round(ks, 6) AS ks, psi >= 0.2 OR ks >= 0.1 AS drifted, CASE WHEN NOT (psi >= 0.2 OR ks >= 0.1) THEN 'none' WHEN psi >= 0.5 THEN 'critical' WHEN psi >= 0.3 THEN 'high' WHEN psi >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM psi JOIN ks ON psi.event_type = ks.event_type
""")
def drift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(table(spark, sf_dir, "events"), "event_type", "value", _current())


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.feature_stats(table(spark, sf_dir, "events"), "event_type", "value")


@query("""
WITH s AS (SELECT event_id, user_id, value <= 20 AS c, row_number() OVER w AS seq, avg(CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rc, avg(CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS oc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq, round(rc, 6) AS rolling_coverage, round(oc, 6) AS overall_coverage, round(0.9::DOUBLE - rc, 6) AS coverage_gap, least(seq, 50) >= 25 AND round(rc, 6) < 0.85 AS degraded FROM s
""")
def rolling_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.rolling(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") <= 20, window=50)
    r6 = {c: F.round(c, 6) for c in ("rolling_coverage", "overall_coverage", "coverage_gap")}
    return found.select("user_id", "event_id", "seq", *[v.alias(k) for k, v in r6.items()], ((F.least("seq", F.lit(50)) >= 25) & (F.round("rolling_coverage", 6) < 0.85)).alias("degraded"))


@query("""
WITH s AS (SELECT user_id, CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
w AS (SELECT user_id, (seq - 1) // 50 AS window_id, CAST(min(seq) AS INTEGER) AS first_seq, CAST(max(seq) AS INTEGER) AS last_seq, count(*) AS n, round(avg(c), 6) AS coverage FROM s GROUP BY 1, 2)
SELECT *, n >= 25 AND coverage < 0.85 AS degraded FROM w
""")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.tumbling(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") <= 20, window=50)


_COVERAGE_DRIFT = """
WITH s AS (SELECT user_id, CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
w AS (SELECT user_id, count(*) AS n, round(avg(c), 6) AS coverage FROM s WHERE rn <= 50 GROUP BY user_id), g AS (SELECT *, round(0.9::DOUBLE - coverage, 6) AS gap FROM w),
v AS (SELECT *, CASE WHEN n < 25 OR gap <= 0 THEN 'none' WHEN gap < 0.05 THEN 'low' WHEN gap < 0.1 THEN 'medium' WHEN gap < 0.15 THEN 'high' ELSE 'critical' END AS severity FROM g)
"""


@query(_COVERAGE_DRIFT + "SELECT *, severity IN ('medium', 'high', 'critical') AS significant FROM v")
def coverage_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.drift(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") <= 20, window=50)


@query("""
WITH p AS (SELECT o_orderkey, o_orderpriority, o_totalprice * 0.8::DOUBLE AS lo, o_totalprice * 1.1::DOUBLE AS hi FROM orders), q AS (SELECT l_orderkey, sum(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderpriority, count(*) AS n_predictions, count(y) AS n_outcomes, round(coalesce(avg(CASE WHEN y IS NOT NULL THEN CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS coverage, round(coalesce(avg(CASE WHEN y IS NOT NULL THEN hi - lo END), 0.0), 2) AS mean_width FROM p LEFT JOIN q ON o_orderkey = l_orderkey GROUP BY o_orderpriority)
SELECT *, CASE WHEN 0.9 - coverage > 0.1 THEN 'critical' WHEN 0.9 - coverage > 0.05 THEN 'warning' ELSE 'none' END AS alert FROM r
""")
def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    predictions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"), "o_orderpriority", (price * 0.8).alias("lower"), (price * 1.1).alias("upper"))
    outcomes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("prediction_id")).agg(F.sum("l_extendedprice").alias("outcome"))
    return coverage.calibration_stats(predictions, outcomes, "o_orderpriority").withColumn("mean_width", F.round("mean_width", 2))


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def recalibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.newest(table(spark, sf_dir, "events"), "ts", "event_id", 25).select("event_id", "user_id", "value")


_VITALS = "v AS (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS rr, 85 + l_quantity % 15 AS spo2, 34 + (l_orderkey % 60) / 10.0::DOUBLE AS temp, 80 + l_quantity * 3 AS sbp, 40 + l_quantity * 2 AS hr, 15 - (l_orderkey % 3) AS gcs FROM lineitem)"


def _vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    cols = {"respiratory_rate": q / 2, "oxygen_saturation": 85 + q % 15, "temperature": 34 + (k % 60) / 10.0, "systolic_bp": 80 + q * 3, "heart_rate": 40 + q * 2, "level_of_consciousness": 15 - k % 3}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query(f"""
WITH {_VITALS}, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN rr <= 8 THEN 3 WHEN rr <= 11 THEN 1 WHEN rr <= 20 THEN 0 WHEN rr <= 24 THEN 2 ELSE 3 END + CASE WHEN spo2 <= 91 THEN 3 WHEN spo2 <= 93 THEN 2 WHEN spo2 <= 95 THEN 1 ELSE 0 END
 + CASE WHEN temp <= 35 THEN 3 WHEN temp <= 36 THEN 1 WHEN temp <= 38 THEN 0 WHEN temp <= 39 THEN 1 ELSE 2 END + CASE WHEN sbp <= 90 THEN 3 WHEN sbp <= 100 THEN 2 WHEN sbp <= 110 THEN 1 WHEN sbp <= 219 THEN 0 ELSE 3 END
 + CASE WHEN hr <= 40 THEN 3 WHEN hr <= 50 THEN 1 WHEN hr <= 90 THEN 0 WHEN hr <= 110 THEN 1 WHEN hr <= 130 THEN 2 ELSE 3 END + CASE WHEN gcs < 15 THEN 3 ELSE 0 END AS news,
 (CASE WHEN rr >= 22 THEN 1 ELSE 0 END) + (CASE WHEN sbp <= 100 THEN 1 ELSE 0 END) + (CASE WHEN gcs < 15 THEN 1 ELSE 0 END) AS qsofa FROM v)
SELECT news, qsofa, count(*) AS n FROM s GROUP BY ALL
""")
def news_qsofa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vitals(spark, sf_dir)
    named = {c: F.col(c) for c in v.columns[2:]}
    q = clinical.qsofa(F.col("respiratory_rate"), F.col("systolic_bp"), F.col("level_of_consciousness") < 15)
    return v.groupBy(clinical.news(named).alias("news"), q.alias("qsofa")).agg(F.count("*").alias("n"))


_RULES = [("respiratory_rate", 4.0, 20.0, "warning"), ("oxygen_saturation", 90.0, 100.0, "error"), ("temperature", 35.0, 39.0, "error"), ("systolic_bp", 90.0, 219.0, "warning"), ("heart_rate", 50.0, 130.0, "critical")]
_RULE_ROWS = ", ".join(f"('{n}', {lo}, {hi}, '{s}')" for n, lo, hi, s in _RULES)


@query(f"""
WITH {_VITALS}, u AS (SELECT l_orderkey, unnest([rr, spo2, temp, sbp, hr]) AS value, unnest(['respiratory_rate', 'oxygen_saturation', 'temperature', 'systolic_bp', 'heart_rate']) AS input FROM v),
r(input, lo, hi, sev) AS (VALUES {_RULE_ROWS}), m AS (SELECT u.l_orderkey, u.input, sev, value < lo OR value > hi AS bad FROM u JOIN r ON u.input = r.input)
SELECT l_orderkey, count(*) AS n_checked, count(*) FILTER (bad AND sev IN ('error', 'critical')) AS n_errors, count(*) FILTER (bad AND sev = 'warning') AS n_warnings, coalesce(string_agg(CASE WHEN bad THEN input END, ',' ORDER BY input), '') AS failures FROM m GROUP BY l_orderkey
""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, *_ in _RULES]
    values = _vitals(spark, sf_dir).unpivot(["l_orderkey"], names, "input", "value")
    rules = spark.createDataFrame([(n, lo, hi, s, False) for n, lo, hi, s in _RULES], "input string, low double, high double, severity string, required boolean")
    return verification.rule_violations(values, rules, "l_orderkey")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'sepsis' WHEN 1 THEN 'readmission' ELSE 'mortality' END AS kind, l_discount * 8 AS score FROM lineitem)
SELECT kind, CASE kind WHEN 'sepsis' THEN CASE WHEN score >= 0.6 THEN 'critical' WHEN score >= 0.4 THEN 'urgent' WHEN score >= 0.2 THEN 'elevated' ELSE 'routine' END WHEN 'readmission' THEN CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'urgent' WHEN score >= 0.3 THEN 'elevated' ELSE 'routine' END
ELSE CASE WHEN score >= 0.5 THEN 'critical' WHEN score >= 0.25 THEN 'urgent' WHEN score >= 0.1 THEN 'elevated' ELSE 'routine' END END AS action, count(*) AS n FROM s GROUP BY ALL
""")
def action_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "sepsis").when(F.col("l_linenumber") % 3 == 1, "readmission").otherwise("mortality")
    rows = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), (F.col("l_discount") * 8).alias("score"))
    return rows.groupBy("kind", clinical.action_for(F.col("kind"), F.col("score")).alias("action")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT vec_id, label, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, abs(embedding[3]::DOUBLE) + 0.1::DOUBLE AS aw, embedding[4]::DOUBLE AS bx, embedding[5]::DOUBLE AS "by", abs(embedding[6]::DOUBLE) + 0.1::DOUBLE AS bw FROM embeddings),
o AS (SELECT vec_id, greatest(0.0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0.0, least(ay + aw, "by" + bw) - greatest(ay, "by")) / (((ax + aw) - ax) * ((ay + aw) - ay)) AS f FROM b)
SELECT vec_id, round(f, 6) AS overlap, CASE WHEN round(f, 6) < 0.3 THEN 'wrong_region' ELSE '' END AS concerns FROM o
""")
def attention_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    boxes = {"a": (e[0], e[1], F.abs(e[2]) + 0.1), "b": (e[3], e[4], F.abs(e[5]) + 0.1)}
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2")).alias(n) for n, (x, y, w) in boxes.items()])
    found = rows.select("vec_id", F.round(verification.box_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))
    concerns = risk.attention_concerns(F.col("overlap"), F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(True), min_coverage=0.3)
    return found.withColumn("concerns", F.array_join(concerns, ","))


@query("""
WITH p AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior_price FROM orders),
l AS (SELECT o_custkey, o_orderkey, o_totalprice, prior_price FROM p)
SELECT o_custkey, o_orderkey, CASE WHEN prior_price IS NULL THEN 'new' WHEN o_totalprice > prior_price * 1.2::DOUBLE THEN 'worsened' WHEN o_totalprice < prior_price * 0.8::DOUBLE THEN 'improved' ELSE 'stable' END AS change FROM l
""")
def latest_prior_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lag("o_totalprice").over(by).alias("prior"))
    price, prior = F.col("o_totalprice"), F.col("prior")
    return rows.select("o_custkey", "o_orderkey", F.when(prior.isNull(), "new").when(price > prior * 1.2, "worsened").when(price < prior * 0.8, "improved").otherwise("stable").alias("change"))


@query("""
WITH pur AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), vw AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT pur.event_id, vw.ts AS prior_ts, vw.view_id AS prior_id FROM pur ASOF LEFT JOIN vw ON pur.user_id = vw.user_id AND pur.ts > vw.ts
""")
def as_of_prior_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return verification.latest_prior(bought, seen, "user_id", "ts").select("event_id", F.col("prior_at").alias("prior_ts"), F.col("prior.view_id").alias("prior_id"))
