"""Composed analyses: of notes, of responses, of diagnostic predictions, and the rows they give a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dashboard, imaging, orchestration, risk


def analyze_notes(claims: DataFrame, entropy: str = "entropy", confidence: str = "confidence") -> DataFrame:
    """Claims with ``entropy``, ``entropy_risk``, ``confidence``, ``review_tier``, ``flag`` and ``priority`` of the note analysis.

    Entropy counts for contradicted and missing claims only (else null; null input there: 0.5). A verified claim has confidence
    0.95 and a brief review; other claims have their own (null: 0.5), from 0.8 brief, from 0.5 standard. The flag is the part of
    ``interpretation`` ahead of " - ", null for verified claims and empty interpretations.
    """
    status, verified = F.col("status"), F.coalesce(F.col("status") == "verified", F.lit(False))
    h = F.when(status.isin("contradicted", "not_found"), F.coalesce(F.col(entropy), F.lit(0.5)))
    sure = F.when(verified, 0.95).otherwise(F.coalesce(F.col(confidence), F.lit(0.5)))
    out = claims.withColumns({"_h": h, "_c": sure}).withColumns(
        {
            "entropy": F.col("_h"),
            "entropy_risk": F.when(F.col("_h").isNotNull(), dashboard.api_risk_label(F.col("_h"))),
            "confidence": F.col("_c"),
            "review_tier": F.when(verified | (F.col("_c") >= 0.8), "brief").when(F.col("_c") >= 0.5, "standard").otherwise("detailed"),
            "flag": F.when(~verified, F.nullif(F.substring_index("interpretation", " - ", 1), F.lit(""))),
        }
    )
    score = risk.priority_score(status, F.col("_h"), F.col("_c"), F.col("review_tier"), F.col("claim_risk"), F.col("flag").isNotNull().cast("int"))
    return out.withColumn("priority", score).drop("_h", "_c")


def note_summary(analyzed: DataFrame, key: str) -> DataFrame:
    """One row a note from ``analyze_notes``: counts, share of entropy checks saved in percent, and the most urgent entropy."""
    s = F.col("status")
    per = analyzed.groupBy(key).agg(
        F.count("*").alias("total_claims"),
        F.count_if(s == "verified").alias("verified"),
        F.count_if(s == "contradicted").alias("contradictions"),
        F.count_if((s == "contradicted") & (F.col("entropy") < 0.3)).alias("confident_hallucinators"),
        F.count_if(F.col("priority") > 40).alias("high_priority_count"),
        *[F.count_if(F.col("review_tier") == t).alias(f"{t}_review") for t in ("brief", "standard", "detailed")],
    )
    return per.withColumns({"needs_review": F.col("total_claims") - F.col("verified"), "compute_saved_percent": F.col("verified") * 100.0 / F.col("total_claims")})


def dashboard_rows(summaries: DataFrame, key: str) -> DataFrame:
    """Rows of the dashboard from ``note_summary`` with ``overall_risk`` and ``entropy`` of the most urgent claim."""
    return summaries.select(
        key,
        dashboard.row_status(F.col("overall_risk")).alias("row_status"),
        dashboard.row_type(F.col("overall_risk")).alias("row_type"),
        dashboard.row_review(F.col("detailed_review"), F.col("standard_review")).alias("review_level"),
        dashboard.risk_band(F.col("contradictions"), F.col("needs_review"), F.col("entropy")).alias("risk_band"),
        dashboard.entropy_text(F.col("entropy")).alias("entropy_text"),
    )


def record_results(claims: DataFrame) -> DataFrame:
    """What a check against records answers for each claim, and nothing else."""
    return claims.select("claim_text", "claim_type", "status", "ehr_match", "confidence", "explanation")


def analyze_claims(claims: DataFrame) -> DataFrame:
    """``status, entropy`` claims with ``pattern``, ``risk``, ``review_level`` and ``entropy_calculated``.

    Entropy is looked at for claims that are not verified only; where it is skipped or null it counts as 0, so as confident.
    """
    needed = F.coalesce(risk.needs_entropy(F.col("status")), F.lit(True))
    h = F.when(needed, F.col("entropy"))
    found = claims.withColumns({"_h": h, "entropy_calculated": needed}).withColumn("_d", orchestration.detect(F.col("_h"), F.col("status")))
    out = found.withColumns({"pattern": F.col("_d.pattern"), "risk": F.col("_d.risk")})
    return out.withColumn("review_level", orchestration.review_level(F.col("risk"), F.col("_h"))).drop("_h", "_d")


def flagged(claims: DataFrame) -> DataFrame:
    """Contradicted claims with ``flag_group`` 0, then missing ones with 1: ordering by it puts all contradicted ones first."""
    group = F.when(F.col("status") == "contradicted", 0).when(F.col("status") == "not_found", 1)
    return claims.withColumn("flag_group", group).where(F.col("flag_group").isNotNull())


def without_low_risk(claims: DataFrame, keep_low: bool = False, level: str = "risk") -> DataFrame:
    """Claims worth checking: those of low risk go unless they are asked for; a null risk stays."""
    return claims if keep_low else claims.where(F.coalesce(F.col(level) != "low", F.lit(True)))


def source_text(session: Column, documents: Column) -> Column:
    """Text to check against: the session's own unless null or empty, else the documents' contents (array of strings) joined by blanks."""
    return F.coalesce(F.nullif(session, F.lit("")), F.array_join(documents, " "))


def residual(claims: DataFrame, *taken: DataFrame, key: str) -> DataFrame:
    """Claims that none of ``taken`` has, by key; repeated keys of ``taken`` add no rows, a null key stays."""
    out = claims
    for other in taken:
        out = out.join(other.select(key), key, "left_anti")
    return out


def ai_documents(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("author_type") == "ai_scribe")


def single_document(mapped: DataFrame, document_id: str, prefix: str = "cerner_") -> DataFrame:
    """The document with an id, given with or without the prefix of mapped ids."""
    return mapped.where(F.col("document_id") == prefix + document_id.removeprefix(prefix))


def dashboard_time_saved(claims: DataFrame, by: list[str]) -> DataFrame:
    """Seconds by hand against seconds by the service and on contradictions, and the percent saved, never below 0."""
    contradicted = F.count_if(F.col("status") == "contradicted")
    per = claims.groupBy(*by).agg(F.sum(dashboard.manual_seconds(F.col("claim_type"))).alias("manual_seconds"), (F.count("*") * dashboard.SERVICE_SECONDS + contradicted * dashboard.CONTRADICTION_SECONDS).alias("service_seconds"))
    share = (F.col("manual_seconds") - F.col("service_seconds")) * 100.0 / F.col("manual_seconds")
    return per.withColumn("saved_percent", F.round(F.greatest(F.lit(0.0), share), 1))


def analyze_diagnostics(predictions: DataFrame, coverage: float = 0.9) -> DataFrame:
    """``top, top_score, set_size, n_concerns, drifted, n_modifications`` with ``risk``, ``review_level`` and ``action``."""
    out = predictions.withColumn("risk", risk.diagnostic_risk(F.col("n_concerns"), F.col("drifted"), F.col("set_size")))
    out = out.withColumn("review_level", imaging.diagnostic_review(F.col("risk"), F.col("n_modifications"), F.col("set_size"), F.col("top_score")))
    return out.withColumn("action", imaging.diagnostic_action(F.col("review_level"), F.col("top"), F.col("top_score"), F.col("set_size"), coverage))


def validate_first_pass(claims: DataFrame) -> DataFrame:
    """``status, faithfulness, entropy_level`` claims with ``risk`` and ``priority`` of the records-first validation: the record
    decides first, faithfulness weighs what it lacks or contradicts, and entropy only what it contradicts."""
    band = F.when(F.col("status") == "contradiction", F.col("entropy_level"))
    scored = claims.withColumn("risk", risk.first_pass_risk(F.col("status"), F.col("faithfulness"), band))
    return scored.withColumn("priority", risk.review_priority(F.col("risk")))
