"""Audit and model logs: filters, summaries and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import redacted
from ..functions.risk import log_score


def recent(logs: DataFrame, as_of: Column, days: int, user: str | None = None, action: str | None = None, n: int = 100) -> DataFrame:
    """The newest ``n`` entries of the last ``days`` days, filtered before they are limited."""
    rows = logs.where(F.col("timestamp") >= as_of - F.expr(f"interval {days} days"))
    if user is not None:
        rows = rows.where(F.col("user_email") == user)
    if action is not None:
        rows = rows.where(F.col("action") == action)
    return rows.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(n)


def summary(logs: DataFrame) -> DataFrame:
    """Total, distinct users with an address, and entries of each action (``action`` null: of all)."""
    users = F.count_distinct(F.nullif(F.col("user_email"), F.lit("")))
    return logs.rollup("action").agg(F.count("*").alias("total"), users.alias("users"))


def model_log_summary(logs: DataFrame) -> DataFrame:
    """Counts and mean milliseconds in total, by type and by level, in one pass of grouping sets."""
    sets = logs.groupingSets([[], ["analysis_type"], ["level"]], "analysis_type", "level")
    return sets.agg(F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("total"), F.round(F.coalesce(F.avg("processing_ms"), F.lit(0.0)), 6).alias("avg_ms"))


def model_log_entry(df: DataFrame) -> DataFrame:
    """Text cut to 1000 characters and the first non-zero score."""
    return df.withColumn("text", F.substring("text", 1, 1000)).withColumn("score", log_score(F.col("entropy"), F.col("uncertainty"), F.col("confidence")))


def redact(df: DataFrame, columns: list[str], nested: str | None = None) -> DataFrame:
    """Personal information masked in columns and in the ``claim_text`` of an array column; a row is stamped, and fails rather than passes unmasked."""
    out = df.withColumns({c: redacted(F.col(c)) for c in columns})
    if nested:
        out = out.withColumn(nested, F.transform(nested, lambda c: c.withField("claim_text", redacted(c["claim_text"]))))
    return out.withColumn("_phi_redacted", F.lit(True))


def audit_entry(claims: DataFrame, key: str) -> DataFrame:
    """One entry for a note: its flagged claims, how many need more than a brief review, and how many it has."""
    flagged = F.collect_list(F.when(F.size("flags") > 0, F.struct("claim_id", "flags")))
    return claims.groupBy(key).agg(F.array_sort(flagged).alias("flagged"), F.count_if(F.col("review_tier") != "brief").alias("needs_review"), F.count("*").alias("n_claims"))


def author_counts(docs: DataFrame) -> DataFrame:
    """Processed, AI-written and their rate."""
    ai = F.count_if(F.col("author_type") == "ai_scribe")
    return docs.agg(F.count("*").alias("processed"), ai.alias("ai"), (ai / F.greatest(F.lit(1), F.count("*"))).alias("ai_rate"))


# Columns of a user activity entry.
ACTIVITY = ["user_id", "user_email", "user_name", "action", "resource_type", "resource_id", "ip", "user_agent", "details", "timestamp"]


def activity_entry(df: DataFrame) -> DataFrame:
    """The columns of a user activity entry, in order; those that ``df`` lacks are null."""
    kinds = {"timestamp": "timestamp"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ACTIVITY])
