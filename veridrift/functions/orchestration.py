"""The detection matrix with three bands of entropy, its review levels and the quick check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below the first an entropy is confident, from the second on uncertain.
CONFIDENT, UNCERTAIN = 0.3, 0.7


def band(entropy: Column, confident: float = CONFIDENT, uncertain: float = UNCERTAIN) -> Column:
    """``confident``, ``moderate`` or ``uncertain``; an entropy that was not computed (null) counts as 0, so confident."""
    h = F.coalesce(entropy, F.lit(0.0))
    return F.when(h < confident, "confident").when(h < uncertain, "moderate").otherwise("uncertain")


def detect(entropy: Column, status: Column, confident: float = CONFIDENT, uncertain: float = UNCERTAIN) -> Column:
    """``struct(pattern, risk)`` of a claim. Any status but verified and contradicted (null too) counts as unverified."""
    b = band(entropy, confident, uncertain)
    pattern = (
        F.when(status == "contradicted", F.when(b == "confident", "confident_hallucinator").otherwise("uncertain_error"))
        .when(status == "verified", "none")
        .otherwise(F.when(b == "confident", "confident_unverified").otherwise("uncertain_unverified"))
    )
    risk = (
        F.when(status == "contradicted", F.when(b == "confident", "critical").otherwise("high"))
        .when(status == "verified", F.when(b == "uncertain", "medium").otherwise("low"))
        .otherwise(F.when(b == "uncertain", "high").otherwise("medium"))
    )
    return F.struct(pattern.alias("pattern"), risk.alias("risk"))


def review_level(risk: Column, entropy: Column, uncertain: float = UNCERTAIN) -> Column:
    """As the two-band level, but only an entropy above ``uncertain`` makes medium risk standard, and minimal risk needs no review."""
    h = F.coalesce(entropy, F.lit(0.0))
    return F.when(risk.isin("critical", "high"), "detailed").when(risk == "medium", F.when(h > uncertain, "standard").otherwise("brief")).when(risk == "low", "brief").otherwise("none")


def quick_check(entropy: Column, verified: Column, contradicted: Column) -> Column:
    """``struct(is_hallucination, pattern)`` from an entropy at hand and two flags; contradiction outweighs, a null flag is false."""
    status = F.when(contradicted, "contradicted").when(verified, "verified").otherwise("not_found")
    found = detect(entropy, status)["pattern"]
    return F.struct(found.isin("confident_hallucinator", "uncertain_error").alias("is_hallucination"), found.alias("pattern"))
