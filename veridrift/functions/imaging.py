"""Review of image findings: descriptions, modifiers by change and correlation, review level and action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a finding means.
FINDINGS = {
    "normal": "No acute cardiopulmonary abnormality",
    "pneumonia": "Infectious consolidation in lung parenchyma",
    "atelectasis": "Partial or complete collapse of lung or lobe",
    "cardiomegaly": "Enlarged cardiac silhouette",
    "effusion": "Fluid accumulation in pleural space",
    "infiltration": "Increased opacity suggesting inflammation or infection",
    "mass": "Discrete opacity > 3cm in diameter",
    "nodule": "Discrete opacity < 3cm in diameter",
    "pneumothorax": "Air in pleural space",
    "consolidation": "Airspace filled with fluid, pus, or cells",
    "edema": "Pulmonary vascular congestion",
    "emphysema": "Chronic destruction of alveoli",
    "fibrosis": "Scarring of lung tissue",
    "pleural_thickening": "Thickened pleural membrane",
}
# Factors of risk, and notes, by change since the prior study and by fit with the indication.
CHANGE_FACTORS = {"new": 1.5, "worsened": 2.0, "stable": 0.8}
CORRELATION_FACTORS = {"incidental": 1.2, "strong": 0.9}
CHANGE_NOTES = {"new": "NEW FINDING - not present on prior studies", "stable": "Stable compared to prior", "worsened": "WORSENED compared to prior - clinical attention needed"}
CORRELATION_NOTES = {"incidental": "Incidental finding - may not explain presenting symptoms", "strong": "Correlates with clinical indication"}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def finding_description(finding: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(FINDINGS), F.lower(finding)), F.concat(F.lit("Finding: "), finding))


def score_description(score: Column, kind: str) -> Column:
    """What an early warning (``NEWS``) or sepsis (``qSOFA``) score means; other kinds show the score."""
    if kind == "NEWS":
        return F.when(score <= 4, "Low risk - routine monitoring").when(score <= 6, "Medium risk - increased monitoring frequency").otherwise("High risk - urgent clinical review required")
    if kind == "qSOFA":
        return F.when(score <= 1, "Low risk of sepsis").otherwise("High risk of sepsis - consider sepsis workup")
    return F.concat(F.lit("Score: "), score.cast("string"))


def risk_modifier(change: Column, correlation: Column) -> Column:
    """Factor on a finding's risk; what is in neither table (null too) leaves it as it is."""
    return F.coalesce(F.try_element_at(_map(CHANGE_FACTORS), change), F.lit(1.0)) * F.coalesce(F.try_element_at(_map(CORRELATION_FACTORS), correlation), F.lit(1.0))


def context_notes(change: Column, correlation: Column, indication: Column) -> Column:
    """Notes on a finding: its change, its fit, then the indication unless empty or null."""
    asked = F.when(indication != "", F.concat(F.lit("Clinical indication: "), indication))
    return F.array_compact(F.array(F.try_element_at(_map(CHANGE_NOTES), change), F.try_element_at(_map(CORRELATION_NOTES), correlation), asked))


def study_age_days(study_date: Column, as_of: Column) -> Column:
    """Days from a study to ``as_of``; a study without a date counts as a year old."""
    return F.coalesce(F.datediff(as_of, study_date), F.lit(365))


def expected_region(regions: Column, finding: Column) -> Column:
    """First of ``regions`` (an array of structs with ``name`` and ``expected_for``) that expects the finding; null if none does."""
    return F.try_element_at(F.filter(regions, lambda r: F.array_contains(r["expected_for"], finding)), F.lit(1))


def diagnostic_review(risk: Column, n_modifications: Column, set_size: Column, top_score: Column) -> Column:
    """Review level of a diagnostic prediction; only a sure single class with low risk and nothing modified needs none."""
    sure = (risk == "low") & (set_size == 1) & (top_score > 0.9)
    return (
        F.when(risk == "invalid", "reject")
        .when(risk == "uncertain", "detailed")
        .when((risk == "high") | (n_modifications > 0), "standard")
        .when(sure, "none")
        .otherwise("quick_check")
    )


def diagnostic_action(level: Column, top: Column, top_score: Column, set_size: Column, coverage: float = 0.9) -> Column:
    """Sentence that says what to do at a review level; shares are shown as whole percents."""

    def percent(c: Column) -> Column:
        return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))

    return (
        F.when(level == "reject", "REJECT: AI prediction should not be used. Full manual review required.")
        .when(level == "detailed", F.concat(F.lit("DETAILED REVIEW: Prediction set has "), set_size.cast("string"), F.lit(" possibilities. Careful review with priors required.")))
        .when(level == "standard", F.concat(F.lit("STANDARD REVIEW: Normal radiologist review recommended for "), top, F.lit(".")))
        .when(level == "quick_check", F.concat(F.lit("QUICK CHECK: Brief verification of "), top, F.lit(" ("), percent(top_score), F.lit(" confidence).")))
        .otherwise(F.concat(F.lit("AI CONFIDENT: "), top, F.lit(" ("), percent(F.lit(coverage)), F.lit(" coverage guarantee).")))
    )
