"""Clinical scores and plausible ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible ranges of vital signs and laboratory values.
VITAL_RANGES = {
    "heart_rate": (30, 250),
    "respiratory_rate": (4, 60),
    "systolic_bp": (50, 280),
    "diastolic_bp": (20, 180),
    "mean_arterial_pressure": (30, 200),
    "temperature": (30, 45),
    "oxygen_saturation": (50, 100),
    "level_of_consciousness": (0, 15),
}
LAB_RANGES = {
    "wbc": (0.5, 100),
    "lactate": (0.1, 30),
    "creatinine": (0.1, 25),
    "bilirubin": (0.1, 50),
    "platelet_count": (5, 1000),
    "ph": (6.5, 8.0),
    "po2": (20, 600),
    "pco2": (10, 150),
    "glucose": (20, 1000),
    "sodium": (100, 180),
    "potassium": (1.5, 10),
    "hemoglobin": (2, 25),
    "bun": (1, 200),
}
# Risk scores from which action is elevated, urgent, critical.
ACTION_THRESHOLDS = {
    "sepsis": (0.20, 0.40, 0.60),
    "readmission": (0.30, 0.50, 0.70),
    "deterioration": (0.15, 0.30, 0.50),
    "mortality": (0.10, 0.25, 0.50),
    "cardiac_arrest": (0.05, 0.15, 0.30),
}
# Upper bounds of bands and their points, and the points above the last; then the value assumed if missing.
NEWS_BANDS = {
    "respiratory_rate": ([(8, 3), (11, 1), (20, 0), (24, 2)], 3, 16.0),
    "oxygen_saturation": ([(91, 3), (93, 2), (95, 1)], 0, 98.0),
    "temperature": ([(35.0, 3), (36.0, 1), (38.0, 0), (39.0, 1)], 2, 37.0),
    "systolic_bp": ([(90, 3), (100, 2), (110, 1), (219, 0)], 3, 120.0),
    "heart_rate": ([(40, 3), (50, 1), (90, 0), (110, 1), (130, 2)], 3, 75.0),
}


def banded(value: Column, bands: list[tuple[float, int]], above: int) -> Column:
    out = F.lit(above)
    for bound, points in reversed(bands):
        out = F.when(value <= bound, points).otherwise(out)
    return out


def news(vitals: dict[str, Column]) -> Column:
    """Early warning score from columns by vital sign; missing and null values count as normal."""
    total = F.when(F.coalesce(vitals.get("level_of_consciousness", F.lit(15)), F.lit(15)) < 15, 3).otherwise(0)
    for name, (bands, above, default) in NEWS_BANDS.items():
        total = total + banded(F.coalesce(vitals.get(name, F.lit(default)), F.lit(default)), bands, above)
    return total


def qsofa(respiratory_rate: Column, systolic_bp: Column, altered: Column) -> Column:
    return (respiratory_rate >= 22).cast("int") + (systolic_bp <= 100).cast("int") + altered.cast("int")


def action_for(score_type: Column, score: Column) -> Column:
    """Action level of a risk score by the thresholds of its type; null for an unknown type."""
    out = F.lit(None).cast("string")
    for name, (elevated, urgent, critical) in ACTION_THRESHOLDS.items():
        level = F.when(score >= critical, "critical").when(score >= urgent, "urgent").when(score >= elevated, "elevated").otherwise("routine")
        out = F.when(score_type == name, level).otherwise(out)
    return out
