"""Governance of predictions, inputs first; and of diagnostic scores, prediction sets first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dashboard, risk
from ..functions.packs import is_narrow, reliability
from . import analysis, calibration, history, numbering

#: Half the width of the interval that stands in where a model gives no quantiles.
MARGIN = 0.1
# What is said of an action level, around the interval.
ACTIONS = {
    "critical": ("CRITICAL: Risk interval ", ". Immediate clinical review required."),
    "urgent": ("URGENT: Risk interval ", ". Prompt clinical assessment needed."),
    "elevated": ("ELEVATED: Risk interval ", ". Increased monitoring recommended."),
    "routine": ("ROUTINE: Risk interval ", ". Continue standard monitoring."),
}


def input_summary(inputs: Column, required: list[str], ranges: dict[str, tuple[float, float]], reject_on_missing: bool = False, most_missing: float = 0.2) -> Column:
    """``struct(n_inputs, n_valid, n_invalid, n_missing, acceptable, issues)`` of a map of inputs.

    Required inputs that are absent or null are missing; what is given, required or not, is valid unless it is outside its range (an input without
    one is valid). Acceptable: nothing invalid, few enough missing, and none at all if ``reject_on_missing``. A null map has no inputs.
    """
    given = F.map_filter(F.coalesce(inputs, F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull())
    names = F.array(*[F.lit(r) for r in required]) if required else F.array().cast("array<string>")
    missing = F.array_except(names, F.map_keys(given))
    low, high = (F.create_map(*[F.lit(x) for name, bounds in ranges.items() for x in (name, float(bounds[at]))]) if ranges else F.create_map().cast("map<string,double>") for at in (0, 1))
    outside = F.array_sort(F.map_keys(F.map_filter(given, lambda k, v: F.coalesce((v < F.try_element_at(low, k)) | (v > F.try_element_at(high, k)), F.lit(False)))))
    said = [F.transform(outside, lambda n: F.concat(n, F.lit(" out of range")))]
    if reject_on_missing:
        said.insert(0, F.transform(missing, lambda n: F.concat(F.lit("Missing required input: "), n)))
    issues = F.concat(*said)
    acceptable = (F.size(issues) == 0) & (F.size(missing) <= most_missing * len(required))
    return F.struct(
        (F.size(F.map_keys(given)) + F.size(missing)).alias("n_inputs"),
        (F.size(F.map_keys(given)) - F.size(outside)).alias("n_valid"),
        F.size(outside).alias("n_invalid"),
        F.size(missing).alias("n_missing"),
        acceptable.alias("acceptable"),
        issues.alias("issues"),
    )


def analyze_predictions(predictions: DataFrame, order: list[str], required: list[str], ranges: dict[str, tuple[float, float]], threshold: float | None = None, target: float = 0.9, thresholds: tuple[float, float, float] = (0.3, 0.5, 0.8), reject_on_missing: bool = False) -> DataFrame:
    """Predictions (``inputs`` and ``outputs`` maps, ``lower, upper`` or null, ``drifted``) with all that is decided about them.

    Adds ``validation`` (``input_summary``), ``point``, ``lower, upper`` (the quantiles, or ``MARGIN`` around the point, widened by
    the conformal ``threshold`` if there is one), ``guarantee`` (0 without one), ``reliability``, ``action`` (by the upper bound), ``recommended_action`` and
    ``tracking_id`` (in ``order``). A prediction whose inputs are not acceptable is rejected: it has no interval, no id, and routine action.
    """
    staged = predictions.withColumn("validation", input_summary(F.col("inputs"), required, ranges, reject_on_missing))
    accepted, point = F.col("validation.acceptable"), dashboard.point_estimate(F.col("outputs"))
    own = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    low, high = F.when(own, F.col("lower")).otherwise(point - MARGIN), F.when(own, F.col("upper")).otherwise(point + MARGIN)
    wide = 0.0 if threshold is None else float(threshold)
    staged = staged.withColumns({"_low": low - wide, "_high": high + wide, "_point": point})
    narrow = (F.col("_high") - F.col("_low")) < 0.2 if threshold is None else is_narrow(F.col("_low"), F.col("_high"), F.col("_point"))
    level = reliability(accepted, F.coalesce("drifted", F.lit(False)), F.col("validation.n_missing"), narrow)
    elevated, urgent, critical = thresholds
    action = F.when(accepted, risk.action_level(F.col("_high"), F.lit(elevated), F.lit(urgent), F.lit(critical))).otherwise("routine")
    out = staged.withColumns({"point": F.when(accepted, F.col("_point")), "lower": F.when(accepted, F.col("_low")), "upper": F.when(accepted, F.col("_high")), "guarantee": F.when(accepted, F.lit(0.0 if threshold is None else target)), "reliability": level, "action": action})
    interval = F.format_string("[%.2f, %.2f]", "_low", "_high")
    text = F.concat(F.lit("REJECTED: "), F.array_join("validation.issues", "; "))
    for name, (before, after) in ACTIONS.items():
        text = F.when(accepted & (F.col("action") == name), F.concat(F.lit(before), interval, F.lit(after))).otherwise(text)
    out = out.withColumn("recommended_action", text).drop("_low", "_high", "_point")
    ids = numbering.sequential_ids(out.where("validation.acceptable").select(*order), order, "PRED-%06d", "tracking_id", start=1)
    return out.join(ids, order, "left")


def analyze_diagnostics(studies: DataFrame, threshold: float, classes: list[str], priors: DataFrame, drifted: DataFrame, site: str, patient: str = "patient_id", coverage: float = 0.9) -> DataFrame:
    """Diagnostic scores to review level and action: prediction set, attention, earlier studies and drift, each from its operator.

    ``studies``: patient, ``study_id, study_date, p`` (scores of ``classes``), ``concerns`` (array of ``attention_concerns``, null if no map), site,
    ``indication, symptoms``. A top class that is new against the patient's earlier studies (``priors``, as in ``history.integrate``) is one
    modification. ``drifted``: site, ``significant``, as ``coverage.drift`` gives it. Adds ``set_size, top, top_score, change,
    n_concerns, n_modifications, drifted, risk, review_level, action``.
    """
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    staged = studies.withColumns({"set_size": F.size(calibration.prediction_set(F.col("p"), F.lit(threshold))), "top": F.element_at(names, best), "top_score": F.array_max("p"), "n_concerns": F.size(F.coalesce("concerns", F.array().cast("array<string>")))})
    told = history.integrate(staged.withColumn("findings", F.array("top")), priors, patient).select("study_id", F.col("finding").alias("top"), "change")
    met = staged.join(told, ["study_id", "top"], "left").join(drifted.select(site, F.col("significant").alias("drifted")), site, "left")
    met = met.withColumns({"n_modifications": F.when(F.col("change") == "new", 1).otherwise(0), "drifted": F.coalesce("drifted", F.lit(False))})
    return analysis.analyze_diagnostics(met, coverage)
