"""Findings of a study against the patient's earlier ones, by an inverted index of findings joined as of the study's date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from ..functions.packs import clinical_correlation
from ..sources.shared import stored
from .similarity import contained
from .verification import latest_prior


def _exploded(studies: DataFrame, patient: str, *columns: str) -> DataFrame:
    rows = studies.select(F.col(patient).alias("patient"), *columns, F.explode("findings").alias("finding"))
    return rows.where("patient is not null and trim(finding) <> ''").withColumn("norm", F.lower("finding"))


def alike_findings(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """``norm, earlier``: distinct findings and the distinct earlier ones that contain them, in lower case; every distinct text is compared once, whoever has it."""
    a, b = current.select("norm").distinct(), earlier.select("norm").distinct()
    pairs = contained(a.select(F.col("norm").alias("claim_id"), F.col("norm").alias("claim_text")), b.select(F.col("norm").alias("source_id"), F.col("norm").alias("source_text")), threshold=1.0)
    return pairs.where(F.contains("source_id", F.col("claim_id"))).select(F.col("claim_id").alias("norm"), F.col("source_id").alias("earlier"))


def integrate(current: DataFrame, priors: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Each finding of each study in the light of the patient's studies before it, and of why it was asked for.

    ``current``: patient, ``study_id, study_date, findings, indication, symptoms``; ``priors``: patient, ``study_id, study_date,
    findings``. A study had a finding if one of its own contains it, in any case. Gives ``study_id, finding, description, change``
    (``stable`` if the patient's latest day of studies before had it, ``new`` if not, ``unknown`` without any), ``correlation, first_prior, latest_prior``
    (``id (date)`` of the earliest and the latest before that had it; the smaller id of one day), ``risk_modifier, notes``.

    Prior findings become an index by patient and finding, in which an earlier finding stands under each of now that it contains:
    one as-of join answers the first and the latest prior, linear in the rows of a patient and finding. Studies are given their latest day
    before while they are one row each, and repeated findings go where the as-of join has them. Null and blank findings, null patients and
    null dates of priors are left out; repeated findings of a study are one.
    """
    studies = current.select(F.col(patient).alias("patient"), "study_id", "study_date", "findings", "indication", "symptoms").where("patient is not null")
    known = priors.select(F.col(patient).alias("patient"), "study_id", "study_date", "findings").where("patient is not null and study_date is not null")
    days = [rows.where("study_date is not null").select("patient", "study_date").distinct() for rows in (studies, known)]
    before = latest_prior(days[0].withColumn("one", F.lit(1)), days[1], "patient", "study_date").select("patient", "study_date", F.col("prior_at").alias("recent"))
    # stored, so that Spark knows its size before it plans the join
    alike = stored(alike_findings(_exploded(studies, "patient"), _exploded(known, "patient")))
    had = _exploded(known, "patient", "study_id", "study_date").groupBy("patient", F.col("norm").alias("earlier"), "study_date").agg(F.min("study_id").alias("prior_id"))
    index = had.join(alike, "earlier").select("patient", "norm", "study_date", "prior_id")
    asked = _exploded(studies.join(before, ["patient", "study_date"], "left"), "patient", "study_id", "study_date", "indication", "symptoms", "recent")
    asked = asked.withColumn("correlation", clinical_correlation(F.col("finding"), F.col("indication"), F.col("symptoms"))).drop("symptoms")
    met = latest_prior(asked, index, ["patient", "norm"], "study_date", earliest=True)
    own = lambda c: F.when(F.col("study_id").isNotNull(), F.col(c))  # noqa: E731  studies without an id are not told their priors
    met = met.withColumns({"first_id": own("earliest.prior_id"), "first_at": own("earliest.study_date"), "latest_id": own("prior.prior_id"), "latest_at": own("prior_at")}).drop("prior", "prior_at", "earliest")
    met = met.dropDuplicates(["patient", "norm", "study_id", "study_date", "finding"])  # where the as-of join has them
    change = F.when(F.col("recent").isNull(), "unknown").when(F.col("latest_at") == F.col("recent"), "stable").otherwise("new")
    cited = lambda i, d: F.concat(i.cast("string"), F.lit(" ("), F.date_format(d, "yyyy-MM-dd"), F.lit(")"))
    return met.withColumn("change", change).select(
        "study_id",
        "finding",
        imaging.finding_description(F.col("finding")).alias("description"),
        "change",
        "correlation",
        cited(F.col("first_id"), F.col("first_at")).alias("first_prior"),
        cited(F.col("latest_id"), F.col("latest_at")).alias("latest_prior"),
        F.round(imaging.risk_modifier(F.col("change"), F.col("correlation")), 6).alias("risk_modifier"),
        imaging.context_notes(F.col("change"), F.col("correlation"), F.col("indication")).alias("notes"),
    )
