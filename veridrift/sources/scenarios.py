"""Small fixed tables that stand in for record systems: snapshots by scenario, image metadata, paraphrases, a fixed search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clinical import LAB_RANGES, VITAL_RANGES

# Measurements of each scenario, in the order of the names.
MEASURES = ["heart_rate", "respiratory_rate", "systolic_bp", "diastolic_bp", "temperature", "oxygen_saturation", "level_of_consciousness", "wbc", "lactate", "creatinine"]
SCENARIOS = {
    "normal": [75, 16, 120, 80, 37.0, 98, 15, 7.5, 1.0, 1.0],
    "septic": [110, 24, 90, 55, 38.8, 92, 14, 18.5, 4.2, 2.1],
    "deteriorating": [95, 22, 105, 65, 37.8, 94, 15, 12.0, 2.5, 1.4],
}
# Prior studies and metadata of any image study.
PRIOR_STUDIES = [("XR-2023-001", "2023-06-15", ["normal"], "Normal chest radiograph"), ("XR-2022-045", "2022-12-01", ["normal"], "No acute cardiopulmonary abnormality")]
IMAGE_METADATA = {"modality": "CR", "body_part": "CHEST", "view_position": "PA", "bits_stored": "12", "photometric_interpretation": "MONOCHROME2"}
# Ids that a search without parameters finds.
SEARCH_IDS = ["12742400", "12724066", "12742399"]


def snapshots(patients: DataFrame, key: str = "patient_id", scenario: str = "scenario") -> DataFrame:
    """``key, scenario, vitals, labs`` (maps) of each patient; an unknown or null scenario has the values of ``normal``."""

    def values(name: str, kinds: dict) -> Column:
        return F.create_map(*[F.lit(x) for m, v in zip(MEASURES, SCENARIOS[name]) if m in kinds for x in (m, float(v))])

    def pick(kinds: dict) -> Column:
        return F.when(F.col(scenario) == "septic", values("septic", kinds)).when(F.col(scenario) == "deteriorating", values("deteriorating", kinds)).otherwise(values("normal", kinds))

    return patients.select(key, scenario, pick(VITAL_RANGES).alias("vitals"), pick(LAB_RANGES).alias("labs"))


def prior_studies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRIOR_STUDIES, "study_id string, study_date string, findings array<string>, impression string")


def image_metadata(studies: DataFrame, key: str = "study_id") -> DataFrame:
    return studies.select(key, *[F.lit(v).alias(k) for k, v in IMAGE_METADATA.items()])


def paraphrases(prompt: Column, n: int) -> Column:
    """The first ``n`` of five ways to say a prompt, from which entropy can be computed without a model."""
    bare = F.replace(F.replace(prompt, F.lit("Patient is on ")), F.lit("Patient on "))
    said = F.array(prompt, F.concat(prompt, F.lit(", as documented")), F.concat(F.lit("The patient is prescribed "), bare), F.concat(prompt, F.lit(" per medication list")), F.concat(F.lit("Current medication includes "), bare))
    return F.slice(said, 1, max(n, 0))


def search_patients(patients: DataFrame, count: int = 10, ids: list[str] | None = None, key: str = "patient_id") -> DataFrame:
    """Patients among the first ``count`` of the fixed ids; ids that no patient has are passed over."""
    return patients.where(F.col(key).isin(*(SEARCH_IDS if ids is None else ids)[:count]))
