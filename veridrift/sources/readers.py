"""Readers of notes, records, cases and logs; malformed lines and missing resources cost their own row only."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEDICATION = "struct<name:string,dose:string,route:string,frequency:string>"
FLAG = "struct<claim:string,issue:string,severity:string,type:string>"
NOTE_SCHEMA = f"""note_id string, patient struct<id:string,name:string,dob:string,mrn:string>, encounter struct<id:string,type:string,date:string,provider:string>,
ai_scribe_output struct<generated_at:string,model:string,sections:map<string,string>,hallucination_flags:array<{FLAG}>>, source_transcript string"""
TRAINING_SCHEMA = "claim_type string, claim_text string, source_sentence string, ehr_status string, hhem_score double, semantic_entropy double, risk_score double, review_level string"
CASE_SCHEMA = """case_id string, claim_text string, claim_type string, ehr_record map<string,string>, ehr_data_available boolean, ground_truth_correct boolean,
multiple_responses array<string>, expected_ehr_status string, difficulty string, softmax_probs map<string,double>, true_risk_label string"""
CODING = "struct<code:string,display:string>"
DOCUMENT_SCHEMA = f"""resourceType string, id string, subject struct<reference:string,display:string>, type struct<coding:array<{CODING}>,text:string>, author array<struct<display:string,reference:string>>,
date string, content array<struct<attachment:struct<data:string,url:string>>>, context struct<encounter:array<struct<reference:string>>>"""
BUNDLE_SCHEMA = f"""resourceType string, entry array<struct<resource:struct<resourceType:string,id:string,subject:struct<reference:string>,code:struct<text:string,coding:array<{CODING}>>,
medicationCodeableConcept:struct<text:string,coding:array<{CODING}>>>>>"""


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Clinical notes, one JSON document a file."""
    return spark.read.schema(NOTE_SCHEMA).option("multiLine", True).json(path)


def note_sections(notes_df: DataFrame) -> DataFrame:
    """``note_id, section_pos, section, text`` of each note; a medication list in JSON becomes bullet lines."""
    rows = notes_df.select("note_id", F.posexplode(F.map_entries("ai_scribe_output.sections")).alias("section_pos", "e"))
    listed = F.from_json("e.value", f"array<{MEDICATION}>")
    lines = F.array_join(F.transform(listed, lambda m: F.concat(F.lit("- "), F.trim(F.concat_ws(" ", m["name"], m["dose"], m["route"], m["frequency"])))), "\n")
    is_list = F.startswith(F.ltrim("e.value"), F.lit("["))
    return rows.select("note_id", "section_pos", F.col("e.key").alias("section"), F.when(is_list, F.coalesce(lines, F.col("e.value"))).otherwise(F.col("e.value")).alias("text"))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(TRAINING_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Experiment cases from one JSON array."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)


def document_references(spark: SparkSession, path: str, patient: str | None = None, count: int | None = None) -> DataFrame:
    rows = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    if patient is not None:
        rows = rows.where(F.col("subject.reference") == f"Patient/{patient}")
    return rows if count is None else rows.orderBy("id").limit(count)


def bundle_facts(spark: SparkSession, path: str, per_patient: int = 20) -> DataFrame:
    """``patient_id, resource_type, pos, name`` of the resources in bundles, the first ``per_patient`` of each kind; a missing name is ``Unknown``."""
    r = F.col("entry.resource")
    rows = spark.read.schema(BUNDLE_SCHEMA).json(path).select(F.posexplode("entry").alias("pos", "entry"))
    flat = rows.select(F.element_at(F.split(r["subject"]["reference"], "/"), -1).alias("patient_id"), r["resourceType"].alias("resource_type"), "pos", r["id"].alias("resource_id"), F.coalesce(r["code"]["text"], r["medicationCodeableConcept"]["text"], F.lit("Unknown")).alias("name"))
    rank = F.row_number().over(Window.partitionBy("patient_id", "resource_type").orderBy("pos", "resource_id"))
    return flat.withColumn("_n", rank).where(F.col("_n") <= per_patient).drop("_n")


def patient_context(facts: DataFrame, patients: DataFrame) -> DataFrame:
    """Patients with arrays of their conditions, medications and allergies, in order; empty where there are none."""
    kinds = {"conditions": "Condition", "medications": "MedicationRequest", "allergies": "AllergyIntolerance"}
    own = F.array_sort
    per = facts.groupBy("patient_id").agg(*[F.transform(own(F.collect_list(F.when(F.col("resource_type") == k, F.struct("pos", "name")))), lambda x: x["name"]).alias(n) for n, k in kinds.items()])
    met = patients.join(per, "patient_id", "left")
    return met.select(*patients.columns, *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in kinds])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Settings:
    """Thresholds of a run; keys of a file that are unknown are ignored, a missing file gives these defaults."""

    target_coverage: float = 0.9
    coverage_tolerance: float = 0.05
    window: int = 100
    psi_threshold: float = 0.2
    ks_threshold: float = 0.1
    bins: int = 10
    entropy_low: float = 0.3
    entropy_high: float = 0.6
    similarity_threshold: float = 0.5
    dose_tolerance: float = 0.1

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        if path is None or not Path(path).exists():
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})
