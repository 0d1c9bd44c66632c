"""FHIR-style document references as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, slug

# Note types by code, and words that tell of automated authors.
NOTE_TYPES = {
    "11488-4": "consult_note",
    "18842-5": "discharge_summary",
    "34117-2": "history_and_physical",
    "28570-0": "procedure_note",
    "34746-8": "anesthesia_note",
    "11506-3": "progress_note",
    "11504-8": "surgical_note",
    "34874-8": "pre_operative_note",
    "34878-9": "post_operative_note",
    "18748-4": "radiology_report",
    "59258-4": "emergency_note",
}
AI_WORDS = ["device", "ai", "scribe", "dragon", "dax", "nuance", "ambient", "automated", "bot", "agent"]


def author_type(reference: Column, display: Column, strict: bool = False) -> Column:
    """``ai_scribe`` by device reference or keyword, else by practitioner reference and name, else ``unknown``. ``strict``: keywords as whole words only."""
    ref, both = F.lower(F.coalesce(reference, F.lit(""))), F.lower(F.concat_ws(" ", reference, display))
    keyword = F.rlike(both, F.lit(rf"\b({'|'.join(AI_WORDS)})\b")) if strict else any_of(both, AI_WORDS)
    name = F.lower(F.coalesce(display, F.lit("")))
    staff = F.when(any_of(name, ["md", "dr.", "physician", "doctor"]), "physician").when(any_of(name, ["rn", "nurse"]), "nurse").otherwise("clinical_staff")
    return F.when(both == "", "unknown").when(F.contains(ref, F.lit("device/")) | keyword, "ai_scribe").when(F.contains(ref, F.lit("practitioner")), staff).otherwise("unknown")


def last_segment(reference: Column) -> Column:
    return F.element_at(F.split(reference, "/"), -1)


def patient_id(reference: Column, display: Column) -> Column:
    return F.coalesce(F.nullif(last_segment(reference), F.lit("")), F.concat(F.lit("name:"), F.nullif(display, F.lit(""))), F.lit("unknown"))


def note_type(codes: Column, text: Column) -> Column:
    """The type of the first known code, else the text as a slug, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for kv in NOTE_TYPES.items() for x in kv])
    known = F.filter(F.transform(codes, lambda c: F.try_element_at(table, c)), lambda t: t.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.nullif(slug(F.coalesce(text, F.lit(""))), F.lit("")), F.lit("unknown"))


def decoded(data: Column, url: Column) -> Column:
    """Attachment text from base64, else a mark of its address, else null."""
    text = F.try_to_binary(data, F.lit("base64")).cast("string")
    return F.coalesce(text, F.concat(F.lit("[external: "), url, F.lit("]")))


def review_level(author: Column) -> Column:
    return F.when(author == "ai_scribe", "detailed").when(author == "unknown", "standard").otherwise("brief")


def map_documents(docs: DataFrame) -> DataFrame:
    """Flat rows of nested document references: ids, type, author, content, date, warnings and review level."""
    first = F.try_element_at("author", F.lit(1))
    author = author_type(first["reference"], first["display"])
    content = F.try_element_at(F.filter(F.transform("content", lambda c: decoded(c["attachment"]["data"], c["attachment"]["url"])), lambda t: t.isNotNull()), F.lit(1))
    encounter = F.try_element_at(F.col("context.encounter"), F.lit(1))["reference"]
    return docs.select(
        F.concat(F.lit("cerner_"), F.col("id")).alias("document_id"),
        patient_id(F.col("subject.reference"), F.col("subject.display")).alias("patient_id"),
        last_segment(encounter).alias("encounter_id"),
        note_type(F.transform("type.coding", lambda c: c["code"]), F.col("type.text")).alias("note_type"),
        F.coalesce(first["display"], F.lit("Unknown")).alias("author_name"),
        author.alias("author_type"),
        F.coalesce(content, F.lit("")).alias("content"),
        F.try_to_timestamp(F.col("date")).alias("document_date"),
        F.array_compact(F.array(F.when(content.isNull(), "no content"), F.when(F.try_to_timestamp(F.col("date")).isNull(), "no date"))).alias("warnings"),
        review_level(author).alias("review_level"),
    )
