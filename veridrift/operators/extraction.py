"""Claims from text: one row for each claim that a note makes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import Rule, Scanner, disjoint
from ..functions.text import collapsed, normalized

# Patterns of claims in clinical notes.
ALLERGY_PATTERNS = [r"(?i)allerg(?:y|ic|ies)\s*(?:to\s+)?:?\s*([^.,]+)", r"(?i)(NKDA)", r"(?i)(no known (?:drug )?allergies)"]
ALLERGY_REACTION = r"(?i)([A-Za-z]+)\s*\(([^)]+(?:rash|anaphylaxis|hives|swelling)[^)]*)\)"
VITAL_PATTERNS = {
    "blood_pressure": r"(?i)BP\s*:?\s*(\d{2,3}/\d{2,3})",
    "heart_rate": r"(?i)(?:HR|heart rate|pulse)\s*:?\s*(\d{2,3})",
    "oxygen_sat": r"(?i)(?:SpO2|O2 sat|oxygen)\s*:?\s*(\d{2,3})%?",
    "temperature": r"(?i)(?:temp|temperature)\s*:?\s*(\d{2,3}(?:\.\d)?)",
    "respiratory_rate": r"(?i)(?:RR|resp(?:iratory)? rate)\s*:?\s*(\d{1,2})",
}
EXAM_PATTERNS = [
    r"(?i)(murmur[^.]*)",
    r"(?i)(edema[^.]*)",
    r"(?i)(regular (?:rate and )?rhythm)",
    r"(?i)(irregular rhythm)",
    r"(?i)(clear to auscultation)",
    r"(?i)(no (?:murmurs|gallops|rubs))",
    r"(?i)(JVD[^.]*)",
    r"(?i)(jugular venous[^.]*)",
]
# Section names whose bullets are conditions.
CONDITION_SECTIONS = ["condition", "history", "diagnos"]


def _bullets(text: Column) -> Column:
    """What follows a bullet, line by line, if longer than two characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("• ")))
    return F.filter(F.transform(marked, lambda x: F.regexp_replace(F.substr(x, F.lit(3)), r"^\s+|\s+$", "")), lambda x: F.length(x) > 2)


def _tagged(values: Column, kind: str, risk: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("claim_type"), F.lit(risk).alias("risk"), x.alias("claim_text")))


def medication_claims(section: Column, text: Column) -> Column:
    return F.when(F.contains(F.lower(section), F.lit("medication")), _tagged(_bullets(text), "medication", "high")).otherwise(_tagged(F.array().cast("array<string>"), "medication", "high"))


def condition_claims(section: Column, text: Column) -> Column:
    hit = F.lit(False)
    for w in CONDITION_SECTIONS:
        hit = hit | F.contains(F.lower(section), F.lit(w))
    return F.when(hit, _tagged(_bullets(text), "diagnosis", "high")).otherwise(_tagged(F.array().cast("array<string>"), "diagnosis", "high"))


def allergy_claims(text: Column) -> Column:
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)) for p in ALLERGY_PATTERNS]
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(ALLERGY_REACTION), F.lit(1)), F.regexp_extract_all(text, F.lit(ALLERGY_REACTION), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
    return _tagged(F.filter(F.concat(*found, pairs), lambda x: x != ""), "allergy", "high")


def vital_claims(text: Column) -> Column:
    def named(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{name}: "), x))

    return _tagged(F.concat(*[named(n, p) for n, p in VITAL_PATTERNS.items()]), "vital_sign", "medium")


def exam_claims(text: Column) -> Column:
    return _tagged(F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)) for p in EXAM_PATTERNS]), "exam_finding", "medium")


def note_claims(sections: DataFrame, note: str = "note_id", order: str = "section_pos") -> DataFrame:
    """``note_id, pos, claim_id, claim_type, risk, claim_text`` of ``note_id, section_pos, section, text``.

    Each section gives medications, allergies, vital signs, exam findings and conditions in that
    order; ids number the claims of a note through its sections.
    """
    s, t = F.col("section"), F.coalesce(F.col("text"), F.lit(""))
    rows = sections.select(note, order, F.posexplode(F.concat(medication_claims(s, t), allergy_claims(t), vital_claims(t), exam_claims(t), condition_claims(s, t))).alias("_at", "c"))
    pos = F.row_number().over(Window.partitionBy(note).orderBy(order, "_at")) - 1
    numbered = rows.select(note, pos.alias("pos"), "c.claim_type", "c.risk", "c.claim_text")
    return numbered.withColumn("claim_id", F.format_string("claim_%03d_%s", "pos", "claim_type"))


def line_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, claim_text``: lines that are bullets."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    trimmed = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    return trimmed.where(F.startswith("line", F.lit("- ")) | F.startswith("line", F.lit("• "))).select(key, "line_no", F.substr(F.col("line"), F.lit(3)).alias("claim_text")).where(F.length("claim_text") > 2)


def pattern_claims(df: DataFrame, key: str, text: str, patterns: dict[str, str], before: int = 50, after: int = 50, least: float = 0.5, cap: int | None = 100) -> DataFrame:
    """Matches of named patterns with offsets and context: ``key, pos, claim_type, claim_text, start, stop, context, confidence``.

    Match offsets are what built-in functions do not give. Within a text, claims of higher
    confidence win over those that overlap them or say the same; the rest come in order of
    their start, ``cap`` at most (a report limit; None for all).
    """
    rules = [Rule(k, p) for k, p in patterns.items()]

    def of(scanner: Scanner, value: str) -> list[tuple]:
        found = []
        for k in sorted(scanner.candidates(value)):
            for m in scanner.matches(k, value):
                groups = sum(1 for g in m.groups() if g)
                sure = min(1.0, 0.7 + min(0.1, len(m.group()) / 100) + min(0.1, 0.02 * groups))
                if sure >= least:
                    found.append((sure, m.start(), m.end(), rules[k].claim_type, re.sub(r"\s+", " ", m.group()).strip(), value[max(0, m.start() - before) : m.end() + after]))
        return disjoint(found)[:cap]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [(k, pos, f[3], f[4], f[1], f[2], f[5], f[0]) for k, value in batch.itertuples(index=False) if value for pos, f in enumerate(of(scanner, value))]
            yield pd.DataFrame(rows, columns=["key", "pos", "claim_type", "claim_text", "start", "stop", "context", "confidence"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, f"key {kind}, pos int, claim_type string, claim_text string, start int, stop int, context string, confidence double")
    return out.withColumnRenamed("key", key)


def sections(df: DataFrame, key: str, text: str, is_header: Column) -> DataFrame:
    """``key, section, body``: lines under the last header above them. ``is_header`` is a condition on ``line``."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.coalesce(F.last(F.when(is_header, normalized("line")), ignorenulls=True).over(by), F.lit("general"))).where(~is_header)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return named.groupBy(key, "section").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n_lines"))


def response_claims(df: DataFrame, key: str, response: str) -> DataFrame:
    """Claims from a model's answer: its JSON array, or the first bracketed block in it; ids from 001."""
    schema = "array<struct<claim_text:string,claim_type:string,source_sentence:string>>"
    inner = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    parsed = F.coalesce(F.from_json(response, schema), F.from_json(F.nullif(inner, F.lit("")), schema))
    rows = df.select(key, F.posexplode(parsed).alias("pos", "c"))
    return rows.select(key, F.format_string("claim_%03d", F.col("pos") + 1).alias("claim_id"), "c.claim_text", "c.claim_type", "c.source_sentence")


def predictor_response(response: Column) -> Column:
    """``struct(risk_score, review_level)`` of a model's answer: clamped JSON, else the first number and level, else 0.5 and STANDARD."""
    block = F.from_json(F.regexp_extract(response, r"(?s)\{.*?\}", 0), "risk_score double, review_level string")
    number = F.nullif(F.regexp_extract(response, r"risk_score\D*([0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")
    level = F.nullif(F.upper(F.regexp_extract(response, r"(?i)\b(BRIEF|STANDARD|DETAILED|CRITICAL)\b", 1)), F.lit(""))
    score = F.coalesce(block["risk_score"], number, F.lit(0.5))
    return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("risk_score"), F.coalesce(F.upper(block["review_level"]), level, F.lit("STANDARD")).alias("review_level"))


def distinct_claims(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first claim of each text within its key, compared without case and spacing."""
    own = Window.partitionBy(key, collapsed(text)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def sentence_around(text: Column, start: Column, stop: Column) -> Column:
    """The sentence (up to . ! ? or a line end) around the 0-based span."""
    head = F.regexp_extract(F.substring(text, F.lit(1), start), r"(?s)([^.!?\n]*)$", 1)
    tail = F.regexp_extract(F.substr(text, stop + 1), r"(?s)^([^.!?\n]*[.!?]?)", 1)
    return F.trim(F.concat(head, F.substring(text, start + 1, stop - start), tail))
