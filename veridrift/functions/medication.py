"""Medication strings: doses, names, brands, and how a claim fits a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, normalized

# Brand names and their generic names, in the order in which they are tried.
GENERIC_OF = {
    "tylenol": "acetaminophen",
    "advil": "ibuprofen",
    "motrin": "ibuprofen",
    "lipitor": "atorvastatin",
    "zocor": "simvastatin",
    "norvasc": "amlodipine",
    "lasix": "furosemide",
    "plavix": "clopidogrel",
    "glucophage": "metformin",
    "lopressor": "metoprolol",
    "toprol": "metoprolol",
    "prinivil": "lisinopril",
    "zestril": "lisinopril",
    "prilosec": "omeprazole",
    "nexium": "esomeprazole",
    "synthroid": "levothyroxine",
    "coumadin": "warfarin",
    "ambien": "zolpidem",
}
# Allergens looked for in records, and in transcripts.
RECORD_ALLERGENS = ["penicillin", "sulfa", "aspirin", "ibuprofen", "latex", "peanut", "egg", "milk", "codeine", "morphine", "amoxicillin", "shellfish", "contrast"]
TRANSCRIPT_ALLERGENS = ["penicillin", "sulfa", "codeine", "morphine", "latex", "iodine", "contrast", "aspirin", "nsaid", "ace inhibitor"]
# Patterns of doses, routes and frequencies, and what a unit is in mg.
DOSE_PER_KG = r"(?i)(\d+(?:\.\d+)?)\s*(mcg|mg|g)/kg"
DOSE = r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|meq|units?|iu)\b"
DOSE_SPELLED = r"(?i)(\d+(?:\.\d+)?)\s*(milligrams?|micrograms?)"
ROUTE = r"\b(po|iv|im|sc|sq|pr|sl|topical)\b"
FREQUENCY = r"\b(daily|bid|tid|qid|prn|once|twice|weekly|q\d+h?)\b"
MG_OF = {"mg": 1.0, "g": 1000.0, "mcg": 0.001, "meq": 1.0, "units": 1.0, "iu": 1.0, "ml": 1.0}
UNIT_NAMES = {"milligram": "mg", "milligrams": "mg", "microgram": "mcg", "micrograms": "mcg", "unit": "units"}


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _mapped(c: Column, table: dict, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), default)


def dose(c: Column) -> Column:
    """``struct(value, unit)`` of the first dose, by weight first; null members if there is none."""
    s = F.replace(c, F.lit(","), F.lit(""))
    value = F.coalesce(_found(s, DOSE_PER_KG, 1), _found(s, DOSE, 1), _found(s, DOSE_SPELLED, 1))
    plain = F.lower(F.coalesce(_found(s, DOSE, 2), _found(s, DOSE_SPELLED, 2)))
    by_weight = F.concat(F.lower(_found(s, DOSE_PER_KG, 2)), F.lit("/kg"))
    return F.struct(value.cast("double").alias("value"), F.coalesce(by_weight, _mapped(plain, UNIT_NAMES, plain)).alias("unit"))


def in_mg(d: Column) -> Column:
    """The dose in mg; a unit without a factor counts as mg."""
    unit = F.lower(F.coalesce(d["unit"], F.lit("mg")))
    return d["value"] * _mapped(unit, MG_OF, F.lit(1.0))


def doses_match(claim: Column, record: Column, tolerance: float = 0.1) -> Column:
    """Whether the doses agree within the tolerance of the record's; a missing dose agrees with any."""
    a, b = in_mg(claim), in_mg(record)
    return (
        F.when(claim["value"].isNull() | record["value"].isNull(), True)
        .when(b == 0, a == 0)
        .otherwise(F.try_divide(F.abs(a - b), b) <= tolerance)
    )


def drug_name(c: Column) -> Column:
    """The first word left without brand in parentheses, doses and dose forms; empty if none is."""
    s = F.regexp_replace(normalized(c), r"\([^)]*\)", "")
    s = F.regexp_replace(s, DOSE, "")
    s = F.regexp_replace(s, r"(?i)\s+(tablet|capsule|solution|oral|iv|bid|tid|qid|prn|daily|qd|qhs)s?\b", "")
    return F.coalesce(F.regexp_extract(s, r"(\S+)", 1), F.lit(""))


def generic_name(name: Column) -> Column:
    """The generic name of the first brand that the name contains, else the name."""
    brands = F.array(*[F.lit(b) for b in GENERIC_OF])
    table = F.create_map(*[F.lit(x) for kv in GENERIC_OF.items() for x in kv])
    return let(name, lambda n: F.coalesce(F.try_element_at(table, F.try_element_at(F.filter(brands, lambda b: F.contains(n, b)), F.lit(1))), n))


def names_match(a: Column, b: Column, allow_empty: bool = False) -> Column:
    """Equal, or one contains the other. An empty name, which any text contains, matches only if ``allow_empty``."""
    match = F.contains(b, a) | F.contains(a, b)
    return match if allow_empty else match & (F.length(a) > 0) & (F.length(b) > 0)


def parsed_medication(c: Column) -> Column:
    """``struct(text, name, dose)`` of a medication text, its brand made generic."""
    return F.struct(c.alias("text"), generic_name(drug_name(c)).alias("name"), dose(c).alias("dose"))


def parsed_medications(records: Column) -> Column:
    """A record's list, parsed; a null list is empty."""
    return F.transform(F.coalesce(records, F.array().cast("array<string>")), parsed_medication)


def medication_match(claim: Column, records: Column, tolerance: float = 0.1, parsed: bool = False) -> Column:
    """How a claimed medication fits the record's list: ``struct(matches, matched, kind)``.

    The first record with the same drug and an agreeing dose decides (``exact``). Without one,
    the last record with the same drug does: ``name_only`` if either dose is missing, which
    matches, else ``dose_mismatch``. Otherwise ``not_found``, or ``no_name``. ``parsed``: both are
    given as ``parsed_medication`` and ``parsed_medications``, which is done once a claim and a patient ahead of a join.
    """

    def judged(own: Column, same: Column, both: Column) -> Column:
        first, last = F.try_element_at(both, F.lit(1)), F.try_element_at(same, F.lit(-1))
        comparable = own["dose"]["value"].isNotNull() & last["dose"]["value"].isNotNull()
        kind = F.when(own["name"] == "", "no_name").when(F.size(both) > 0, "exact").when(F.size(same) == 0, "not_found").when(comparable, "dose_mismatch").otherwise("name_only")
        matched = F.when(kind == "exact", first["text"]).when(kind.isin("dose_mismatch", "name_only"), last["text"])
        return F.struct(kind.isin("exact", "name_only").alias("matches"), matched.alias("matched"), kind.alias("kind"))

    def fits(own: Column, r: Column) -> Column:
        return own["dose"]["value"].isNotNull() & r["dose"]["value"].isNotNull() & doses_match(own["dose"], r["dose"], tolerance)

    listed = records if parsed else parsed_medications(records)
    return let(
        claim if parsed else parsed_medication(claim),
        lambda own: let(
            F.filter(listed, lambda r: names_match(own["name"], r["name"])),
            lambda same: let(F.filter(same, lambda r: fits(own, r)), lambda both: judged(own, same, both)),
        ),
    )


def allergy_match(claim: Column, records: Column) -> Column:
    """``struct(matches, matched)``: none-known statements against the list, else the first record that shares an allergen."""
    c = normalized(claim)
    records = F.coalesce(records, F.array().cast("array<string>"))
    none_claimed = any_of(c, ["nkda", "no known"])
    none_recorded = F.filter(records, lambda r: F.contains(normalized(r), F.lit("no known")))
    shared = F.filter(records, lambda r: F.exists(F.array(*[F.lit(a) for a in RECORD_ALLERGENS]), lambda a: F.contains(c, a) & F.contains(normalized(r), a)))
    matched = (
        F.when(none_claimed & (F.size(none_recorded) > 0), F.try_element_at(none_recorded, F.lit(1)))
        .when(none_claimed & (F.size(records) > 0), F.lit(None).cast("string"))
        .otherwise(F.try_element_at(shared, F.lit(1)))
    )
    return F.struct(matched.isNotNull().alias("matches"), matched.alias("matched"))


def components(c: Column) -> Column:
    """``struct(name, dose, unit, route, frequency)`` of a lower-cased medication text."""
    t = F.lower(c)
    pattern = r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?)"
    return F.struct(
        _found(t, r"^([a-z]+)", 1).alias("name"),
        _found(t, pattern, 1).cast("double").alias("dose"),
        _found(t, pattern, 2).alias("unit"),
        _found(t, ROUTE, 1).alias("route"),
        _found(t, FREQUENCY, 1).alias("frequency"),
    )
