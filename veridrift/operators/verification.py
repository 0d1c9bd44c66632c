"""Claims joined with what they can be checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains, medication
from ..functions.text import fuzzy_match


def against_records(claims: DataFrame, patients: DataFrame, patient: str = "patient_id") -> DataFrame:
    """``claims`` with ``ehr_status, ehr_match, ehr_kind`` from each patient's ``medications`` and ``allergies`` arrays.

    An equi-join on the patient; the drug comparison runs over that patient's own list only. A
    patient without a record leaves every claim ``ehr_unavailable``.
    """
    # lists and claims are parsed once each, ahead of the join; claims of another type have no medication to parse
    lists = patients.select(patient, medication.parsed_medications(F.col("medications")).alias("_listed"), "allergies", F.lit(True).alias("_known"))
    own = claims.withColumn("_own", F.when(F.col("claim_type") == "medication", medication.parsed_medication(F.col("claim_text"))))
    met = own.join(lists, patient, "left")
    med = F.when(F.col("_own").isNotNull(), medication.medication_match(F.col("_own"), F.coalesce("_listed", F.array().cast(dict(lists.dtypes)["_listed"])), parsed=True))
    allergy = medication.allergy_match(F.col("claim_text"), F.col("allergies"))
    staged = met.withColumn("_med", med).withColumn("_all", allergy)
    status = domains.record_check(F.col("claim_type"), F.col("_med"), F.col("_all"), domains.none_known(F.col("claim_text")), F.size(F.coalesce("allergies", F.array().cast("array<string>"))) > 0)
    return staged.withColumn("ehr_status", F.when(F.col("_known").isNull(), "ehr_unavailable").otherwise(status)).withColumn("ehr_match", F.when(F.col("claim_type") == "medication", F.col("_med.matched")).when(F.col("claim_type") == "allergy", F.col("_all.matched"))).withColumn("ehr_kind", F.when(F.col("claim_type") == "medication", F.col("_med.kind"))).drop("_med", "_all", "_known", "_own", "_listed", "allergies")


def against_transcript(claims: DataFrame, transcripts: DataFrame, note: str = "note_id") -> DataFrame:
    """``claims`` with ``status, score, needs_entropy`` from the note's transcript; no transcript counts as an empty one."""
    met = claims.join(transcripts.select(note, "transcript"), note, "left")
    check = domains.transcript_check(F.col("claim_type"), F.col("claim_text"), F.coalesce("transcript", F.lit("")))
    return met.withColumn("_c", check).select(*claims.columns, "_c.status", "_c.score", "_c.needs_entropy")


def merge_results(transcript: DataFrame, records: DataFrame, key: str = "claim_id") -> DataFrame:
    """The record's verdict over the transcript's, claim by claim: verified and contradicted override, ``not_in_ehr`` becomes ``not_found``."""
    met = transcript.join(records.select(key, "ehr_status"), key, "left")
    status = F.when(F.col("ehr_status").isin("verified", "contradicted"), F.col("ehr_status")).when(F.col("ehr_status") == "not_in_ehr", "not_found").otherwise(F.col("status"))
    return met.withColumn("status", status)


# The kind of record in which a claim type is looked up.
RESOURCE_OF = {"medication": "MedicationStatement", "allergy": "AllergyIntolerance", "diagnosis": "Condition", "procedure": "Procedure", "vital_sign": "Observation", "lab_result": "Observation", "demographic": "Patient"}


def first_pass(claims: DataFrame, facts: DataFrame, patient: str = "patient_id", threshold: float = 0.6) -> DataFrame:
    """``claims`` with ``status`` and the first matching fact.

    Facts (``patient_id, resource_type, pos, name, detail, active``) are joined on patient and
    kind of record; the name must be contained in the claim or share enough words with it, and
    the first match in order decides. A medication whose dosage the claim lacks is a
    ``contradiction``, as is a statement of no allergies against active ones. Claim types
    without a kind of record are ``not_checkable``.
    """
    table = F.create_map(*[F.lit(x) for kv in RESOURCE_OF.items() for x in kv])
    keyed = claims.withColumn("resource_type", F.try_element_at(table, F.col("claim_type")))
    c, name = F.lower("claim_text"), F.lower("name")
    near = (F.length("name") > 0) & (F.contains(c, name) | fuzzy_match(F.col("claim_text"), F.col("name"), threshold))
    none = domains.none_known(F.col("claim_text")) & (F.col("claim_type") == "allergy")
    met = keyed.join(facts, [patient, "resource_type"], "left")
    ranked = met.groupBy("claim_id").agg(
        F.first("claim_type").alias("claim_type"),
        F.first("claim_text").alias("claim_text"),
        F.first("resource_type").alias("resource_type"),
        F.min_by(F.struct("name", "detail"), F.when(near & ~none, F.col("pos"))).alias("hit"),
        F.max((near & ~none).cast("int")).alias("found"),
        F.max(F.coalesce((F.col("name").isNotNull() & F.coalesce("active", F.lit(True))).cast("int"), F.lit(0))).alias("any_active"),
        F.first(none).alias("none"),
    )
    lacking = (F.col("claim_type") == "medication") & (F.length(F.coalesce("hit.detail", F.lit(""))) > 0) & ~F.contains(F.lower("claim_text"), F.lower("hit.detail"))
    status = (
        F.when(F.col("resource_type").isNull(), "not_checkable")
        .when(F.col("none"), F.when(F.col("any_active") == 1, "contradiction").otherwise("verified"))
        .when(F.coalesce(F.col("found"), F.lit(0)) == 0, "not_found")
        .when(lacking, "contradiction")
        .otherwise("verified")
    )
    return ranked.select("claim_id", "claim_type", "claim_text", status.alias("status"), F.when(F.col("found") == 1, F.col("hit.name")).alias("matched"))


def numeric_match(claims: DataFrame, facts: DataFrame, on: str, value: str = "value", tolerance: float = 0.01) -> DataFrame:
    """Claims joined with the first fact (by ``pos``) of the same key within the relative tolerance of the claimed value; null where none is.

    The equi-key comes first, so the range condition is checked within a key only.
    """
    c, v = F.col(f"c.{value}"), F.col("f.fact_value")
    near = (F.col(f"c.{on}") == F.col(f"f.{on}")) & (F.abs(v - c) <= F.abs(c * tolerance))
    met = claims.alias("c").join(facts.alias("f"), near, "left")
    first = met.groupBy("c.claim_id").agg(F.min_by(F.struct("f.fact_id", "f.fact_value"), F.col("f.pos")).alias("hit"))
    return first.select("claim_id", F.col("hit.fact_id").alias("fact_id"), F.col("hit.fact_value").alias("fact_value"), F.when(F.col("hit.fact_id").isNotNull(), "verified").otherwise("not_found").alias("status"))


def latest_prior(current: DataFrame, priors: DataFrame, key: str | list[str], at: str, earliest: bool = False) -> DataFrame:
    """``current`` with its latest prior strictly before it, as ``prior_at`` and ``prior``: an as-of join. ``key``: a column or several.

    Both sides are united and sorted within the key, and the last prior seen is carried forward:
    one shuffle, linear in the rows. A prior's key is its row's and is shuffled once. With ``earliest``, the first prior is
    carried too, and of several at one time the least counts, column by column and null first.
    """
    keys = [key] if isinstance(key, str) else [*key]
    cols, rest = [c for c in current.columns if c not in (*keys, at)], [at, *[c for c in priors.columns if c not in (*keys, at)]]
    a = current.select(*keys, at, F.lit(0).alias("_is_prior"), F.struct(*cols).alias("_cur"), F.lit(None).cast(priors.select(F.struct(*rest)).schema[0].dataType).alias("_prior"))
    b = priors.select(*keys, at, F.lit(1).alias("_is_prior"), F.lit(None).cast(a.schema["_cur"].dataType).alias("_cur"), F.struct(*rest).alias("_prior"))
    before = Window.partitionBy(*keys).orderBy(at, "_is_prior", *([F.desc("_prior")] if earliest else [])).rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_last": F.last("_prior", ignorenulls=True).over(before)} | ({"_first": F.min("_prior").over(before)} if earliest else {})
    kinds = {f.name: f.dataType for f in priors.schema}
    whole = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[(F.col(n).cast(kinds[n]) if n in keys else F.col(c)[n]).alias(n) for n in priors.columns]))
    met = a.union(b).withColumns(carried).where("_is_prior = 0")
    return met.select(*keys, at, "_cur.*", F.col("_last")[at].alias("prior_at"), whole("_last").alias("prior"), *([whole("_first").alias("earliest")] if earliest else []))


def finding_changes(current: DataFrame, priors: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Findings against the latest prior study: ``stable`` and ``new`` by substring either way, and ``resolved`` ones of the prior.

    ``current``: patient, findings; ``priors``: patient, study_date, findings.
    """
    latest = priors.groupBy(patient).agg(F.max_by("findings", "study_date").alias("prior"))
    met = current.join(latest, patient, "left").withColumn("prior", F.coalesce("prior", F.array().cast("array<string>")))

    def alike(a: Column, b: Column) -> Column:
        return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))

    known = F.filter("findings", lambda f: F.exists("prior", lambda p: alike(f, p)))
    new = F.filter("findings", lambda f: ~F.exists("prior", lambda p: alike(f, p)))
    gone = F.filter("prior", lambda p: ~F.exists("findings", lambda f: F.contains(F.lower(f), F.lower(p))))
    return met.select(patient, known.alias("stable"), new.alias("new"), gone.alias("resolved"))


def box_overlap(a: Column, b: Column) -> Column:
    """Share of box ``a`` that ``b`` covers; boxes are ``struct(x1, y1, x2, y2)``, an empty box gives 0."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def detected_injections(injected: DataFrame, claims: DataFrame, key: str = "note_id") -> DataFrame:
    """Injected statements that a flagged claim of the same note contains: ``injected`` with ``detected``."""
    flagged = claims.where(F.col("status").isin("contradicted", "not_found"))
    met = injected.join(flagged.select(key, F.lower("claim_text").alias("_claim")), key, "left")
    hit = F.max(F.coalesce(F.contains(F.col("_claim"), F.lower("fake_claim")), F.lit(False)).cast("int")) == 1
    return met.groupBy(*injected.columns).agg(hit.alias("detected"))


def rule_violations(values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, n_checked, n_errors, n_warnings, failures`` of ``key, input, value`` against ``rules`` (``input, low, high, severity, required``), a table of at most a few hundred rows."""
    small = F.broadcast(rules)
    met = values.join(small, "input")
    bad = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")) | (F.col("value").isNull() & F.col("required"))
    failed = F.coalesce(bad, F.lit(False))
    return met.groupBy(key).agg(
        F.count("*").alias("n_checked"),
        F.count_if(failed & F.col("severity").isin("error", "critical")).alias("n_errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("n_warnings"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("input")))), ",").alias("failures"),
    )


def check_rules(values: DataFrame, rules: DataFrame, key: str, custom: dict[str, Column] | None = None, strict: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``key, n_validated, n_passed, is_valid, failures, warnings`` of ``key, input, value`` (value as text) against ``rules``, a table of at most a few hundred rows.

    ``rules``: ``input, kind, low, high, expected, allow, severity``. Kinds: ``range`` (null or no number fails, a null bound is none),
    ``type`` (``expected`` double, bigint or boolean, by whether the text casts; null passes only with ``allow``), ``required`` (null and
    blank fail, zero too unless ``allow``) and ``custom`` (``expected`` names a condition of ``custom`` over ``value``; one that is null, as of
    text that does not cast, fails). An input with a ``required`` rule and no row for a key fails as critical. Inputs without rules are not
    counted. ``keys`` (a table with ``key``) adds keys that have no row at all, whose required inputs are all missing. Failures and warnings are sorted ``input:kind``. ``strict``: warnings make a row invalid too.
    """
    v, number = F.col("value"), F.expr("try_cast(value as double)")
    in_range = number.isNotNull() & ~F.coalesce((number < F.col("low")) | (number > F.col("high")), F.lit(False))
    casts = {"double": number, "bigint": F.expr("try_cast(value as bigint)"), "boolean": F.expr("try_cast(value as boolean)")}
    typed = F.lit(False)
    for name, cast in casts.items():
        typed = F.when(F.col("expected") == name, cast.isNotNull()).otherwise(typed)
    present = v.isNotNull() & (F.trim(v) != "") & (F.col("allow") | F.coalesce(number != 0, F.lit(True)))
    holds = F.lit(False)
    for name, condition in (custom or {}).items():
        holds = F.when(F.col("expected") == name, condition).otherwise(holds)
    kind = F.col("kind")
    passed = F.when(kind == "range", in_range).when(kind == "type", F.when(v.isNull(), F.col("allow")).otherwise(typed)).when(kind == "required", present).otherwise(holds)
    met = values.select(key, "input", "value").join(F.broadcast(rules), "input")
    judged = met.select(key, "input", "kind", "severity", (~F.coalesce(passed, F.lit(False))).alias("bad"))
    each = judged.groupBy(key, "input").agg(
        F.max("bad").alias("bad"),
        F.collect_list(F.when(F.col("bad") & (F.col("severity") != "warning"), F.concat_ws(":", "input", "kind"))).alias("f"),
        F.collect_list(F.when(F.col("bad") & (F.col("severity") == "warning"), F.concat_ws(":", "input", "kind"))).alias("w"),
    )
    needed = rules.where(kind == "required").select(F.collect_set("input").alias("_needed"))
    known = values.select(key) if keys is None else values.select(key).union(keys.select(key))
    per = known.distinct().join(
        each.groupBy(key).agg(F.count("*").alias("n_validated"), F.count_if(~F.col("bad")).alias("n_passed"), F.flatten(F.collect_list("f")).alias("f"), F.flatten(F.collect_list("w")).alias("w"), F.collect_set("input").alias("seen")), key, "left"
    )
    none = F.array().cast("array<string>")
    per = per.crossJoin(F.broadcast(needed)).withColumn("_missing", F.transform(F.array_except("_needed", F.coalesce("seen", none)), lambda i: F.concat(i, F.lit(":missing"))))
    failures, warnings = F.array_sort(F.concat(F.coalesce("f", none), "_missing")), F.array_sort(F.coalesce("w", none))
    valid = (F.size(failures) == 0) & (F.size(warnings) == 0) if strict else F.size(failures) == 0
    return per.select(key, F.coalesce("n_validated", F.lit(0)).alias("n_validated"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"), valid.alias("is_valid"), failures.alias("failures"), warnings.alias("warnings"))
