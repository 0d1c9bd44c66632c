"""What sets the domains apart, as data: claim types by risk, cuts, and patterns of claims."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domains import FORWARD_LOOKING, GUARANTEES
from .scan import Rule


@dataclass(frozen=True)
class DomainPack:
    """A domain: its claim types of each risk, entropy bounds, review and escalation cuts, and extraction patterns with their context."""

    name: str
    critical: tuple[str, ...]
    high: tuple[str, ...]
    medium: tuple[str, ...]
    entropy_bounds: tuple[float, float]
    review_cut: float
    least_confidence: float
    #: Begins a claim's id; what is sought in a text, in order.
    prefix: str = ""
    rules: list[Rule] = field(default_factory=list)

    def claim_risk(self, claim_type: Column) -> Column:
        return F.when(claim_type.isin(*self.critical), "critical").when(claim_type.isin(*self.high), "high").when(claim_type.isin(*self.medium), "medium").otherwise("low")

    def entropy_level(self, h: Column) -> Column:
        low, high = self.entropy_bounds
        return F.when(h < low, "low").when(h < high, "medium").otherwise("high")

    def review_level(self, risk: Column, entropy: Column, flagged: Column | None = None) -> Column:
        level = F.when(risk.isin("critical", "high"), "detailed").when((risk == "medium") & (entropy > self.review_cut), "standard").otherwise("brief")
        return level if flagged is None else F.when(flagged, "detailed").otherwise(level)

    def escalation_reasons(self, risk: Column, confidence: Column, passed: Column, warnings: Column, flagged: Column) -> Column:
        """Why a response goes to a person, in order; empty if it does not."""
        return F.array_compact(
            F.array(
                F.when(risk.isin("critical", "high"), F.concat(F.lit("risk "), risk)),
                F.when(flagged, "compliance"),
                F.when(confidence < self.least_confidence, "low confidence"),
                F.when(~passed, "not verified"),
                F.when(F.size(warnings) > 0, "warnings"),
            )
        )


def _rules(claim_type: str, patterns: list[str], **settings: object) -> list[Rule]:
    return [Rule(claim_type, f"(?i){p}", **settings) for p in patterns]


# Patterns of medications, vital signs, allergies, findings and conditions.
DOSE = r"(\d+(?:[.,]\d+)?)\s*(mg|mcg|g|ml|units?|iu|meq)"
VITAL_SIGNS = {
    "blood_pressure": r"(?:BP|blood pressure)\s*:?\s*(\d{2,3})\s*/\s*(\d{2,3})",
    "heart_rate": r"(?:HR|heart rate|pulse)\s*:?\s*(\d{2,3})\s*(?:bpm)?",
    "oxygen_sat": r"(?:SpO2|O2 sat|oxygen saturation?|sat)\s*:?\s*(\d{2,3})\s*%?",
    "temperature": r"(?:temp|temperature)\s*:?\s*(\d{2,3}(?:\.\d)?)\s*(?:°?[FC])?",
    "respiratory_rate": r"(?:RR|resp(?:iratory)? rate)\s*:?\s*(\d{1,2})",
    "weight": r"(?:weight|wt)\s*:?\s*(\d{2,3}(?:\.\d)?)\s*(?:kg|lbs?|pounds?)?",
    "height": r"(?:height|ht)\s*:?\s*(\d{1,3}(?:\.\d)?)\s*(?:cm|in|inches|feet|ft)?",
}
ALLERGIES = [
    r"allerg(?:y|ic|ies)\s*(?:to\s+)?:?\s*([^.,\n]+)",
    r"NKDA",
    r"no known (?:drug )?allergies",
    r"NKA",
    r"([A-Za-z]+)\s*\(([^)]*(?:rash|anaphylaxis|hives|swelling|itching|reaction)[^)]*)\)",
]
EXAM_FINDINGS = [
    r"((?:grade\s+)?[I-V]+/(?:VI|6)\s+(?:systolic|diastolic|holosystolic)?\s*murmur[^.]*)",
    r"(\d\+\s*(?:pitting\s+)?edema[^.]*)",
    r"(regular (?:rate and )?rhythm)",
    r"(irregularly irregular)",
    r"(clear to auscultation(?:\s+bilaterally)?)",
    r"(no (?:murmurs|gallops|rubs|wheezes|crackles))",
    r"(JVD[^.]*)",
    r"(jugular venous (?:distension|pressure)[^.]*)",
    r"(hepatomegaly|splenomegaly)",
]
# Abbreviations of reporters in which cases are published.
REPORTERS = (
    "U.S.|S. Ct.|S.Ct.|L. Ed.|L.Ed.|L. Ed. 2d|L.Ed.2d|F.|F.2d|F.3d|F.4th|F. Supp.|F.Supp.|F. Supp. 2d|F.Supp.2d|F. Supp. 3d|F.Supp.3d|Fed. Cl.|Fed.Cl.|B.R.|"
    "Cal.|Cal.2d|Cal.3d|Cal.4th|Cal.5th|Cal. App.|Cal.App.2d|Cal.App.3d|Cal.App.4th|Cal.App.5th|N.Y.|N.Y.2d|N.Y.3d|A.D.|A.D.2d|A.D.3d|Ill.|Ill.2d|Tex.|S.W.|S.W.2d|S.W.3d|"
    "N.E.|N.E.2d|N.E.3d|So.|So.2d|So.3d|P.|P.2d|P.3d|A.|A.2d|A.3d|N.W.|N.W.2d|S.E.|S.E.2d"
).split("|")
_REPORTER = "|".join(re.escape(r) for r in REPORTERS)
_NAME = string.ascii_letters + "'-.\u0130\u0131\u017f\u212a"  # with the letters that case-insensitive patterns take for i, s and k
# Patterns of case and statute citations.
CASE_CITATION = r"(?i)([A-Z][A-Za-z\'\-\.\s]+(?:\s+v\.?\s+[A-Z][A-Za-z\'\-\.\s]+)?),?\s*(\d+)\s+(" + _REPORTER + r")\s+(\d+)(?:\s*\(([^)]+)\s*(\d{4})\))?"
OTHER_CITATIONS = [r"([A-Z][a-z]+(?:\s+v\.?\s+[A-Z][a-z]+)?),?\s+supra", r"\bId\.\s+at\s+(\d+)"]
STATUTES = [
    r"(\d+)\s+U\.?S\.?C\.?\s*§?\s*(\d+[a-z]?)(?:\(([^)]+)\))?",
    r"(\d+)\s+C\.?F\.?R\.?\s*§?\s*([\d\.]+[a-z\-]*)",
    r"([A-Z][a-z]+\.?)\s+([A-Z][a-z]+\.?)\s+(?:Code|Law)\s*§?\s*(\d+[a-z]?)",
]
NAMED_SECTION = r"[Ss]ection\s+(\d+(?:\.\d+)?[a-z]?)\s+of\s+(?:the\s+)?([A-Z][A-Za-z\s]+(?:Act|Code|Law))"
# Claim types by risk, thresholds and patterns of the three domains.
HEALTHCARE = DomainPack(
    "healthcare",
    critical=("dosage", "drug_interaction", "contraindication"),
    high=("medication", "allergy", "diagnosis", "procedure"),
    medium=("vital_sign", "lab_value", "exam_finding", "symptom", "history"),
    entropy_bounds=(0.2, 0.5),
    review_cut=0.5,
    least_confidence=0.7,
    prefix="hc",
    rules=[
        Rule("medication", r"^(?:- |• |\* )(.*)$", kind="line", also=f"(?i){DOSE}"),
        *_rules("allergy", ALLERGIES, kind="groups"),
        *[Rule("vital_sign", f"(?i){p}", kind="groups", label=name, joint="/") for name, p in VITAL_SIGNS.items()],
        *_rules("exam_finding", EXAM_FINDINGS, kind="groups"),
        Rule("diagnosis", r"^(?=- |• |\* |1\.|2\.|3\.)[-•*\d.]+\s*(.*)$", kind="line", given="diagnos", least=4),
    ],
)
LEGAL = DomainPack(
    "legal",
    critical=("case_citation", "statute_reference", "regulation_reference"),
    high=("contract_clause", "legal_holding", "precedent", "jurisdiction"),
    medium=("limitation_period", "legal_standard", "procedural_requirement", "damages_calculation"),
    entropy_bounds=(0.15, 0.4),
    review_cut=0.4,
    least_confidence=0.8,
    prefix="legal",
    rules=[
        Rule("case_citation", CASE_CITATION, distinct=True, anchor=rf"(?i)\d+\s+(?:{_REPORTER})\s+\d+", lead=_NAME, joint=","),
        *_rules("case_citation", OTHER_CITATIONS, distinct=True),
        *_rules("statute_reference", STATUTES, distinct=True),
        *_rules("statute_reference", [NAMED_SECTION], distinct=True),
        *_rules(
            "contract_clause",
            [
                r"(?:Section|Article|Clause|Paragraph)\s+(\d+(?:\.\d+)?[a-z]?)",
                r"(?:pursuant to|under|in accordance with)\s+(?:Section|Article)\s+(\d+)",
                r"indemnif(?:y|ication|ies)",
                r"limitation of liability",
                r"force majeure",
                r"governing law",
                r"arbitration\s+(?:clause|provision|agreement)",
                r"non-?compete",
                r"confidentiality",
                r"termination\s+(?:clause|provision|for cause)",
            ],
            kind="context",
            before=50,
            after=100,
        ),
        *_rules(
            "jurisdiction",
            [
                r"(?:subject matter|personal|in rem|quasi in rem)\s+jurisdiction",
                r"diversity\s+(?:jurisdiction|of citizenship)",
                r"federal\s+question\s+jurisdiction",
                r"(?:proper|appropriate)\s+venue",
                r"forum\s+(?:selection|non conveniens)",
                r"(?:state|federal)\s+court\s+(?:has|lacks)\s+jurisdiction",
            ],
            kind="context",
            before=30,
            after=50,
        ),
        *_rules(
            "limitation_period",
            [
                r"statute of limitations?\s+(?:is|of)\s+(\d+)\s+years?",
                r"limitations?\s+period\s+(?:is|of)\s+(\d+)\s+(?:years?|months?|days?)",
                r"must (?:be filed|file|commence|bring)\s+within\s+(\d+)\s+(?:years?|months?|days?)",
                r"(?:time-?barred|barred by limitations?)\s+after\s+(\d+)",
            ],
            kind="context",
            before=20,
            after=30,
        ),
    ],
)
FINANCE = DomainPack(
    "finance",
    critical=("performance_figure", "fee_disclosure", "guaranteed_return"),
    high=("risk_rating", "suitability", "benchmark_comparison", "forward_looking"),
    medium=("asset_allocation", "diversification", "tax_implication", "liquidity"),
    entropy_bounds=(0.15, 0.4),
    review_cut=0.4,
    least_confidence=0.8,
    prefix="finance",
    rules=[
        *_rules(
            "performance_figure",
            [
                r"(?:return(?:ed|s)?|gain(?:ed|s)?|up|down|lost?|yield(?:ed|s)?|perform(?:ed|ance)?|increas(?:ed?|ing)|decreas(?:ed?|ing))\s*(?:of\s+)?(?:approximately\s+)?([+-]?\d+(?:\.\d+)?)\s*%",
                r"([+-]?\d+(?:\.\d+)?)\s*%\s*(?:return|gain|loss|yield|increase|decrease|growth)",
                r"(?:annual(?:ized)?|yearly|YTD|year-to-date|MTD|QTD|ITD)\s*(?:return|performance|gain)?\s*(?:of\s+)?([+-]?\d+(?:\.\d+)?)\s*%",
                r"(?:out|under)perform(?:ed|ing)?\s*(?:by\s+)?([+-]?\d+(?:\.\d+)?)\s*%",
                r"\$\s*([\d,]+(?:\.\d{2})?)\s*(?:gain|loss|return|profit)",
            ],
            distinct=True,
        ),
        *_rules(
            "fee_disclosure",
            [
                r"expense\s+ratio\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*%",
                r"(?:management|advisory|admin(?:istrative)?)\s+fee\s*(?:of\s+)?(\d+(?:\.\d+)?)\s*%",
                r"(\d+)\s*(?:bps|basis\s+points?)",
                r"(?:annual|monthly|quarterly)?\s*fee\s+(?:of\s+)?\$\s*([\d,]+(?:\.\d{2})?)",
                r"(?:front[- ]?end|back[- ]?end|deferred)?\s*load\s*(?:of\s+)?(\d+(?:\.\d+)?)\s*%",
                r"commission\s*(?:of\s+)?\$\s*([\d,]+(?:\.\d{2})?)",
            ],
            distinct=True,
        ),
        *_rules(
            "risk_rating",
            [
                r"risk\s+(?:score|rating|level)\s*(?:of\s+)?(\d+)(?:\s*/\s*(\d+))?",
                r"(?:low|moderate|medium|high|aggressive|conservative)\s+risk",
                r"(\d)\s*(?:star|stars)\s+(?:rating|rated)",
                r"(?:standard deviation|volatility|beta)\s+(?:of\s+)?(\d+(?:\.\d+)?)",
                r"sharpe\s+ratio\s+(?:of\s+)?([+-]?\d+(?:\.\d+)?)",
            ],
            kind="context",
            before=30,
            after=50,
        ),
        *_rules(
            "suitability",
            [
                r"(?:suitable|appropriate|recommended)\s+for\s+(?:you|your|investors?|clients?)",
                r"(?:risk\s+tolerance|investment\s+objective|time\s+horizon)\s+(?:is|of)\s+([a-z]+)",
                r"(?:aggressive|moderate|conservative)\s+(?:investor|portfolio|allocation)",
                r"(?:growth|income|balanced|preservation)\s+(?:objective|strategy)",
            ],
            kind="context",
            before=30,
            after=80,
        ),
        *_rules("forward_looking", FORWARD_LOOKING, kind="context", before=20, after=60),
        *_rules("guaranteed_return", GUARANTEES, kind="context", before=20, after=40),
    ],
)
PACKS = {p.name: p for p in (HEALTHCARE, LEGAL, FINANCE)}
# Terms in an indication or symptom that go with a finding.
RELATED_TERMS = {
    "pneumonia": ["cough", "fever", "shortness of breath", "respiratory"],
    "cardiomegaly": ["heart", "cardiac", "shortness of breath", "edema"],
    "nodule": ["cancer", "mass", "smoking", "weight loss"],
    "fracture": ["trauma", "pain", "fall", "injury"],
}


def clinical_correlation(finding: Column, indication: Column, symptoms: Column) -> Column:
    """``strong`` by the indication or ``moderate`` by a symptom, term after term; else ``incidental``, or ``weak`` without an indication."""
    f, i = F.lower(finding), F.lower(F.coalesce(indication, F.lit("")))
    said = F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), lambda s: F.lower(s))
    out = F.when(i != "", "incidental").otherwise("weak")
    for condition, terms in reversed(RELATED_TERMS.items()):
        for term in reversed(terms):
            hit = F.when(F.contains(i, F.lit(term)), "strong").when(F.contains(F.array_join(said, "\n"), F.lit(term)), "moderate")
            out = F.when(F.contains(f, F.lit(condition)) & hit.isNotNull(), hit).otherwise(out)
    return out


def reliability(acceptable: Column, drifted: Column, missing: Column, narrow: Column) -> Column:
    """How far a prediction can be relied on."""
    return F.when(~acceptable, "rejected").when(drifted, "unreliable").when((missing > 0) | ~narrow, "moderate").otherwise("reliable")


def is_narrow(lower: Column, upper: Column, point: Column) -> Column:
    """Width within a fifth of the point estimate, or within 0.1 where that is about 0."""
    width = upper - lower
    return F.when(F.abs(point) < 1e-6, width <= 0.1).otherwise(width / F.abs(point) <= 0.2)
