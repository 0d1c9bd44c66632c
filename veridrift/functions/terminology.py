"""Abbreviations of the three domains, written out in texts, and the sources that count as authoritative."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations and what they stand for, in the order in which they are written out.
HEALTHCARE_TERMS = {
    "PRN": "as needed", "BID": "twice daily", "TID": "three times daily", "QID": "four times daily", "QD": "once daily", "QHS": "at bedtime", "QAM": "every morning", "QPM": "every evening",
    "Q4H": "every 4 hours", "Q6H": "every 6 hours", "Q8H": "every 8 hours", "Q12H": "every 12 hours",
    "PO": "by mouth", "IV": "intravenous", "IM": "intramuscular", "SC": "subcutaneous", "SQ": "subcutaneous", "SL": "sublingual", "PR": "per rectum", "TOP": "topical", "INH": "inhaled", "NEB": "nebulized",
    "HTN": "hypertension", "DM": "diabetes mellitus", "T2DM": "type 2 diabetes mellitus", "CHF": "congestive heart failure", "COPD": "chronic obstructive pulmonary disease", "CAD": "coronary artery disease",
    "MI": "myocardial infarction", "CVA": "cerebrovascular accident (stroke)", "DVT": "deep vein thrombosis", "PE": "pulmonary embolism", "UTI": "urinary tract infection", "GERD": "gastroesophageal reflux disease",
    "CKD": "chronic kidney disease", "ESRD": "end-stage renal disease", "NKDA": "no known drug allergies", "NKA": "no known allergies",
}
LEGAL_TERMS = {
    "stare decisis": "let the decision stand (precedent)", "res judicata": "matter already judged", "prima facie": "on its face; at first appearance", "pro se": "representing oneself", "amicus curiae": "friend of the court",
    "habeas corpus": "produce the body", "certiorari": "to be made certain", "mandamus": "we command", "de novo": "anew; from the beginning", "sua sponte": "on its own motion", "inter alia": "among other things",
    "mens rea": "guilty mind", "actus reus": "guilty act",
    "v.": "versus", "et al.": "and others", "Id.": "the same (citation)", "Ibid.": "in the same place", "cf.": "compare", "e.g.": "for example", "i.e.": "that is",
    "SCOTUS": "Supreme Court of the United States", "SDNY": "Southern District of New York", "EDNY": "Eastern District of New York", "NDCA": "Northern District of California",
    "9th Cir.": "Ninth Circuit Court of Appeals", "2d Cir.": "Second Circuit Court of Appeals",
    "BRD": "beyond a reasonable doubt", "BFOQ": "bona fide occupational qualification", "TRO": "temporary restraining order", "MSJ": "motion for summary judgment", "MTD": "motion to dismiss",
}
FINANCE_TERMS = {
    "NAV": "Net Asset Value", "AUM": "Assets Under Management", "CAGR": "Compound Annual Growth Rate", "IRR": "Internal Rate of Return", "TWR": "Time-Weighted Return", "MWR": "Money-Weighted Return",
    "YTD": "Year-to-Date", "MTD": "Month-to-Date", "QTD": "Quarter-to-Date", "ITD": "Inception-to-Date",
    "alpha": "Excess return vs benchmark", "beta": "Market sensitivity", "Sharpe": "Risk-adjusted return", "Sortino": "Downside risk-adjusted return", "VaR": "Value at Risk", "CVaR": "Conditional Value at Risk",
    "bps": "Basis points (0.01%)", "MER": "Management Expense Ratio", "TER": "Total Expense Ratio", "12b-1": "Marketing/distribution fee",
    "RIA": "Registered Investment Adviser", "IAR": "Investment Adviser Representative", "BD": "Broker-Dealer", "RR": "Registered Representative", "CRD": "Central Registration Depository",
    "ADV": "Form ADV (adviser registration)", "Reg BI": "Regulation Best Interest",
    "IRA": "Individual Retirement Account", "401(k)": "Employer-sponsored retirement plan", "403(b)": "Non-profit/education retirement plan", "SEP": "Simplified Employee Pension",
    "SIMPLE": "Savings Incentive Match Plan for Employees", "HSA": "Health Savings Account", "529": "Education savings plan",
    "equity": "Stocks/ownership securities", "fixed income": "Bonds/debt securities", "alternatives": "Non-traditional investments", "REIT": "Real Estate Investment Trust", "ETF": "Exchange-Traded Fund", "MF": "Mutual Fund",
}
TERMS = {"healthcare": HEALTHCARE_TERMS, "legal": LEGAL_TERMS, "finance": FINANCE_TERMS}
# Authoritative sources by domain and kind.
SOURCES = {
    "healthcare": {
        "drug": ["fda.gov", "drugbank.com", "rxnorm", "dailymed.nlm.nih.gov", "drugs.com", "epocrates", "micromedex", "lexicomp"],
        "clinical": ["uptodate.com", "pubmed.ncbi.nlm.nih.gov", "cochranelibrary.com", "nice.org.uk", "ahrq.gov", "cdc.gov", "who.int", "nejm.org", "jamanetwork.com", "thelancet.com"],
    },
    "legal": {
        "case": ["westlaw.com", "lexisnexis.com", "courtlistener.com", "casetext.com", "google.com/scholar", "law.justia.com", "findlaw.com", "oyez.org", "supremecourt.gov", "uscourts.gov"],
        "statute": ["law.cornell.edu", "congress.gov", "govinfo.gov", "uscode.house.gov", "law.justia.com", "legis.state", "westlaw.com", "lexisnexis.com"],
        "regulatory": ["ecfr.gov", "federalregister.gov", "regulations.gov", "sec.gov", "ftc.gov", "dol.gov"],
    },
    "finance": {
        "market": ["bloomberg.com", "refinitiv.com", "morningstar.com", "factset.com", "yahoofinance.com", "marketwatch.com", "wsj.com", "cnbc.com", "reuters.com"],
        "regulatory": ["sec.gov", "finra.org", "cftc.gov", "fdic.gov", "occ.gov", "federalreserve.gov", "nasaa.org"],
        "fund": ["morningstar.com", "fundresearch.fidelity.com", "vanguard.com", "blackrock.com", "schwab.com", "etf.com"],
    },
}
# The kinds of source for a claim type; other types take the kinds at None.
SOURCE_KINDS = {
    "healthcare": {"medication": ["drug"], "dosage": ["drug"], "drug_interaction": ["drug"], "allergy": ["drug"], None: ["clinical"]},
    "legal": {"case_citation": ["case"], "legal_holding": ["case"], "statute_reference": ["statute"], "regulation_reference": ["regulatory"], None: ["case", "statute"]},
    "finance": {"performance_figure": ["market"], "benchmark_comparison": ["market"], "market_data": ["market"], "fee_disclosure": ["fund"], "risk_rating": ["fund"], "regulatory_status": ["regulatory"], None: ["market", "fund"]},
}


def written_out(text: Column, terms: dict[str, str]) -> Column:
    """Each standalone abbreviation, in any case, followed by what it stands for in parentheses.

    Entries are applied one after another, so what one writes can match a later one. Texts that have none of them
    are told by a single pattern and left alone; a term that ends without a letter or digit needs a word to follow, as ``\\b`` does.
    """
    any_term = r"(?i)\b(?:" + "|".join(map(re.escape, terms)) + r")\b"
    out = text
    for short, long in terms.items():
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(short)}\b", f"{short} ({long})".replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(F.rlike(text, F.lit(any_term)), out).otherwise(text)


def normalized_response(text: Column, domain: str) -> Column:
    """A response in the form in which its domain compares it: abbreviations written out, ``v.`` and section signs, or percents and basis points."""
    if domain == "healthcare":
        return written_out(text, HEALTHCARE_TERMS)
    if domain == "legal":
        return F.regexp_replace(F.regexp_replace(text, r"v\s+", "v. "), r"§\s*(\d)", "§ $1")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(\d+)\s*percent", "$1%"), r"(?i)(\d+)\s*basis\s+points?", "$1 bps")


def sources_for(claim_type: Column, domain: str) -> Column:
    """The authoritative sources that a claim of this type is checked against."""
    listed = lambda kinds: F.array(*[F.lit(s) for k in kinds for s in SOURCES[domain][k]])
    out = listed(SOURCE_KINDS[domain][None])
    for name, kinds in SOURCE_KINDS[domain].items():
        if name is not None:
            out = F.when(claim_type == name, listed(kinds)).otherwise(out)
    return out


def is_authoritative(identifier: Column, domain: str, strict: bool = False) -> Column:
    """Whether a source is one of the domain's, as part of its name; ``strict``: its host is one of them or below one, so that a look-alike name does not pass."""
    known = sorted({s for kinds in SOURCES[domain].values() for s in kinds})
    lower = F.lower(identifier)
    if not strict:
        return F.coalesce(F.exists(F.array(*[F.lit(s) for s in known]), lambda s: F.contains(lower, s)), F.lit(False))
    place = F.regexp_extract(lower, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)(?::\d+)?([^?#]*)", 0)
    host = F.regexp_extract(lower, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    labels = F.reverse(F.split(host, r"\."))  # from the top: suffixes of the host become prefixes
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, F.lit(1), n)), "."))
    pages = [s for s in known if "/" in s]
    hosts = F.arrays_overlap(below, F.array(*[F.lit(s) for s in known if "/" not in s]))
    in_page = F.lit(False)
    for s in pages:
        in_page = in_page | F.rlike(place, F.lit(r"(?:^|//|\.)" + re.escape(s) + r"(?:/|$)"))
    return F.coalesce(hosts | in_page, F.lit(False))
