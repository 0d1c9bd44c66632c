"""Extraction as table functions of SQL: a text in, a row for each claim out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .packs import PACKS
from .scan import Scanner



def _shape(**columns: type) -> AnalyzeResult:
    """Columns of int or str; analysis runs without a session that could read a DDL string."""
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, IntegerType() if kind is int else StringType())
    return AnalyzeResult(out)


class DomainClaims:
    """``domain_claims(text, 'finance')``: the claims of a domain, which must be a constant."""

    @staticmethod
    def analyze(text: AnalyzeArgument, domain: AnalyzeArgument) -> AnalyzeResult:
        if not domain.isConstantExpression or domain.value not in PACKS:
            raise ValueError(f"the domain must be one of {', '.join(sorted(PACKS))}")
        return _shape(pos=int, claim_id=str, claim_type=str, claim_text=str, start=int, stop=int, context=str)

    def __init__(self) -> None:
        self.scanners: dict[str, Scanner] = {}

    def eval(self, text: str | None, domain: str) -> Iterator[tuple]:
        pack = PACKS[domain]
        if domain not in self.scanners:
            self.scanners[domain] = Scanner(pack.rules)
        for pos, claim in enumerate(self.scanners[domain].claims(text) if text else ()):
            yield (pos, f"{pack.prefix}_{pos:03d}_{claim[0]}", *claim)


class TextSections:
    """``text_sections(text, 60)``: the lines under the last line shorter than ``limit`` above them, as sections in order."""

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not limit.isConstantExpression or limit.value is None or limit.value < 0:
            raise ValueError("the limit must be a constant of 0 or more")
        return _shape(pos=int, section=str, body=str, n_lines=int)

    def eval(self, text: str | None, limit: int) -> Iterator[tuple]:
        found: dict[str, list[str]] = {}
        name = "general"
        for line in (text or "").split("\n") if text is not None else ():
            if len(line) < limit:
                name = line.lower().strip()
            else:
                found.setdefault(name, []).append(line)
        for pos, (section, lines) in enumerate(found.items()):
            yield pos, section, "\n".join(lines), len(lines)


TABLE_FUNCTIONS = {"domain_claims": DomainClaims, "text_sections": TextSections}


def register(spark: SparkSession) -> None:
    """Let the session's SQL call the functions by name, after LATERAL."""
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
