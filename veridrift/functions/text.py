"""Text normalization, word sets and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as evidence.
STOP_WORDS = (
    "the a an is are was were been be have has had do does did will would could should may might shall can to of "
    "in for on with at by from as into that which who whom this these those it its and but or nor not no so "
    "if then than too very just about patient noted reported states denies"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the text contains any of the words, as substrings."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_of(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """How many of the words the text contains; each counts once, as a substring."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def normalized(c: Column | str) -> Column:
    """Lower case without white space at both ends."""
    return F.regexp_replace(F.lower(_col(c)), r"^\s+|\s+$", "")


def collapsed(c: Column | str) -> Column:
    """``normalized`` with each run of white space as one blank."""
    return F.regexp_replace(normalized(c), r"\s+", " ")


def words(c: Column | str) -> Column:
    """The distinct words of the collapsed text."""
    return F.array_distinct(F.filter(F.split(collapsed(c), " "), lambda w: w != ""))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_of_larger(a: Column | str, b: Column | str) -> Column:
    """Shared words over the size of the larger word set; 0 if either has none."""
    wa, wb = words(a), words(b)
    most = F.greatest(F.size(wa), F.size(wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(shared_words(wa, wb) / most)


def fuzzy_match(a: Column | str, b: Column | str, threshold: float = 0.6) -> Column:
    return overlap_of_larger(a, b) >= threshold


def similarity(claim: Column | str, source: Column | str) -> Column:
    """1 if the source contains the claim, else the share of the claim's words that the source has."""
    c, s = collapsed(claim), collapsed(source)
    wc = words(claim)
    return F.when(F.contains(s, c), 1.0).when(F.size(wc) == 0, 0.0).otherwise(shared_words(wc, words(source)) / F.size(wc))


def faithfulness(claim: Column | str, source: Column | str, overrides: dict[str, float] | None = None) -> Column:
    """Deterministic faithfulness: overrides by keyword, 0.95 if contained, 0.4 to 0.85 by overlap of telling words, 0.15 without any."""
    c, s = collapsed(claim), collapsed(source)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    wc, ws = F.array_except(words(claim), stop), F.array_except(words(source), stop)
    overlap = F.when(F.size(wc) > 0, shared_words(wc, ws) / F.size(wc)).otherwise(0.0)
    score = F.when(F.contains(s, c), 0.95).when(overlap > 0, 0.4 + overlap * 0.45).otherwise(0.15)
    for keyword, fixed in reversed((overrides or {}).items()):
        score = F.when(F.contains(c, F.lit(keyword.lower())), float(fixed)).otherwise(score)
    return score


def faithfulness_level(score: Column) -> Column:
    return F.when(score >= 0.8, "faithful").when(score >= 0.5, "partially_faithful").when(score >= 0.2, "likely_hallucinated").otherwise("hallucinated")


def preview(c: Column | str, size: int = 200) -> Column:
    """The first ``size`` characters, with dots where the text goes on."""
    c = _col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def context_window(text: Column, at: Column, before: int, after: int) -> Column:
    """The characters from ``before`` ahead of the 0-based position to ``after`` behind it."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(normalized(c), r"[\s\-/]+", "_")
