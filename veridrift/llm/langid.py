"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts

UNKNOWN = "und"
#: Documents whose crc32(id) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2
#: The labelled rows learned from: whole texts of so many documents of a language at most. Of each hash bucket a document of up to
#: ``ROW_CHARS`` characters is taken, or if there is none the shortest.
SAMPLE_DOCS, ROW_CHARS = 8, 4_000
_OTHERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of learning; true where it has no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def letters_of(text: str) -> str:
    """The words of letters in lower case, one blank before each and after the last."""
    return f" {_OTHERS.sub(' ', text.casefold()).strip()} "


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the automaton that accepts every substring of ``text``; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


def linked(step: list[dict[str, int]]) -> dict:
    """The start of an automaton whose states are the dictionaries of their transitions; ``step`` is used up."""
    for own in step:
        for c, to in own.items():
            own[c] = step[to]
    return step[0]


def phrases(start: dict, unit: str) -> int:
    """How many phrases a greedy parse of ``unit`` takes, each the longest match in the learned text or one unseen character."""
    n, at, anew = 0, start, start.get
    for c in unit:
        to = at.get(c)
        if to is None:
            if at is not start:
                n += 1
            to = anew(c)
            if to is None:
                n += 1
                to = start
        at = to
    return n + (at is not start)


class Languages:
    """The automata of all learned languages."""

    def __init__(self, learned: dict[str, str]):
        self.names = sorted(learned)
        self.automata = [linked(suffix_automaton(learned[k])) for k in self.names]
        #: Bits to point at a phrase; they make parses against texts of different length comparable.
        self.bits = [math.log2(len(learned[k]) + 1) for k in self.names]

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and phrases for each letter (of the winner)."""
        if not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        unit = letters_of(text)
        n = [phrases(a, unit) for a in self.automata]
        cost = [x * bits for x, bits in zip(n, self.bits)]
        best = cost.index(min(cost))
        rest = min((c for i, c in enumerate(cost) if i != best), default=None)
        score = 1.0 if rest is None else rest / (rest + cost[best])
        return self.names[best], score, n[best] / max(1, len(unit) - unit.count(" "))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Text of each labelled language: whole texts of a bounded sample of the documents that are not held out.

    Of each of ``SAMPLE_DOCS`` hash buckets of a language one document is learned, the least hash of those of up to ``ROW_CHARS`` characters;
    where an id repeats, its least text. So what reaches the driver is bounded by the number of languages.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("doc_id") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    h = F.xxhash64("doc_id")
    size = F.greatest(F.length("text"), F.lit(ROW_CHARS))
    picked = rows.groupBy("lang", F.pmod(h, F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min(F.struct(size.alias("size"), h.alias("h"), "doc_id")).alias("least"))
    ids = picked.select("lang", "bucket", "least.doc_id", "least.size")
    found = rows.join(F.broadcast(ids), ["lang", "doc_id"]).where(size == F.col("size")).groupBy("lang", "bucket").agg(F.min("text").alias("text"))
    learned: dict[str, list[str]] = {}
    for row in sorted(found.collect(), key=lambda r: (r.lang, r.bucket)):
        learned.setdefault(row.lang, []).append(letters_of(row.text))
    return {k: "".join(own) for k, own in learned.items()}


_worker: dict[str, Languages] = {}


def _loaded(value: tuple[str, dict[str, str]]) -> Languages:
    if value[0] not in _worker:
        _worker.clear()
        _worker[value[0]] = Languages(value[1])
    return _worker[value[0]]


def identify(docs: DataFrame, learned: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each whole text: ``doc_id, held_out, lang_pred, score``, a row for each input row.

    Texts are lower-cased and parsed from end to end, across words, into the longest phrases found in the
    learned text of each language; the language with the least phrase bits
    wins, ties go to the first name. The score is the runner-up's share of both costs, from
    0.5 (undecided) up to 1; it is 1 if only one language was learned.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with
    score 0. Rows without an id count as held out. Repeated rows keep their rows, an empty table
    gives none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, learned))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _loaded(spread.value)
        for batch in slices(batches):
            names, score, _ = zip(*map(languages.predict, texts(batch.column("text"))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, learned: dict[str, str], text_col: str = "text", max_rate: float = 0.9) -> DataFrame:
    """The documents with a language, all columns unchanged.

    A document is rejected if it is ``und``, or if its best parse needs more than ``max_rate``
    phrases a letter (hardly any two letters in a row were learned: no language at all).
    Null and empty texts, and all texts if nothing was learned, are ``und``. Rows without an id are
    judged like others, repeated rows stay or go together, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, learned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _loaded(spread.value)
        for batch in slices(batches):
            found = map(languages.predict, texts(batch.column(text_col)))
            yield batch.filter(pa.array([name != UNKNOWN and rate <= max_rate for name, _, rate in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
