"""Exact substring dedup by seed and extend."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .common import discard

#: Words of a repeat, and of the winnowed anchors.
WINDOW, GRAM = 13, 5


def _joined(anchors: DataFrame) -> DataFrame:
    """``row, key, total`` of the anchors that several rows have."""
    own = Window.partitionBy("key")
    picked = anchors.select("row", "key", F.sum("n").over(own).alias("total"), F.min("row").over(own).alias("least"), F.max("row").over(own).alias("most"))
    return picked.where("least != most").select("row", "key", "total")


class Extension:
    """Extends the matches of one anchor's occurrences word by word to both sides, all of them at once.

    Occurrences that agree in so many words to the left form a class, and so to the right; each further
    word divides a class. A window is a class to the left with one to the right, and keeps its least document.
    """

    def __init__(self, window: int):
        self.window = window
        self.left: dict[tuple[int, bytes], int] = {}
        self.right: dict[tuple[int, bytes], int] = {}
        self.least: dict[tuple[int, int], int] = {}

    def classes(self, words: list[bytes], gap: int, n: int) -> list[tuple[int, int]]:
        """The class of each of the ``n`` windows, first word first; the anchor is ``gap`` words in."""
        left, right, a, gap = [0], [0], 0, max(gap, 0)
        for word in words[gap - 1 :: -1] if gap else ():
            a = self.left.setdefault((a, word), len(self.left) + 1)
            left.append(a)
        a = 0
        for word in words[gap:]:
            a = self.right.setdefault((a, word), len(self.right) + 1)
            right.append(a)
        return [(left[gap - i], right[self.window - gap + i]) for i in range(n)]

    def offer(self, doc: int, classes: list[tuple[int, int]]) -> None:
        for c in classes:
            if doc < self.least.get(c, doc + 1):
                self.least[c] = doc


def extended(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``doc_id, part, start, run`` of the windows that a smaller document has too, for the occurrences of one anchor."""
    if len(group) == 1:
        return
    if all(g[1:3] == group[0][1:3] for g in group):  # alike as far as windows reach
        least = min(g[3] for g in group)
        yield from (g[3:] for g in group if g[3] > least)
        return
    match, known = Extension(window), []
    for _, gap, words, doc, _, _, n in group:
        known.append(match.classes(words.split(b" "), gap, n))
        match.offer(doc, known[-1])
    for (_, _, _, doc, part, start, _), own in zip(group, known):
        for at, n in repeats.runs(start, [match.least[c] < doc for c in own]):
            yield doc, part, at, n


def _found(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    rows, shape = repeats.source_rows(docs, id_col, text_col), repeats.Shape(window, min(gram, window))
    shared, hot = repeats.shared_grams(rows, shape, _joined)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] is None:
                    out.append(row[3:])
                    continue
                if group and group[0][0] != row[0]:
                    out += extended(group, window)
                    group = []
                group.append(row)
            yield repeats.run_table(out)
        yield repeats.run_table(list(extended(group, window)) if group else [])

    met = repeats.placed(rows, shared, shape, hot).repartition("key").sortWithinPartitions("key")
    found = repeats.by_document(met.mapInArrow(extend, repeats.RUN))
    discard(shared)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, repeats, kept_text``: texts without the passages of earlier documents.

    Documents are joined on winnowed anchors (the least hashed gram of every window). The matches
    of an anchor's occurrences are extended word by word both ways, as far as windows with the
    anchor reach; every word is removed that a window covers which also starts in a document with a
    smaller id. Overlapping windows merge to maximal repeats. Windows are judged on the input.
    Hashes only bring occurrences together: words themselves are compared.

    An anchor of more than ``repeats.HOT`` rows is extended to the whole window before the join, so
    no group holds more occurrences; equal windows are then reduced within tasks.

    Null and empty texts have no words. A row without an id is neither cut nor matched. Rows
    that share an id are each cut against smaller ids only, so a repeated row keeps what its
    twin keeps; work grows with their number, as for rows of distinct ids. An empty table gives no rows; other columns are not read.
    """
    found = _found(docs, window, gram, id_col, text_col)
    return repeats.without_repeats(docs, found, window, id_col, text_col)
