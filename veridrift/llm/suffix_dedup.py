"""Exact dedup of long passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import discard, written

#: Words of a repeat, and of the prefixes by which suffixes are selected.
WINDOW, PREFIX = 50, 16


def _neighbours(keys: DataFrame) -> DataFrame:
    """``row, key, total`` of the hashed prefixes that several rows have: range-sorted over the cluster, each compared with its neighbours."""

    def settled(k: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        begin = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        several = (np.maximum.reduceat(d, begin) > np.minimum.reduceat(d, begin))[group] if len(k) else first
        total = np.add.reduceat(n, begin)[group] if len(k) else n
        return pa.record_batch([pa.array(d[several]), pa.array(k[several]), pa.array(total[several])], names=["row", "key", "total"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "row", "n"))]
            end = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on in the next batch
            if end:
                yield settled(*(h[:end] for h in held))
            held = [h[end:] for h in held]
        yield settled(*held)

    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(compare, "row long, key long, total long")


def common_words(a: bytes, b: bytes) -> int:
    """How many words, each with a blank behind it, two suffixes have in common."""
    if a == b:
        return a.count(b" ")
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = np.flatnonzero(x != y)
    return a[: int(differ[0]) if len(differ) else n].count(b" ")


def extended(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``doc_id, part, start, run`` of the windows that a smaller document has too, for suffixes in order that agree in their prefix.

    Suffixes with so many words in common are neighbours, so the length of the common prefix with the one before tells
    where the class of each length begins. To the left the match is extended word by word from the prefix.
    """
    if len(group) == 1:
        return
    begin = [0] * (window + 1)  # of the suffixes that agree with this one in so many words
    left: dict[tuple[int, bytes], int] = {}
    least: dict[tuple[int, int, int], int] = {}
    known, before = [], None
    for k, (cut, rest, words, doc, _, _, n) in enumerate(group):
        if before is not None:
            same = cut.count(b" ") + common_words(before, rest)
            if same < window:
                begin[same + 1 :] = [k] * (window - same)
        before = rest
        back, a = [0], 0
        for word in reversed(words.split(b" ")) if words else ():
            a = left.setdefault((a, word), len(left) + 1)
            back.append(a)
        gap = len(back) - 1
        own = [(begin[window - s], back[s], s) for s in range(gap, gap - n, -1)]
        for c in own:
            if doc < least.get(c, doc + 1):
                least[c] = doc
        known.append(own)
    for (_, _, _, doc, part, start, _), own in zip(group, known):
        for at, n in repeats.runs(start, [least[c] < doc for c in own]):
            yield doc, part, at, n


_SUFFIX = pa.schema([("cut", pa.binary()), ("rest", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("run", pa.int32())])


def _found(docs: DataFrame, window: int, prefix: int, id_col: str, text_col: str) -> DataFrame:
    rows, shape = repeats.source_rows(docs, id_col, text_col), repeats.Shape(window, min(prefix, window))
    shared, hot = repeats.shared_grams(rows, shape, _neighbours)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, rests, lefts = [], [], []
            for words, gap in zip(batch.column("words").to_pylist(), batch.column("gap").to_pylist()):
                if words is None:
                    cuts.append(None), rests.append(None), lefts.append(None)
                    continue
                every = words.split(b" ")
                at, gap = (gap + shape.gram, gap) if gap >= 0 else (window, 0)  # a window by itself is told apart as a whole
                cuts.append(b" ".join([*every[gap:at], b""]))
                rests.append(b" ".join([*every[at:], b""]) if at < len(every) else b"")
                lefts.append(b" ".join(every[:gap]))
            yield pa.record_batch([*(pa.array(c, pa.binary()) for c in (cuts, rests, lefts)), *(batch.column(c) for c in _SUFFIX.names[3:])], schema=_SUFFIX)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    out += extended(group, window)
                    group = []
                group.append(row)
            yield repeats.run_table(out)
        yield repeats.run_table(list(extended(group, window)) if group else [])

    retained = written(repeats.placed(rows, shared, shape, hot).mapInArrow(suffixes, f"cut binary, rest binary, left binary, {repeats.RUN}"))
    ordered = retained.where("cut is not null").repartitionByRange("cut").sortWithinPartitions("cut", "rest")
    found = repeats.by_document(ordered.mapInArrow(compare, repeats.RUN).union(retained.where("cut is null").select("doc_id", "part", "start", "run")))
    discard(shared, retained)
    return found


def remove_passages(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, repeats, kept_text``: texts without the long passages of earlier documents.

    Of all suffixes only those at minimiser positions are retained: where the hashed prefix is
    the least of a window, so that every window of ``window`` words has one. Those whose prefix several
    documents have are sorted over the cluster by their words; the common prefix of neighbours
    tells how far matches go to the right, and from the prefix they are extended to the left. A word is
    removed if a window covers it that also starts in a document with a smaller id, so each
    passage stays in one document. Hashes only select: words themselves are compared.

    Of a prefix that more than ``repeats.HOT`` rows have, the suffixes at each window are retained in its place and told
    apart by all their words, so no class holds more suffixes; equal ones are reduced within tasks.

    Null and empty texts have no words. A row without an id is neither cut nor matched; rows
    that share an id are each cut against smaller ids only, in work that grows with their number. An empty table gives no rows; other
    columns are not read.
    """
    return repeats.without_repeats(docs, _found(docs, window, prefix, id_col, text_col), window, id_col, text_col)


def cut_passages(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all columns, such passages cut out of the text.

    Texts without such a passage stay as they are, null and empty ones too; what a cut leaves may be
    empty. Rows without an id are neither cut nor matched; rows that share an id are each cut against smaller ids only.
    An empty table gives no rows, and columns keep their names whatever these are.
    """
    return repeats.cut_in_place(docs, _found(docs, window, prefix, id_col, text_col), window, id_col, text_col)
