"""What substring and suffix-array dedup share: places chosen by content, what surrounds them, and cutting words out.

Every window of ``window`` words is represented by its least hashed gram of ``gram`` words, so
equal windows have equal representatives at the same place (winnowing). Only places whose gram is
shared between documents are looked at closely: their words go to the operator's own comparison. Within a task
equal rows are reduced to one first, so what all documents hold crosses the shuffle once for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, ids_and_text, slices, texts, written
from .words import covered, hashed_windows, word_starts, word_sums

#: Keys, and bytes of surroundings, that a task reduces at a time.
_HELD, _HELD_BYTES = 1 << 20, 12 << 20
#: Grams of more rows than this are hot: each of their windows is compared on its own. At most ``HOT_KEYS`` of them
#: (8 MB) are broadcast, the commonest first, so any other gram has less than one in so many of all occurrences.
HOT, HOT_KEYS = 4096, 1 << 20
_KEYED = "key long, row long, n long, known boolean"


def hashed_words(text: str) -> np.ndarray:
    """Hashes by which places are chosen; words themselves are compared later."""
    return word_sums(text.encode())


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int

    def representatives(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams, and for each window the place of its least gram (the first of equals)."""
        grams = hashed_windows(h, self.gram)
        reach = self.window - self.gram + 1
        if len(grams) < reach:
            return grams, np.empty(0, np.int64)
        # the least of spans of 1, 2, 4, ... grams, then of two spans that cover the window; the first of equals
        least, span = np.arange(len(grams)), 1
        while span * 2 <= reach:
            least = _less(grams, least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = _less(grams, least[: span - reach], least[reach - span :])
        return grams, least


def _less(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(grams[b] < grams[a], b, a)


def _reduced(keys: list[np.ndarray], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each key with its least holder and how many there are, and a known row for each holder of keys that several have."""
    if not keys:
        return
    holder = np.array([own[0] for own in held])
    in_order = np.argsort(holder, kind="stable")
    k, d = np.concatenate([keys[i] for i in in_order]), np.concatenate([held[i] for i in in_order])
    order = np.argsort(k, kind="stable")  # so the holders of a key stay in order
    k, d = k[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d = k[new], d[new]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    n = np.diff(np.append(np.flatnonzero(first), len(k)))
    several = ~(first & np.append(first[1:], True))
    for rows, count, flag in ((first, n, False), (several, np.zeros(several.sum(), np.int64), True)):
        if rows.any():
            yield pa.record_batch([pa.array(k[rows].view(np.int64)), pa.array(d[rows]), pa.array(count), pa.array(np.full(rows.sum(), flag))], names=["key", "row", "n", "known"])


def _keyed(rows: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys, holders, held = [], [], 0
    for row, own in rows:
        keys.append(own)
        holders.append(np.full(len(own), row, np.int64))
        held += len(own)
        if held >= _HELD:
            yield from _reduced(keys, holders)
            keys, holders, held = [], [], 0
    yield from _reduced(keys, holders)


def source_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, part, row, text`` of the rows with an id; ``part`` tells rows that share an id but not the text.

    ``row`` stands for both where keys are counted, so an id that many rows share gathers no keys of all of them.
    Equal texts under different ids never have one ``row``; two other rows have by a chance of 2**-64.
    """
    rows = ids_and_text(docs, id_col, text_col).where("doc_id is not null").withColumn("part", F.xxhash64("text"))
    return rows.select("doc_id", "part", F.col("part").bitwiseXOR(F.col("doc_id")).alias("row"), "text")


def shared_grams(rows: DataFrame, shape: Shape, resolve: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, np.ndarray]:
    """``row, keys`` (the grams at chosen places that several rows have), and the hot ones of all.

    ``resolve`` gets ``key, row, n`` (a few rows a key) and gives ``row, key, total`` for the keys of several rows.
    """

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray]]:
            for batch in slices(batches):
                for row, text in zip(batch.column("row").to_pylist(), texts(batch.column("text"))):
                    grams, at = shape.representatives(hashed_words(text))
                    if len(at):
                        yield row, grams[np.unique(at)]

        yield from _keyed(each())

    table = written(rows.select("row", "text").mapInArrow(seeds, _KEYED))
    told = written(resolve(table.where("not known").select("key", "row", "n")))
    often = told.where(F.col("total") > HOT).select("key", "total").distinct().orderBy(F.desc("total"), "key").limit(HOT_KEYS)
    hot = np.array(sorted(r.key for r in often.select("key").collect()), np.int64)
    shared = written(table.where("known").select("row", "key").union(told.select("row", "key")).groupBy("row").agg(F.collect_set("key").alias("keys")))
    discard(table, told)
    return shared, hot


@dataclass
class Place:
    """A chosen place: the ``n`` windows that it stands for begin at ``start``, and the gram ``left`` words later (-1: a window by itself)."""

    key: int
    start: int
    n: int
    left: int
    words: bytes  # of all these windows


def places(text: str, shape: Shape, shared: np.ndarray, hot: np.ndarray) -> Iterator[Place]:
    """The places whose gram is shared, with what surrounds them as far as windows reach; of hot grams each window by itself."""
    h = hashed_words(text)
    grams, at = shape.representatives(h)
    if not len(at):
        return
    chosen, first, n = np.unique(at, return_index=True, return_counts=True)
    keys = grams[chosen].view(np.int64)
    among = np.isin(keys, shared)
    if not among.any():
        return
    words = text.encode().split()
    chosen, first, n, keys = chosen[among], first[among], n[among], keys[among]
    for p, start, count, key, often in zip(chosen.tolist(), first.tolist(), n.tolist(), keys.tolist(), np.isin(keys, hot).tolist()):
        if not often:
            yield Place(key, start, count, p - start, b" ".join(words[start : start + count - 1 + shape.window]))
            continue
        for i in range(start, start + count):
            own = b" ".join(words[i : i + shape.window])
            yield Place(xxhash.xxh64_intdigest(own) - (1 << 63), i, 1, -1, own)


#: A document's windows that an earlier one has too: so many from the word ``start`` on.
RUN = "doc_id long, part long, start int, run int"
PLACED = f"key long, gap int, words binary, {RUN}"
_PLACED = pa.schema([("key", pa.int64()), ("gap", pa.int32()), ("words", pa.binary()), ("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("run", pa.int32())])


def placed(rows: DataFrame, shared: DataFrame, shape: Shape, hot: np.ndarray) -> DataFrame:
    """The places of each document (``PLACED``: ``gap`` words before the gram). Where a task has equal surroundings in several
    documents, those of the least go on; the others are known to repeat and have null words."""
    often = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def reduced() -> Iterator[pa.RecordBatch]:
            out, known = [], []
            for (key, gap, words), found in held.items():
                found = set(found)  # rows may be repeated
                least = min(found)[0]
                for f in found:
                    if f[0] == least:
                        out.append((key, gap, words, *f))
                    else:
                        known.append(f)
            # what is known needs no key: it only passes through, spread by document, runs that touch as one
            out += [(f[0], -1, None, *f) for f in merged(known)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _PLACED.types)], schema=_PLACED)

        for batch in slices(batches):
            for doc, part, text, keys in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts(batch.column("text")), batch.column("keys")):
                for x in places(text, shape, keys.values.to_numpy(), often.value):
                    found = held.setdefault((x.key, x.left, x.words), [])
                    size += 60 if found else 160 + len(x.words)
                    found.append((doc, part, x.start, x.n))
                    if size > _HELD_BYTES:
                        yield from reduced()
                        held.clear()
                        size = 0
        yield from reduced()

    return rows.join(shared, "row").select("doc_id", "part", "text", "keys").mapInArrow(run, PLACED)


def runs(start: int, matched: list[bool]) -> Iterator[tuple[int, int]]:
    """Where in a document the matched ones among consecutive windows begin, and how many follow each other."""
    at = 0
    for i, found in enumerate([*matched, False]):
        if not found:
            if i > at:
                yield start + at, i - at
            at = i + 1


def merged(found: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """``doc_id, part, start, run`` of the same windows, runs of a text that touch or overlap as one."""
    now, end = None, 0
    for doc, part, start, n in sorted(found):
        if now and now[:2] == (doc, part) and start <= end:
            end = max(end, start + n)
            continue
        if now:
            yield *now, end - now[2]
        now, end = (doc, part, start), start + n
    if now:
        yield *now, end - now[2]


def run_table(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PLACED.types[3:])], names=_PLACED.names[3:])


def by_document(found: DataFrame) -> DataFrame:
    """``doc_id, part, runs`` of rows like ``RUN``; repeated rows give theirs once."""
    return written(found.groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "run")).alias("runs")))


def _cut(text: str, found: pa.Scalar, window: int) -> tuple[int, int, list, str]:
    """n_words, n_removed, the removed runs (maximal repeats) as (first word, words), and the text without them."""
    raw = text.encode()
    if not found.is_valid:
        return len(raw.split()), 0, [], text
    spans = word_starts(raw).tolist()
    starts = np.zeros(max(0, len(spans) - window + 1), bool)
    for r in found.as_py():
        starts[r["start"] : r["start"] + r["run"]] = True
    gone = covered(starts, window, len(spans))
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    out, at, cut = [], 0, list(zip(turns[::2].tolist(), (turns[1::2] - turns[::2]).tolist()))
    spans.append(len(raw))
    for first, n in cut:
        out.append(raw[at : spans[first]])
        at = spans[first + n]
    return len(spans) - 1, int(gone.sum()), [{"first": a, "words": n} for a, n in cut], b"".join([*out, raw[at:]]).decode()


CUT_TYPE = "n_words long, n_removed long, repeats array<struct<first:int,words:int>>, kept_text string"


def without_repeats(docs: DataFrame, found: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, repeats, kept_text`` for each row, the repeats as maximal runs of words."""
    rows = ids_and_text(docs, id_col, text_col).withColumn("part", F.xxhash64("text")).join(found, ["doc_id", "part"], "left").select("doc_id", "text", "runs")
    kinds = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, spans, kept = zip(*(_cut(t, k, window) for t, k in zip(texts(batch.column("text")), batch.column("runs"))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "repeats", "kept_text"])

    return rows.mapInArrow(run, f"doc_id long, {CUT_TYPE}")


def cut_in_place(docs: DataFrame, found: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the repeats cut out of the text (and ``n_chars`` counted anew, where there is such a column)."""
    id_name, part_name, runs_name = (free_name(f"_repeat_{c}", docs) for c in ("id", "part", "runs"))
    keyed = found.select(F.col("doc_id").alias(id_name), F.col("part").alias(part_name), F.col("runs").alias(runs_name))
    on = (docs[id_col].cast("long") == keyed[id_name]) & (F.xxhash64(docs[text_col].cast("string")) == keyed[part_name])
    rows = docs.join(keyed, on, "left").drop(id_name, part_name)
    size = "n_chars" if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = batch.column(runs_name)
            kept = [t if t is None or not k.is_valid else _cut(t, k, window)[3] for t, k in zip(batch.column(text_col).to_pylist(), cut)]
            columns = {c: batch.column(c) for c in names} | {text_col: pa.array(kept, pa.string())}
            if size:
                columns[size] = pa.array([len(t) if k.is_valid else old for old, t, k in zip(columns[size].to_pylist(), kept, cut)], columns[size].type)
            yield pa.record_batch(columns)

    return rows.mapInArrow(run, docs.schema)
