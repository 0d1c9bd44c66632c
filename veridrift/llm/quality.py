"""Quality rules: base rules and a calibrated n-gram classifier with a fixed threshold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, slices, small_batches, texts
from .words import MIX, covered, hashed_windows, hashed_words

#: Hashed features of each kind: words (one and two), characters (three and four).
BITS = 17
#: Labelled documents learned from, at most, of each label; a fifth of them calibrates.
SAMPLE_DOCS = 800
STEPS, RATE, DECAY = 150, 0.5, 1e-5
#: Added to the number of features that a mean is taken over: a short text says less and stays nearer to the prior.
SHRINK = 40
THRESHOLD = 0.5
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Features that the fit copies at a time.
_BLOCK = 1 << 17
_MIX32 = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def repeated_words(h: np.ndarray, size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    w = hashed_windows(h, size)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return int(covered(twice, size, len(h)).sum())


def base_counts(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(h), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


def features(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word and character n-grams, repeats included."""
    shift = np.uint64(64 - BITS)
    pairs = (h[:-1] * MIX + h[1:]) * MIX
    words = np.concatenate([(h * MIX) >> shift, pairs >> shift]).astype(np.int32)
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    chars = []
    for n in (3, 4):
        m = len(u) - n + 1
        if m > 0:
            g = np.zeros(m, np.uint32)
            for i in range(n):
                g += u[i : i + m] * _MIX32[i]
            chars.append((g * _MIX32[0]) >> np.uint32(32 - BITS))
    return words, np.concatenate(chars).astype(np.int32) if chars else np.empty(0, np.int32)


@dataclass
class Model:
    """Weights of words and of characters; scale and shift turn a sum into a calibrated probability."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    chars: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    scale: float = 0.0
    shift: float = 20.0  # keeps everything until something is learned
    key: str = ""

    def probability(self, text: str, h: np.ndarray) -> float:
        words, chars = features(text, h)
        z = self.bias + float(self.words[words].sum(dtype=np.float64)) / (len(words) + SHRINK) + float(self.chars[chars].sum(dtype=np.float64)) / (len(chars) + SHRINK)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))


def _blocks(rows: list[tuple[int, np.ndarray, np.ndarray]], chosen: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Features, values and places of the chosen rows, in order, about ``_BLOCK`` at a time: all at once would be copied several times over."""
    places, at = np.flatnonzero(chosen), 0
    ends = np.cumsum([len(rows[k][1]) for k in places])
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, "right")))
        own = [rows[k] for k in places[at:to]]
        sizes = [len(r[1]) for r in own]
        yield slice(places[at], places[to - 1] + 1), np.concatenate([r[1] for r in own]).astype(np.int64), np.concatenate([r[2] for r in own]).astype(np.float64), np.repeat(places[at:to], sizes)
        at = to


def _fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> Model:
    """Logistic regression by Adam on four fifths of the rows, Platt scaling on the rest, weighted to ``prior``."""
    y = np.array([r[0] for r in rows], np.float64)
    for_fit = np.arange(len(rows)) % 5 != 4
    if len(set(y[for_fit])) < 2 or len(set(y[~for_fit])) < 2:
        return Model()
    w, b, m, v, mb, vb = np.zeros(2 << BITS), 0.0, np.zeros(2 << BITS), np.zeros(2 << BITS), 0.0, 0.0
    share = y[for_fit].mean()
    weight = for_fit * np.where(y > 0, prior / share, (1 - prior) / (1 - share)) / for_fit.sum()
    for t in range(1, STEPS + 1):
        g, r = np.zeros(2 << BITS), np.zeros(len(rows))
        for span, idx, val, at in _blocks(rows, for_fit):
            z = np.bincount(at - span.start, val * w[idx], span.stop - span.start) + b
            r[span] = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[span]) * weight[span]
            np.add.at(g, idx, val * r[at])
        gb = r.sum()
        g += DECAY * w / len(w)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    z = np.zeros(len(rows))
    for span, idx, val, at in _blocks(rows, ~for_fit):
        z[span] = np.bincount(at - span.start, val * w[idx], span.stop - span.start)
    z = (z + b)[~for_fit]
    yc = y[~for_fit]
    target = np.where(yc > 0, (yc.sum() + 1) / (yc.sum() + 2), 1 / (len(yc) - yc.sum() + 2))
    share = np.where(yc > 0, prior / yc.mean(), (1 - prior) / (1 - yc.mean())) / len(yc)
    spread = z.std() + 1e-9
    x, theta = np.stack([z / spread, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        grad = x @ ((p - target) * share) + 1e-4 * theta
        theta = theta - np.linalg.solve((x * (p * (1 - p) * share)) @ x.T + 1e-4 * np.eye(2), grad).clip(-2, 2)
    return Model(w[: 1 << BITS].astype(np.float32), w[1 << BITS :].astype(np.float32), float(b), float(theta[0] / spread), float(theta[1]), uuid.uuid4().hex)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of labelled rows: ``SAMPLE_DOCS`` of each label at most, by hash.

    A document with several labels takes the least, one with several rows its least text, so what
    reaches the driver is bounded however often an id repeats. Ids, texts and labels that are null are not
    learned from. With fewer than two labels the model keeps every document.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    h = F.xxhash64("doc_id")
    picked = known.groupBy("label", F.pmod(h, F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("least"), F.count("*").alias("n"))
    rows = picked.collect()  # at most 2 * SAMPLE_DOCS rows
    if not rows:
        return Model()
    prior = sum(r.n for r in rows if r.label) / sum(r.n for r in rows)
    sample = docs.sparkSession.createDataFrame([(r.least.doc_id, r.label) for r in rows], "doc_id long, label int")

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            idx, val = [], []
            for text in texts(batch.column("text")):
                words, chars = features(text, hashed_words(text))
                wi, wn = np.unique(words, return_counts=True)
                ci, cn = np.unique(chars, return_counts=True)
                idx.append(np.concatenate([wi, ci + (1 << BITS)]).astype(np.int32))
                val.append(np.concatenate([wn / (len(words) + SHRINK), cn / (len(chars) + SHRINK)]).astype(np.float32))
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["doc_id", "label", "idx", "val"])

    found = ids_and_text(docs, id_col, text_col).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = found.mapInArrow(to_features, "doc_id long, label int, idx array<int>, val array<float>").toArrow()
    order = pc.sort_indices(table, [("doc_id", "ascending"), ("label", "ascending")]).to_pylist()  # places, so the features are not copied
    examples = [(table["label"][k].as_py(), table["idx"][k].values.to_numpy(), table["val"][k].values.to_numpy()) for k in order]
    model = _fitted(examples, prior) if examples else Model()
    del table, examples
    pa.default_memory_pool().release_unused()
    return model


def _verdict(model: Model, text: str) -> tuple:
    h = hashed_words(text)
    counts = base_counts(text, h)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
    p = model.probability(text, h)
    return (*counts, failed, not failed and p >= THRESHOLD, float(p))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, verdict and probability of good quality of each whole text, a row for each input row.

    A document is kept if the base rules pass and its calibrated probability reaches
    ``THRESHOLD``. Null and empty texts have no words and fail. Null and repeated ids keep their
    rows, an empty table gives none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = zip(*(_verdict(spread.value, t) for t in texts(batch.column("text"))))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(list(c), kind) for (k, kind), c in zip(kinds, columns)})

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose verdict is kept, all columns unchanged, whatever their names.

    Null and empty texts have no words and go. Rows without an id are judged like others, repeated
    rows stay or go together, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([_verdict(spread.value, t)[6] for t in texts(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
