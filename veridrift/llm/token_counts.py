"""Token counts by a map-side two-tier lookup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_model
from .common import ids_and_text, slices, texts

#: Entries of the broadcast table, and of what one task reports for it.
TABLE_ENTRIES, REPORTED = 16_384, 4_096
#: Distinct pre-tokens that a task counts before it forgets the rarer half, and that a worker caches.
COUNTED, CACHED = 200_000, 200_000


def frequent_lengths(docs: DataFrame, model_path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens over all documents, at most ``entries`` of them.

    Each task counts its own pre-tokens and reports a summary of bounded length; only these
    summaries are added up. The table only saves work: what it lacks is encoded where it occurs.
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for text in texts(batch.column("text")):
                counts.update(piece_model.pre_tokens(text))
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in counts.most_common(REPORTED) if len(k) <= piece_model.CACHED_CHARS]
        yield pa.record_batch({"pre_token": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    model = piece_model.load(model_path)
    top = ids_and_text(docs).select("text").mapInArrow(summarize, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(entries)
    return {row.pre_token: len(model.encode(row.pre_token)) for row in top.collect()}


class _Lengths(dict):
    """The broadcast table, with a worker cache of misses behind it."""

    def __init__(self, table: dict[str, int], model: piece_model.PieceModel):
        super().__init__(table)
        self.table, self.model = table, model

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.encode(pre_token))
        if len(pre_token) <= piece_model.CACHED_CHARS:
            self[pre_token] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHED:
            self.clear()
            self.update(self.table)


_worker: dict[str, _Lengths] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """Tokens of each whole text: ``doc_id, n_bytes, n_tokens, over_limit``, a row for each input row.

    A compact table of frequent pre-token lengths is broadcast (at most ``TABLE_ENTRIES`` short
    strings); misses are encoded once per worker. No pre-token occurrence is shuffled. With
    ``entries`` 0 there is no table and no pass to make it: worker caches alone serve a single
    use of the counts.

    Null and empty texts have 0 bytes and 0 tokens. Null and repeated ids keep their rows. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    pairs = ids_and_text(docs, id_col, text_col)
    table = pairs.sparkSession.sparkContext.broadcast(frequent_lengths(pairs, model_path, entries) if entries else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_path} {table.value.get('', 0)} {hash(frozenset(table.value))}"
        if key not in _worker:
            _worker.clear()
            _worker[key] = _Lengths(table.value, piece_model.load(model_path))
        lengths = _worker[key]
        for batch in slices(batches):
            lengths.trim()
            n = [sum(map(lengths.__getitem__, piece_model.pre_tokens(text))) for text in texts(batch.column("text"))]
            tokens = pa.array(n, pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pairs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
