"""SentencePiece encoding with source offsets, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import piece_model
from .common import ids_and_text, slices, texts


def _spans_by_map(model: piece_model.PieceModel, norm: bytes, source: list[int], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source spans of the pieces of a text whose normalization moved bytes."""
    # what the model sees: a space mark before the text and one of three bytes for each space
    marks = np.frombuffer(norm, dtype=np.uint8) == 0x20
    width = np.where(marks, 3, 1)
    aligned = np.concatenate([[source[0]] * 3, np.repeat(source[:-1], width), [source[-1]]])
    ends = np.cumsum(model.norm_bytes[ids])
    return aligned[ends - model.norm_bytes[ids]].astype(np.int32), aligned[ends].astype(np.int32)


def encode_batch(model: piece_model.PieceModel, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, ids, and the source bytes where each piece begins and ends, for all rows one after another."""
    model.trim()
    pre, counts, moved = [], [], {}
    for i, text in enumerate(rows):
        if text and (model.chars_map.units or piece_model.SPACE in text):
            moved[i] = model.chars_map.normalize(text)
            text = moved[i][0].decode()
        own = piece_model.pre_tokens(text)
        pre += own
        counts.append(len(own))
    places = np.fromiter(map(model.__getitem__, pre), dtype=np.int64, count=len(pre))
    ids, n = model.gather(places)
    ends_of_pre = np.concatenate([[0], np.cumsum(n)])
    offsets = ends_of_pre[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].astype(np.int32)
    width = model.source_bytes[ids].astype(np.int64)
    first = offsets[:-1][np.diff(offsets) > 0]
    width[first] -= 1  # the space mark before the text has no source
    ends = np.cumsum(width)
    base = np.repeat((ends - width)[np.minimum(offsets[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(rows), np.int64), np.diff(offsets))
    begin, end = (ends - width - base).astype(np.int32), (ends - base).astype(np.int32)
    for i, (norm, source) in moved.items():
        at = slice(offsets[i], offsets[i + 1])
        if offsets[i] < offsets[i + 1]:
            begin[at], end[at] = _spans_by_map(model, norm, source, ids[at])
    return offsets, ids, begin, end


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text with the source bytes they cover: ``doc_id, ids, begins, ends``.

    A piece's span lies in the original UTF-8 text, before normalization. The space mark that
    the model sets before a text has no source, so a span may be empty. Each byte-fallback
    piece covers its own byte.

    Null and empty texts have no ids. Null and repeated doc ids keep their rows. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model.load(model_path)
        for batch in slices(batches, 128):
            offsets, *values = encode_batch(model, texts(batch.column("text")))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in values]
            yield pa.record_batch([batch.column("doc_id"), *lists], names=["doc_id", "ids", "begins", "ends"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The texts of lists of ids: ``ids_col`` gives way to a string column ``to``, other columns stay.

    Null and empty lists decode to the empty string.
    """
    fields = [f for f in encoded.schema.fields if f.name != ids_col]
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = piece_model.load(model_path).lib
        for batch in slices(batches, 128):
            rows = [lib.decode(x) if x else "" for x in batch.column(ids_col).to_pylist()]
            kept = {f.name: batch.column(f.name) for f in fields}
            yield pa.record_batch(kept | {to: pa.array(rows, pa.string())})

    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.StringType())]))
