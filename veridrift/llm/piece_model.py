"""A sentencepiece BPE model, cut at the borders that its merges cannot cross."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import sentencepiece

SPACE = "▁"
_RUNS = re.compile(" +[^ ]*")
#: Longer pre-tokens are encoded each time and never cached.
CACHED_CHARS = 48
CACHE_ENTRIES = 200_000


class CharsMap:
    """The compiled character map of a model: a double-array trie over UTF-8 keys and a block of replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that starts at ``at``: its length and its replacement."""
        if not self.units:
            return None
        found = None
        node = self._children(0, self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._children(node, unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _children(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)

    def normalize(self, text: str) -> tuple[bytes, list[int]]:
        """The text after longest-prefix replacement, and for each of its bytes (and its end) the source byte it comes from."""
        data, out, source, at = text.encode(), bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                piece = data[at : at + n]
            else:
                n, piece = hit
            out += piece
            # bytes kept as they are map one to one, replacements to the start of their key
            source += range(at, at + n) if piece == data[at : at + n] else [at] * len(piece)
            at += n
        return bytes(out), [*source, len(data)]


class PieceModel(dict):
    """Maps a pre-token to its place in a flat store of ids, as a bounded cache.

    A pre-token is a run of spaces with what follows up to the next space. No piece of a
    supported model has a space mark after another character, so no merge crosses the border
    of two pre-tokens and the ids of a text are those of its pre-tokens in order.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        spec.ParseFromString(self.lib.serialized_model_proto())
        pieces = [p.piece for p in spec.pieces]
        norm = spec.normalizer_spec
        if (
            spec.trainer_spec.model_type != pb.TrainerSpec.BPE
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or not spec.trainer_spec.byte_fallback
            or spec.trainer_spec.treat_whitespace_as_suffix
            or any(p.type == 4 or re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in spec.pieces)
        ):
            raise ValueError("only BPE models with byte fallback whose pieces end at spaces are supported")
        self.chars_map = CharsMap(norm.precompiled_charsmap)
        is_byte = np.array([p.type == 6 for p in spec.pieces])
        #: Bytes of each piece in the normalized text, and where a space mark stands for one byte.
        self.norm_bytes = np.where(is_byte, 1, [len(p.encode()) for p in pieces]).astype(np.int32)
        self.source_bytes = np.where(is_byte, 1, [len(p.replace(SPACE, " ").encode()) for p in pieces]).astype(np.int32)
        self.lone_space = self.lib.piece_to_id(SPACE)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts = array("i"), array("q", [0])

    def encode(self, pre_token: str) -> list[int]:
        return self.lib.encode(pre_token) if pre_token else [self.lone_space]

    def __missing__(self, pre_token: str) -> int:
        self.flat.extend(self.encode(pre_token))
        self.starts.append(len(self.flat))
        place = len(self.starts) - 2
        if len(pre_token) <= CACHED_CHARS:
            self[pre_token] = place
        return place

    def trim(self) -> None:
        """Between batches: start anew when the store has outgrown its bound."""
        if len(self.starts) > CACHE_ENTRIES or len(self.flat) > 16 * CACHE_ENTRIES:
            self.reset()

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pre-tokens one after another, and how many each has."""
        starts = np.frombuffer(self.starts, dtype=np.int64)
        first = starts[places]
        n = starts[places + 1] - first
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        ids = np.frombuffer(self.flat, dtype=np.int32)[at] if len(self.flat) else np.empty(0, np.int32)
        return ids, n


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a normalized text, each without its first space mark."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of this Python worker."""
    return PieceModel(path)
