"""Hashed words of a text, with a worker cache."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words are runs of anything but the six blanks; bytes.split() cuts at exactly these.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CACHED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def hashed_words(text: str, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order; of ``lower`` words with A-Z in lower case."""
    raw = text.encode()
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


_SOLID = np.ones(256, bool)
_SOLID[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = False
_PIECE = 1 << 16


def word_starts(raw: bytes) -> np.ndarray:
    """Where words begin."""
    solid = _SOLID[np.frombuffer(raw, np.uint8)]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    return np.flatnonzero(begins)


class _Powers:
    """Powers, from the first on, of an odd number and of its inverse modulo 2**64, as many as the longest piece so far has bytes."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, _PIECE)
            self.up, self.down = (np.cumprod(np.full(size, x, np.uint64)) for x in (int(MIX), pow(int(MIX), -1, 1 << 64)))
        return self.up[:n], self.down


_powers = _Powers()
#: What a byte counts in a word's hash: mixed from its number; blanks count nothing.
_COUNTS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_COUNTS = (_COUNTS ^ (_COUNTS >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
_COUNTS[~_SOLID] = 0


def word_sums(raw: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of each word, in order: made from all bytes at once, for choosing places; texts go in pieces that end at blanks."""
    out, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            blank = WORD.match(raw, end)  # a word may go on; the piece ends behind it
            end = blank.end() if blank else end
        own = raw[at:end]
        piece, starts = np.frombuffer(own, np.uint8), word_starts(own)
        if len(starts):
            up, down = _powers.of(len(piece))
            h = np.add.reduceat(_COUNTS[piece] * up, starts) * down[starts]
            h ^= h >> np.uint64(32)
            h *= MIX
            out.append(h ^ (h >> np.uint64(29)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hashed_windows(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(size):
        w = w * MIX + h[i : i + n]
    w ^= w >> np.uint64(29)
    w *= np.uint64(0xBF58476D1CE4E5B9)
    return w ^ (w >> np.uint64(32))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words the windows that begin at ``starts`` (a mask) cover."""
    edges = np.zeros(n + 1, np.int64)
    edges[: len(starts)] += starts
    edges[size : size + len(starts)] -= starts
    return np.cumsum(edges[:-1]) > 0
