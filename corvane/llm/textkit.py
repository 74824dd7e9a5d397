"""Words, word hashes and shingle hashes of many texts at once, over raw UTF-8 buffers.

A batch of texts is one byte array with document offsets, so every step is a
numpy operation over the batch instead of a Python loop over words. Hashes are
64-bit; whatever needs certainty compares the words themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Byte classes: True where a byte parts words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NON_ALNUM = np.ones(256, bool)
_NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SPACE_PARTED, ALNUM = _SPACE, _NON_ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Two tables of odd numbers for bytes: two independent hashes of a word.
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240229, 20240301)]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (or more) of a fixed odd base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offset of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes: first document, bytes, offsets.

    One document longer than `limit` is a run of its own; none is cut.
    """
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        yield k, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end


class Words:
    """Words of a run of documents.

    start, end: byte positions of each word. first: index of each document's
    first word, with the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, lower: bool = True) -> None:
        self.data = _LOWER[data] if lower else data
        inside = ~parts[data]
        begins = np.empty(len(data) + 1, bool)
        begins[:-1] = inside
        begins[-1] = False
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        self.start = np.flatnonzero(begins & (fresh | ~before))
        self.end = np.flatnonzero(before & (fresh | ~begins))
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; hashes 0 and 1 are independent of each other."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[which][self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + _ODD)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def list(self, a: int, b: int) -> list[bytes]:
        """Words a to b-1 as bytes."""
        if a >= b:
            return []
        low = int(self.start[a])
        raw = self.data[low : self.end[b - 1]].tobytes()
        return [raw[s:e] for s, e in zip((self.start[a:b] - low).tolist(), (self.end[a:b] - low).tolist(), strict=True)]


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out + np.uint64(k * int(_ODD) % (1 << 64)))
