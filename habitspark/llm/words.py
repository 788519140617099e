"""Vectorised word and shingle hashing over Arrow text columns.

Texts lower-case A-Z; words are runs of bytes other than space and 0x09-0x0D. Null counts
as empty. A word becomes a 64-bit hash, a shingle of five words a hash of five hashes.
Work goes through slices of a few megabytes, so memory does not depend on batch size; one
very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SHINGLE = 5

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M
    h = h ^ (h >> np.uint64(32))
    h = h * _M
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_R, _R_INV)):
            p = np.full(size, base)
            p[0] = 1
            _POWERS[at] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of a slice of texts: positions refer to ``data``; ``first`` has one entry more than texts."""

    data: np.ndarray  # bytes of the slice, A-Z in lower case
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word
    offsets: np.ndarray  # byte where each text starts

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """``between`` marks the byte values that separate words."""
    data = _LOWER[data]
    n = len(data)
    inner = np.ones(n + 2, bool)  # separator flags with one at either end
    inner[1:-1] = between[data]
    word = ~inner
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (inner[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[1:-1] & (inner[2:] | cut[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES, between: np.ndarray = _SPACE) -> Iterator[tuple[int, Words]]:
    """Words of consecutive texts, a few megabytes at a time, with the index of the first text."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, split_words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], between)
        at = end


def rolling(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, across text borders as well."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= _R
        out += hashes[i : i + n]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence shorter than a shingle; tagged so it equals no shingle of other length."""
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _R + h
    return mix(np.array([out ^ np.uint64(0x5851F42D4C957F2D)]))[0]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, in order of the texts."""
    for _, w in slices(column):
        h = w.hashes()
        rolled = rolling(h)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= SHINGLE:
                s = np.sort(rolled[a : b - SHINGLE + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                yield np.array([whole(h[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


class Bytes:
    """Hashes of any stretch of a byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.total[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        """Hash of every stretch of ``size`` bytes."""
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
