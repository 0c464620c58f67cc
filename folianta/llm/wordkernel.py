"""Words of many texts at once, hashed with numpy straight from Arrow's buffers.

A word is a maximal run of ASCII letters, digits and bytes from 0x80 on (so every
accented letter belongs to its word), after Unicode lower-casing. Its 64-bit hash is a
polynomial over random byte codes, taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


@dataclass
class Words:
    """hash, start and end byte of each word, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def words(texts: pa.Array, cut_lines: bool = False) -> Words:
    """The words of each text; null counts as the empty text."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    n = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64, n + 1 + lowered.offset)[lowered.offset :]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = lowered.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _powers(_BASE, max(1, len(data)))[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    hashes = mix(value + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


_LAGS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    m = n - k + 1
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += (hashes[j : j + m] ^ (hashes[j : j + m] >> _U(29))) * _U(_LAGS[j % len(_LAGS)] + 2 * (j // len(_LAGS)))
    return mix(out + _U(k))
