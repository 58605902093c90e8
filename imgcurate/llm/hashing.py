"""64-bit hashes of many words at once.

A word's hash is a polynomial over its bytes, each byte mapped to a random number, taken
from one running sum over the whole block, then mixed. All is arithmetic modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240917)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of words: all but space and the five control characters from tab to carriage return.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        made = np.full(max(n, _BLOCK), base, np.uint64)
        made[0] = 1
        held = np.cumprod(made, dtype=np.uint64)
        if len(held) <= 4 * _BLOCK:
            _POWERS[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each number over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; no run crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each span of bytes; ``fold`` takes A-Z for a-z. Spans must be in order and not overlap."""
    table = _FOLDED if fold else _BYTES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        part = data[low : ends[j - 1]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[part] * _powers(_BASE, len(part)), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        value = (sums[e] - sums[s]) * _powers(_INVERSE, len(part) + 1)[s]
        out[i:j] = mix(value + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words of a row; a shorter row is one run."""
    n = len(words)
    if not n:
        return words, rows
    full = np.zeros(n, bool)
    if n >= size:
        full[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    at = np.flatnonzero(full)
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = mix(value + words[at + k] * np.uint64(2 * k + 3))
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    count = np.diff(np.append(first, n))
    short = first[count < size]
    if len(short):
        lengths = count[count < size]
        more = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            some = lengths > k
            more[some] = mix(more[some] + words[short[some] + k] * np.uint64(2 * k + 3))
        more = mix(more + lengths.astype(np.uint64))
        order = np.argsort(np.concatenate([at, short]), kind="stable")
        return np.concatenate([value, more])[order], np.concatenate([rows[at], rows[short]])[order]
    return value, rows[at]


def prefix_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span of ``values`` a sum that depends on their order, not on where the span lies."""
    n = len(values) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * _powers(_BASE, n)[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
