"""Hashes of words and word windows straight from Arrow buffers, with numpy only.

Word hashes are 64-bit polynomials over the word's bytes (arithmetic modulo 2^64), then mixed;
windows are polynomials over word hashes. A window of 128 bits uses two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEPS = (np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Powers that a worker keeps between calls; longer runs are worked out again, so that idle workers hold little.
KEPT = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base^0 .. base^(n-1); short runs are kept for the next call of the same name."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= KEPT:
            _powers[name] = have
    return have[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_spans(texts: pa.Array, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some UTF-8 texts (null: none), where each word begins and ends in them, and where each text's words start.
    ``gap`` says which of the 256 bytes separate words."""
    texts = texts.fill_null(b"") if texts.null_count else texts
    none = np.empty(0, np.int64)
    if len(texts) == 0:
        return np.empty(0, np.uint8), none, none, np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begins[borders] = inside[borders]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    finishes[borders - 1] = inside[borders - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return data, first, end, np.searchsorted(first, offsets)


def hash_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data), "bytes"), out=total[1:])
    hashes = (total[end] - total[first]) * powers(_INVERSE, len(data), "inverse")[first]
    return mix(hashes + (end - first).astype(np.uint64) * _STEPS[0])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, and where each text's words start."""
    data, first, end, offsets = word_spans(texts)
    return hash_spans(data, first, end), offsets


def windows(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` words, also across texts; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = _STEPS[which]
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= step
        out += hashes[k : k + n]
    return mix(out)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that stay within one text, and where each text's own windows start among them."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - ends + counts, counts)
    return at, np.concatenate([[0], ends]).astype(np.int64)


def whole(hashes: np.ndarray, which: int = 0) -> np.uint64:
    """One hash for a short run of words."""
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _STEPS[which] + h
    return mix(np.array([out], np.uint64))[0]
