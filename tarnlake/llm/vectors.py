"""Words of many texts at once as numpy arrays: places, 64-bit hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tarnlake.llm.common import BLANK, LOWER

#: Bytes of text that are worked on at once (a longer text alone): some 50 bytes of arrays each.
CHUNK = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or of one text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # the texts' bytes, a space behind each
    doc_start: np.ndarray  # where each text starts there, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # each text's first word, and the number of all


def words(texts: list[bytes], blank: np.ndarray = BLANK, lower: bool = False) -> Words:
    joined = b" ".join((*texts, b""))
    if lower:
        joined = joined.translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], ~blank[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    doc_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start]
    return Words(data, doc_start, start, end, mix(h), np.searchsorted(start, doc_start))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole if it has fewer, none if none."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = mix(out * np.uint64(BASE) + h[j : len(h) - k + 1 + j])
    return out
