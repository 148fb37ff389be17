"""Word shingles of texts as sorted sets of 64-bit hashes, by array operations."""

from __future__ import annotations

import numpy as np

from docbatch.llm.pieces import hashes, mixed

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(values: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` lower-cased words.

    A text with fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    raw = _LOWER[np.frombuffer(("\n".join(values) + "\n").encode(), dtype=np.uint8)]
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    word = hashes(raw, starts, ends - starts)
    sizes = np.fromiter((len(v) if v.isascii() else len(v.encode()) for v in values), np.int64, len(values)) + 1
    first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    if len(word) >= words:
        n = len(word) - words + 1
        window = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            window += mixed(word[j : j + n] * _PLACE[j])
        window = mixed(window)
    else:
        window = np.empty(0, dtype=np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(window[a : b - words + 1]))
        elif b > a:
            short = mixed(word[a:b] * _PLACE[32 : 32 + b - a])
            out.append(mixed(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
