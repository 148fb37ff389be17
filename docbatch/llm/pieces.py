"""Distinct byte strings of a buffer, found by array operations."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1 ... start+length-1 of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: the sum over its bytes of a mix of value and place."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    place = spread(np.zeros(len(starts), dtype=np.int64), lengths).astype(np.uint64)
    value = _BYTE[raw[spread(starts, lengths)]] * ((place * _STEP) | np.uint64(1))
    value ^= value >> np.uint64(31)
    value *= _ODD
    sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
    ends = np.cumsum(lengths)
    return mixed(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))


def distinct(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one range for each distinct content, and for every range the number of its content.

    Ranges meet by hash and are then compared byte by byte, so the result is exact.
    """
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    _, first, inverse = np.unique(hashes(raw, starts, lengths), return_index=True, return_inverse=True)
    same = np.array_equal(lengths[first[inverse]], lengths) and np.array_equal(raw[spread(starts[first[inverse]], lengths)], raw[spread(starts, lengths)])
    if not same:  # two contents met in one hash
        data = raw.tobytes()
        number: dict[bytes, int] = {}
        inverse = np.array([number.setdefault(data[s : s + n], len(number)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse
