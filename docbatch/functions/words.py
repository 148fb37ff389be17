"""Words and keys of whole batches of texts, by array operations on their characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from docbatch.functions.text import CONFUSABLE, _accents

#: Bytes of text that are worked at once, so that memory follows neither the rows of a batch nor the length of lines.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about ``most`` bytes each; a longer text is a part of its own."""
    ends = _parts(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each of them starts and the last ends; null is empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int32)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def _characters(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def split_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(line, number from 1, place from 0, length, word) of all that stands between single spaces and is not empty; places and lengths count characters."""
    data, starts = _parts(lines)
    space = data == 32
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    first = np.flatnonzero(~space & (border[:-1] | np.r_[True, space[:-1]][: len(data)]))
    last = np.flatnonzero(~space & (border[1:] | np.r_[space[1:], True][: len(data)])) + 1
    line = np.searchsorted(starts, first, side="right") - 1
    own = starts[line]
    chars, spaces = _sums(_characters(data)), _sums(space)
    words = _texts(data[~space], np.r_[0, np.cumsum(last - first)])
    return line, spaces[first] - spaces[own] + 1, chars[first] - chars[own], chars[last] - chars[first], words


@lru_cache(maxsize=None)
def _key_table(mode: str) -> np.ndarray:
    """What ``functions.text.confusable_key`` makes of each character; 0 where it goes."""
    old, new = _accents()
    plain = list(range(0x10001))
    for c in old[len(new) :]:
        plain[ord(c)] = 0
    for c, p in zip(old, new):  # noqa: B905 (the marks, which go, have no counterpart)
        plain[ord(c)] = ord(p)
    table = np.zeros(0x10001, np.uint8)
    was, now = CONFUSABLE[mode]
    for c, p in enumerate(plain):
        low = "1" if mode == "bar" and p == ord("|") else chr(p).lower() if p < 128 else ""
        if low and low in "abcdefghijklmnopqrstuvwxyz0123456789":
            table[c] = ord(now[was.index(low)] if low in was else low)
    return table


def folded_keys(texts: pa.Array, mode: str = "o") -> pa.StringArray:
    """``functions.text.confusable_key`` of each text."""
    data, starts = _parts(texts)
    chars = _sums(_characters(data))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    codes = _key_table(mode)[np.minimum(points, 0x10000)]
    kept = codes != 0
    return _texts(codes[kept], _sums(kept)[chars[starts]])


def key_places(keys: pa.StringArray) -> tuple[str, np.ndarray]:
    """The keys as one text, and where each of them starts in it and the last ends."""
    data, starts = _parts(keys)
    return data.tobytes().decode(), starts
