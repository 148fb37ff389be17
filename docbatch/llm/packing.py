"""Operator 3: sequence packing by non-negative least squares over a length histogram.

1. Every document is tokenised, an end id is added, and the ids are cut into full windows and a rest.
2. The histogram of rest lengths (at most ``window`` numbers, whatever the input) goes to the driver.
   Shallow combinations of lengths that fill a window, or the greatest power of two below it, are
   enumerated; non-negative least squares finds how often to repeat each so that the histogram is met.
   Repeat counts are rounded down, and what remains is packed greedily, longest first, again on counts.
3. Pieces of one length are interchangeable, so the plan only says which rank among the pieces of a
   length goes where. Ranks come from counts per partition and length, so no length, however
   frequent, is gathered in one task.

Sequences may be left at a power of two instead of being padded to the window, so combinations that end
there cost no padding either.

Defined results: null and empty text are one end id; a text of any length is cut into windows; equal
rows are packed each for itself; ties in a length are broken by place in the written table; an empty
table gives an empty result; extra columns are not read, or passed through by no function here.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbatch.llm.common import slices, staged, texts

WINDOW = 1024
END_ID = 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer file's ids by the library's core, which is several times faster on long texts than its own batches.

    The file has one pattern, ranks in the order of its vocabulary and one special string, which counts
    as its id wherever it occurs; tests compare with the tokenizer library.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in shown)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), list(special)


#: Runs of white space (as the pattern's engine knows it) that are too long for its backtracking.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text. Long runs of white space are cut as the pattern does: all but the last character, or all before
    the end or a special string, are one piece."""
    core, special = _tokenizer(path)

    def encoded(part: str) -> np.ndarray:
        if any(s in part for s in special):
            return np.array(core.encode(part, allowed_special="all"), dtype=np.uint32)
        return core.encode_to_numpy(part, allowed_special=set(), disallowed_special=()).astype(np.uint32)

    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        last = m.end() == len(text) or any(text.startswith(s, m.end()) for s in special)
        end = m.end() if last else m.end() - 1
        piece = core._core_bpe.encode_single_piece(text[m.start() : end].encode())
        out += [encoded(text[at : m.start()]), np.array(piece, dtype=np.uint32)]
        at = end
    return np.concatenate([*out, encoded(text[at:])]) if out else encoded(text)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The windows and the rest of every document, with the partition that cut them and the rank among its pieces of that length."""
    schema = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank")] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for keys, values in slices(batches):
            rows: list[tuple] = []
            ids = []
            for k, value in enumerate(values):
                found = np.append(token_ids(path, value), np.uint32(END_ID)).astype("<u4")
                for a in range(0, len(found), window):
                    cut = found[a : a + window]
                    rows.append((k, a, len(cut), binascii.crc32(cut.tobytes()), len(found), part, seen[len(cut)]))
                    seen[len(cut)] += 1
                    if with_ids:
                        ids.append(cut.astype(np.int32))
            docs, *data = zip(*rows, strict=True)
            columns = [keys.take(pa.array(docs, pa.int64())), *(pa.array(x, pa.int64()) for x in data)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, schema=schema)

    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long" + ", ids array<int>" * with_ids
    return texts(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col).mapInArrow(run, kinds)


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of at most three lengths that fill the window, or end at half of it (a power of two), longest first."""
    lengths = np.flatnonzero(histogram)
    present = set(lengths.tolist())
    out: set[tuple[int, ...]] = set()
    for total in (window, window // 2):
        for a in lengths[lengths <= total].tolist():
            if a == total:
                out.add((a,))
            elif total - a in present and 2 * a >= total:
                out.add((a, total - a))
        # triples: each length with a spread of partners, so that their number stays proportional to the window
        for a in lengths[lengths < total].tolist():
            rest = total - a
            step = max(1, rest // 12)
            for b in range((rest + 1) // 2, min(rest, a) + 1, step):
                if b in present and rest - b in present and rest - b > 0:
                    out.add(tuple(sorted((a, b, rest - b), reverse=True)))
    return sorted(out, reverse=True)


def nonnegative_least_squares(rows: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - target|, A's columns being the combinations.

    Accelerated projected gradient steps on the sparse matrix, in units of the mean count.
    """
    if not rows:
        return np.zeros(0)
    column = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    length = np.array([x for r in rows for x in r])
    unit = max(1.0, float(target.max()))
    goal = target / unit
    times = lambda x: np.bincount(length, weights=x[column], minlength=len(target))
    back = lambda y: np.bincount(column, weights=y[length], minlength=len(rows))
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue of A'A sets the step
        v = back(times(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x = momentum = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, momentum - back(times(momentum) - goal) / norm)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, x, t = new + (t - 1) / following * (new - x), new, following
    return x * unit


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram exactly; ``histogram[n]`` pieces have length n."""
    left = histogram.astype(np.int64).copy()
    found: list[tuple[tuple[int, ...], int]] = []

    def take(combination: tuple[int, ...], repeats: int) -> None:
        need: dict[int, int] = {}
        for n in combination:
            need[n] = need.get(n, 0) + 1
        repeats = min([repeats, *(int(left[n]) // k for n, k in need.items())])
        if repeats > 0:
            for n, k in need.items():
                left[n] -= k * repeats
            found.append((combination, repeats))

    rows = combinations(left, window)
    for combination, x in sorted(zip(rows, np.floor(nonnegative_least_squares(rows, left.astype(float)) + 1e-6).astype(np.int64).tolist(), strict=True), key=lambda p: -p[1]):
        take(combination, x)
    # residuals: the longest piece, then the longest that still fits, as often as all of them last
    while (present := np.flatnonzero(left)).size:
        space, combination, count = window, [], left.copy()
        while space > 0 and (fits := present[(present <= space) & (count[present] > 0)]).size:
            n = int(fits[-1])
            combination.append(n)
            count[n] -= 1
            space -= n
        take(tuple(combination), int(left.sum()))
    return found


def placements(found: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length: (first rank, repeats, first sequence, offset) of each slot, by rank."""
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for combination, repeats in found:
        offset = 0
        for n in combination:
            first = used.get(n, 0)
            slots.setdefault(n, []).append((first, repeats, sequence, offset))
            used[n] = first + repeats
            offset += n
        sequence += repeats
    return slots


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a written table of ``pieces``."""
    counts = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["length"]] = row["n"]
    slots = placements(plan(histogram, window))
    # the plan has at most a few slots per length and combination; its size depends on the window, not on the input
    first = np.array([(n << 40) | f for n, own in sorted(slots.items()) for f, *_ in own], dtype=np.int64)
    target = np.array([(s, f, o) for n, own in sorted(slots.items()) for f, _, s, o in own], dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(first, (length.to_numpy() << 40) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": target[at, 0] + rank.to_numpy() - target[at, 1], "offset": target[at, 2]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.col("base")))
    return ranked.select(*(c for c in cut.columns if c not in ("part", "rank")), "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the document, its place in it, the digest of its ids (and the ids), and its sequence and offset."""
    return pack(staged(pieces(docs, path, window, id_col, text_col, with_ids), "pieces"), window).withColumnRenamed("id", id_col)
