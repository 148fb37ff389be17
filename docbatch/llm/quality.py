"""Operator 1: a quality classifier by random Fourier features.

Statistics of the whole text (lengths, shares of character classes, repetition of words and lines) are
standardised and mapped to ``FEATURES`` random Fourier features, which approximate a Gaussian kernel.
Each partition sums its own normal equations; their total is solved for ridge weights. Ridge scores of
rows that took no part in the fit are calibrated by isotonic regression (pool adjacent violators over
sums per score). Fit and calibration use a sample of about ``sample`` labelled rows, chosen by a hash of
their id; every row is scored.

Defined results: null and empty text are scored like any other (all statistics 0); texts of any length
count whole; ties and repeated rows get equal scores; without a usable label every score is the share
of good labels, 0.5 without any; where labels are so few that none is left for the calibration, those of
the fit serve; several labels of one id count by their mean; an empty table gives an empty result; extra
columns are not read, or passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import arrow_rows, slices, staged, texts
from docbatch.llm.pieces import hashes

#: Labelled rows that fit and calibration use together, about.
SAMPLE = 20_000
FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
#: Characters of a run of texts: the arrays of a run take some hundred bytes a character.
RUN_CHARS = 500_000

CLASSES = ("upper", "lower", "wide_letter", "digit", "space", "line_end", "mark", "strong_mark", "symbol", "pipe", "other")
_N = len(CLASSES)
#: Statistics per document: the length, the share of each class, and ten more (see ``statistics``).
STATISTICS = 1 + _N + 10


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.full(0x110000, CLASSES.index("other"), dtype=np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isupper():
            kind[c] = CLASSES.index("upper")
        elif x.isalpha():
            kind[c] = CLASSES.index("lower" if c < 0x250 else "wide_letter")
        elif x.isdigit():
            kind[c] = CLASSES.index("digit")
    kind[0x10000:] = CLASSES.index("wide_letter")
    for group, name in ((" \t\x0b\x0c", "space"), ("\n\r", "line_end"), (".,;:'\"()-", "mark"), ("!?", "strong_mark"), ("#$%&*+/<=>@\\^_`~[]{}", "symbol"), ("|", "pipe")):
        kind[[ord(x) for x in group]] = CLASSES.index(name)
    return kind


def _per_text(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)


def statistics(values: list[str]) -> np.ndarray:
    """A row of statistics per text."""
    n = len(values)
    out = np.zeros((n, STATISTICS))
    joined = "\n".join(values) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, values), np.int64, n)
    of = np.repeat(np.arange(n), sizes + 1)
    kind = _classes()[codes]
    counts = np.bincount(of * _N + kind, minlength=n * _N).reshape(n, _N).astype(float)
    counts[:, CLASSES.index("line_end")] -= 1  # the separator
    out[:, 0] = np.log1p(sizes)
    out[:, 1 : 1 + _N] = counts / np.maximum(sizes, 1)[:, None]
    rest = out[:, 1 + _N :]
    letters = counts[:, 0] + counts[:, 1] + counts[:, 2]
    rest[:, 0] = counts[:, 0] / np.maximum(letters, 1)
    # words: runs without white space
    blank = (kind == CLASSES.index("space")) | (kind == CLASSES.index("line_end"))
    edges = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        lengths = ends - starts
        word_of = of[starts]
        words = np.maximum(np.bincount(word_of, minlength=n), 1)
        key = hashes(codes.astype(np.uint8), starts, lengths)
        with_before = np.r_[False, word_of[1:] == word_of[:-1]]
        rest[:, 1] = np.log1p(np.bincount(word_of, minlength=n))
        rest[:, 2] = _per_text(lengths, word_of, n) / words
        rest[:, 3] = _per_text(np.r_[False, key[1:] == key[:-1]] & with_before, word_of, n) / words
        order = np.lexsort((key, word_of))
        again = np.r_[False, (key[order][1:] == key[order][:-1]) & (word_of[order][1:] == word_of[order][:-1])]
        rest[:, 4] = _per_text(again, word_of[order], n) / words
        symbols = np.r_[0, np.cumsum((kind >= CLASSES.index("strong_mark")) & (kind <= CLASSES.index("pipe")))]
        rest[:, 5] = _per_text(symbols[ends] > symbols[starts], word_of, n) / words
        upper = np.r_[0, np.cumsum(kind == CLASSES.index("upper"))]
        rest[:, 6] = _per_text((upper[ends] - upper[starts] >= np.maximum(2, lengths / 2)), word_of, n) / words
        rest[:, 7] = _per_text(lengths > 25, word_of, n) / words
    # lines
    line_ends = np.flatnonzero(codes == 10)
    line_starts = np.r_[0, line_ends[:-1] + 1]
    line_of, long = of[line_ends], line_ends - line_starts
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    rest[:, 8] = np.log1p(_per_text(long, line_of, n) / lines)
    full = np.flatnonzero(long > 0)
    key = hashes(codes.astype(np.uint8), line_starts[full], long[full])
    order = np.lexsort((key, line_of[full]))
    again = np.r_[False, (key[order][1:] == key[order][:-1]) & (line_of[full][order][1:] == line_of[full][order][:-1])] if len(full) else np.empty(0, bool)
    rest[:, 9] = _per_text(again, line_of[full][order], n) / lines
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(7).normal(size=(STATISTICS, FEATURES // 2)) / np.sqrt(STATISTICS)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    angle = np.clip(z, -6, 6) @ _directions()
    return np.hstack([np.cos(angle), np.sin(angle), np.ones((len(z), 1))])


def isotonic(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising (score, share) steps for sums of good labels and weights by rising score."""
    blocks: list[list[float]] = []
    for s, g, w in zip(scores, good, weight, strict=True):
        blocks.append([s, s, g, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    steps = [x for b in blocks for x in ((b[0], b[2] / b[3]), (b[1], b[2] / b[3]))]
    return np.array([s for s, _ in steps]), np.array([v for _, v in steps])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from the given labels (1: good). Pass only the labels that may be seen."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    # about ``sample`` ids at most, so their size is bounded
    chosen = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    chosen = chosen.select(F.struct(F.col("y"), (F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(10)) < 7).alias("in_fit")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches, RUN_CHARS):
            yield pa.RecordBatch.from_arrays([keys.field("y"), keys.field("in_fit"), pa.array(list(statistics(values)), pa.list_(pa.float64()))], names=["y", "in_fit", "x"])

    rows = staged(chosen.mapInArrow(measure, "y double, in_fit boolean, x array<double>"), "quality").coalesce(16)

    def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
        return batch.column(batch.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATISTICS))
        n = good = 0.0
        for b in batches:
            x = matrix(b)
            total += [x.sum(axis=0), (x * x).sum(axis=0)]
            n, good = n + len(x), good + float(np.sum(b.column(0).to_numpy()))
        yield pa.RecordBatch.from_pydict({"n": [float(n)], "good": [good], "sums": [total.tobytes()]})

    parts = rows.mapInArrow(moments, "n double, good double, sums binary").collect()
    n, good = sum(p.n for p in parts), sum(p.good for p in parts)
    if good in (0, n):
        share = good / n if n else 0.5
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([share]))
    sums = sum(np.frombuffer(p.sums).reshape(2, STATISTICS) for p in parts)
    mean = sums[0] / n
    scale = np.sqrt(np.maximum(sums[1] / n - mean**2, 0)) + 1e-6

    def equations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            use = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            z, y = fourier((matrix(b)[use] - mean) / scale), b.column(0).to_numpy()[use]
            left += z.T @ z
            right += z.T @ y
        yield pa.RecordBatch.from_pydict({"a": [left.tobytes()], "b": [right.tobytes()]})

    parts = rows.mapInArrow(equations, "a binary, b binary").collect()  # at most 16 sums
    left = sum(np.frombuffer(p.a).reshape(FEATURES + 1, FEATURES + 1) for p in parts)
    weights = np.linalg.solve(left + RIDGE * max(1.0, n) * np.eye(FEATURES + 1) / 100, sum(np.frombuffer(p.b) for p in parts))
    model = QualityModel(mean, scale, weights, np.array([0.0]), np.array([0.5]))

    def calibration(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"s": np.round(model.raw(matrix(b)), 3), "y": b.column(0)})

    def calibrated(some: DataFrame) -> list:
        return some.mapInArrow(calibration, "s double, y double").groupBy("s").agg(F.sum("y").alias("good"), F.count("y").alias("n")).orderBy("s").collect()

    # with a handful of labels no row may be left for the calibration; then those of the fit serve
    bins = calibrated(rows.filter("not in_fit")) or calibrated(rows)
    model.steps, model.values = isotonic(*(np.array([b[i] for b in bins], dtype=float) for i in range(3)))
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Scores every row: (id, score, predicted). A map without shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches, RUN_CHARS):
            s = model.score(statistics(values))
            yield arrow_rows(keys, schema, score=s, predicted=(s >= threshold).astype(np.int32))

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    @F.pandas_udf("boolean")
    def good(values):
        out = np.empty(len(values), dtype=bool)
        data = values.fillna("").tolist()
        start = held = 0
        for i in range(len(data) + 1):
            if i == len(data) or held > RUN_CHARS:
                if i > start:
                    out[start:i] = model.score(statistics(data[start:i])) >= threshold
                start, held = i, 0
            if i < len(data):
                held += len(data[i])
        import pandas as pd

        return pd.Series(out)

    return docs.filter(good(F.col(text_col)))
