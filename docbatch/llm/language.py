"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of the
documents that may be learned from: about ``PER_LANGUAGE`` of each language, chosen and ordered by hashes of the id. Every text is cut into windows
of ``WINDOW`` bytes that cover all of it. Windows of many documents run in lock-step, forwards and
backwards; every byte position gets its own label probabilities, and a document's probabilities are
their mean over its positions.

Defined results: null text and text without a letter give ``und`` with score 0, as does a model that
had nothing to learn from; a text of any length is labelled at every byte; equal rows get equal
results; ties go to the language that sorts first; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import arrow_rows, slices, texts

WINDOW = 64
HIDDEN = 8
#: Documents that the training sample has of each language, about, and the windows cut from each.
PER_LANGUAGE = 250
WINDOWS_EACH = 8
STEPS = 260
BATCH = 192
UNDETERMINED = "und"
#: Windows that run in lock-step.
LOCKSTEP = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """One direction's weights: an input row per byte value, and the recurrent matrix, for update, reset and new gates."""

    bytes_in: np.ndarray
    hidden: np.ndarray
    new_bias: np.ndarray

    @staticmethod
    def start(rng: np.random.Generator, hidden: int) -> Direction:
        return Direction(rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32), rng.normal(0, 0.4, (hidden, 3 * hidden)).astype(np.float32), np.zeros(hidden, np.float32))

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        x, u = self.bytes_in[byte], h @ self.hidden
        gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        inner = u[:, 2 * n :] + self.new_bias
        new = np.tanh(x[:, 2 * n :] + r * inner)
        return new + z * (h - new), z, r, inner, new


@dataclass
class LanguageModel:
    labels: list[str]
    forward: Direction | None = None
    backward: Direction | None = None
    out: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def label_positions(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities [time, window, label] of byte windows [window, time]."""
        steps = np.ascontiguousarray(windows.T)
        n, hidden = windows.shape[0], self.forward.hidden.shape[0]
        states = np.empty((len(steps), n, hidden), np.float32)
        h = np.zeros((n, hidden), np.float32)
        for t, byte in enumerate(steps):
            h = states[t] = self.forward.step(byte, h)[0]
        out = np.empty((len(steps), n, len(self.labels)), np.float32)
        h = np.zeros((n, hidden), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h = self.backward.step(steps[t], h)[0]
            score = states[t] @ self.out[:hidden] + h @ self.out[hidden:] + self.bias
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[t] = score / score.sum(axis=1, keepdims=True)
        return out

    def pooled(self, raw: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean label probabilities over all byte positions of each text (not empty).

        Whole windows run together; the rests of texts run together by length.
        """
        sums = np.zeros((len(raw), len(self.labels)))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        first = np.cumsum(sizes) - sizes
        whole = sizes // window
        of = np.repeat(np.arange(len(raw)), whole)
        begin = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)) * window
        groups = [(of, begin, window)]
        rest = sizes % window
        # a rest runs with the bytes before it where there are any, and only its own positions count
        for width in range(8, window + 1, 8):
            at = np.flatnonzero((rest > width - 8) & (rest <= width))
            full = at[sizes[at] >= width]
            groups.append((full, first[full] + sizes[full] - width, width))
            short = at[sizes[at] < width]
            for n in np.unique(sizes[short]).tolist():
                some = short[sizes[short] == n]
                groups.append((some, first[some], n))
        for k, (of, begin, width) in enumerate(groups):
            for a in range(0, len(of), LOCKSTEP):
                own, start = of[a : a + LOCKSTEP], begin[a : a + LOCKSTEP]
                p = self.label_positions(flat[start[:, None] + np.arange(width)])
                if k:
                    p = p * (np.arange(width)[:, None] >= width - rest[own][None, :])[:, :, None]
                totals = p.sum(axis=0)
                for label in range(len(self.labels)):
                    sums[:, label] += np.bincount(own, weights=totals[:, label], minlength=len(raw))
        return sums / np.maximum(sizes, 1)[:, None]


def _backwards(direction: Direction, steps: np.ndarray, kept: list[tuple], grads: np.ndarray) -> Direction:
    """Gradients of one direction by backpropagation through time. ``kept`` has each step's (h before, z, r, inner, new)."""
    d_in, d_hidden, d_bias = np.zeros_like(direction.bytes_in), np.zeros_like(direction.hidden), np.zeros_like(direction.new_bias)
    carry = np.zeros_like(grads[0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, inner, new = kept[t]
        d = grads[t] + carry
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_inner = d_new * r
        d_bias += d_inner.sum(axis=0)
        d_u = np.hstack([d_z, d_r, d_inner])
        d_hidden += h.T @ d_u
        np.add.at(d_in, steps[t], np.hstack([d_z, d_r, d_new]))
        carry = d * z + d_u @ direction.hidden.T
    return Direction(d_in, d_hidden, d_bias)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> LanguageModel:
    """Fits the network to byte windows [window, time] and the label number of each, with Adam."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(labels, Direction.start(rng, hidden), Direction.start(rng, hidden), rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def weights(m: LanguageModel) -> list[np.ndarray]:
        return [m.forward.bytes_in, m.forward.hidden, m.forward.new_bias, m.backward.bytes_in, m.backward.hidden, m.backward.new_bias, m.out, m.bias]

    mean, square = ([np.zeros_like(w) for w in weights(model)] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        bytes_, goal = np.ascontiguousarray(windows[pick].T), target[pick]
        states, kept = {}, {}
        for name, direction, order in (("f", model.forward, bytes_), ("b", model.backward, bytes_[::-1])):
            h = np.zeros((BATCH, hidden), np.float32)
            states[name], kept[name] = [], []
            for byte in order:
                new = direction.step(byte, h)
                kept[name].append((h, *new[1:]))
                h = new[0]
                states[name].append(h)
        both = np.concatenate([np.stack(states["f"]), np.stack(states["b"][::-1])], axis=2)
        score = both @ model.out + model.bias
        score = np.exp(score - score.max(axis=2, keepdims=True))
        p = score / score.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), goal] -= 1
        p /= p.shape[0] * BATCH
        d_both = p @ model.out.T
        f = _backwards(model.forward, bytes_, kept["f"], d_both[:, :, :hidden])
        b = _backwards(model.backward, bytes_[::-1], kept["b"], d_both[::-1, :, hidden:])
        grads = [f.bytes_in, f.hidden, f.new_bias, b.bytes_in, b.hidden, b.new_bias, np.einsum("tbh,tbl->hl", both, p), p.sum(axis=(0, 1))]
        rate = 0.03 * min(1.0, (steps - step + 1) / (0.5 * steps))
        for w, g, m, v in zip(weights(model), grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from the given documents; pass only those that may be seen."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row per language
    if not counts:
        return LanguageModel([])
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    chosen = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20)) < share[F.col(lang_col).cast("string")] * (1 << 20))
    labels = sorted(counts)
    limit = 2 * per_language * len(labels)
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda i: F.substring(text_col, (F.length(text_col) * i / WINDOWS_EACH).cast("int") + 1, F.lit(WINDOW)))
    rng = np.random.default_rng(1)
    windows, target = [], []
    # in an order of the rows' own, so that the same documents give the same network however they lie in files
    order_by = (F.xxhash64(F.col(id_col), F.lit(12)), F.col(id_col), F.col(lang_col).cast("string"), F.xxhash64(text_col))
    for row in chosen.orderBy(*order_by).select(F.col(lang_col).cast("string").alias("lang"), cut.alias("parts")).limit(limit).collect():
        for part in row["parts"]:
            raw = part.encode()[:WINDOW]
            if any(map(str.isalpha, part)):
                windows.append(np.frombuffer((raw * (WINDOW // len(raw) + 1))[:WINDOW], np.uint8))
                target.append(labels.index(row["lang"]))
    if not windows:
        return LanguageModel([])
    order = rng.permutation(len(windows))
    return train(np.stack(windows)[order], np.array(target)[order], labels)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. A map without shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches, 2_000_000):
            names, scores = [UNDETERMINED] * len(values), [0.0] * len(values)
            at = [i for i, v in enumerate(values) if model.labels and any(map(str.isalpha, v))]
            if at:
                p = model.pooled([values[i].encode() for i in at])
                for i, label, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    names[i], scores[i] = model.labels[label], min(1.0, s)
            yield arrow_rows(keys, schema, lang_pred=names, score=scores)

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double")
