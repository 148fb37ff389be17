"""Operator 13: benchmark decontamination by a generalised suffix automaton.

The items' words go into one suffix automaton, whose states know the windows (``width`` consecutive item words, or
a whole shorter item) that end in them. The words of each text are streamed through it: the state and the longest
matching length change with every word, and where the length reaches that of a window, the window has occurred.
Adjoining windows make a span. ``leaks`` reports spans and items; ``without_leaks`` removes spans longer than a
limit and rows of which too large a part is hit.

Only words that can be part of a window are streamed: the pairs of neighbouring words of a text are compared with
the items' pairs by hash, and a stretch with too few common pairs in a row for the shortest window is passed over. Words
of the others are compared by their bytes, so that a hash decides nothing. It is a map over the documents without
shuffle, whatever key holds however many rows.

The items are sent to the executors. Their size is measured first: beyond ``sent`` bytes they are dealt into groups
of that size, the documents are read once for each, and what was found is joined by row.

Defined results: null and empty texts have no words, and items without words occur nowhere; texts of any length are
read whole; rows that share an item id are one item, and items without id count as hits but have no name; repeated
documents each have their own row; empty tables give no hits or no rows; extra columns are not read, or passed
through by ``without_leaks``, of any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import slices, staged
from docbatch.llm.pieces import hashes, mixed

WIDTH = 10
#: Bytes of item texts that are sent, and compiled in a worker, at once.
SENT = 2_000_000
#: Words that are hashed at once.
AT_ONCE = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# fixed values: digits, lower-case letters and every character beyond ASCII are parts of words
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

_FILTER_BITS = 20


class Words(NamedTuple):
    """The words of a run of bytes: where they start and end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __getitem__(self, i):
        return self.raw[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self, longest: int) -> np.ndarray:
        """A hash of each word; 0 for those of more than ``longest`` bytes."""
        lengths = self.ends - self.starts
        out = np.zeros(len(lengths), dtype=np.uint64)
        short = np.flatnonzero(lengths <= longest)
        for a in range(0, len(short), AT_ONCE):
            some = short[a : a + AT_ONCE]
            out[some] = hashes(self.raw, self.starts[some], lengths[some])
        return out


def words_of(data: bytes) -> Words:
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, _IN_WORD[raw], False].astype(np.int8)))
    return Words(raw, edges[::2], edges[1::2])


class Hits(NamedTuple):
    """What occurs in one text: merged spans as places of words and of bytes, and the ids of items."""

    n_words: int
    spans: list[tuple[int, int]]
    places: list[tuple[int, int]]
    items: set[int]

    @property
    def n_hit(self) -> int:
        return sum(b - a for a, b in self.spans)


class SuffixAutomaton:
    """All substrings of all items, each state with the windows that are suffixes of its strings."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], width: int):
        self.width = width
        self.moves: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extended(last, word)
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window = [0] * n  # of a state's strings, the state of their last ``width`` words
        for s in order:
            if self.length[s] >= width:
                self.window[s] = s if self.length[self.link[s]] < width else self.window[self.link[s]]
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, set[int]]]] = {}
        for item, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.moves[state][word]
                while self.length[self.link[state]] >= width:
                    state = self.link[state]
                if at + 1 >= width:
                    self._owned(self.owners.setdefault(state, set()), item)
            if words and len(words) < width:
                sizes = dict(self.whole.get(state, ()))
                self._owned(sizes.setdefault(len(words), set()), item)
                self.whole[state] = sorted(sizes.items())
        self.nearest = [0] * n  # the state, or the first above it, at which a whole short item ends; 0: none
        for s in order:
            self.nearest[s] = s if s in self.whole else self.nearest[self.link[s]]

    @staticmethod
    def _owned(items: set[int], item: int | None) -> None:
        if item is not None:
            items.add(item)

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length), self.link.append(link), self.moves.append(moves)
        return len(self.link) - 1

    def _extended(self, last: int, word: bytes) -> int:
        """The state of the strings of ``last`` with one more word."""
        known = self.moves[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        new = -1 if known is not None else self._state(self.length[last] + 1, 0, {})
        at = last
        while new >= 0 and at >= 0 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.link[at]
        if at < 0:
            return new
        old = self.moves[at][word]
        if self.length[old] != self.length[at] + 1:
            part = self._state(self.length[at] + 1, self.link[old], dict(self.moves[old]))
            self.link[old] = part
            while at >= 0 and self.moves[at].get(word) == old:
                self.moves[at][word] = part
                at = self.link[at]
            old = part
        if new < 0:
            return old
        self.link[new] = old
        return new

    def stream(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, length, items) of each window that ends after word number ``end``."""
        state = length = 0
        moves, link, lengths = self.moves, self.link, self.length
        for end, word in enumerate(words, 1):
            while state and word not in moves[state]:
                state = link[state]
                length = lengths[state]
            if word not in moves[state]:
                continue
            state, length = moves[state][word], length + 1
            if length >= self.width:
                yield end, self.width, self.owners[self.window[state]]
            above = self.nearest[state]
            while above:
                for size, items in self.whole[above]:
                    if size <= length:
                        yield end, size, items
                above = self.nearest[link[above]]


class Scanner:
    """Finds the windows of items in runs of texts."""

    def __init__(self, items: list[tuple[int | None, str]], width: int = WIDTH):
        split = [(item, (w := words_of(text.encode())), w.hashes(1 << 62)) for item, text in items]
        self.automaton = SuffixAutomaton([(item, [w[i] for i in range(len(w.starts))]) for item, w, _ in split], width)
        self.longest = max((int((w.ends - w.starts).max(initial=0)) for _, w, _ in split), default=0)
        self.least = min([len(h) for _, _, h in split if len(h)] + [width])
        self.pairs = self._filter([self._paired(h) for _, _, h in split])
        self.singles = self._filter([h for _, _, h in split if len(h) == 1])

    @staticmethod
    def _paired(hashed: np.ndarray) -> np.ndarray:
        return mixed(hashed[:-1] * np.uint64(3) + hashed[1:])

    @staticmethod
    def _filter(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))
        marks = np.zeros(1 << _FILTER_BITS, dtype=bool)
        marks[(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return values, marks

    @staticmethod
    def _among(hashed: np.ndarray, kept: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        values, marks = kept
        out = marks[(hashed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        some = np.flatnonzero(out)
        if some.size:
            at = np.minimum(np.searchsorted(values, hashed[some]), len(values) - 1)
            out[some] = values[at] == hashed[some]
        return out

    def stretches(self, words: Words, borders: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words that share enough pairs in a row with the items; none goes over one of ``borders``."""
        hashed = words.hashes(self.longest)
        joined = np.zeros(len(hashed) + 1, dtype=bool)  # at i: word i goes on from the one before
        if len(hashed) > 1:
            joined[1:-1] = self._among(self._paired(hashed), self.pairs)
        joined[borders] = False
        edges = np.flatnonzero(np.diff(np.r_[False, joined, False].astype(np.int8)))
        starts, ends = edges[::2] - 1, edges[1::2]
        long = ends - starts >= self.least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        if len(self.singles[0]):
            alone = self._among(hashed, self.singles) & ~joined[:-1] & ~joined[1:]
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def scan(self, values: list[str]) -> list[Hits]:
        data = [v.encode() for v in values]
        words = words_of(b"\n".join(data))
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
        offsets = np.r_[0, np.cumsum(sizes)]
        first = np.searchsorted(words.starts, offsets)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for a, b in self.stretches(words, first):
            for end, length, items in self.automaton.stream(words[i] for i in range(a, b)):
                spans, names = found.setdefault(int(np.searchsorted(first, a, side="right")) - 1, ([], set()))
                spans.append((a + end - length, a + end))
                names |= items
        out = []
        for k in range(len(values)):
            spans, names = found.get(k, ((), set()))
            merged: list[tuple[int, int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            places = [(int(words.starts[a] - offsets[k]), int(words.ends[b - 1] - offsets[k])) for a, b in merged]
            out.append(Hits(int(first[k + 1] - first[k]), [(a - int(first[k]), b - int(first[k])) for a, b in merged], places, names))
        return out


@lru_cache(maxsize=1)
def _compiled(name: str, sent, width: int) -> Scanner:
    """The scanner of a group of items, built once in each worker."""
    return Scanner(sent.value, width)


_FOUND = "row long, n_words long, spans array<struct<a: long, b: long, start: long, end: long>>, items array<long>"
_FOUND_TYPE = pa.schema(
    [
        ("row", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.int64())),
    ]
)


def _hits(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``_FOUND`` for rows of (row, text) and one group of items (item, text)."""
    sent = rows.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in items.distinct().collect()])
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _compiled(name, sent, width)
        for keys, values in slices(batches, 1_000_000):
            found = scanner.scan(values)
            spans = [[{"a": a, "b": b, "start": s, "end": e} for (a, b), (s, e) in zip(h.spans, h.places, strict=True)] for h in found]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([h.n_words for h in found], pa.int64()), pa.array(spans, _FOUND_TYPE.field("spans").type), pa.array([sorted(h.items) for h in found], pa.list_(pa.int64()))],
                schema=_FOUND_TYPE,
            )

    return rows.select("row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _FOUND)


def _groups(benchmark: DataFrame, item_col: str, text_col: str, sent: int) -> list[DataFrame]:
    """The items with words, in groups of about ``sent`` bytes at most."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-int(size) // sent)
    if n <= 1:
        return [items]
    n *= 2  # a group may get more than its share
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _found(rows: DataFrame, groups: list[DataFrame], width: int) -> DataFrame:
    """``_FOUND`` over all groups of items; spans of several groups may overlap."""
    if len(groups) == 1:
        return _hits(rows, groups[0], width)
    every = reduce(DataFrame.unionByName, (_hits(rows, g, width) for g in groups))
    some = every.groupBy("row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return some


def _merged(spans: F.Column) -> F.Column:
    """Overlapping and adjoining spans as one, in order."""
    kind = "array<struct<a: bigint, b: bigint, start: bigint, end: bigint>>"

    def step(done, s):
        last = F.element_at(done, -1)
        wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (s["a"] <= F.get(done, F.size(done) - 1)["b"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {kind})"), step)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, sent: int = SENT) -> DataFrame:
    """For every row its id, n_words, n_hit, spans (places of words ``a`` to ``b`` and of UTF-8 bytes ``start`` to ``end``) and sorted ids of items."""
    groups = _groups(benchmark, item_col, item_text_col, sent)
    if len(groups) == 1:
        found = _hits(docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text")), groups[0], width).withColumnRenamed("row", id_col)
    else:
        numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("own id"), F.col(text_col).alias("text")), "numbered")
        found = _found(numbered, groups, width).join(numbered.select("row", F.col("own id").alias(id_col)), "row")
        found = found.withColumn("spans", _merged(F.col("spans"))).withColumn("items", F.array_sort("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), "spans", "items")


def item_digest(items: F.Column) -> F.Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)


def without_leaks(docs: DataFrame, benchmark: DataFrame, longest: int = 0, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, sent: int = SENT) -> DataFrame:
    """``docs`` without rows of which more than ``coverage`` of the words are hit; in the others spans of more than ``longest`` words are cut out.

    All columns stay as they are but the text. One pass over the rows for each group of items, without shuffle.
    """
    spark, out = docs.sparkSession, docs
    numbered = [spark.sparkContext.broadcast([(r.item, r.text) for r in g.distinct().collect()]) for g in _groups(benchmark, item_col, item_text_col, sent)]
    name = uuid.uuid4().hex

    @F.pandas_udf("struct<kept: boolean, text: string>")
    def cleaned(values):
        import pandas as pd

        kept, texts = [], []
        for a in range(0, len(values), 64):
            some = values.iloc[a : a + 64].tolist()
            found = [_compiled(f"{name}-{i}", part, width).scan([v or "" for v in some]) for i, part in enumerate(numbered)]
            for v, *parts in zip(some, *found, strict=True):
                hits = _united(parts)
                kept.append(hits.n_hit <= coverage * hits.n_words)
                texts.append(v if not hits.spans else _cut(v, [p for p, (x, y) in zip(hits.places, hits.spans, strict=True) if y - x > longest]))
        return pd.DataFrame({"kept": kept, "text": texts})

    verdict = "_verdict"
    while verdict in map(str.lower, docs.columns):
        verdict += "_"
    out = docs.withColumn(verdict, cleaned(F.col(text_col)))
    return out.filter(F.col(verdict)["kept"]).select(*(F.col(verdict)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def _united(parts: tuple[Hits, ...]) -> Hits:
    """The hits of several groups of items in one text."""
    if len(parts) == 1:
        return parts[0]
    merged: list[tuple[tuple[int, int], tuple[int, int]]] = []
    for span, place in sorted((s, p) for h in parts for s, p in zip(h.spans, h.places, strict=True)):
        if merged and span[0] <= merged[-1][0][1]:
            (a, b), (start, end) = merged[-1]
            merged[-1] = (a, max(b, span[1])), (start, max(end, place[1]))
        else:
            merged.append((span, place))
    return Hits(parts[0].n_words, [s for s, _ in merged], [p for _, p in merged], set().union(*(h.items for h in parts)))


def _cut(text: str, places: list[tuple[int, int]]) -> str:
    data, out, at = text.encode(), [], 0
    for start, end in places:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]).decode()


def sha256_of(ids: Iterable[int]) -> str:
    """The digest of ``item_digest`` for plain values."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
