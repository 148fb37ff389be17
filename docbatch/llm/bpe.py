"""Operator 9: byte-level BPE encoding and decoding by length-bucketed padded matrices.

Every distinct pre-token of a run of documents becomes a row of an integer matrix, padded to the width
of its length bucket. In each round every row merges its leftmost pair of minimum rank; pair ranks come
from a hash map over both ids, rows without a mergeable pair leave the matrix, and merged cells are
closed up (compaction). Rows are independent, so a round is a handful of array operations. A pre-token
longer than ``LONG`` bytes would need as many rounds of its whole width as it has merges; it is a row of
its own, whose cells are linked and filed by the rank of their pair, and merges by the same rule.

Defined results: null and empty text give no ids (``n_tokens`` 0, digests of the empty string); the
length of a text is unbounded (runs are cut at document borders, one document is never cut); repeated
rows and ties need no rule, as each row depends on its own text alone; an empty table gives an empty
result; extra columns are not read. Special strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docbatch.llm.common import arrow_rows, slices, texts
from docbatch.llm.pieces import spread
from docbatch.llm.u64map import U64Map

_NONE = np.int64(1) << 40
#: A longer pre-token is a row of its own, of linked cells.
LONG = 512
#: Distinct pre-tokens that a worker remembers between runs.
REMEMBERED = 300_000


class BpeTable:
    """The ranks of a rank file, its pair map and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        #: ids that are part of a pair ranking below them
        self.unsafe: set[int] = set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
                    self.unsafe.update(x for x in (a, b) if x > rank)
        self.pairs = U64Map(missing=int(_NONE))
        self.pairs.put(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int64))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        real = (a >= 0) & (b >= 0)
        keys = np.where(real, (a << 32) | np.where(b >= 0, b, 0), 0).astype(np.uint64)
        return np.where(real, self.pairs.get(keys.ravel()).reshape(keys.shape), _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, each merged on its own."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONG:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, 2_000_000 // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        cells = np.full((len(pieces), width), -1, dtype=np.int64)
        lengths = np.array([len(p) for p in pieces])
        inside = np.arange(width)[None, :] < lengths[:, None]
        cells[inside] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pair_rank(cells[:, :-1], cells[:, 1:])
        alive, out = np.arange(len(pieces)), [[]] * len(pieces)
        while alive.size:
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)  # the leftmost of equal ranks
                best = ranks[np.arange(len(alive)), at]
                ended = best >= _NONE
            else:
                at = best = np.zeros(len(alive), dtype=np.int64)
                ended = np.ones(len(alive), dtype=bool)
            if ended.any():
                rest = cells[ended]
                full = rest >= 0
                flat, ends = rest[full].tolist(), np.cumsum(full.sum(axis=1)).tolist()
                for i, start, end in zip(alive[ended].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[start:end]
                go = ~ended
                alive, cells, ranks, at, best = alive[go], cells[go], ranks[go], at[go], best[go]
                if not alive.size:
                    break
            # compaction: each row drops the right cell of its pair, so the matrix narrows by one column
            n, w = cells.shape
            rows, column = np.arange(n), np.arange(w)[None, :]
            cells[rows, at] = best
            cells = cells[column != (at + 1)[:, None]].reshape(n, w - 1)
            ranks = ranks[column[:, : w - 1] != at[:, None]].reshape(n, w - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            ranks[left, at[left] - 1] = self.pair_rank(cells[left, at[left] - 1], best[left])
            ranks[right, at[right]] = self.pair_rank(best[right], cells[right, at[right] + 1])
        return out

    def _long(self, piece: bytes) -> list[int]:
        """One row on its own, as a row of linked cells whose places are filed by the rank of their pair.

        A round merges the places of the minimum rank from left to right, as long as no merge makes a pair that
        ranks below it. Work follows the merges made, not rounds times length.
        """
        n = len(piece)
        ids = np.append(self.byte_id[np.frombuffer(piece, dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.append(self.pair_rank(ids[: n - 1], ids[1:n]), [_NONE, _NONE])  # of the pair that starts at a cell
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(cells: np.ndarray) -> None:
            found = rank[cells]
            cells, found = cells[found < _NONE], found[found < _NONE]
            if not len(cells):
                return
            order = np.argsort(found, kind="stable")
            cells, found = cells[order], found[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(found)) + 1, len(found)].tolist()
            for r, a, b in zip(found[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(heap, r)
                filed[r].append(cells[a:b])

        file(np.arange(n))
        while heap:
            best = heapq.heappop(heap)
            at = np.unique(np.concatenate(filed.pop(best)))
            at = at[rank[at] == best]
            if not len(at):
                continue
            places = at
            touches = np.r_[False, after[at[:-1]] == at[1:]]  # of touching pairs the first, third, fifth ... merge
            first = np.flatnonzero(~touches)
            at = at[(np.arange(len(at)) - first[np.cumsum(~touches) - 1]) % 2 == 0]
            if best in self.unsafe:  # up to the first merge that makes a pair of lower rank
                left, right = before[at], np.minimum(after[after[at]], n)
                left_id = np.where(left >= 0, ids[left], -1)
                left_id[1:][left[1:] == after[at[:-1]]] = best
                merged = np.full(len(at), best)
                lower = np.flatnonzero(np.minimum(self.pair_rank(left_id, merged), self.pair_rank(merged, ids[right])) < best)
                if len(lower) and lower[0] + 1 < len(at):
                    at = at[: lower[0] + 1]
                    file(places[places > at[-1]])
            gone = after[at]
            ids[at], ids[gone], rank[gone] = best, -1, _NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            changed = np.unique(np.r_[at, left[left >= 0]])
            following = np.minimum(after[changed], n)
            rank[changed] = self.pair_rank(ids[changed], ids[following])
            file(changed)
        return ids[ids >= 0].tolist()


@lru_cache(maxsize=4)
def bpe_table(path: str) -> BpeTable:
    return BpeTable(path)


class Encoder:
    """Encodes runs of texts. Distinct pre-tokens are merged once and remembered between runs, up to ``REMEMBERED``."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe, self.split = bpe_table(path), regex.compile(pattern).findall
        self._forget()
        shown = [b"%d " % i for i in range(len(self.bpe.bytes_of))]
        self.shown = np.array([list(x.ljust(8)) for x in shown], dtype=np.uint8)
        self.shown_n = np.array([len(x) for x in shown])
        self.raw = np.frombuffer(b"".join(self.bpe.bytes_of), dtype=np.uint8)
        self.raw_n = np.array([len(x) for x in self.bpe.bytes_of])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        pieces = [self.split(v) for v in values]
        words = [w for p in pieces for w in p]
        here = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(self.row) > REMEMBERED:
            self._forget()
        new = [w for w in here if w not in self.row]
        if new:
            got = self.bpe.encode_pieces([w.encode() for w in new])
            n = np.fromiter(map(len, got), np.int64, len(got))
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.at = np.r_[self.at, len(self.ids) + np.cumsum(n) - n]
            self.n = np.r_[self.n, n]
            self.ids = np.r_[self.ids, np.array([i for ids in got for i in ids], dtype=np.int64)]
        rows = np.fromiter(map(self.row.__getitem__, here), np.int64, len(here))
        rows = rows[np.fromiter(map(here.__getitem__, words), np.int64, len(words))]
        lengths = self.n[rows]
        of_text = np.r_[0, np.cumsum(lengths)][np.cumsum([0, *map(len, pieces)])]
        return self.ids[spread(self.at[rows], lengths)], np.diff(of_text)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Per text its ids as decimals, joined by one space."""
        n = self.shown_n[ids]
        flat = self.shown[ids][np.arange(8)[None, :] < n[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Per text the bytes of its ids."""
        n = self.raw_n[ids]
        flat = self.raw[spread(self.raw_at[ids], n)].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


#: Characters of a run; long enough for wide matrices, short enough for the processor's caches.
RUN = 1_000_000


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; one row per row of ``docs`` with digests of the ids and of the decoded bytes.

    A map without shuffle: the rank file is read from ``path`` once per worker.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for keys, values in slices(batches, RUN):
            ids, counts = own.encode(values)
            yield arrow_rows(
                keys,
                schema,
                n_tokens=counts,
                ids_sha256=[hashlib.sha256(x).hexdigest() for x in own.decimals(ids, counts)],
                decoded_sha256=[hashlib.sha256(x).hexdigest() for x in own.decode(ids, counts)],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves, as an array per row."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for keys, values in slices(batches, RUN):
            ids, counts = own.encode(values)
            yield arrow_rows(keys, schema, ids=np.split(ids.astype(np.int32), np.cumsum(counts)[:-1]))

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of an array of ids (null: empty)."""
    schema = pa.schema([(id_col, pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe_table(path).bytes_of
        for batch in batches:
            yield arrow_rows(batch.column(0), schema, decoded=[b"".join(table[i] for i in x or []) for x in batch.column(1).to_pylist()])

    return rows.select(id_col, ids_col).mapInArrow(run, f"{id_col} long, decoded binary")
