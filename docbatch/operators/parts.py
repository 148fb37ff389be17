"""An index of the parts of many targets, for similar keys: of a target that differs by few edits some part stands unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets of one index. A longer list makes several, and the rows are read once for each.
MOST_INDEXED = 100_000


class PartIndex:
    """Targets by their parts.

    A key within ``accept`` of a target's key differs from it by a number of edits that its length bounds. Of one part
    more than edits, one is untouched, and lies at most as many places from where it is in the target. All
    parts of all targets make one automaton, so a text is read once, whatever the number of targets.
    """

    def __init__(self, targets: Iterable[tuple[str, str]], accept: float):
        self.targets = list(targets)
        self.edits = [int((1 - accept) * int(len(key) / accept + 1e-9) + 1e-9) for _, key in self.targets]
        self.always: list[int] = []  # targets so short that a part is empty
        named: dict[str, list[tuple[int, int]]] = {}
        for t, ((_, key), edits) in enumerate(zip(self.targets, self.edits, strict=True)):
            cuts = [j * len(key) // (edits + 1) for j in range(edits + 2)]
            parts = [(key[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if all(p for p, _ in parts):
                for part, at in parts:
                    named.setdefault(part, []).append((t, at))
            else:
                self.always.append(t)
        self.automaton = ahocorasick.Automaton()
        for part, owners in named.items():
            self.automaton.add_word(part, (len(part), owners))
        if named:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(target, start, end, place in the target) of every part that stands in the text."""
        if len(self.automaton):
            for last, (size, owners) in self.automaton.iter(text):
                for target, at in owners:
                    yield target, last + 1 - size, last + 1, at

    def near(self, key: str) -> set[int]:
        """Targets that the whole key may be similar to."""
        found = {t for t, start, _, at in self.hits(key) if abs(start - at) <= self.edits[t]}
        found.update(self.always)
        return found


@lru_cache(maxsize=1)
def _built(name: str, sent, accept: float) -> PartIndex:
    return PartIndex(sent.value, accept)


def sent_index(targets: DataFrame, accept: float) -> Callable[[], PartIndex]:
    """Sends (target, t_key), which are ``MOST_INDEXED`` at most, to every executor; what is returned gives their index in a task."""
    sent = targets.sparkSession.sparkContext.broadcast([(r.target, r.t_key) for r in targets.select("target", "t_key").collect()])
    name = uuid.uuid4().hex
    return lambda: _built(name, sent, accept)


Found = tuple[pa.RecordBatch, list[int]]


def indexed(rows: DataFrame, targets: DataFrame, accept: float, find: Callable[[PartIndex, pa.RecordBatch], Found], shape: str) -> DataFrame:
    """Rows of ``shape`` with target and t_key: what ``find`` gives for each batch, as a batch and its rows' places in the index.

    ``targets`` has (target, t_key). The list goes to every executor, a long one in groups.
    """
    groups = -(-targets.count() // MOST_INDEXED)
    own = F.pmod(F.xxhash64("target", "t_key"), F.lit(max(1, groups)))

    def one(listed: DataFrame) -> DataFrame:
        built = sent_index(listed, accept)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built()
            for batch in batches:
                found, places = find(index, batch)
                chosen = [index.targets[t] for t in places]
                columns = [*found.columns, pa.array([t for t, _ in chosen], pa.string()), pa.array([k for _, k in chosen], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*found.schema.names, "target", "t_key"])

        return rows.mapInArrow(run, f"{shape}, target string, t_key string")

    return reduce(DataFrame.unionByName, (one(targets.filter(own == i) if groups > 1 else targets) for i in range(max(1, groups))))


def near_keys(rows: DataFrame, targets: DataFrame, accept: float) -> DataFrame:
    """``rows``, which have a column ``key``, with each target (target, t_key) that their key may be similar to."""
    at = rows.columns.index("key")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def find(index: PartIndex, batch: pa.RecordBatch) -> Found:
        line, places = [], []
        for i, key in enumerate(batch.column(at).to_pylist()):
            for t in sorted(index.near(key)) if key else ():
                line.append(i), places.append(t)
        return batch.take(pa.array(line, pa.int64())), places

    return indexed(rows, targets, accept, find, shape)
