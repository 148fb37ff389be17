"""Operator 12: spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes one the other, that is, if their common
prefix and their common suffix together reach the longer length minus one. Words are rows of padded code-point
matrices, one aligned to the left and one to the right; tiles of rows are compared by whole arrays, and each pair's
prefix and suffix lengths decide it.

Tiles hold only words that may be near. For a pair whose longer word has M code points, and a step s, one of a few places i
has i code points of prefix and M - s - i of suffix in common, whatever the edit; so words meet by (M, i) and
a hash of these parts. With s about a quarter of M, and 3 at least, that is five places at most for words of any
length. Groups of more than ``MOST`` words are dealt again, each with smaller steps around its place, as long as there are
any; with a step of 1 the words of a group differ in one place, so that the alphabet bounds it, and nothing is cut off.

Words are counted within partitions first, so that a frequent word is a row for each of them; roots are followed
from word to form, at most once for each tenfold of the counts.

Defined results: null and empty texts have no words, as have rows without letters; a null id counts as an empty one
in what decides deletions; repeated rows count again; ties of the form go to the smallest in code-point order; a
word without near words has none of it; an empty table has no words; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import slices, staged
from docbatch.plans.staging import scratch, staged_with

#: Code points a word has at least, occurrences, and how many times more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many words of a document loses a code point.
DROPPED = 31
#: Words of a group that are compared with each other.
MOST = 512
#: Words that a task counts before it hands them on, and cells of the matrices that are compared at once.
HELD, CELLS = 200_000, 4_000_000
#: Words that are sent to every executor in one round of following forms.
SENT_FORMS = 200_000

# The letters of the contract, of which only the first 26 have a lower case here.
LETTERS = r"A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(65, 91)}


def occurring(text: str, doc_id: str, least: int = LEAST_LENGTH, one_in: int = DROPPED) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text's words of at least ``least`` code points, after deletions."""
    runs: Counter[str] = Counter()
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{least},}}", text)).items():
        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    begun = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), begun)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of all texts that occur at least ``least_count`` times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for keys, values in slices(batches):
            for doc_id, text in zip(keys.to_pylist(), values, strict=True):
                for word, n in occurring(text, doc_id, least):
                    held[word] += n
            if len(held) > HELD:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    # the id as text: what a deletion depends on
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))


def _step(length: int) -> int:
    return min(length, max(3, -(-length // 4)))


def _finer(step: int) -> int:
    return 1 if step < 8 else -(-step // 4)


def _places(low: int, span: int, step: int) -> list[int]:
    """Places low, low + step ... low + span."""
    return [*range(low, low + span, step), low + span]


def places(length: int) -> list[int]:
    """Prefix lengths under which words meet as the longer of a pair with ``length`` code points, or as the shorter."""
    step = _step(length)
    return _places(0, length - step, step)


def _part(word: str, longer: int, i: int, step: int) -> int:
    """A hash of the parts that a word shares with its partners."""
    j = longer - step - i
    data = f"{longer}:{i}:{step}:{word[:i]}:{word[len(word) - j :] if j else ''}".encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_POSTED = "part long, longer int, i int, step int, word string, n long"
_POSTED_TYPE = pa.schema([("part", pa.int64()), ("longer", pa.int32()), ("i", pa.int32()), ("step", pa.int32()), ("word", pa.string()), ("n", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _POSTED_TYPE.types, strict=True)], schema=_POSTED_TYPE) if rows else pa.RecordBatch.from_pylist([], _POSTED_TYPE)


def posted(words: DataFrame) -> DataFrame:
    """The parts under which each word of (word, n) meets others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for longer in (len(word), len(word) + 1):
                    step = _step(longer)
                    out += [(_part(word, longer, i, step), longer, i, step, word, n) for i in places(longer)]
            yield _rows(out)

    return words.select("word", "n").mapInArrow(run, _POSTED)


def _finer_posted(large: DataFrame) -> DataFrame:
    """Rows of large groups under finer parts around their places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                step = _finer(r["step"])
                for i in _places(r["i"], r["step"] - step, step):
                    out.append((_part(r["word"], r["longer"], i, step), r["longer"], i, step, r["word"], r["n"]))
            yield _rows(out)

    return large.select(*_POSTED_TYPE.names).mapInArrow(run, _POSTED)


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, padded by 0 on the right or, aligned to the right, on the left."""
    out = np.zeros((len(words), width), dtype=np.uint32)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place + np.repeat(width - lengths, lengths) if right else place] = codes
    return out


def _leading(same: np.ndarray) -> np.ndarray:
    """How many cells are true from the left, along the last axis."""
    return np.where(same.all(axis=-1), same.shape[-1], np.argmin(same, axis=-1))


def near_in_tiles(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) in ``words``, a before b, of pairs that are near, tile by tile."""
    width = max(map(len, words), default=0)
    side = max(1, min(len(words), int((CELLS / max(1, width)) ** 0.5)))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tiles = range(0, len(words), side)
    for a in tiles:
        left, right = (_matrix(words[a : a + side], width, r) for r in (False, True))
        for b in tiles[a // side :]:
            other_left, other_right = (left, right) if a == b else (_matrix(words[b : b + side], width, r) for r in (False, True))
            longer = np.maximum(lengths[a : a + side, None], lengths[None, b : b + side])
            shorter = np.minimum(lengths[a : a + side, None], lengths[None, b : b + side])
            prefix = np.minimum(_leading(left[:, None, :] == other_left[None, :, :]), shorter)
            suffix = np.minimum(_leading((right[:, None, :] == other_right[None, :, :])[:, :, ::-1]), shorter)
            near = (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (prefix < longer)
            if a == b:
                near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])[None, :]
            x, y = np.nonzero(near)
            yield x + a, y + b


def _small_pairs(words: list[str], borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of neighbouring small groups: one matrix for all, rows compared with those at a distance of 1, 2 ... in their group."""
    width = max(map(len, words), default=0)
    left, right = (_matrix(words, width, r) for r in (False, True))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.repeat(borders[1:], np.diff(borders))
    rows = np.arange(len(words))
    for distance in range(1, int(np.diff(borders).max(initial=0))):
        x = rows[rows + distance < ends]
        y = x + distance
        longer, shorter = np.maximum(lengths[x], lengths[y]), np.minimum(lengths[x], lengths[y])
        prefix = np.minimum(_leading(left[x] == left[y]), shorter)
        suffix = np.minimum(_leading((right[x] == right[y])[:, ::-1]), shorter)
        near = (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (prefix < longer)
        yield x[near], y[near]


_PAIR = "word string, n long, near string, near_n long"
_PAIR_TYPE = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
#: Groups of up to so many words are compared together with their neighbours in one matrix.
SMALL = 32


def near_pairs(groups: DataFrame) -> DataFrame:
    """Near words of rows of (part, word, n), both ways; a pair that meets in several groups comes from each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, words, counts in _whole_groups(batches):
            cuts = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
            for a, b, small in _bundles(cuts, words):
                some, some_n = words[a:b], counts[a:b]
                inner = cuts[(cuts >= a) & (cuts <= b)] - a
                for x, y in _small_pairs(some, inner) if small else near_in_tiles(some):
                    if len(x):
                        x, y = np.r_[x, y], np.r_[y, x]
                        own, other = pa.array(some), pa.array(some_n)
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(x)), other.take(pa.array(x)), own.take(pa.array(y)), other.take(pa.array(y))], schema=_PAIR_TYPE)

    return groups.select("part", "word", "n").mapInArrow(run, _PAIR)


def _bundles(cuts: np.ndarray, words: list[str]) -> Iterator[tuple[int, int, bool]]:
    """Ranges of words: runs of small groups, which are bounded by the cells of their matrix, and single larger groups."""
    start, width = int(cuts[0]), 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        longest = max(map(len, words[a:b]))
        if b - a > SMALL:
            if a > start:
                yield start, a, True
            yield a, b, False
            start, width = b, 0
        elif (b - start) * max(width, longest) > CELLS and a > start:
            yield start, a, True
            start, width = a, longest
        else:
            width = max(width, longest)
    if start < int(cuts[-1]):
        yield start, int(cuts[-1]), True


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], list[int]]]:
    """Columns of rows sorted by their part, so that no group is cut between two yields."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[batch.num_rows - 1].as_py()
        own = batch.column(0).to_numpy()
        cut = int(np.searchsorted(own, last, side="left"))
        if cut or (held and held[-1].column(0)[0].as_py() != last):
            yield _columns([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, list[str], list[int]]:
    whole = pa.Table.from_batches([b for b in batches if b.num_rows])
    return whole.column(0).to_numpy(), whole.column(1).to_pylist(), whole.column(2).to_pylist()


def _rounds(words: DataFrame, most: int) -> list[DataFrame]:
    """Near pairs, from each round of parts, staged."""
    found, rows = [], posted(words)
    while True:
        rows = staged(rows, "posted")
        sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.max("step").alias("widest")).filter("size > 1")
        sizes = staged(sizes, "sizes")
        large = F.expr(f"size > {most} AND widest > 1")
        met = rows.join(sizes, "part")
        groups = met.filter(~large).select("part", "word", "n").repartition("part").sortWithinPartitions("part", "word")
        found.append(staged(near_pairs(groups), "near"))
        if not sizes.filter(large).count():
            return found
        rows = _finer_posted(met.filter(large))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n) of every near pair of (word, n), both ways, once."""
    found = _rounds(words, most)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n for words of (word, n)."""
    with scratch(words.sparkSession) as keep:
        words = keep(staged(words, "words"))
        near = near_words(words, most)
        # of the near words the most frequent, of these the smallest in code-point order (as is the order of UTF-8 bytes)
        best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("less"), F.col("near")))
        summed = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        summed = staged(summed, "summed")
        formed = summed.join(words, "word").filter(F.col("best.near_n") >= ratio * F.col("n")).select("word", F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n"))
        forms, seen = staged_with(formed, "forms")
        forms = keep(forms)
        roots = keep(_roots(forms, seen["n"]))
        summed = keep(staged(summed.select("word", "n_near"), "counts"))
    out = words.join(summed, "word", "left").join(forms, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def _roots(forms: DataFrame, n: int) -> DataFrame:
    """(word, root): every word that has a form, followed to the last. Each round doubles the steps that were followed."""
    sent = (lambda df: F.broadcast(df)) if n <= SENT_FORMS else (lambda df: df)
    paths = staged(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer, seen = staged_with(paths.join(sent(onward), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "paths", moved=F.count_if("moved"))
        paths = longer.select("word", "root")
        if not seen["moved"]:
            return paths


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of all texts."""
    return variants(word_counts(docs, id_col, text_col))
