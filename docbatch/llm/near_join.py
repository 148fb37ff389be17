"""Operator 8: n-gram Jaccard join with signature trees.

Two documents link when their sets of word shingles have a Jaccard similarity of at least 0.8; the
result gives each document its set size and the smallest document reachable by links. The join is exact.

1. One pass over the documents makes each set's identity (128 bits of hash over the whole set; copies
   share it), its size and an OR-combined token bitmap, and counts shingles in a sketch of fixed size.
   Shingles are ordered by the rank of their counter, rare ones first; any order gives the same links.
2. Of n shingles the first n - ceil(0.8 n) + 1 in that order are posted: two linked sets share at least
   one of them. Postings meet by hash range; shingles posted by one set alone vanish there, and groups
   with equal members are kept once. A group is what the trees join, so no set meets all others.
3. Signature trees join each group. Nodes hold OR-combined bitmaps, size ranges and component ranges; the
   dual traversal drops node pairs whose sizes cannot match, whose greatest possible overlap is too small,
   or that lie in one component already. Groups larger than ``BLOCK`` are split, and each pair of blocks is
   a unit of its own: first each block with itself, then the first block with the others, last all pairs
   of blocks that are not yet in one component.
4. Of the pairs that survive, each set first has the one with its smallest partner verified on the whole
   sets, so that a family of copies falls into one component without all its pairs.
5. The trees then run again over the groups that still span several components. The sets in pairs that
   survive this are joined by trees over their whole sets, where every surviving pair is verified unless
   a link has joined its components before. All links come from pairs that a traversal left.

Whole sets are made again from the texts of just the documents that are asked for, and are sent once to each
unit that needs them. Keys with many rows (sets with many copies, large components) go to the rows.

Defined results: null and empty text and text without words have size 0 and link with nothing; fewer
words than five make one shingle; copies of a set need no pairs, as they share its identity; a null id
gets the component of its text if that has another id; texts of any length are whole; an empty table
gives an empty result; extra columns are not read, or passed through by ``drop_near_copies``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import identified, join_counted, slices, staged, texts, unused
from docbatch.llm.pieces import mixed
from docbatch.llm.shingles import shingle_sets
from docbatch.operators.components import connected_components
from docbatch.plans.staging import scratch, staged_with

COUNTERS = 1 << 20
SLICES = 64
#: Postings of a hash range, about; a range with many times more holds a shingle that very many sets post.
RANGE_POSTINGS = 250_000
HOT_RANGE = 32
#: Characters of a run of texts, and postings that a task holds.
RUN_CHARS, RUN_POSTINGS = 500_000, 500_000
#: Sets of a block of a large group.
BLOCK = 1024
FANOUT = 8
#: Rows that a task takes at once, about.
TASK_ROWS, TASK_SETS = 20_000, 2_000
#: Up to so many ids are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets whose 64-bit names clash with another set's; 64 bits make a few hundred of them among 10**11 sets.
CLASHES = 10_000


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection with 100 * intersection >= 80 * union: ceil(80 * (a + b) / 180)."""
    return -(-80 * (a + b) // 180)


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits at the low end of each hash; at least twice as many bits as shingles, a power of two from 64."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    marks = np.zeros(bits, dtype=bool)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller power of two: halves are OR-combined."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def identity(hashes: np.ndarray, clashing: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set, (0, 0) for the empty one. The first is its name, or the second if the first clashes."""
    if not len(hashes):
        return 0, 0
    n = np.uint64(len(hashes))
    name = np.bitwise_xor.reduce(mixed(hashes + np.uint64(1))) ^ n
    check = mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + n
    name, check = mixed(np.array([name, check])).view(np.int64).tolist()
    return (check if name in clashing else name), check


def sketches(docs: DataFrame) -> DataFrame:
    """Per document (id, key, set, check, n, bits); and per partition the slices of its shingle counters (slice, counts)."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("set", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.uint32)
        for keys, values in slices(batches, RUN_CHARS):
            sets = shingle_sets(values)
            n = len(sets)
            counters += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            name, check = zip(*map(identity, sets), strict=True)
            data = [keys.field("id"), keys.field("key"), pa.array(name, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(data, schema=schema)
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counters, SLICES)]
        data = [pa.nulls(SLICES, pa.int64())] * 5 + [pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(data, schema=schema)

    return docs.select(F.struct("id", "key").alias("at"), "text").mapInArrow(run, "id long, key long, set long, check long, n long, bits binary, slice int, counts binary")


def counter_ranks(rows: DataFrame) -> tuple[bytes, int]:
    """A 16-bit number per counter, its place among all counters by what it counted, and the largest count. Its size is fixed."""

    def total(table: pa.Table) -> pa.Table:
        sums = sum((np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist()), np.zeros(COUNTERS // SLICES, np.uint64))
        return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = rows.filter("counts is not null").select("slice", "counts").groupBy("slice").applyInArrow(total, "slice int, sums binary").collect()
    if not parts:
        return bytes(2 * COUNTERS), 0
    sums = np.concatenate([np.frombuffer(p.sums, np.uint64) for p in sorted(parts, key=lambda p: p.slice)])
    return (np.searchsorted(np.sort(sums), sums) * 65536 // COUNTERS).astype(np.uint16).tobytes(), int(sums.max())


def postings(docs: DataFrame, ranks: bytes, bits: int, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(range, shingles, sets): the posted shingles of a run of documents in one hash range, as parallel arrays.

    Of a shingle's hash the range has ``bits`` bits and ``shingles`` the 32 after them. Two shingles that share these
    meet in one group, which costs a comparison and changes nothing, since links are verified on whole sets.
    """
    schema = pa.schema([("range", pa.int64()), ("shingles", pa.binary()), ("sets", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks, np.uint16)
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            h = np.concatenate(list(held.values())) if held else np.empty(0, np.uint64)
            s = np.repeat(np.array(list(held), dtype=np.int64), [len(x) for x in held.values()])
            at = mixed(h)  # posted shingles lie unevenly, so ranges are cut on another hash
            block = (at >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            order = np.argsort(block, kind="stable")
            h, s, block = ((at << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)[order], s[order], block[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.array([0])
            ends = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in ends], pa.int64()), pa.array([h[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([s[a:b].tobytes() for a, b in ends], pa.binary())], schema=schema)

        size = 0
        for _, values in slices(batches, RUN_CHARS):
            for s in shingle_sets(values):
                if len(s):
                    n = len(s) - (-(-80 * len(s) // 100)) + 1
                    first = s[np.lexsort((s, rank[(s >> np.uint64(44)).astype(np.int64)]))[:n]]
                    held[identity(s, clashing)[0]] = first
                    size += n
            if size > RUN_POSTINGS:
                yield flush()
                size = 0
        yield flush()

    return docs.select("id", "text").mapInArrow(run, "range long, shingles binary, sets binary")


def shared_groups(posted: DataFrame, most: int) -> DataFrame:
    """(grp, set): sets that posted one shingle, for shingles that several sets posted; equal groups once.

    ``most`` is a bound of the sets that hold one shingle. Only where it is large are the ranges' sizes counted, for
    which the postings are made once more; they are shuffled once, and never written elsewhere.
    """
    schema = pa.schema([("shingle", pa.int64()), ("set", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()])
        s = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("sets").to_pylist()])
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.empty(0, bool)
        h, s = h[keep], s[keep]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(h)])
        key = np.zeros(0, np.uint64)
        if len(first):
            key = mixed(np.add.reduceat(mixed(s.view(np.uint64)), first) + size.astype(np.uint64))
        one = np.unique(key, return_index=True)[1]
        one = one[size[one] > 1]
        mine = np.repeat(one, size[one])
        at = np.arange(len(mine)) - np.repeat(np.cumsum(size[one]) - size[one], size[one]) + first[mine]
        return pa.table({"grp": pa.array(key[mine].view(np.int64), pa.int64()), "set": pa.array(s[at], pa.int64())})

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, h, s in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                shingle = np.frombuffer(h.as_py(), np.uint32).astype(np.int64) | r.as_py() << 32
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.frombuffer(s.as_py(), np.int64))], schema=schema)

    if most <= HOT_RANGE * RANGE_POSTINGS:
        return posted.groupBy("range").applyInArrow(meet, "grp long, set long").distinct()
    loads = posted.groupBy("range").agg((F.sum(F.octet_length("shingles")) / 4).alias("n"))
    hot, seen = staged_with(loads.filter(F.col("n") > HOT_RANGE * RANGE_POSTINGS).select("range"), "hot-ranges")
    if not seen["n"]:
        return posted.groupBy("range").applyInArrow(meet, "grp long, set long").distinct()
    usual = posted.join(F.broadcast(hot), "range", "left_anti").groupBy("range").applyInArrow(meet, "grp long, set long")
    # what one task should not hold meets row by row, and a shingle is its group's name
    rows, seen = staged_with(posted.join(F.broadcast(hot), "range").select("range", "shingles", "sets").mapInArrow(flat, "shingle long, set long").distinct(), "hot-postings")
    often = staged(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "hot-shingles")
    return usual.unionByName(join_counted(rows, often, "shingle", "m", seen["n"]).select(F.col("shingle").alias("grp"), "set")).distinct()


class SignatureTree:
    """Nodes over sets sorted by size: OR-combined bitmaps of one width, size range, greatest excess of size over bits, and component range."""

    def __init__(self, sets: np.ndarray, n: np.ndarray, words: np.ndarray, component: np.ndarray):
        order = np.argsort(n, kind="stable")
        self.sets, n, words, component = sets[order], n[order], words[order], component[order]
        excess = n - np.bitwise_count(words).sum(axis=1).astype(np.int64)
        self.levels = [(words, n, n, excess, component, component)]
        while len(self.levels[-1][0]) > 1:
            w, low, high, excess, c_low, c_high = self.levels[-1]
            at = np.arange(0, len(w), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(w, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.minimum.reduceat(c_low, at), np.maximum.reduceat(c_high, at)))


class Forest:
    """The sets of a block, a tree for each width of bitmap. Sets that can link differ by at most one doubling of the width."""

    def __init__(self, sets: np.ndarray, n: np.ndarray, bits: list[bytes], component: np.ndarray):
        self.sets, self.n, self.bits, self.component = sets, n, bits, component
        self.width = np.array([len(b) // 8 for b in bits])
        self.trees: dict[tuple[int, int], SignatureTree] = {}

    def tree(self, own: int, width: int) -> SignatureTree:
        """The tree of the bitmaps ``own`` words wide, folded to ``width`` words."""
        found = self.trees.get((own, width))
        if found is None:
            at = np.flatnonzero(self.width == own)
            words = folded(np.stack([np.frombuffer(self.bits[k], np.uint64) for k in at]), width)
            found = self.trees[own, width] = SignatureTree(self.sets[at], self.n[at], words, self.component[at])
        return found


def forest_pairs(x: Forest, y: Forest) -> list[np.ndarray]:
    """Pairs of sets of two blocks, or of one block with itself, that no bound excludes."""
    found = []
    for a in np.unique(x.width).tolist():
        for b in np.unique(y.width).tolist():
            if max(a, b) <= 2 * min(a, b) and not (x is y and a > b):
                width = min(a, b)
                found.append(np.stack(tree_pairs(x.tree(a, width), y.tree(b, width), x is y and a == b), axis=1))
    return found


def tree_pairs(x: SignatureTree, y: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that no bound excludes, by dual traversal from the roots."""
    depth = max(len(x.levels), len(y.levels))
    i = j = np.zeros(1, dtype=np.int64)
    for level in range(depth - 1, -1, -1):
        a, b = x.levels[min(level, len(x.levels) - 1)], y.levels[min(level, len(y.levels) - 1)]
        kept_i, kept_j = [], []
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            ok = (100 * a[2][p] >= 80 * b[1][q]) & (100 * b[2][q] >= 80 * a[1][p])
            ok &= ~((a[4][p] == a[5][p]) & (b[4][q] == b[5][q]) & (a[4][p] == b[4][q]))
            p, q = p[ok], q[ok]
            both = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1).astype(np.int64)
            ok = both + np.minimum(a[3][p], b[3][q]) >= needed(a[1][p], b[1][q])
            p, q = p[ok], q[ok]
            kept_i.append(p)
            kept_j.append(q)
        i, j = np.concatenate(kept_i), np.concatenate(kept_j)
        if not len(i):
            break
        if level:
            below_a = level <= len(x.levels) - 1
            below_b = level <= len(y.levels) - 1
            step = np.arange(FANOUT)
            n_a = len(x.levels[min(level - 1, len(x.levels) - 1)][0])
            n_b = len(y.levels[min(level - 1, len(y.levels) - 1)][0])
            ii = (i[:, None] * FANOUT + step) if below_a else i[:, None]
            jj = (j[:, None] * FANOUT + step) if below_b else j[:, None]
            pairs_i = np.repeat(ii, jj.shape[1], axis=1).ravel()
            pairs_j = np.tile(jj, (1, ii.shape[1])).ravel()
            ok = (pairs_i < n_a) & (pairs_j < n_b)
            if same:
                ok &= pairs_i <= pairs_j
            i, j = pairs_i[ok], pairs_j[ok]
    if same:
        i, j = i[i < j], j[i < j]
    return x.sets[i], y.sets[j]


UNIT = ("grp", "left", "right")


def _units(table: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each pair of blocks, in a table sorted by ``UNIT``."""
    if table.num_rows:
        key = np.stack([table.column(c).to_numpy() for c in UNIT], axis=1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)].tolist()
        yield from (np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Adds ``unit``, which deals out pairs of blocks, so that a task takes many small ones at once."""
    return rows.withColumn("unit", F.pmod(F.xxhash64(*UNIT), F.lit(parts)))


def blocked(groups: DataFrame, total: int) -> tuple[DataFrame, bool]:
    """``groups`` with ``blocks``, the number of blocks of the group, and ``block``, the row's; and whether any group has several."""
    large, seen = staged_with(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK), "large-groups")
    if not seen["n"]:
        return groups.withColumn("blocks", F.lit(1)).withColumn("block", F.lit(0)), False
    rows = join_counted(groups, large, "grp", "m", total, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")).drop("m")
    return staged(rows.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")), "blocks"), True


def _pair(other: F.Column) -> list[F.Column]:
    return [F.least("block", other).alias("left"), F.greatest("block", other).alias("right")]


def same_block(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("block").alias("left"), F.col("block").alias("right"))


def first_block(rows: DataFrame) -> DataFrame:
    """The first block with each other one."""
    others = F.when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.filter("blocks > 1").withColumn("other", F.explode(others))
    return rows.select(*(c for c in rows.columns if c != "other"), *_pair(F.col("other")))


def open_blocks(rows: DataFrame, large: bool) -> DataFrame:
    """All pairs of blocks but those of two blocks that lie in one component together; ``large``: whether a group has several."""
    if not large:
        return same_block(rows)
    small = same_block(rows.filter("blocks = 1"))
    several = rows.filter("blocks > 1")
    spans = staged(several.groupBy("grp", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")), "block-spans")
    pairs = several.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(spans, ["grp", "block"])
    pairs = pairs.join(spans.toDF("grp", "other", "o_low", "o_high"), ["grp", "other"]).filter("low <> high or o_low <> o_high or low <> o_low")
    return small.unionByName(pairs.select(*rows.columns, *_pair(F.col("other"))))


def _survivors(table: pa.Table, own: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``table`` of the sets of one unit that the traversal leaves; ``bits`` are the bitmaps of the unit's rows."""
    block, n, component = (table.column(c).to_numpy()[own] for c in ("block", "n", "component"))
    left, right = table.column("left")[int(own[0])].as_py(), table.column("right")[int(own[0])].as_py()
    none = np.empty(0, np.int64)
    if len(own) <= FANOUT:  # a tree of one node above its leaves
        found = [(i, j) for i in range(len(own)) for j in range(i) if (left == right or block[i] != block[j]) and component[i] != component[j] and _fits(int(n[i]), bits[i], int(n[j]), bits[j])]
        return (own[[i for i, _ in found]], own[[j for _, j in found]]) if found else (none, none)

    def forest(at: np.ndarray) -> Forest:
        return Forest(own[at], n[at], [bits[k] for k in at.tolist()], component[at])

    first = block == left
    if left != right and (first.all() or not first.any()):
        return none, none
    x = forest(np.flatnonzero(first))
    found = [p for p in forest_pairs(x, x if left == right else forest(np.flatnonzero(~first))) if len(p)]
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _fits(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sizes and bitmaps allow the overlap that a link of two sets needs."""
    if 100 * min(n, m) < 80 * max(n, m):
        return False
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    for _ in range(len(x).bit_length() - (bits // 8).bit_length()):  # at most one, as sets that can link differ little in size
        a = (a >> bits) | (a & ((1 << bits) - 1))
    for _ in range(len(y).bit_length() - (bits // 8).bit_length()):
        b = (b >> bits) | (b & ((1 << bits) - 1))
    return (a & b).bit_count() + min(n - a.bit_count(), m - b.bit_count()) >= -(-80 * (n + m) // 180)


def tree_join(rows: DataFrame, sets: DataFrame, parts: int, label: str) -> DataFrame:
    """(set, partner, grp): the sets of pairs of two components that the trees leave, each with its smallest partner in the unit.

    ``rows`` has (grp, left, right, block, set, component), ``sets`` has (set, n, bits). A row comes out for a row
    that goes in, at most, so large groups of similar sets cost no pairs here.
    """
    rows = _dealt(rows.select(*UNIT, "block", "set", "component").join(sets, "set"), parts)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in UNIT])
        bits, names, kept = table.column("bits"), table.column("set").to_numpy(), []
        for own in _units(table):
            i, j = _survivors(table, own, [bits[int(k)].as_py() for k in own])
            i, j = np.r_[i, j], np.r_[j, i]
            order = np.lexsort((names[j], i))
            kept.append(np.stack([i[order], j[order]], axis=1)[np.unique(i[order], return_index=True)[1]])
        at = np.concatenate(kept) if kept else np.empty((0, 2), np.int64)
        return pa.table({"set": pa.array(names[at[:, 0]]), "partner": pa.array(names[at[:, 1]]), "grp": table.column("grp").take(pa.array(at[:, 0]))})

    return staged(rows.groupBy("unit").applyInArrow(join, "set long, partner long, grp long").distinct(), label)


def delivered(asked: DataFrame, docs: DataFrame, ids: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """The rows of ``asked`` (set, and columns of UNIT, block, component) with the whole sets (n, shingles), made again from a text of each."""
    to = F.struct(*(c for c in asked.columns if c != "set"))
    wanted, seen = staged_with(asked.groupBy("set").agg(F.collect_list(to).alias("to")).join(ids, "set"), "wanted", places=F.sum(F.size("to")))
    if seen["n"] + (seen["places"] or 0) <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    inner = wanted.schema["to"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for keys, values in slices(batches, RUN_CHARS):
            sets, names, keep = shingle_sets(values), keys.field("set").to_pylist(), []
            for k, s in enumerate(sets):
                if names[k] not in seen and identity(s, clashing)[0] == names[k]:
                    keep.append(k)
                    seen.add(names[k])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.field("set").take(at), keys.field("to").take(at), pa.array([len(sets[k]) for k in keep], pa.int64()), pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=["set", "to", "n", "shingles"])

    # ids may be null or repeated, so the text must be the one that the set was made of, too
    own = docs.select(F.col("id").alias("doc"), F.col("key").alias("own"), "text").join(wanted, F.col("doc").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")))
    own = own.select(F.struct("set", "to").alias("key"), "text").mapInArrow(run, f"set long, to {inner}, n long, shingles binary")
    return own.select("set", "n", "shingles", F.explode("to").alias("at")).select("set", "n", "shingles", "at.*")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, clashing: frozenset[int], parts: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that link, by their whole sets, and their number. Many pairs of one a are split up, and its set goes to each part."""
    pairs, seen = staged_with(pairs.distinct(), "pairs")
    counts = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "leaders").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    many = counts.filter("parts > 1").select("a", "m", "parts")
    left = join_counted(pairs, many, "a", "m", seen["n"], "left")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    asked = left.select(F.col("b").alias("set"), F.col("a").alias("grp"), part.alias("left"))
    asked = asked.unionByName(counts.select(F.col("a").alias("set"), F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("left")))
    rows = _dealt(delivered(asked.withColumn("right", F.col("left")), docs, ids, clashing), max(parts, seen["n"] // TASK_SETS))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in UNIT])
        names, leader, data = table.column("set").to_numpy(), table.column("grp").to_numpy(), table.column("shingles")
        out = []
        for own in _units(table):
            head = own[names[own] == leader[own]]
            if len(head):
                x = np.frombuffer(data[int(head[0])].as_py(), np.uint64)
                out += [(int(leader[k]), int(names[k])) for k in own if names[k] != leader[k] and _linked(x, np.frombuffer(data[int(k)].as_py(), np.uint64))]
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    links, seen = staged_with(rows.groupBy("unit").applyInArrow(join, "a long, b long"), "links")
    return links, seen["n"]


#: Bytes of exact bitmaps that a pair of blocks may take; beyond it sets are compared one by one.
EXACT_BYTES = 1 << 25


def merges(sets: list[np.ndarray], component: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of components that a link among the given pairs of sets joins; a pair is skipped once its components have met.

    Overlaps are exact: bitmaps over the shingles that at least two of the sets hold.
    """
    n, root = np.array([len(x) for x in sets]), component.copy()
    words, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    width = -(-int(shared[-1] + 1) // 64) * 64 if len(shared) else 0
    exact = None
    if width * len(sets) // 8 <= EXACT_BYTES:
        exact = np.zeros((len(sets), width // 64), np.uint64)
        row = np.repeat(np.arange(len(sets)), n)
        at = count[number] > 1
        bit = shared[number[at]].astype(np.uint64)
        np.bitwise_or.at(exact, (row[at], (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    out = []
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(i)) + 1, len(i)].tolist() if len(i) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, ys = int(i[a]), j[a:b]
        ys = ys[root[ys] != root[x]]
        for at in range(0, len(ys), 128):
            some = ys[at : at + 128]
            some = some[root[some] != root[x]]
            if not len(some):
                continue
            if exact is not None:
                both = np.bitwise_count(exact[some] & exact[x]).sum(axis=1, dtype=np.int64)
            else:
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in some])
            for y in some[100 * both >= 80 * (n[x] + n[some] - both)].tolist():
                if root[y] != root[x]:
                    out.append((int(component[x]), int(component[y])))
                    root[root == root[y]] = root[x]
    return out


def exact_join(families: DataFrame, total: int, component: DataFrame, docs: DataFrame, ids: DataFrame, clashing: frozenset[int], parts: int) -> DataFrame:
    """(a, b): components that a link joins, between two sets of one family, by trees over the whole sets.

    Rows come out for merges alone, fewer than there are sets.
    """
    rows = open_blocks(*blocked(families.join(component, "set"), total))
    rows = _dealt(delivered(rows.select("set", *UNIT, "block", "component"), docs, ids, clashing), max(parts, total // TASK_SETS))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in UNIT])
        label, data = table.column("component").to_numpy(), table.column("shingles")
        out: list[tuple[int, int]] = []
        for own in _units(table):
            sets = [np.frombuffer(data[int(k)].as_py(), np.uint64) for k in own]
            i, j = _survivors(table, own, list(map(bitmap, sets)))
            if len(i):
                out += merges(sets, label[own], i - own[0], j - own[0])
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.groupBy("unit").applyInArrow(join, "a long, b long").distinct()


def set_components(docs: DataFrame, sets: DataFrame, groups: DataFrame, clashing: frozenset[int] = frozenset()) -> DataFrame | None:
    """(set, component) of all sets that link with another one; None where no sets meet. ``sets`` has (set, id, key, n, bits)."""
    spark = docs.sparkSession
    groups, seen = staged_with(groups, "groups")
    if not seen["n"]:
        return None
    total, ids, shape = seen["n"], sets.select("set", "id", "key"), sets.select("set", "n", "bits")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    units = max(parts, total // TASK_ROWS)
    rows, large = blocked(groups, total)
    links, component = None, None
    for schedule in (same_block, *([first_block] if large else [])):
        if component is None:
            labelled = rows.withColumn("component", F.col("set"))
        else:
            labelled = rows.join(component, "set", "left").withColumn("component", F.coalesce("component", "set"))
        left = tree_join(schedule(labelled), shape, units, "tree")
        found, n = verified(left.filter("partner < set").select(F.col("partner").alias("a"), F.col("set").alias("b")), docs, ids, clashing, parts)
        links = found if links is None else links.unionByName(found)
        if n or component is None:
            component = staged(connected_components(links, "a", "b").withColumnRenamed("node", "set"), "labels")
    labelled = rows.join(component, "set", "left").withColumn("component", F.coalesce("component", "set"))
    spans = labelled.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"))
    # the one pair of a group of two was verified, if it survived
    several = staged(spans.filter("low <> high and m > 2").select("grp", "m"), "several")
    open_groups = staged(join_counted(labelled, several, "grp", "m", total).select("grp", "set", "blocks", "block", "component"), "open-groups")
    left = tree_join(open_blocks(open_groups, large), shape, units, "tree-again")
    # a set is in many groups; the families that surviving sets form hold each of them once
    family = connected_components(left.select(F.col("set").alias("u"), F.col("grp").alias("v")))
    families, seen = staged_with(left.select("set").distinct().join(family.withColumnRenamed("node", "set"), "set").select(F.col("component").alias("grp"), "set"), "families")
    if not seen["n"]:
        return component
    label = open_groups.select("set", "component").distinct()
    more, seen = staged_with(exact_join(families, seen["n"], label, docs, ids, clashing, parts), "merges")
    if not seen["n"]:
        return component
    merged = connected_components(more, "a", "b").select(F.col("node").alias("set"), F.col("component").alias("merged"))
    joined = component.unionByName(merged.select("set", F.col("set").alias("component")).join(component, "set", "left_anti"))
    return staged(joined.join(merged.withColumnRenamed("set", "component"), "component", "left").select("set", F.coalesce("merged", "component").alias("component")), "labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    docs = texts(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col).withColumn("key", F.xxhash64("text"))
    rows = staged(sketches(docs), "sketches")
    ranks, most = counter_ranks(rows)
    sized = rows.filter("n is not null")
    total = sized.agg(F.sum(F.col("n") - F.ceil(F.col("n") * 0.8) + 1).alias("posted"), F.count(F.lit(1)).alias("n")).first()
    sets = sized.filter("n > 0").groupBy("set", "check").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("at"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")
    )
    sets = staged(sets.select("set", "check", "at.id", "at.key", "n", "bits", "copies"), "sets")
    clashing = frozenset(r["set"] for r in sets.groupBy("set").count().filter("count > 1").select("set").limit(CLASHES).collect())
    if clashing:
        if len(clashing) == CLASHES:
            raise RuntimeError(f"{CLASHES} or more names of sets clash")
        name = F.when(F.col("set").isin(list(clashing)), F.col("check")).otherwise(F.col("set"))
        sized, sets = sized.withColumn("set", name), sets.withColumn("set", name)
    with scratch(docs.sparkSession) as keep:
        posted = postings(docs, ranks, int((total["posted"] or 0) // RANGE_POSTINGS).bit_length(), clashing)
        component = set_components(docs, sets, shared_groups(posted, most), clashing)
        own = sets.select("set", "id", "copies")
        if component is None:
            named = own.withColumnRenamed("id", "component_id")
        else:
            own = staged(own.join(component, "set", "left").withColumn("component", F.coalesce("component", "set")), "named-sets")
            smallest = own.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
            named = join_counted(own, staged(smallest, "smallest"), "component", "m", total["n"])
        named = keep(staged(named.select("set", "component_id", "copies"), "named"))
    linked = join_counted(sized.filter("n > 0").select("id", "set", "n"), named, "set", "copies", total["n"]).select("id", "n", "component_id")
    alone = sized.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the smallest id, then the first in the written table.

    Rows are told apart as ``identified`` does, so that repeated and null ids do no harm.
    """
    number = unused("_row", docs)
    numbered = identified(docs, number)
    with scratch(docs.sparkSession) as keep:
        keyed = numbered.select(F.col(number).alias("row"), F.col(text_col).alias("text"))
        found, seen = staged_with(near_classes(keyed, "row", "text").filter("n_shingles > 0").select("row", F.col("component_id").alias("component")), "near-rows")
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        members = join_counted(found, staged(sizes, "near-groups"), "component", "m", seen["n"])
        members = staged(members.join(numbered.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("id")), "row"), "near-members")
        first = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
        dropped, seen = staged_with(members.select("row").join(first.select("first.row"), "row", "left_anti"), "near-copies")
        dropped = keep(dropped).withColumnRenamed("row", number)
    if seen["n"] <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return numbered.join(dropped, number, "left_anti").select(*docs.columns)
