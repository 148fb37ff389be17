"""Operator 11: a Merkle manifest of a dataset, with the witness of every row, by incremental appends.

Rows of one key form a tree, in the order of their ids; the keys' roots form a tree above. A node is the digest of
its run of two digests, or of the one that is left at the end.

1. One pass makes the digest of each row, and rows without their texts are range-partitioned by key and id. Their
   running numbers, less the first of the key in the partition, plus what the key has in earlier partitions, are their
   places: no key has to fit into one task.
2. A tree is cut at aligned places into blocks of ``BLOCK`` leaves. In a block digests are appended one by one
   (``Appender``): each starts as an open subtree with an empty witness, and whenever a sibling is completed, both
   halves' witnesses are extended by the other's digest.
3. The roots of the blocks are appended in the same way to the level above, until each key has one root; the
   keys' roots are a tree of their own. Each level is a ``BLOCK``-th of the one below.
4. The rows' blocks are then appended once more, now with what was attached to the block's own root: witness by
   witness the proofs are finished and folded to a root.

Defined results: null values are written as "-"; null ids come first, and among rows with one id the
smaller digest is first, so that equal rows are leaves of their own; null is a key of its own and comes before all others;
a key with one row has that row's digest as its root; empty texts have a length of 0; an empty table has no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import staged
from docbatch.plans.staging import scratch, staged_with

#: Leaves of a block.
BLOCK = 1024
#: Up to so many starts of keys in partitions are sent to every executor.
SENT_STARTS = 100_000
#: Columns of documents that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in UTF-8, or "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row, as text."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def node(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


class Appender:
    """An aligned stretch of at most ``most`` leaves that grows by appends, with the witness of each leaf so far.

    ``open`` holds the completed subtrees that still lack a sibling: (height, first leaf, digest), the highest
    first. The witness of a leaf is one digest for each level, empty where the node is alone in its run.
    """

    def __init__(self, most: int, height: int | None = None):
        self.open: list[tuple[int, int, bytes]] = []
        self.size = 0
        self.witness = np.zeros((most, max(1, _levels(most) if height is None else height)), dtype="S64")

    def append(self, digest: bytes) -> None:
        self.open.append((0, self.size, digest))
        self.size += 1
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        """The last two open subtrees, of one height, become one; each is the other's witness."""
        height, first, left = self.open[-2]
        _, middle, right = self.open[-1]
        self.witness[first:middle, height] = right
        self.witness[middle : self.size, height] = left
        self.open[-2:] = [(height + 1, first, node((left, right)))]

    def close(self, height: int | None = None) -> bytes:
        """The root, after nodes alone in their run went up to ``height``, or until one is left."""
        while len(self.open) > 1 or height is not None and self.open[-1][0] < height:
            low, first, digest = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == low:
                self._join()
            else:
                self.open[-1] = low + 1, first, node((digest,))
        return self.open[-1][2]


def fold(digest: bytes, place: int, witness: Iterable[bytes]) -> bytes:
    """The root that a digest at a place and its witness lead to."""
    for other in witness:
        digest = node((digest,) if not other else (other, digest) if place & 1 else (digest, other))
        place >>= 1
    return digest


def _levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def _block(digests: list[bytes], total: int, size: int) -> tuple[Appender, bytes, int]:
    """The appender, root and height of a block of a tree of ``total`` leaves. A last, smaller block is as high as the others."""
    height = min(_levels(total), _levels(size))
    appender = Appender(len(digests), height)
    for d in digests:
        appender.append(d)
    return appender, appender.close(height), height


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _roots(nodes: DataFrame, size: int) -> DataFrame:
    """(tree, place, total, digest) of the blocks' roots as the nodes of the level above."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        place, total = table["place"][0].as_py(), table["total"][0].as_py()
        _, root, _ = _block([d.encode() for d in table["digest"].to_pylist()], total, size)
        return pa.table({"tree": table["tree"].slice(0, 1), "place": [place // size], "total": [-(-total // size)], "digest": [root.decode()]})

    return nodes.groupBy("tree", F.expr(f"place div {size}").alias("block")).applyInArrow(run, "tree string, place long, total long, digest string")


_CARRIED = "tree string, place long, witness array<string>, root string"


def _down(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """(tree, place, witness, root) of nodes, from those of their blocks' roots: a row for each block on both sides."""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _ordered(table)
        places = table["place"].to_numpy()
        appender, _, height = _block([d.encode() for d in table["digest"].to_pylist()], table["total"][0].as_py(), size)
        rest, root = upper["witness"][0].as_py(), upper["root"][0].as_py()
        own = [[w.decode() for w in appender.witness[i, :height]] + rest for i in range(len(places))]
        return pa.table({"tree": table["tree"], "place": places, "witness": pa.array(own, pa.list_(pa.string())), "root": [root] * len(places)})

    own = nodes.groupBy("tree", F.expr(f"place div {size}").alias("block"))
    return own.cogroup(above.groupBy("tree", F.col("place").alias("block"))).applyInArrow(run, _CARRIED)


def _trees(nodes: DataFrame, most: int, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """Each tree's root as (tree, digest), and the levels of blocks' roots, the lowest first. ``most`` is the largest tree's size."""
    levels: list[DataFrame] = []
    while most > 1 or not levels:
        nodes = staged(_roots(nodes, size), "block-roots")
        levels.append(nodes)
        most = -(-most // size)
    return nodes, levels


def _placed(rows: DataFrame, tree: Column, order: list[Column]) -> tuple[DataFrame, int]:
    """Rows with ``tree`` (its key as text, null as empty), their ``place`` in it and its ``total``, staged; and the largest total."""
    columns = rows.columns
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), tree), F.lit("")))
    ranged = keyed.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = staged(ranged.withColumn("run", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id()), "ordered")
    runs = numbered.groupBy("tree", "run").agg(F.min("number").alias("least"), F.count(F.lit(1)).alias("n"))
    ran = "sum(n) OVER (PARTITION BY tree ORDER BY run ROWS UNBOUNDED PRECEDING) - n - least AS shift"
    runs, seen = staged_with(runs.selectExpr("tree", "run", ran, "sum(n) OVER (PARTITION BY tree) AS total"), "runs", most=F.max("total"))
    starts = F.broadcast(runs) if seen["n"] <= SENT_STARTS else runs
    return numbered.join(starts, ["tree", "run"]).select(*columns, "tree", (F.col("number") + F.col("shift")).alias("place"), "total"), seen["most"] or 0


def manifest(rows: DataFrame, key_col: str, order: list[str], kept: list[str], size: int = BLOCK) -> DataFrame:
    """Proofs for rows of (leaf, folded, ``key_col``, ``order``, ``kept``): ``kept`` columns, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` is a row's digest, ``folded`` the one that is led to a root along the leaf's witness.
    """
    if size & (size - 1):
        raise ValueError("the size of a block is a power of two")
    with scratch(rows.sparkSession) as keep:
        base = staged(rows.select(F.col(key_col).cast("string").alias("_key"), "leaf", "folded", *dict.fromkeys([*order, *kept])), "leaves")
        leaves, most = _placed(base, F.col("_key"), [F.col(c).asc_nulls_first() for c in order] + [F.col("leaf")])
        leaves = leaves.withColumnRenamed("leaf", "digest")
        subroots, levels = _trees(leaves.select("tree", "place", "total", "digest"), most, size)
        # the trees' roots are the leaves of one more tree
        tops, n_trees = _placed(subroots.select(F.col("tree").alias("own"), "digest"), F.lit("").cast("string"), [F.col("own").asc()])
        top, above = _trees(tops.select("tree", "place", "total", "digest"), n_trees, size)
        carried = top.select("tree", "place", F.expr("cast(array() as array<string>)").alias("witness"), F.col("digest").alias("root"))
        for nodes in [*reversed(above[:-1]), tops.select("tree", "place", "total", "digest")]:
            carried = staged(_down(nodes, carried, size), "witnesses")
        carried = tops.select(F.col("own").alias("key"), "place", "digest").join(carried.select("place", "witness", "root"), "place")
        # of each tree's single root: its path above, as places and digests
        carried = keep(staged(carried.select(F.col("key").alias("tree"), F.col("place").alias("top"), F.col("digest").alias("subroot"), "witness", "root"), "roots"))
        paths = carried.select("tree", F.lit(0).cast("long").alias("place"), F.expr("cast(array() as array<string>)").alias("witness"), "subroot")
        paths = paths.withColumnRenamed("subroot", "root")
        for nodes in reversed(levels[:-1]):
            paths = staged(_down(nodes, paths, size), "witnesses")
        ends = paths.select("tree", F.col("place").alias("block"), F.col("witness").alias("middle"))
        ends = keep(staged(ends.join(carried, "tree"), "ends"))
        leaves = keep(staged(leaves.select("tree", "place", "total", "digest", "folded", *kept), "placed"))
    return _proofs(leaves, ends, kept, size)


def _proofs(leaves: DataFrame, ends: DataFrame, kept: list[str], size: int) -> DataFrame:
    """The finished rows: a leaf's witness in its block, the block's in its tree, and the tree's, in one."""
    types = {f.name: f.dataType.simpleString() for f in leaves.schema}
    fields = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _ordered(table)
        places = table["place"].to_pylist()
        total = table["total"][0].as_py()
        digests = [d.encode() for d in table["digest"].to_pylist()]
        appender, _, height = _block(digests, total, size)
        end = upper.slice(0, 1).to_pylist()[0]
        middle, high = ([w.encode() for w in end[c]] for c in ("middle", "witness"))
        below, proofs, folded = _levels(total), [], []
        for i, (place, start) in enumerate(zip(places, table["folded"].to_pylist(), strict=True)):
            witness = [*appender.witness[i, :height].tolist(), *middle, *high]
            proofs.append(hashlib.sha256(_left_to_right(witness)).hexdigest())
            folded.append(fold(start.encode(), place | end["top"] << below, witness).decode())
        n, root = len(places), end["root"]
        data = {c: table[c] for c in kept} | {"leaf": table["digest"], "subroot": [end["subroot"]] * n, "root": [root] * n}
        return pa.table(data | {"proof_sha256": proofs, "folded_root": folded, "verified": pa.array([f == root for f in folded], pa.bool_())})

    own = leaves.groupBy("tree", F.expr(f"place div {size}").alias("block"))
    return own.cogroup(ends.groupBy("tree", "block")).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + (", " if kept else "") + fields)


def _left_to_right(witness: list[bytes]) -> bytes:
    """A run holds one sibling at most, so level by level is left to right."""
    return b"".join(witness)


def document_manifest(docs: DataFrame, tampered: Column, size: int = BLOCK) -> DataFrame:
    """The manifest of documents by language. Where ``tampered`` holds, a row with 1 added to n_chars is led to the root.

    A third of all rows in one language weighs no more than any other rows.
    """
    own = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", leaf(*own).alias("leaf"), F.when(tampered, leaf(*changed)).alias("changed"))
    rows = rows.select("doc_id", "lang", "leaf", F.coalesce("changed", "leaf").alias("folded"))
    return manifest(rows, "lang", ["doc_id"], ["doc_id"], size)
