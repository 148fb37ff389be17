"""Operator 5: exact duplicates by counting quotient filters.

Each partition builds a counting quotient filter of its 64-bit fingerprints: the high bits (the quotient)
name a block, the low bits (the remainder) are kept sorted in it with a count. Filters of all partitions
merge losslessly, block by block, by merging their sorted remainders and adding counts. Fingerprints
whose merged count is one are unique and take no further part. Rows of the others, and only they, are
verified on their bytes: they are grouped by the whole normalised text. Each of these groups is a class,
named by the digest of its text; two texts that only share a fingerprint part there.

A copied text adds one entry per partition to a filter, and one to the byte groups, however often it
occurs, and classes that hold many rows are sent to the rows, not the rows to a class. So a text that
holds a third of all rows weighs no more than any other. The number of blocks follows the number of rows,
so a block stays small.

Defined results: null counts as empty, and all empty texts are one class; of equal rows (same id and
text) one stays; a null id orders last among ties; texts of any length are compared whole; an empty table
gives an empty result; extra columns are not read, or passed through by ``drop_copies``, of any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import identified, join_counted, slices, staged, unused
from docbatch.plans.staging import scratch, staged_with

#: Fingerprints that a block holds on average.
BLOCK_ROWS = 65_536
#: Up to so many row numbers or fingerprints are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: str) -> bytes:
    """The text's UTF-8 without spaces, tabs and line ends."""
    return text.encode().translate(None, _SPACES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, id, n_chars, fingerprint (64 bits) and sha256 of the normalised text of every row."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.int64()), ("sha", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches):
            plain = [normalised(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    keys.field("row"),
                    keys.field("id"),
                    pa.array(list(map(len, values)), pa.int64()),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(p) for p in plain], dtype=np.uint64).view(np.int64)),
                    pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary()),
                ],
                schema=schema,
            )

    return docs.select(F.struct("row", F.col("id").cast("long").alias("id")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        run, "row long, id long, n_chars long, fingerprint long, sha binary"
    )


def whole_texts(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The normalised texts of the ``n`` rows of ``docs`` that ``rows`` (row) names, read again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(map(normalised, values)), pa.binary())], names=["plain"])

    named = docs.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, "row", "left_semi")
    return named.select("row", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "plain binary")


def partition_filters(prints: DataFrame, bits: int) -> DataFrame:
    """One counting quotient filter per partition, cut into its blocks: (block, remainders, counts), remainders sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        blocks = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        low = values & np.uint64((1 << (64 - bits)) - 1)
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
        for a in range(0, max(0, len(cuts) - 1), 1000):
            ends = list(zip(cuts[a : a + 1000].tolist(), cuts[a + 1 : a + 1001].tolist(), strict=False))
            ends = [(s, e) for s, e in ends if e > s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(blocks[s]) for s, _ in ends], pa.int64()), pa.array([low[s:e].tobytes() for s, e in ends], pa.binary()), pa.array([counts[s:e].astype(np.int64).tobytes() for s, e in ends], pa.binary())],
                names=["block", "remainders", "counts"],
            )

    return prints.select("fingerprint").mapInArrow(run, "block long, remainders binary, counts binary")


def merged_filter(filters: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """Fingerprints whose count over all partitions is at least ``least``, with their counts."""

    def merge(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py() if table.num_rows else 0
        low = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("remainders").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        order = np.argsort(low, kind="stable")  # merges the sorted runs
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        total = np.add.reduceat(counts, first)
        full = low[first] | (np.uint64(block) << np.uint64(64 - bits) if bits else np.uint64(0))
        often = total >= least
        return pa.table({"fingerprint": full[often].view(np.int64), "n": total[often]})

    return filters.groupBy("block").applyInArrow(merge, "fingerprint long, n long")


def byte_classes(whole: DataFrame) -> DataFrame:
    """(sha, group_size, texts): classes of the normalised texts ``plain``, and how many texts have the digest.

    Rows meet by all their bytes. Copies are counted where they lie before they are shuffled, so of each text
    and partition one goes on.
    """
    each = whole.groupBy("plain").agg(F.count(F.lit(1)).alias("group_size"))
    named = each.select(F.unhex(F.sha2("plain", 256)).alias("sha"), "group_size")
    return named.groupBy("sha").agg(F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))


def _classes(docs: DataFrame) -> DataFrame:
    """(row, id, keep_id, group_size, kept, sha) for docs of (row, id, text), which is read again for rows of repeated fingerprints."""
    rows, seen = staged_with(fingerprints(docs), "fingerprints")
    bits = max(0, (seen["n"] // BLOCK_ROWS).bit_length())
    often = staged(merged_filter(partition_filters(rows, bits), bits), "repeats")
    marked = join_counted(rows, often, "fingerprint", "n", seen["n"], "left")
    single = marked.filter("n is null").select(F.col("row"), F.col("id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    several, repeated = staged_with(marked.filter("n is not null").select("row", "id", "n_chars", "sha"), "repeated-rows")
    named = byte_classes(whole_texts(docs, several.select("row"), repeated["n"]))
    # of equal texts the longest original stays, then the smallest id, then the first row; ~x reverses the order of x
    best = several.groupBy("sha").agg(F.max(F.struct("n_chars", F.bitwise_not("id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best"))
    best = best.select("sha", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))
    classes, met = staged_with(named.join(best, "sha"), "classes", texts=F.max("texts"))
    if (met["texts"] or 1) > 1:
        raise RuntimeError("two texts have one SHA-256 digest, so it can't name their classes")
    found = join_counted(several.select("row", "id", "sha"), classes, "sha", "group_size", seen["n"])
    return single.unionByName(found.select("row", "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the id of the row that stays, the size of its class, whether it stays, and the digest."""
    number = unused("_row", docs)
    found = _classes(identified(docs, number).select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that do not stay. Rows are told apart as ``identified`` does."""
    number = unused("_row", docs)
    numbered = identified(docs, number)
    with scratch(docs.sparkSession) as keep:
        found = _classes(numbered.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        dropped, seen = staged_with(found.filter("not kept").select(F.col("row").alias(number)), "copies")
        dropped = keep(dropped)
    return numbered.join(F.broadcast(dropped) if seen["n"] <= BROADCAST_ROWS else dropped, number, "left_anti").drop(number)
