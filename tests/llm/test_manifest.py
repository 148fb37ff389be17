"""The Merkle manifest against a plain version over whole levels."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docbatch.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        path.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
        at >>= 1
    return path


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {k: levels_of([d for *_, d, _ in sorted(trees[k], key=lambda t: t[:3])]) for k in keys}
    top = levels_of([levels[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for i, (_, _, digest, r) in enumerate(sorted(trees[k], key=lambda t: t[:3])):
            path = path_of(levels[k], i) + path_of(top, at)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            now = leaf(r | {"n_chars": r["n_chars"] + 1}) if hit else digest
            for other, right in path:
                now = sha(now) if other is None else sha(other, now) if right else sha(now, other)
            out.append((r["doc_id"], digest, levels[k][-1][0], top[-1][0], sha(*(o for o, _ in path if o)), now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place string, tree int"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 70, 333])
def test_against_whole_levels(spark, n):
    """Nulls in all columns, repeated rows, keys with one row, a key with most rows, names that the operator uses."""
    langs = [None, "", "de", "é", "en", "en", "en", "en"]
    rows = [(i // 2 if i % 9 else None, None if i % 11 == 0 else f"täxt {i // 3}" * (i % 5), "one" if i == 7 else langs[i % 8], None if i % 13 == 0 else "s", None if i % 17 == 0 else i // 4, "x", "y", 1) for i in range(n)]
    rows += rows[: n // 10]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    want = brute([dict(zip(names, r, strict=True)) for r in rows])
    for size in (2, 8, 1024):
        got = manifest.document_manifest(docs, tampered, size)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        if n > 9 and size > 2:
            break


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_appended_witnesses(n):
    digests = [sha(str(i)) for i in range(n)]
    appender = manifest.Appender(n)
    for d in digests:
        appender.append(d.encode())
    levels = levels_of(digests)
    assert appender.close().decode() == levels[-1][0]
    for i, d in enumerate(digests):
        witness = [w for w in appender.witness[i, : len(levels) - 1]]
        assert witness == [(o or "").encode() for o, _ in path_of(levels, i)]
        assert manifest.fold(d.encode(), i, witness).decode() == levels[-1][0]


def test_blocks_are_powers_of_two(spark):
    with pytest.raises(ValueError):
        manifest.manifest(spark.range(3).selectExpr("id", "'a' AS k", "'x' AS leaf", "'x' AS folded"), "k", ["id"], ["id"], 3)
