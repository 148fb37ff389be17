"""The corpus pipeline: each stage and the chain against plain Python, with nulls, repeated ids and rows, extra columns and an empty table."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docbatch.llm import quality, secrets
from docbatch.llm.queries import quality_model
from docbatch.plans.staging import staged
from test_llm import brute_components

#: Extra columns bear names that the stages use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, component long, id string, plain string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    long = next(r.text for r in base if len(r.text.split()) > 100)
    secret = "password = ghijkl0123456789xy"
    rows += [(None, None, None, None, None), (9001, None, None, None, 0), (9001, "", "en", "s", 0), (9002, long, "en", "s", 1), (9002, long, "en", "s", 1), (9003, long.replace(" ", "  "), "en", "s", 1)]
    rows += [(None, long + " near", "en", "s", 1), (9004, long + " near copy", "en", "s", 1), (9005, f"{long[: len(long) // 2]} {secret} {long[len(long) // 2 :]}", "en", "s", 1), (9006, long[::-1] + " " + secret, "en", "s", 1)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, i, 7, "x", "y") for i, r in enumerate(rows)], SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, folder), "test")
        now[name] = (rows_of(before), rows_of(docs))
        if name != "packing":
            assert docs.columns == columns
    before, after = now["quality classifier"]
    model = quality_model(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r["_row"] for r in before if model.score(quality.statistics([r["text"] or ""]))[0] >= quality.THRESHOLD}
    assert {r["_row"] for r in after} == good and len(after) < len(before)

    before, after = now["exact dedup"]
    best = {}
    for r in before:
        best.setdefault(normal(r["text"]), []).append(((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0), r["_row"]))
    assert len(after) == len(best)
    for r in after:
        rivals = best[normal(r["text"])]
        assert min(rivals)[0] == next(k for k, row in rivals if row == r["_row"])

    before, after = now["n-gram Jaccard join"]
    component = brute_components({r["_row"]: r["text"] or "" for r in before})
    groups = {}
    for r in before:
        groups.setdefault(component[r["_row"]][1], []).append(((r["doc_id"] is None, r["doc_id"] or 0), r["_row"]))
    assert len(after) == len(groups) < len(before)
    for r in after:
        own = groups[component[r["_row"]][1]]
        assert min(own)[0] == next(k for k, row in own if row == r["_row"])

    before, after = now["secret scans"]
    want = {r["_row"]: r["text"] and secrets.masked(r["text"], secrets.findings(r["text"])[1], "[SECRET]") for r in before}
    assert {r["_row"]: r["text"] for r in after} == want and any("[SECRET]" in (t or "") for t in want.values())
    assert not any("ghijkl0123456789xy" in (t or "") for t in want.values())

    before, after = now["packing"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
    used = {}
    for r in after:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in after) == tokens
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_chain(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
