"""Words and keys of whole batches, and the operators that work on them, against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.functions.words import folded_keys, slices, split_words
from docbatch.operators import fuzzy as Z
from docbatch.sources import tables as S


def random_lines(n, letters=" aé\U0001f600bo|", seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 9))) for _ in range(n)] + ["", " ", "x"]


def test_split_words():
    lines = random_lines(500)
    line, no, x0, size, words = split_words(pa.array(["zz", *lines, "q q"]).slice(1, len(lines)))
    expected = []
    for i, text in enumerate(lines):
        at = 0
        for n, w in enumerate(text.split(" "), 1):
            if w:
                expected.append((i, n, at, len(w), w))
            at += len(w) + 1
    assert list(zip(line.tolist(), no.tolist(), x0.tolist(), size.tolist(), words.to_pylist())) == expected
    assert split_words(pa.array([None, "a"]))[4].to_pylist() == ["a"]


def test_slices_hold_all_rows():
    lines = random_lines(200)
    parts = list(slices(pa.RecordBatch.from_arrays([pa.array(lines)], names=["line"]), 0, 20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == lines
    assert max(sum(len(x.encode()) for x in p.column(0).to_pylist()) for p in parts) <= 28


@pytest.mark.parametrize("mode", list(T.CONFUSABLE))
def test_folded_keys_are_confusable_keys(spark, mode):
    """Of every character of the basic plane, and one beyond it."""
    characters = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF] + ["\U0001d400"]
    rows = spark.createDataFrame([(c,) for c in characters], "c string").select("c", T.confusable_key(F.col("c"), mode).alias("k")).collect()
    assert folded_keys(pa.array([r.c for r in rows]), mode).to_pylist() == [r.k for r in rows]


def lines_of(spark, texts):
    return spark.createDataFrame([(i // 5, i % 5, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")


def test_window_totals(spark):
    """The totals are those of the runs of words themselves."""
    lines = S.words_of(lines_of(spark, random_lines(300, " abo é")))
    runs = Z.word_windows(lines, 3, (1, 4)).groupBy("doc_id", "n").agg(F.count("*"), F.sum(F.length("words")), F.min("conf"), F.max(F.col("x1") - F.col("x0")))
    got = Z.window_totals(lines, 3, (1, 4))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs.collect())) and got.count() > 50


@pytest.mark.parametrize("p", [Z.WORDS, Z.WIDE, Z.LONG_CODE, Z.TITLE_BLOCK_WIDE], ids=["words", "wide", "long code", "title block"])
def test_near_lines(spark, p):
    """Windows are found in the near lines alone as in all lines, and most others are left out."""
    r = random.Random(3)
    wanted = ["of the", "License", "ab", "The and attion to thanedble"]
    texts = []
    for _ in range(400):
        words = ["".join(r.choice("abdeno") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 12))]
        if r.random() < 0.4:
            t = list(r.choice(wanted))
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(["", "x", " ", "ll"])
            words.insert(r.randrange(len(words) + 1), "".join(t))
        texts.append(" ".join(words))
    lines, targets = lines_of(spark, texts), spark.createDataFrame([(t,) for t in wanted], "target string")
    near = Z.near_lines(lines, targets, p)
    every = sorted(map(tuple, Z.match_windows(S.words_of(lines), targets, p).collect()))
    assert every and every == sorted(map(tuple, Z.match_windows(S.words_of(near), targets, p).collect()))
    assert near.count() < 0.75 * len(texts)


def test_norm_of_all_white_space(spark):
    """Runs are replaced as by the class of white space itself."""
    texts = random_lines(300, "a \t\n  ﻿")
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(T.norm(F.col("s")).alias("a"), F.trim(F.regexp_replace("s", T.WS + "+", " ")).alias("b"))
    assert rows.filter("a <> b").count() == 0


def test_openings_need_so_many_words(spark):
    from docbatch.operators.rules import frequent_openings

    lines = lines_of(spark, ["a b c d", "a  b c", " a b", "a", "", "x y z", "x y  z w"])
    for words in (1, 2, 3):
        want = {}
        for s in (" ".join(t.split()) for t in ["a b c d", "a  b c", " a b", "a", "", "x y z", "x y  z w"]):
            if len(s.split(" ")) >= words:
                want[" ".join(s.split(" ")[:words])] = 1
        assert {r.find for r in frequent_openings(lines, words, 10).collect()} == set(want)


def test_routed_keys_are_united_routes(spark):
    from docbatch.operators.intake import routed_keys, united_routes

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(50)], "i int, c int")
    routes = [("zero", F.col("c") == 0, F.col("i") * 2), ("small", F.col("c") < 2, F.col("i") + 1)]
    one = united_routes(rows, [(n, c, lambda r, k=k: r.select("i", k.alias("key"))) for n, c, k in routes])
    got = routed_keys(rows, routes)
    assert sorted(map(tuple, got.select("i", "key", "route").collect())) == sorted(map(tuple, one.select("i", "key", "route").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan  # the rows are read once


def test_exact_codes_against_all_windows(spark):
    import re

    texts = [t.upper() if i % 2 else t for i, t in enumerate(random_lines(400, "ab oo-"))]
    lines = S.words_of(lines_of(spark, texts))
    codes, p = ["AB", "O A", "0"], Z.FuzzyParams(window=3, least_conf=5, slack=4)
    got = {(r.doc_id, r.line_no, r.word_no, r.target) for r in Z.exact_codes(lines, codes, p).collect()}
    want = set()
    for i, text in enumerate(texts):
        words = [(n, w, (i // 5 * 31 + i % 5 * 7 + n) % 101) for n, w in enumerate(text.split(" "), 1) if w]
        for t in codes:
            size = len(t.split())
            for j in range(len(words) - size + 1):
                run = words[j : j + size]
                joined = " ".join(w for _, w, _ in run)
                if min(c for _, _, c in run) >= 5 and len(joined) <= len(t) + 4 and re.search(f"(?<![A-Z0-9]){re.escape(Z.code_text(t))}(?![A-Z0-9])", Z.code_text(joined)):
                    want.add((i // 5, i % 5, run[0][0], t))
    assert got == want and len({t for *_, t in got}) == 3


def test_anchor_words_against_all_words(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("andrs") for _ in range(r.randrange(1, 8))) + r.choice(["", "!"]) for _ in range(9)) for _ in range(150)] + ["", "sand sand"]
    lines, target = lines_of(spark, texts), "sand_dradna sandars"
    got = {(x.doc_id, x.anchor): (x.line_no, x.word_no, round(x.similarity, 9)) for x in Z.anchor_words(lines, spark.createDataFrame([(target,)], "target string"), accept=0.7).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for i, text in enumerate(texts):
        for n, w in enumerate(text.split(" "), 1):
            key = w.strip("!")
            for anchor in ("sand", "dradna", "sandars"):
                if key:
                    s = 1 - distance(key, anchor) / max(len(key), len(anchor))
                    if s >= 0.7:
                        want[i // 5, anchor] = min(want.get((i // 5, anchor), (0, 0, 0)), (-s, i % 5, n))
    assert got == {k: (v[1], v[2], round(-v[0], 9)) for k, v in want.items()} and len(got) > 10


def test_lines_to_locate(spark):
    """Words are located in these lines alone as in all."""
    texts = ["a Lic ensed under", "Lioensed und er", "nothing here", "|1censed umder x", "under", "", "Li censed vmder it"] + random_lines(50)
    lines = lines_of(spark, texts)
    some = Z.lines_to_locate(lines, "Licensed under")
    every = sorted(map(tuple, Z.locate_words(S.words_of(lines), "Licensed under").collect()))
    assert len(every) >= 3 and every == sorted(map(tuple, Z.locate_words(S.words_of(some), "Licensed under").collect())) and some.count() < 10
