"""Pairs, runs, bands and lines that are gathered before they are shuffled, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from docbatch.operators import geometry as G
from docbatch.operators import intake as I
from docbatch.sources import tables as S


@pytest.mark.parametrize("most", [2_000, 6, 0])
def test_gap_pairs_in_blocks(spark, monkeypatch, most):
    """Also where some or all blocks hold too many marks to be gathered."""
    r = random.Random(2)
    monkeypatch.setattr(G, "BLOCK_CELLS", 3)
    monkeypatch.setattr(G, "PAIR_MARKS", most)
    marks = []
    for i in range(250):
        x, y = r.uniform(-60, 60), r.uniform(-60, 60)
        marks.append((r.randrange(2), i if i % 9 else 1000 + i % 4, x, y, x + r.uniform(0, 30), y + r.uniform(0, 9)))
    marks += [(0, 2000 + i, 4.0 * i, 0.0, 4.0 * i, 0.0) for i in range(-5, 5)]  # gaps of just the limit
    df = spark.createDataFrame(marks, "page_no int, stroke long, x0 double, y0 double, x1 double, y1 double")
    want = []
    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            dx, dy = (max(a[c] - b[c + 2], b[c] - a[c + 2], 0.0) for c in (2, 3))
            if a[0] == b[0] and a[1] != b[1] and dx * dx + dy * dy <= 16.0:
                want.append((a[0], min(a[1], b[1]), max(a[1], b[1])))
    assert sorted(map(tuple, G.gap_pairs(df, ["page_no"], 4.0).collect())) == sorted(want) and len(want) > 100


def test_gap_pairs_send_a_mark_about_once(spark):
    """Marks are not copied to all cells that they touch."""
    strokes = S.strokes(S.table(spark, "/root/testdata/sf0.001", "lineitem")).cache()
    n = strokes.count()
    pairs = G.gap_pairs(strokes, G.FAMILY, G.gap_limit(F.col("line_width")))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    side = F.col("limit") * G.BLOCK_CELLS
    blocks = strokes.withColumn("limit", G.gap_limit(F.col("line_width"))).select(((F.floor((F.col("x1") + F.col("limit")) / side) - F.floor((F.col("x0") - F.col("limit")) / side) + 1)).alias("k"))
    assert blocks.agg(F.sum("k")).first()[0] < 2.5 * n


def test_runs_over_words_of_bits(spark):
    r = random.Random(4)
    rows = {(d, y): sorted({*r.sample(range(-200, 200), r.randrange(1, 300)), *(range(-70, 140) if y == 0 else ())}) for d in range(3) for y in range(4)}
    rows[3, 0] = [5]
    rows[3, 1] = list(range(-64, 256))  # whole words
    rows[3, 2] = [63, 64, 127, 192]
    cells = [(d, x, y) for (d, y), xs in rows.items() for x in xs] + [(0, x, 0) for x in rows[0, 0][:9]]
    want = []
    for (d, y), xs in rows.items():
        for x in xs:
            if x - 1 not in xs:
                end = x
                while end + 1 in xs:
                    end += 1
                want.append((d, y, x, end))
    got = G.runs(spark.createDataFrame(cells, "doc_id int, x int, y int"), ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.dtypes[2][1] == "int"


def test_edge_band_counts(spark):
    docs = spark.createDataFrame([(1, "a bb ccc\n\nx y  z\nlong" + "er" * 20), (2, "one"), (3, "")], "doc_id long, text string")
    lines, t = S.line_words(docs), S.tokens(docs)
    pages = t.groupBy("doc_id").agg(F.lit(0.0).alias("px0"), F.min("y0").alias("py0"), F.max("x1").alias("px1"), F.max("y1").alias("py1"))
    want = I.edge_bands(t, pages, ["doc_id"]).groupBy("doc_id", "band").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, I.edge_band_counts(lines, pages, ["doc_id"]).collect())) == sorted(map(tuple, want.collect()))


def test_token_rows_are_gathered_before_the_shuffle(spark):
    """Rows of a line may come in any order and from anywhere; odd rows are dropped or kept as before."""
    r = random.Random(6)
    rows = [(d, n, w, r.choice(["ab", "c d", "x\ty", " ", ""])) for d in range(4) for n in range(5) for w in range(6)]
    text = ["\t".join(map(str, [5, d, 1, 1, n, w, w * 10.5, 0, 4, 8, 50 + w, word])) for d, n, w, word in rows]
    mixed = r.sample(text, len(text)) + ["level\tpage\tblock", "5\t1\t1", "", "4" + text[0][1:], "55" + text[0][1:]]
    expected = {}
    for d, n, w, word in rows:
        if word.strip(" "):
            e = expected.setdefault((d, n), [])
            e.append((w, word))
    want = sorted((d, n, len(e), " ".join(x for _, x in sorted(e)), min(w for w, _ in e) * 10.5, max(w for w, _ in e) * 10.5 + 4, 50 + min(w for w, _ in e)) for (d, n), e in expected.items())
    for given in (text, mixed):
        df = spark.createDataFrame([(t,) for t in given], "row string").coalesce(1)
        assert sorted(map(tuple, I.parse_token_rows(df).collect())) == want
    plan = I.parse_token_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
