"""Literal cases and brute-force comparisons of the library's operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.operators import edits as E
from docbatch.operators import fuzzy as Z
from docbatch.operators import geometry as G
from docbatch.operators import rules as R
from docbatch.operators.components import connected_components


def test_flexible_matching(spark):
    text = "OBRA- O03 | OBRA – O03 | OBRA O03 | OBRA-O03"
    df = spark.createDataFrame([(1, text), (2, "OBRAS O03"), (3, None), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", T.count_of(T.flexible_key(F.col("text")), T.flexible_key(F.lit("OBRA O03"))).alias("n")).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 0}
    assert E.occurrences(df, "OBRA O03").filter("doc_id = 1").count() == 4


def test_counts_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa",)], "s string")
    assert df.select(T.count_of(F.col("s"), F.lit("aa"))).first()[0] == 2
    assert df.select(T.count_of(F.col("s"), F.lit(""))).first()[0] == 0


def test_replacement_is_literal(spark):
    df = spark.createDataFrame([("of the x of  the",)], "s string")
    assert df.select(E.replaced(F.col("s"), "of the", r"$1\n")).first()[0] == r"$1\n x $1\n"


def test_rules_dedupe_by_folded_key(spark):
    rules = spark.createDataFrame([(1, "the", "a"), (2, "the  ", "b"), (3, "THE", "c"), (4, " ", "d"), (5, "the–x", "e"), (6, "THE - x", "f")], "rule_id int, find string, replace string")
    assert {r.rule_id for r in R.distinct_rules(rules).collect()} == {1, 5}


def test_segment_shares_add_up(spark):
    segments = spark.createDataFrame([(1, 0, "ab of"), (1, 1, " t"), (1, 2, "he end"), (2, 0, "none"), (3, 0, None)], "doc_id int, seg_no int, text string")
    out = {(r.doc_id, r.seg_no): r.text for r in E.segment_replace(segments, "of the", "12345").collect()}
    assert out[(1, 0)] + out[(1, 1)] + out[(1, 2)] == "ab 12345 end"
    assert out[(2, 0)] == "none"


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gap_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(120):
        x, y = rng.uniform(0, 80), rng.uniform(0, 80)
        boxes.append((1, i, x, y, x + rng.uniform(0, 20), y + rng.uniform(0, 3)))
    gap = lambda a, b: (max(a[2] - b[4], b[2] - a[4], 0) ** 2 + max(a[3] - b[5], b[3] - a[5], 0) ** 2) ** 0.5
    want = {(a[1], b[1]) for a, b in itertools.combinations(boxes, 2) if gap(a, b) <= 5}
    df = spark.createDataFrame(boxes, "page_no int, stroke long, x0 double, y0 double, x1 double, y1 double")
    got = [(r.a, r.b) for r in G.gap_pairs(df, ["page_no"], 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_union_area(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.area for r in G.rect_union_area(boxes, ["k"]).collect()} == {1: 7.0, 2: 1.0}


def test_suppression_keeps_the_best(spark):
    boxes = spark.createDataFrame([(1, 0, 1, 1.0, 50, 0.0, 10.0), (1, 1, 1, 0.9, 90, 1.0, 10.0), (1, 5, 1, 0.9, 10, 30.0, 40.0)], "line int, word_no int, n int, similarity double, conf int, x0 double, x1 double")
    assert {r.word_no for r in Z.suppress(boxes, ["line"], 0.6).collect()} == {0, 5}


def test_entry_without_the_optional_part(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "rule_hits" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    sys.modules.pop("__spark_entry__", None)


def plain_similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b)) if a and b else 0.0


def test_best_windows_against_all_substrings(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("Liecns Xy") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a Lizense b", "Licnse", "xxLicenseyy", "", None, "éé Licénse"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: (round(r.score, 9), r.len, r.start) for r in Z.best_windows(df, F.col("s"), "License", 3, 0.7).collect()}
    want = {}
    for i, s in enumerate(texts):
        if s and "License" in s:
            want[i] = (1.0, 7, s.index("License") + 1)
        elif s:
            spans = [(-plain_similarity(s[a : a + k], "License"), k, a + 1) for k in range(4, 11) for a in range(len(s) - k + 1)]
            if spans and -min(spans)[0] >= 0.7:
                want[i] = (round(-min(spans)[0], 9), *min(spans)[1:])
    assert got == want and len(want) > 3


def test_located_words_against_all_substrings(spark):
    words = lambda *ws: [(i + 1, w, float(10 * i), float(10 * i + 8), 50) for i, w in enumerate(ws)]
    rows = [(1, 1, words("a", "Lic", "ensed", "under")), (1, 2, words("Lioensed", "und", "er")), (2, 1, words("nothing", "here")), (2, 2, words("|1censed", "umder", "x"))]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, w array<struct<word_no: int, word: string, x0: double, x1: double, conf: int>>")
    got = {(r.doc_id, r.line_no): (round(r.similarity, 3), r.first_word, r.last_word, r.x0, r.x1) for r in Z.locate_words(df, "Licensed under").collect()}
    assert got[1, 1] == (1.0, 2, 4, 10.0, 38.0) and got[1, 2] == (0.923, 1, 3, 0.0, 28.0) and (2, 1) not in got and got[2, 2][0] >= 0.82


def test_accents_and_composition(spark):
    import unicodedata

    texts = ["Éàñ ǘ Ṩ", unicodedata.normalize("NFD", "Éàñ – x"), "ñ", "Ω Å", "漢字 й", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(T.strip_accents(F.col("s")), T.composed(F.col("s")), T.variant_key(F.col("s")), T.flexible_key(F.col("s"), True)).collect()
    for t, (plain, whole, variant, flexible) in zip(texts, got, strict=True):
        assert plain == "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c))
        assert whole == (t and unicodedata.normalize("NFC", t)) and unicodedata.is_normalized("NFC", variant) and unicodedata.is_normalized("NFC", flexible)


FAMILIES = "page_no int, color string, width string, line_width double, stroke long, x0 double, y0 double, x1 double, y1 double"


def random_strokes(seed):
    """Families of every kind: chains, clusters of several parts, dense, flat, few and scattered ones."""
    rng, rows = random.Random(seed), []

    def add(page, color, x, y, w, h, width=0.0):
        rows.append((page, color, "w", width, len(rows), x, y, x + w, y + h))

    for page in range(3):
        for kind in "abcdefgh":
            n = {"a": 30, "b": 60, "c": 45, "d": 19, "e": 40, "f": 25, "g": 80, "h": 50}[kind]
            ox, oy = rng.uniform(0, 300), rng.uniform(0, 200)
            for i in range(n):
                if kind in "abd":  # a chain round a square
                    t, side = 4 * i / n % 1, 4 * i // n
                    x, y = ((t, 0), (1, t), (1 - t, 1), (0, 1 - t))[side]
                    add(page, kind, ox + 60 * x, oy + 60 * y, 4, 4, 0.2 if kind == "b" else 0.0)
                elif kind in "ceg":  # two or more parts
                    add(page, kind, ox + 90 * (i % (2 if kind != "e" else 4)) + rng.uniform(0, 35), oy + rng.uniform(0, 35), 3, 3)
                elif kind == "f":  # flat
                    add(page, kind, ox + 4 * i, oy + rng.uniform(0, 3), 4, 1)
                else:  # dense
                    add(page, kind, ox + rng.uniform(0, 45), oy + rng.uniform(0, 45), 20, 20)
    return rows


def plain_parts(rows, limit):
    gap = lambda a, b: (max(a[5] - b[7], b[5] - a[7], 0) ** 2 + max(a[6] - b[8], b[6] - a[8], 0) ** 2) ** 0.5
    left, out = list(rows), []
    while left:
        part = [left.pop()]
        for p in part:
            near = [q for q in left if gap(p, q) <= limit]
            left = [q for q in left if q not in near]
            part += near
        out.append(part)
    return sorted(out, key=lambda p: (-len(p), min(r[4] for r in p)))


def plain_box(part):
    return min(r[5] for r in part), min(r[6] for r in part), max(r[7] for r in part), max(r[8] for r in part)


def plain_area(part):
    xs = sorted({v for r in part for v in (r[5], r[7])})
    total = 0.0
    for a, b in zip(xs, xs[1:], strict=False):
        at = -1e9
        for y0, y1 in sorted((r[6], r[8]) for r in part if r[5] <= a and r[7] >= b):
            total += max(0.0, y1 - max(at, y0)) * (b - a)
            at = max(at, y1)
    return total


def by_family(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return out


def test_family_evaluation_by_brute_force(spark):
    rows = random_strokes(3)

    def verdict(own):
        n, width = len(own), own[0][3]
        if n < 20 or n > 1200:
            return "few" if n < 20 else "many"
        main = plain_parts(own, max(8, min(22, width * 30 + 8)))[0]
        x0, y0, x1, y1 = plain_box(main)
        w, h, box = x1 - x0, y1 - y0, (x1 - x0) * (y1 - y0)
        tests = [(len(main) < 20, "main"), (len(main) / n < 0.9, "dispersed"), (w < 40 or h < 40, "small"), (box / 6e5 < 0.00015, "tiny"), (box / 6e5 > 0.08, "huge")]
        tests += [(plain_area(main) / box > 0.25, "dense"), (min(w, h) / max(w, h) < 0.1, "aspect"), (n - len(main) > max(2, n // 20), "outside"), (True, "accepted")]
        return next(name for bad, name in tests if bad)

    got = {(r.page_no, r.color): r.reason for r in G.evaluate_families(spark.createDataFrame(rows, FAMILIES), G.FAMILY, 1000.0, 600.0).collect()}
    want = {k: verdict(own) for k, own in by_family(rows).items()}
    assert got == want and {"accepted", "few", "dispersed", "dense"} <= set(want.values())


def test_pending_and_refined_families_by_brute_force(spark):
    rows = random_strokes(4)
    df = spark.createDataFrame(rows, FAMILIES)
    got = {(r.page_no, r.color): (r.parts, r.members, r.pending) for r in G.evaluate_pending(df, G.FAMILY, 6e5).collect()}
    evidence = {p: plain_box([r for r in rows if r[0] == p and r[1] == "g"]) for p in range(3)}
    boxes = spark.createDataFrame([(p, *map(float, b)) for p, b in evidence.items()], "page_no int, x0 double, y0 double, x1 double, y1 double")
    refined = {(r.page_no, r.color): (r.parts, round(r.covered, 9), r.accepted, r.only) for r in G.refine_parts(df, "page_no", G.FAMILY, boxes).collect()}
    inside = lambda o, i, pad: i[0] >= o[0] - pad and i[1] >= o[1] - pad and i[2] <= o[2] + pad and i[3] <= o[3] + pad
    accepted = {}
    for key, own in by_family(rows).items():
        parts, sides = plain_parts(own, 18.5), lambda b: (b[2] - b[0], b[3] - b[1])
        spans = [sides(plain_box(p)) for p in parts]
        sound = all(len(p) >= 20 and min(s) >= 30 and min(s) / max(s) >= 0.1 for p, s in zip(parts, spans, strict=True))
        assert got[key] == (len(parts), len(own), 40 <= len(own) <= 400 and 2 <= len(parts) <= 8 and sound and sum(a * b for a, b in spans) / 6e5 <= 0.015)
        big = [p for p in plain_parts(own, max(8, min(22, own[0][3] * 30 + 8))) if len(p) >= 20]
        share, e = sum(map(len, big)) / len(own), evidence[key[0]]
        meets = all(b[0] <= e[2] and b[2] >= e[0] and b[1] <= e[3] and b[3] >= e[1] for b in map(plain_box, big))
        union, pad = plain_box(sum(big, [])) if big else None, max(sides(e)) * 0.12 + 8
        accepted[key] = 40 <= len(own) <= 5000 and 2 <= len(big) <= 12 and share >= 0.95 and meets and (inside(e, union, pad) or inside(union, e, pad))
        assert refined[key][:3] == (len(big), round(share, 9), accepted[key])
    for key, (*_, only) in refined.items():
        assert only == (accepted[key] and sum(v for k, v in accepted.items() if k[0] == key[0]) == 1)
    assert any(p for *_, p in got.values()) and any(accepted.values())


def test_sinks_and_file_sources(spark, tmp_path):
    from docbatch.sources import files

    rows = spark.createDataFrame([("a/b", "one", None), ("c\\d", "two", None), ("e", "bad", "broken")], "name string, text string, error string")
    assert files.write_bundle(rows, f"{tmp_path}/bundle", "name", "text", "error") == "bundle"
    assert {(r.name, r.value) for r in spark.read.parquet(f"{tmp_path}/bundle").collect()} == {("a_b", "one"), ("c_d", "two")}
    assert files.write_bundle(rows.limit(1), f"{tmp_path}/single", "name", "text", "error") == "file"
    assert [r.value for r in spark.read.text(f"{tmp_path}/single").collect()] == ["one"]
    assert files.write_bundle(rows.filter("error is not null"), f"{tmp_path}/none", "name", "text", "error") == "nothing" and not (tmp_path / "none").exists()
    good = files.write_verified(rows.select("name", "text"), ["name"], "text")
    assert files.promote(good, f"{tmp_path}/place") == 3 and spark.read.parquet(f"{tmp_path}/place").count() == 3
    twice = files.write_verified(rows.select(F.lit("x").alias("name"), "text"), ["name"], "text")
    with pytest.raises(ValueError):
        files.promote(twice, f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()
    for name in ("x.PDF", "y.pdf", "z.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert {r.path.rsplit("/", 1)[1] for r in files.binary_files(spark, f"{tmp_path}/*.*").select("path").collect()} == {"x.PDF", "y.pdf"}


def test_selected_edits_are_all_or_none(spark):
    rows = spark.createDataFrame([(1, "of the a of-the b of the"), (2, "of the"), (3, "none"), (4, None)], "doc_id int, text string")
    found = E.occurrences(rows, "of the").withColumn("occurrence_id", E.occurrence_id("of the", "doc_id", "ordinal"))
    ids = {(r.doc_id, r.ordinal): r.occurrence_id for r in found.collect()}
    assert len(set(ids.values())) == 4
    selected = spark.createDataFrame([(1, ids[1, 1]), (1, ids[1, 3]), (2, "gone")], "doc_id int, occurrence_id string")
    got = {r.doc_id: (r.text, r.reason) for r in E.apply_selected(rows, found.drop("text"), selected, r"$1\x").collect()}
    assert got == {1: (r"$1\x a of-the b $1\x", None), 2: ("of the", "missing ids"), 3: ("none", "nothing selected"), 4: (None, "nothing selected")}
    done = E.cascade(rows, "of the", "of-the").filter("doc_id = 1").first()
    assert (done.expected, done.direct, done.by_fallback, done.done) == (3, 2, 1, "of-the a of-the b of-the")


def test_long_lists_are_sent_in_parts(spark):
    from docbatch.functions.rows import joined_list

    rows = spark.createDataFrame([(i, f"text {i} and {i % 7}") for i in range(40)], "i int, s string")
    listed = spark.createDataFrame([(str(k),) for k in range(25)], "needle string")
    whole, parts = (sorted(map(tuple, joined_list(rows, listed, F.contains("s", "needle"), most).collect())) for most in (100, 6))
    assert whole == parts and len(whole) > 40


def test_marks_that_share_an_id_are_one_node(spark):
    """A mark's id in two families connects the parts of both; its rows are counted once each."""
    rows = [(1, "a", "w", 0.1, 5, 0.0, 0.0, 1.0, 1.0), (1, "a", "w", 0.1, 9, 2.0, 0.0, 3.0, 1.0), (2, "a", "w", 0.1, 9, 500.0, 0.0, 501.0, 1.0), (2, "a", "w", 0.1, 12, 503.0, 0.0, 504.0, 1.0), (2, "a", "w", 0.1, 7, 800.0, 0.0, 801.0, 1.0)]
    df = spark.createDataFrame(rows, "page_no long, color string, width string, line_width double, stroke long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page_no, r.stroke, r.component) for r in G.components(df, G.FAMILY, 10.0).collect())
    assert got == [(1, 5, 5), (1, 9, 5), (2, 7, 7), (2, 9, 5), (2, 12, 5)]
    boxes = sorted((r.page_no, r.component, r.m) for r in G.component_boxes(df, G.FAMILY, 10.0).collect())
    assert boxes == [(1, 5, 2), (2, 5, 2), (2, 7, 1)]
    pending = sorted((r.page_no, r.parts, r.members) for r in G.evaluate_pending(df, G.FAMILY, 600_000.0, 10.0).collect())
    assert pending == [(1, 1, 2), (2, 2, 3)]
    assert sorted((r.page_no, r.n, r.main) for r in G.evaluate_families(df, G.FAMILY, 1000.0, 600.0, 10.0).collect()) == [(1, 2, 2), (2, 3, 2)]
    evidence = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 500.0, 0.0, 501.0, 1.0)], "page_no long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page_no, r.parts) for r in G.refine_parts(df, "page_no", G.FAMILY, evidence).collect()) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("limit", [8.0, 11.0, 18.5])
def test_gaps_of_just_the_limit(spark, limit):
    """Whether two marks meet is what their boxes' difference says, not sums that round otherwise."""
    rows, meet = [], {}
    for k in range(3000):
        a = k / 20.0 + 1 + 20 * 0.03
        b = round((a + limit) * 20) / 20.0
        rows += [(k, 2 * k, a - 1, 0.0, a, 1.0), (k, 2 * k + 1, b, 0.0, b + 1, 1.0)]
        meet[k] = b - a <= limit
    df = spark.createDataFrame(rows, "page_no long, stroke long, x0 double, y0 double, x1 double, y1 double")
    want = {k for k in meet if meet[k]}
    assert {r.page_no for r in G.gap_pairs(df, ["page_no"], limit).collect()} == want
    assert {r.page_no for r in G.components(df, ["page_no"], limit).filter("stroke <> component").collect()} == want
