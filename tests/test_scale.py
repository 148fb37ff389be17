"""Operators on lists, families and grids larger than one task should take, against plain versions."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docbatch.functions import rows
from docbatch.operators import edits as E
from docbatch.operators import fuzzy as Z
from docbatch.operators import geometry as G
from docbatch.operators import numbering, parts
from docbatch.operators import rules as R
from docbatch.operators import telemetry as T
from docbatch.operators.components import least_labels
from docbatch.operators.sweep import union_area
from docbatch.sources import files


def plain_count(text, needle):
    return len(text.split(needle)) - 1 if needle else 0


@pytest.mark.parametrize("compiled", [100_000, 7_000])
def test_twenty_thousand_rules(spark, monkeypatch, compiled):
    """In one automaton and in three; overlapping, nested, repeated and empty needles; null texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    lines = [(d, d % 5, " ".join(rng.choice(words) for _ in range(12))) for d in range(120)] + [(7, 7, None), (8, 8, ""), (9, 1, "aaaaaaa"), (9, 1, "abababa é漢")]
    pool = [line[2] or "" for line in lines]
    finds = set()
    while len(finds) < 20_000:
        line = rng.choice(pool)
        a = rng.randrange(max(1, len(line)))
        finds.add(line[a : a + rng.randrange(1, 14)] + ("" if rng.random() < 0.7 else rng.choice("xyz") * rng.randrange(1, 4)))
    finds |= {"aa", "aaa", "aba", "é漢"}
    needles = list(enumerate(sorted(finds)))
    want = Counter()
    for d, p, line in lines:
        for i, f in needles:
            if f and line and f in line:
                want[d, p, i] += plain_count(line, f)
    monkeypatch.setattr(R, "MOST_COMPILED", compiled)
    df = spark.createDataFrame(lines, "doc_id long, page_no int, s string").repartition(5)
    got = R.needle_counts(df, ["doc_id", "page_no"], "s", spark.createDataFrame(needles, "rule_id int, needle string")).collect()
    assert len(got) == len(want) and {(r.doc_id, r.page_no, r.rule_id): r.n for r in got} == dict(want)


def test_few_rules_are_expressions(spark):
    df = spark.createDataFrame([(1, 1, "abab ab"), (2, 1, None)], "doc_id long, page_no int, s string")
    few = spark.createDataFrame([(1, "ab"), (2, "aba"), (3, "zz")], "rule_id int, needle string")
    for needles in (few, few.unionByName(spark.range(100).selectExpr("cast(id + 10 as int) AS rule_id", "concat('no', id) AS needle"))):
        assert {(r.doc_id, r.rule_id, r.n) for r in R.needle_counts(df, ["doc_id", "page_no"], "s", needles).collect()} == {(1, 1, 3), (1, 2, 1)}
    assert R.needle_counts(df, ["doc_id", "page_no"], "s", few.limit(0)).count() == 0


def slabs(boxes):
    """Area by all slabs."""
    total, xs = 0.0, sorted({x for b in boxes for x in (b[0], b[2])})
    for a, c in zip(xs[:-1], xs[1:], strict=True):
        end = None
        for y0, y1 in sorted((b[1], b[3]) for b in boxes if b[0] <= a and b[2] >= c):
            total += max(0.0, y1 - (y0 if end is None else max(y0, end))) * (c - a)
            end = y1 if end is None else max(end, y1)
    return total


def test_sweep_against_slabs():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 120):
        boxes = []
        for _ in range(n):
            x, y = rng.randrange(20), rng.uniform(0, 9)
            boxes.append((x, y, x + rng.randrange(1, 9), y + rng.choice([1, rng.uniform(0.1, 5)])))
        assert union_area(*np.array(boxes, float).T) == pytest.approx(slabs(boxes))


def test_union_area_in_strips(spark, monkeypatch):
    """A large family, one whose boxes all start at one x, families without area, null keys."""
    rng = random.Random(2)
    rows = [(1, None, x := rng.uniform(0, 50), y := rng.uniform(0, 20), x + rng.uniform(0, 6), y + rng.uniform(0, 4)) for _ in range(700)]
    rows += [(2, "k", 3.0, float(i), 4.0 + i % 7, i + 1.5) for i in range(150)] + [(3, "k", 1.0, 1.0, 1.0, 5.0), (4, "k", 0.0, 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "a int, b string, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(G, "STRIP_BOXES", 60)
    got = {r.a: r.area for r in G.rect_union_area(df.withColumn("b", F.coalesce("b", F.lit("n"))), ["a", "b"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k in got:
        assert got[k] == pytest.approx(slabs([r[2:] for r in rows if r[0] == k and r[4] > r[2] and r[5] > r[3]]))


def test_union_area_of_a_large_family(spark):
    n = 200_000
    df = spark.range(n).selectExpr("1 AS k", "(id * 7919 % 100003) / 10.0D AS x0", "(id * 104729 % 1009) / 1.0D AS y0").withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 2})
    begin = time.time()
    area = G.rect_union_area(df, ["k"]).first().area
    assert time.time() - begin < 60
    ids = np.arange(n)
    x0, y0 = (ids * 7919 % 100003) / 10.0, (ids * 104729 % 1009) / 1.0
    # by rows of height 1: a box covers two of them
    want = 0.0
    for y in range(1010):
        s = np.sort(x0[(y0 == y) | (y0 == y - 1)])
        want += np.minimum(3, np.diff(s)).sum() + 3 * (len(s) > 0)
    assert area == pytest.approx(want)


def test_least_labels():
    rng = random.Random(3)
    for n, m in ((1, 0), (10, 4), (500, 300), (2000, 1999)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 1999 else [(i, i + 1) for i in range(m)]
        label = list(range(n))
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        got = least_labels(n, np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        assert got.tolist() == label


@pytest.mark.parametrize("crowded", [20_000, 12])
def test_components_over_many_blocks(spark, monkeypatch, crowded):
    """Chains over many blocks, marks in several blocks, crowded blocks; negative places."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        x, y = rng.uniform(-300, 300), rng.uniform(-40, 40)
        rows.append((i % 3, 1000 - i, x, y, x + rng.choice([0.5, 8, 60]), y + rng.uniform(0, 3)))
    rows += [(5, 2000 + i, 4.0 * i - 100, 0.0, 4.0 * i - 99, 1.0) for i in range(200)] + [(6, 3000 + i, 0.0, 0.0, 1.0, 1.0) for i in range(30)]
    limit = 3.5
    label = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(rows):
            for b in rows[:i]:
                if a[0] == b[0] and max(a[2] - b[4], b[2] - a[4], 0) ** 2 + max(a[3] - b[5], b[3] - a[5], 0) ** 2 <= limit**2 and label[a[1]] != label[b[1]]:
                    label[a[1]] = label[b[1]] = min(label[a[1]], label[b[1]])
                    changed = True
    monkeypatch.setattr(G, "BLOCK_CELLS", 2)
    monkeypatch.setattr(G, "BLOCK_MARKS", crowded)
    df = spark.createDataFrame(rows, "page_no int, stroke long, x0 double, y0 double, x1 double, y1 double").repartition(4)
    got = G.components(df, ["page_no"], limit).collect()
    assert len(got) == len(rows) and {r.stroke: r.component for r in got} == label


def test_grid_components_of_keys_that_hash_alike(spark):
    """Keys 34490 and 107140 share 30 bits of their hash; a spiral; long runs; a wide grid; repeated cells."""
    cells = [(107140, 1, 0), (107140, 3, 0), (34490, 2, 0), (5, 0, 7), (5, 10**6, 7), (5, 10**6 + 1, 7), (5, 0, 7)]
    cells += [(9, x, y) for y in range(0, 12, 2) for x in range(30)] + [(9, 29 if y % 4 == 1 else 0, y) for y in range(1, 10, 2)]
    rows = G.grid_components(spark.createDataFrame(cells, "k long, x int, y int"), ["k"]).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.component, set()).add((r.k, r.x, r.y))
    assert sorted(map(len, parts.values())) == [1, 1, 1, 1, 2, 185]
    assert sum(map(len, parts.values())) == len(set(cells)) and all(len({k for k, _, _ in p}) == 1 for p in parts.values())


def test_numbers_over_partitions(spark):
    rng = random.Random(5)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 4}", rng.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, ts long, event_id long").repartition(7)
    want, seen = {}, Counter()
    for k, t, e in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] += 1
        want[e] = seen[k]
    got = numbering.numbered(df, ["run_id"], [F.col("ts"), F.col("event_id")], "n", "all").collect()
    assert {r.event_id: r.n for r in got} == want and all(r["all"] == seen[r.run_id] for r in got)
    every = numbering.numbered(df, [], [F.col("ts"), F.col("event_id")]).collect()
    assert [r.event_id for r in sorted(every, key=lambda r: r.number)] == [e for _, _, e in sorted(rows, key=lambda r: r[1:])]
    assert numbering.numbered(df.limit(0), ["run_id"], [F.col("ts")]).count() == 0


def test_lines_of_a_long_run_keep_their_numbers(spark):
    rows = spark.range(100_200).selectExpr("'r' AS run_id", "id AS ts", "id AS event_id")
    out = numbering.numbered(rows, ["run_id"], [F.col("ts")])
    lines = out.select("event_id", T.report_line(F.col("number"), F.lit("s"), F.lit(1.0), F.lit("f")).alias("line")).filter("event_id in (0, 99998, 99999, 100199)").collect()
    assert {r.event_id: r.line.split(" ")[0] for r in lines} == {0: "00001", 99998: "99999", 99999: "100000", 100199: "100200"}


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=2500), "b": rng.integers(0, 4, 900).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r for r in numbering.exact_quantiles(df, ["k"], F.col("v"), low=0.0, q1=0.25, middle=0.5, high=0.99, top=1.0).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in (("low", 0), ("q1", 0.25), ("middle", 0.5), ("high", 0.99), ("top", 1)):
            assert got[k][name] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_asof_over_partitions(spark):
    """A hot key over many partitions, keys of one side only, null keys, ties in time."""
    rng = random.Random(6)
    left = [(("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])), rng.randrange(5000), i) for i in range(1500)]
    right = [(("hot" if rng.random() < 0.7 else rng.choice(["a", "c", None])), rng.randrange(5000), i) for i in range(200)]
    want = {}
    for k, t, i in left:
        before = [(u, v) for j, u, v in right if j == k and u <= t]
        want[i] = max(before)[1] if before and k is not None else None
    df = lambda rows, name: spark.createDataFrame(rows, f"k string, t long, {name} long").repartition(5)
    got = numbering.asof(df(left, "i"), df(right, "v"), ["k"], "t", ["v"]).collect()
    assert len(got) == len(left) and {r.i: r.v for r in got if r.k is not None} == {i: want[i] for k, _, i in left if k is not None}


def test_many_edits_of_one_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdé漢 ") for _ in range(1_000_000))
    edits = [(i * 50 + rng.randrange(20), i * 50 + 20 + rng.randrange(29), rng.choice(["", "x", "longer é"])) for i in range(20_000)]
    want, at = [], 0
    for a, b, s in edits:
        want += [text[at:a], s]
        at = b
    df = spark.createDataFrame([(text, edits), ("kept", []), ("kept too", None), (None, [(0, 1, "y")])], "t string, e array<struct<a: int, b: int, s: string>>")
    begin = time.time()
    got = [r.x for r in df.select(E.spliced(F.col("t"), F.col("e")).alias("x")).collect()]
    assert got == ["".join(want) + text[at:], "kept", "kept too", None] and time.time() - begin < 30


def plain_similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


@pytest.mark.parametrize("most", [100_000, 4_000])
def test_ten_thousand_targets(spark, monkeypatch, most):
    """Lines against all targets one by one, in one index and in three."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    targets = sorted({word(rng.randrange(1, 22)) for _ in range(10_050)})
    assert len(targets) > 8_000
    keys = []
    for _ in range(25):
        t = list(rng.choice(targets))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "ab"])
        keys.append("".join(t))
    keys += ["", "a", "zzzzzz"]
    lines = spark.createDataFrame([(i, 1, k) for i, k in enumerate(keys)], "doc_id long, line_no int, line string")
    monkeypatch.setattr(parts, "MOST_INDEXED", most)
    p = Z.FuzzyParams(accept=0.8, least_conf=0)
    got = Z.match_lines(lines, spark.createDataFrame([(t,) for t in targets], "target string"), p).collect()
    want = {(i, t) for i, k in enumerate(keys) if k for t in targets if min(len(t), len(k)) >= 0.8 * max(len(t), len(k)) and plain_similarity(k, t) >= 0.8}
    assert len(got) == len(want) and {(r.doc_id, r.target) for r in got} == want


@pytest.mark.parametrize("p", [Z.FuzzyParams(accept=0.75, window=4, least_conf=20, slack=6), Z.FuzzyParams(accept=0.75, window=5, least_conf=0, slack=9, within=True, length_gap=2)])
def test_windows_of_many_targets(spark, p):
    rng = random.Random(12)
    words = ["ab", "cde", "fghij", "ka", "bcd", "efgh", "x"]
    lines = [(d, [(w, rng.choice(words), float(w), float(w + 1), rng.randrange(100)) for w in range(9)]) for d in range(30)]
    targets = sorted({"".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "z"]) for _ in range(60)})
    df = spark.createDataFrame([(d, 1, w) for d, w in lines], "doc_id long, line_no int, w array<struct<word_no: int, word: string, x0: double, x1: double, conf: int>>")
    got = {(r.doc_id, r.word_no, r.target, r.n) for r in Z.match_windows(df, spark.createDataFrame([(t,) for t in targets], "target string"), p).collect()}
    want = set()
    for d, w in lines:
        for t in targets:
            for j in range(9):
                for n in range(1, min(p.window, 9 - j) + 1):
                    key, conf = "".join(x[1] for x in w[j : j + n]), min(x[4] for x in w[j : j + n])
                    most = len(t) + p.slack if p.within else min(int(len(t) / p.accept + 1e-9), len(t) + p.slack)
                    if conf < p.least_conf or not len(t) * p.accept - 1e-9 <= len(key) <= most:
                        continue
                    near = plain_similarity(key, t) if p.length_gap is None or abs(len(key) - len(t)) <= p.length_gap else 0
                    if near >= p.accept - 1e-12 or (p.within and t in key):
                        want.add((d, j, t, n))
                        break
    assert got == want


def test_committed_writes(spark, tmp_path, monkeypatch):
    """A run that breaks before its rename changes nothing; the next one replaces it and removes what it left."""
    path = f"{tmp_path}/table"
    rows = lambda n: spark.createDataFrame([(i, f"text {n}") for i in range(n)], "doc_id long, text string")
    assert files.write_committed(rows(3), ["doc_id"], "text", path) == 3
    with monkeypatch.context() as m:
        m.setattr(files, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            files.write_committed(rows(5), ["doc_id"], "text", path)
    assert files.read_committed(spark, path).count() == 3
    assert len(list((tmp_path / "table").glob("data-*"))) == 2
    with pytest.raises(ValueError):
        files.write_committed(rows(2).union(rows(2)), ["doc_id"], "text", path)
    assert files.write_committed(rows(7), ["doc_id"], "text", path) == 7
    assert {r.text for r in files.read_committed(spark, path).collect()} == {"text 7"}
    assert len(list((tmp_path / "table").glob("data-*"))) == 1


def test_whole_jobs_fail_together(spark):
    rows = spark.createDataFrame([("a", 1, 2, None, "old", "new"), ("a", 2, 0, "nothing selected", "old", "old"), ("b", 3, 1, None, "old", "new"), ("b", 4, 1, "missing ids", "old", "old"), (None, 5, 1, None, "old", "new")], "job_id string, doc_id int, selected long, reason string, original string, text string")
    got = {r.doc_id: (r.job, r.text) for r in E.whole_job(rows, ["job_id"]).collect()}
    assert got == {1: ("done", "new"), 2: ("done", "old"), 3: ("failed", "old"), 4: ("failed", "old"), 5: ("done", "new")}


def test_proofs_as_columns(spark):
    df = spark.createDataFrame([("a b a", "x b a"), ("a", "a"), ("a", None)], "b string, a string")
    lit = F.lit
    assert [r.x for r in df.select(E.proved_edits(F.col("b"), F.col("a"), lit("a"), lit("x")).alias("x")).collect()] == [1, 0, 0]
    assert [(r.x.failed, r.x.text) for r in df.select(E.failsafe(F.col("b"), F.col("a"), F.col("a") == "a").alias("x")).collect()] == [(False, "x b a"), (True, "a"), (True, "a")]
    assert df.select(E.first_strategy(lit(2), ("one", lit(1)), ("two", lit(2)), ("also", lit(2))).alias("x")).first().x == "two"
    hits = [spark.createDataFrame(r, "doc_id long, rule_id int, page_no int") for r in ([(1, 2, 5), (1, 2, 4), (2, 7, 9)], [(1, 1, 8), (2, 7, 1)], [(3, 1, 6)])]
    docs = spark.range(1, 5).withColumnRenamed("id", "doc_id")
    assert {r.doc_id: r.page_no for r in R.first_pages(docs, *hits).collect()} == {1: 8, 2: 9, 3: 6, 4: 1}


def test_lists_in_parts(spark, monkeypatch):
    """A list beyond the bound is sent in parts and gives the same rows; a document without hits has every rule, a rule without hits every document."""
    monkeypatch.setattr(rows, "MOST_SENT", 3)
    docs = spark.range(20).select(F.col("id").alias("doc_id"))
    rules = spark.range(11).select(F.col("id").cast("int").alias("rule_id"), F.concat(F.lit("k"), "id").alias("variant_key"))
    hits = spark.createDataFrame([(d, r) for d in range(20) for r in range(11) if d != 4 and r != 9 and (d * r) % 3 == 0], "doc_id long, rule_id int")
    got = [tuple(x) for x in R.without_hit(docs, rules, hits).collect()]
    want = [(d, r, f"k{r}") for d in range(20) for r in range(11) if d == 4 or r == 9 or (d * r) % 3]
    assert sorted(got) == want
    words = spark.createDataFrame([(w,) for w in "abcdefghij"], "w string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["xyz", "xa", "j", "", None])], "i int, t string")
    assert [x.i for x in rows.not_listed(texts, words, F.contains("t", "w"), 3).orderBy("i").collect()] == [0, 3, 4]


def test_grid_parts_send_no_side_whole(spark):
    """Files of runs and edges are small, their rows are not: no join of the grid operators sends a side to every executor."""
    cells = spark.range(3000).selectExpr("id % 30 AS k", "cast(id * 7 % 60 as int) AS x", "cast(id div 60 as int) AS y")
    parts = G.grid_parts(cells, ["k"], 60)
    out = G.coarse_then_fine(parts.filter("k < 10").select("k", "first", "area"), parts.select("k", "first", "area"), ["k"])
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [20_000, 6])
def test_chains_within_tasks_and_by_pairs(spark, monkeypatch, most):
    """Chains of small keys need one shuffle; keys with more paths than a task takes give the same components and degrees."""
    monkeypatch.setattr(G, "BLOCK_MARKS", most)
    rng, rows = random.Random(5), []
    for ring in range(12):
        for i in range(rng.randint(1, 14)):
            rows.append((ring, 100 * ring + i, *(rng.randint(0, 12) / 2 for _ in range(4))))
    df = spark.createDataFrame(rows, "ring long, path long, sx double, sy double, ex double, ey double")
    touch = {r[1]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 1 for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6])):
                touch[a[1]].add(b[1])
    label = {p: p for p in touch}
    for _ in label:
        label = {p: min([label[p], *(label[q] for q in touch[p])]) for p in label}
    out = G.chains(df, ["ring"], 1.0)
    assert {r.path: (r.component, r.degree) for r in out.collect()} == {p: (label[p], len(touch[p])) for p in touch}
    if most > 14:
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
