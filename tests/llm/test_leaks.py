"""Benchmark decontamination against windows compared one by one."""

import random
import re

import pytest

from docbatch.llm import leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    own, hit, names = words(text), set(), set()
    for item, said in items:
        w = words(said)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            part = w[i : i + width]
            for j in range(len(own) - len(part) + 1):
                if own[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    if item is not None:
                        names.add(item)
    return len(own), sorted(hit), names


def cases(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "E9", "漢", "the"]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, said(n)) for i, n in enumerate((0, 3, 9, 10, 11, 30, 60, 12, 6))]
    items += [(20, None), (21, " .,"), (22, items[5][1]), (5, said(14)), (None, said(11)), (23, "zebra"), (9, "Zebra")]
    texts = [None, "", " \n.", "zebra", said(5), said(40), said(400), items[6][1].upper(), "x " + items[5][1].replace(" ", " -- ") + " y", "zebra-the_" + items[3][1] + "!" + items[4][1]]
    for _ in range(25):
        source = words(rng.choice(items)[1] or "")
        a = rng.randrange(len(source) + 1)
        texts.append(f"{said(6)} {' '.join(source[a : a + rng.randrange(30)])} {said(6)}")
    texts += [("a " * 30_000 + "zebra ") * 2, texts[7], texts[7]]
    return items, texts


@pytest.mark.parametrize("width", [10, 3])
def test_against_every_window(width):
    items, texts = cases()
    scanner = leaks.Scanner([(i, t) for i, t in items if t], width)
    for text, hits in zip(texts, scanner.scan([t or "" for t in texts]), strict=True):
        n, hit, names = brute(text, items, width) if len(text or "") < 9000 else (None, None, None)
        if n is not None:
            assert (hits.n_words, hits.items) == (n, names)
            assert [k for a, b in hits.spans for k in range(a, b)] == hit
            data = (text or "").encode()
            assert [words(data[a:b].decode()) for a, b in hits.places] == [words(text)[a:b] for a, b in hits.spans]


def test_automaton_holds_all_substrings():
    items, _ = cases(9)
    split = [(i, [w.encode() for w in words(t)]) for i, t in items]
    automaton = leaks.SuffixAutomaton(split, 4)
    for _, own in split:
        for a in range(len(own)):
            state = 0
            for w in own[a:]:
                state = automaton.moves[state][w]
    assert len(automaton.link) <= 2 * sum(len(w) for _, w in split) + 1


@pytest.mark.parametrize("sent", [2_000_000, 150])
def test_rows(spark, sent):
    """One group of items and several; repeated ids, extra columns with the operator's names."""
    items, texts = cases()
    texts = [t for t in texts if len(t or "") < 9000]
    docs = spark.createDataFrame([(i // 2, t, "r", [1], 2) for i, t in enumerate(texts)], "doc_id long, text string, row string, spans array<int>, _verdict int").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int")
    want = [(i // 2, *brute(t, items, 10)) for i, t in enumerate(texts)]
    got = leaks.leaks(docs, bench, sent=sent).withColumn("digest", leaks.item_digest(leaks.F.col("items"))).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=key) == sorted(((d, n, len(h), sorted(m)) for d, n, h, m in want), key=key)
    assert sorted(r.digest for r in got) == sorted(leaks.sha256_of(m) for *_, m in want)
    assert all(sum(s.b - s.a for s in r.spans) == r.n_hit for r in got)
    kept = leaks.without_leaks(docs, bench, longest=12, coverage=0.5, sent=sent)
    assert kept.columns == docs.columns
    result = []
    for t, (_, n, hit, _) in zip(texts, want, strict=True):
        if len(hit) <= 0.5 * n:
            runs = [r for r in "".join("x" if k in set(hit) else " " for k in range(n)).split() if len(r) > 12]
            result.append((n - sum(map(len, runs)), t is None))
    assert sorted((len(words(r.text)), r.text is None) for r in kept.collect()) == sorted(result)


def test_empty_tables(spark):
    docs, bench = "doc_id long, text string", "item_id long, text string"
    assert leaks.leaks(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c")], bench)).count() == 0
    rows = leaks.leaks(spark.createDataFrame([(1, "a b c")], docs), spark.createDataFrame([], bench)).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(3, 0, [])]
    assert leaks.without_leaks(spark.createDataFrame([(1, "a b c")], docs), spark.createDataFrame([(1, None)], bench)).count() == 1


def test_words_beyond_a_megabyte():
    item = " ".join(f"w{i}" for i in range(12))
    text = "q" * 3_000_000 + " " + "filler " * 200_000 + item + " tail"
    hits = leaks.Scanner([(7, item)]).scan([text])[0]
    assert hits.n_words == 200_014 and hits.n_hit == 12 and hits.items == {7}
