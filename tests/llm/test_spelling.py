"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from docbatch.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point, tried at every place."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [(v, m) for v, m in counts.items() if near(w, v)]
        best = min(others, key=lambda o: (-o[1], o[0]), default=None)
        forms[w] = best if best and best[1] >= ratio * n else (None, None)
        out[w] = [n, len(others)]
    for w in counts:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[w] = (w, forms[w][0], root, out[w][0], out[w][1], forms[w][1])
    return sorted(out.values())


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_words_of_texts(spark):
    rng = random.Random(5)
    words = ["Straßen", "ÀÉÎabcd", "recherche", "x" * 3000, "seventh", "sixsix", "Répertoire", "a×b÷cdefg", "UPPERCASE"]
    rows = [(None if i % 50 == 0 else i // 2, " ".join(rng.choice(words) + rng.choice(["", "", ".", "1", "_", "é"]) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(3, None), (4, ""), (5, "12 ,.")] + rows[:20]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    got = spelling.document_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(want)


@pytest.mark.parametrize("most", [2, 512])
def test_all_pairs(spark, most):
    """Words of one letter to thousands, groups that differ in one place, chains of forms, ties; small groups force finer parts."""
    rng = random.Random(8)
    words = {"a", "b", "ab", "ba", "abc", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    words |= {"prefix" + c + "suffix" for c in "abcdefghijklmnopqrstuvwxyzéÿ"}
    words |= {"".join(rng.choice("ab") for _ in range(n)) for n in range(1, 14) for _ in range(25)}
    base = "".join(rng.choice("abcdefgh") for _ in range(2500))
    words |= {base, base[1:], base[:-1], base[:900] + "z" + base[900:], base[:900] + "z" + base[901:], base[:900] + "y" + base[901:]}
    counts = {w: rng.choice([2, 3, 30, 30, 400, 5000]) for w in sorted(words)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, spelling.variants(rows, most=most).collect())) == brute_variants(counts)


def test_tiles_of_any_size(monkeypatch):
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(3 + i % 4)) for i in range(200)})
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}
    for cells in (60, 4000, 4_000_000):
        monkeypatch.setattr(spelling, "CELLS", cells)
        assert {(x, y) for a, b in spelling.near_in_tiles(words) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want


@pytest.mark.parametrize("length", [1, 2, 3, 7, 12, 13, 40, 999])
def test_places_cover_every_edit(length):
    """Wherever an edit is, some place has its prefix and suffix in common, also after each round of finer steps."""
    for prefix in range(length):
        suffix = length - 1 - prefix
        step, held = spelling._step(length), spelling.places(length)
        while True:
            held = [i for i in held if i <= prefix and length - step - i <= suffix]
            assert held and len(spelling.places(length)) <= 6
            if step == 1:
                break
            finer = spelling._finer(step)
            held = [j for i in held for j in spelling._places(i, step - finer, finer)]
            step = finer


def test_no_rows(spark):
    assert spelling.document_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
