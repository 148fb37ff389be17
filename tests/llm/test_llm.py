"""Each operator against a brute-force version or its library, with nulls, empty and long texts, ties, empty tables and extra columns."""

import base64
import binascii
import gzip
import hashlib
import json
import random
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docbatch.llm import bpe, exact_dedup, language, main_text, near_join, packing, quality, queries, secrets, token_counts, topk
from docbatch.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
TRICKY = [None, "", " ", "a", "Hello World's they're I'll we'r", "x<|endoftext|>y", "aaaa" * 300, "é漢😀ſΣσ!!  \n\t1", "!?" * 200, "a" * 3000, "the cat  sat\n\non the mat"]
#: ``id``, ``row``, ``set``, ``part`` and the like are names that operators use inside.
SCHEMA = "doc_id long, text string, id string, row int, component int, length string, n double"


def frame(spark, values):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y", 0.5) for i, v in enumerate(values)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 5, 30, 60, 60, 300)]
    values = TRICKY + base + [base[2], base[2].upper(), base[3] + "  ", base[3].replace(" ", "\n")]
    for b in base[2:]:
        w = b.split()
        for k in range(6):
            v = list(w)
            for _ in range(1 + k * len(w) // 60):
                v[rng.randrange(len(v))] = f"new{rng.randrange(9)}"
            values.append(" ".join(v))
    return frame(spark, values)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_bpe_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: lib.encode_ordinary(t) for i, t in texts_of(docs).items()}
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in texts_of(docs).items():
        assert got[i].n_tokens == len(want[i])
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want[i])).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    ids = bpe.encode_ids(docs, path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_ids(ids, path).collect()} == texts_of(docs)


def test_token_counts(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(9)
    more = ["".join(rng.choice(" aab'stre'll'd'm\n1!é漢😀Σİ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = frame(spark, [*texts_of(docs).values(), *more])
    for r in token_counts.count_tokens(df, path, 100).collect():
        t = texts_of(docs).get(r.doc_id) if r.doc_id < docs.count() else more[r.doc_id - docs.count()]
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 100), t


def test_long_pieces_merge_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ACGT", 200_000), ("ab", 5_000), ("a", 5_001), ("aeinst", 3_000), ("é漢x", 2_000)):
        piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        assert bpe.bpe_table(path).encode_pieces([piece]) == [lib._core_bpe.encode_single_piece(piece)]


def test_token_counts_of_long_pieces(monkeypatch):
    """Pieces of tens of thousands of bytes, of which parts are counted beside each other; states forgotten within a piece."""
    import time

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    random_letters = "".join(rng.choice(letters) for _ in range(30_000))
    texts = [random_letters, "é" * 15_001, "aé" * 9_999, "a" * 70_001, "theandofinto" * 4_000, "漢字" * 6_000, "!?" * 9_000 + "#" * 3_001, random_letters[:2048], random_letters[:2049], "ab " + random_letters[:5000] + " x"]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    begin = time.time()
    assert token_counts.counter(path).count(texts).tolist() == want
    assert time.time() - begin < 60
    for name, value in (("STATES", 500), ("PAIRS", 300), ("PART", 64), ("LEAD", 3)):
        monkeypatch.setattr(token_counts, name, value)
    assert token_counts.counter(path).count([t[:1500] for t in texts]).tolist() == [len(lib.encode(t[:1500], add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_every_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    values = [f"ab{c}d {c}{c}1" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    values += ["x <|endoftext|> y"] * 10_000
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    assert (token_counts.Counter(path).count(values) == np.array(want)).all()


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in texts_of(docs).items()}
    rows = packing.pack_documents(docs, path).collect()
    sequences, seen = {}, {i: [] for i in want}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == binascii.crc32(np.array(ids, dtype="<u4").tobytes())
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(seen[i]) == list(range(len(want[i]))) for i in want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    histogram = np.zeros(1025, dtype=np.int64)
    np.add.at(histogram, rng.integers(1, 1025, 20_000), 1)
    left = histogram.copy()
    for combination, repeats in packing.plan(histogram, 1024):
        assert sum(combination) <= 1024
        for n in combination:
            left[n] -= repeats
    assert not left.any()


def test_exact_dedup(spark, docs):
    import re

    norm = {i: re.sub("[\x20\x09-\x0d]", "", t) for i, t in texts_of(docs).items()}
    groups = {}
    for i, v in norm.items():
        groups.setdefault(v, []).append(i)
    keep = {v: min(m, key=lambda i: (-len(texts_of(docs)[i]), i)) for v, m in groups.items()}
    got = {r.doc_id: r for r in exact_dedup.exact_classes(docs).collect()}
    for i, v in norm.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep[v], len(groups[v]), keep[v] == i)
        assert got[i].text_sha256 == hashlib.sha256(v.encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(keep.values())


def test_exact_dedup_of_many_copies(spark, monkeypatch):
    """A third of all rows equal, fingerprints that clash, repeated ids, a column named like the operator's own, no broadcast."""
    values = [f"text {i % 700}" if i % 3 else "the same  text"[: 13 + i % 2] for i in range(3000)] + [None, "", " \t"]
    df = spark.createDataFrame([(i // 2, v, i) for i, v in enumerate(values)], "doc_id long, text string, _ROW long").repartition(7)
    plain = ["".join((v or "").split()) for v in values]
    groups = {}
    for i, p in enumerate(plain):
        groups.setdefault(p, []).append(i)
    want = sorted((i // 2, groups[p][0] // 2 if p != "thesametext" else min(i // 2 for i in groups[p] if len(values[i]) == 14), len(groups[p])) for i, p in enumerate(plain))
    monkeypatch.setattr(exact_dedup.xxhash, "xxh3_64_intdigest", lambda p: len(p) % 5)
    for most in (0, 500_000):
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
        got = exact_dedup.exact_classes(df).collect()
        blank = sorted((r.doc_id, r.keep_id) for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest())
        assert blank == [(1500, 1501), (1500, 1501), (1501, 1501)]
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id < 1500) == [w for w in want if w[0] < 1500]
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns and kept.count() == len(groups) == sum(r.kept for r in got)


def test_copies_go_when_files_are_split_otherwise(spark, monkeypatch, tmp_path):
    frame(spark, [f"text {i % 7}" for i in range(40)]).repartition(6, "doc_id").write.parquet(f"{tmp_path}/docs")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def split(most):
        for n in names:
            spark.conf.set(n, most)

    def staged_with(df, label, real=exact_dedup.staged_with, **measures):
        out = real(df, label, **measures)
        if label == "copies":  # as if cores were lost here
            split("100000000")
        return out

    monkeypatch.setattr(exact_dedup, "staged_with", staged_with)
    try:
        split("1000")
        kept = [r.doc_id for r in exact_dedup.drop_copies(spark.read.parquet(f"{tmp_path}/docs")).collect()]
    finally:
        for n in names:
            spark.conf.set(n, before[n])
    assert sorted(kept) == list(range(7))


def brute_components(values):
    """{row: (set size, smallest row reachable)}, with its own words and an index over all shingles."""
    import re

    sets, holders = {}, {}
    for i, v in values.items():
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", v)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for shingle in sets[i]:
            holders.setdefault(shingle, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, own in sets.items():
        shared = {}
        for shingle in own:
            for b in holders[shingle]:
                shared[b] = shared.get(b, 0) + (b < a)
        for b, both in shared.items():
            if both and 100 * both >= 80 * (len(own) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_join(spark, docs):
    want = brute_components(texts_of(docs))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_classes(docs).collect()} == want
    kept = near_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}


def many_texts(seed=7):
    """Families of near copies from two to hundreds, chains of them, exact copies, a passage that many share, and short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, out = say(60), []
    for size in [500, 300, *([40] * 8), *([7] * 60), *([2] * 200)]:
        base = say(rng.randint(20, 120)) + passage * (rng.random() < 0.3)
        for _ in range(size):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 40))):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    for _ in range(10):
        v = say(100)
        for _ in range(12):  # neighbours in a chain link, its ends do not
            v = v[3:] + say(3)
            out.append(" ".join(v))
    out += [" ".join(say(rng.randint(1, 8))) for _ in range(400)] + [" ".join(passage + say(rng.randint(5, 40))) for _ in range(300)]
    out += [" ".join(say(50))] * 600 + [out[0].upper(), out[3].replace(" ", "\n\t")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_join_of_many(spark, monkeypatch, small):
    values = many_texts()
    want = brute_components(dict(enumerate(values)))
    if small:  # blocks, hot ranges, and ids and keys that are not broadcast
        for name, value in (("BLOCK", 64), ("RANGE_POSTINGS", 500), ("HOT_RANGE", 2), ("BROADCAST_IDS", 0), ("TASK_SETS", 100)):
            monkeypatch.setattr(near_join, name, value)
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_classes(df).collect()}
    assert len(values) > 3000 and got == want


def test_near_join_of_clashing_names(spark, docs, monkeypatch):
    """Names of few bits clash; the sets' second hash tells them apart."""
    monkeypatch.setattr(near_join, "CLASHES", 1_000)
    rows = near_join.sketches(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key")))
    named = {(r.set, r.check) for r in rows.filter("n > 0").collect()}
    clashing = frozenset(s for s, _ in list(named)[:3])
    s = shingle_sets([" ".join(f"w{i}" for i in range(30))])[0]
    name, check = near_join.identity(s)
    assert near_join.identity(s, clashing) == (name, check) and near_join.identity(s, frozenset([name])) == (check, check)
    assert near_join.identity(s[:0]) == (0, 0)


def test_near_rows_that_share_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, 1), (5, long + " x", 2), (None, long + " y", 3), (None, "other words " + long[:80], 4), (None, None, 5), (5, "", 6), (2, long, 7), (2, "alone and short", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    kept = near_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r._row for r in kept.collect()) == [4, 5, 6, 7, 8]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_join.near_classes(df).collect()}
    assert got[5, 56] == got[None, 57] == got[2, 56] == 2


def test_shingles_are_words():
    a, b, c, d = shingle_sets(["One two\tthree four FIVE six", "one TWO three four five six", "one two", "\x0b \n"])
    assert len(a) == 2 and (a == b).all() and len(c) == 1 and len(d) == 0


def test_merges_without_bitmaps(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
    sets = [np.unique(np.r_[base[k:], rng.integers(0, 1 << 60, k, dtype=np.uint64)]) for k in (0, 2, 4, 30)]
    i, j = np.triu_indices(4, 1)
    first = near_join.merges(sets, np.arange(4), i, j)
    monkeypatch.setattr(near_join, "EXACT_BYTES", 0)
    assert near_join.merges(sets, np.arange(4), i, j) == first and len(first) == 2


def test_secrets():
    s = "password=abcdef0123456789ab"
    for wrapped in (
        urllib.parse.quote(s),
        urllib.parse.quote(urllib.parse.quote(s)),
        base64.b64encode(s.encode()).decode(),
        base64.b64encode(base64.b64encode(zlib.compress(s.encode()))).decode(),
        "".join(f"\\u{ord(c):04x}" for c in s),
    ):
        base, spans = secrets.findings(f"see {wrapped} ok")
        assert (4, 4 + len(wrapped), "assign") in spans and set(base) <= set(spans)
    assert secrets.findings("secret: token : abcdefghijklmnop")[0] == []
    assert secrets.scan("AKIA" + "A" * 13) == [] and secrets.scan("AKIA" + "A" * 14) == [(0, 18, "access")]
    assert secrets.scan("paſſword=abcdefghijklmnop") == []


def test_secrets_are_unwrapped_whole():
    s = "password=ghijkl0123456789xy"
    kinds = lambda t: {(a, b) for a, b, k in secrets.findings(t)[1] if k == "assign"}
    code = lambda data: base64.b64encode(data).decode()
    long = zlib.compress(("é, " * 3_000_000 + s).encode())
    two = gzip.compress(b"one, ") + gzip.compress(b"two, " + s.encode())
    cut = zlib.compress(("x" * 3_999_990 + ", " + "é" * 20 + "," + s).encode())
    for data in (long, two, cut, b"\x00\x01" + s.encode(), b"\xff\xfe, " + s.encode(), two + b", rest"):
        assert kinds(f"see {code(data)} ok") == {(4, 4 + len(code(data)))}
    assert kinds("a token: abcd%2Fefgh%2Bijklmnop%3D%3D b") == {(2, 37)}
    assert kinds("a token: abcd%252Fefgh%252Bijklmnop b") == {(2, 35)}
    assert kinds("a password = " + "".join(f"\\u{ord(c):04x}" for c in "ghijklmnopqrst") + " b") == {(2, 97)}
    assert kinds("x%20 password=abcdefghijklmnop b") == {(5, 30)}
    for width, around in ((64, ("", "")), (76, ("data:\n", "\nend of it")), (20, ("key ", "\r\n"))):
        plain = code(("words before, " * 20 + s).encode())
        wrapped = "\r\n  ".join(plain[i : i + width] for i in range(0, len(plain), width))
        start = len(around[0])
        assert (start, start + len(wrapped)) in kinds(around[0] + wrapped + around[1])


def test_secrets_in_many_orders_and_compressions():
    import bz2
    import lzma
    import time

    s = "password=ghijkl0123456789xy"
    kinds = lambda t: {(a, b) for a, b, k in secrets.findings(t)[1] if k == "assign"}
    code = lambda data: base64.b64encode(data).decode()
    bare = zlib.compressobj(wbits=-15)
    bare = bare.compress(s.encode() * 3) + bare.flush()
    for data in (bz2.compress(s.encode()) + bz2.compress(b"x"), lzma.compress(s.encode()), bare, zlib.compress(b"x, " * 4_000_000 + s.encode()), f"a\xa0\u200b{s}\x0c".encode()):
        assert kinds(f"see {code(data)} ok") == {(4, 4 + len(code(data)))}
    text = "%" + "25" * 20 + "41 &#" + "38;#" * 20 + "65; " + urllib.parse.quote(s)
    begin = time.time()
    assert kinds(text) and time.time() - begin < 1
    for t in ("%25" * 2_000, "%2525%2525" * 500, code(code(b"x" * 99).encode()) * 3):
        secrets.findings(t)
    # spans follow the escapes, not the words around them
    assert kinds("x" * 300 + "/%20" + urllib.parse.quote(s) + "?rest") == {(304, 304 + len(urllib.parse.quote(s)))}
    assert kinds("words%20before," + s.replace("=", "%3D") + ",after") == {(15, 15 + len(s) + 2)}


def test_secrets_in_base64_at_any_alignment():
    s = "password=ghijkl0123456789xy"
    bare = zlib.compressobj(wbits=-15)
    bare = bare.compress(s.encode() * 3) + bare.flush()
    rng = random.Random(2)
    for head in ("https://h.io/a/", "data-", "k_", "x+", "key=", "id:", "a", "ab", "abc", "abcd/e-", "long-path_of+words/" * 9):
        lead = len(head) - len(secrets._BASE64.search(head + "A" * 16)[0]) + 16
        for data in (s.encode(), b"xx, " + s.encode(), gzip.compress(s.encode()), zlib.compress(bytes(rng.randbytes(50)) + b"," + s.encode()), *([bare] if head[-1] in "/-_+" else [])):
            for code in (base64.b64encode, base64.urlsafe_b64encode):
                t = code(data).decode()
                if code is base64.b64encode or "=" not in t:
                    _, spans = secrets.findings(f"see {head}{t} ok")
                    assert (4 + lead, 4 + len(head) + len(t), "assign") in spans, (head, t)


def test_secrets_in_time():
    """Escapes of any depth, and a megabyte of what could cost more than its length."""
    import time

    s = "password=ghijkl0123456789xy"
    begin = time.time()
    for deep in ("%" + "25" * 100_000 + "3D", "&#" + "38;#" * 100_000 + "61;", "&#37;3D", "%2&#53;3D"):
        text = "a, " + s.replace("=", deep) + ", b"
        assert (3, 3 + len(s) - 1 + len(deep), "assign") in secrets.findings(text)[1]
    mixed = "%3D"
    for _ in range(400):
        mixed = mixed.replace("%", "&#37;", 1) if mixed[0] == "%" else mixed.replace("&", "%26", 1)
    assert (0, len(s) - 1 + len(mixed), "assign") in secrets.findings(s.replace("=", mixed))[1]
    for t in ("a%2525253D%26amp b\\u0041 " * 9_000, "%" * 1_000_000 + ". a", "a/b-c_d" * 40_000, "token" + " " * 1_000_000, "='" * 200_000, "\n".join(["A" * 64] * 15_000)):
        secrets.findings(t)
    assert time.time() - begin < 60


def test_escapes_step_by_step():
    """The fixpoint of one escape after another, in any order, for escapes that do not touch each other's digits."""
    rng = random.Random(6)
    for _ in range(300):
        plain = "".join(rng.choice("ghxyz=: é漢") for _ in range(rng.randrange(1, 12)))
        text, places = "", []
        for c in plain:
            code = c
            for _ in range(rng.randrange(4)):
                first = code[0]
                code = rng.choice(["".join(f"%{b:02x}" for b in first.encode()), f"\\u{ord(first):04X}", f"&#{ord(first)};", f"&#x{ord(first):x};"]) + code[1:]
            places.append((len(text), len(text) + len(code)))
            text += code
        out, starts, ends = secrets.unescaped(text, True, True)
        assert out == plain and list(zip(starts, ends, strict=True)) == places


def _within(spans, kind, start, end, inner, wrapped):
    """A secret in quotes ends before what encodes its last quote."""
    return inner[-1] == '"' and any(k == kind and a == start and end - 7 * len(wrapped) // len(inner) - 9 <= b <= end for a, b, k in spans)


def test_secrets_against_a_plain_decoder():
    """Random nestings: every span of a plain recursive search, which only asks whether a secret shows up, covers the wrapped secret."""
    rng = random.Random(11)
    wrap = {
        "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        "some": lambda t: "".join(f"%{b:02x}" if rng.random() < 0.4 else chr(b) for b in t.encode()),
        "uni": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "base64": lambda t: base64.b64encode(t.encode()).decode(),
        "safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    }
    for _ in range(200):
        inner = rng.choice(["password=ghijkl0123456789xy", "token: \"qrstuvwxyzabcd\"", "AKIA" + "B" * 16])
        t = inner
        for _ in range(rng.randint(1, 4)):
            t = wrap[rng.choice(sorted(wrap))](t)
        head, tail = rng.choice([("see ", " ok"), ("", ""), ("a, ", ", b"), ("ünï ", "\n")])
        base, every = secrets.findings(head + t + tail)
        assert set(base) <= set(every)
        kind = "access" if inner.startswith("AKIA") else "assign"
        assert (len(head) + (t == inner and 0), len(head) + len(t) - (inner[-1] == '"' and t[-1] == '"'), kind) in every or _within(every, kind, len(head), len(head) + len(t), inner, t), (inner, t)
        redacted = secrets.masked(head + t + tail, every, "[S]")
        assert redacted.startswith(head) and redacted.endswith(tail)
    plain = "x " * 50 + "nothing to see %41 \\u0041 &#65; " + base64.b64encode(b"plain words only here").decode()
    assert secrets.findings(plain) == ([], [])


def test_secret_rows_and_redaction(spark, docs):
    df = frame(spark, [None, "", 'x token = "0123456789abcdef0123" y', "AKIA" + "Z" * 20])
    got = {r.doc_id: r for r in secrets.scan_documents(df).collect()}
    assert (got[2].n_assign, got[2].n_access, got[2].n_hex) == (1, 0, 1)
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] is None and clean[1] == "" and "0123456789" not in clean[2] and clean[3] == "[SECRET]"


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_topk(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale], i) for i in range(300)]
    rows += [(300, None, 0), (301, [float("nan")] + [0.0] * 7, 0), (302, [None] + [0.0] * 7, 0), (303, [0.0] * 8, 0), (304, [1.0], 0), (350, [0.0] * 8, 0)]
    rows += [(400 + i, rows[7][1], 0) for i in range(20)]
    rows += [(50, rows[9][1], 0), (700, [1e300] * 8, 0), (701, [-1.7e308] + [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long")
    got = {}
    for r in topk.top_k(df, F.pmod("id", F.lit(50)) == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    most = np.finfo(float).max
    whole = [(i, [int(min(most, max(-most, np.floor(256 * x)))) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {}
    for at, (q, x) in enumerate(whole):
        if q % 50 == 0:
            score = [(-hold(sum(a * b for a, b in zip(x, y, strict=True))), c) for k, (c, y) in enumerate(whole) if k != at and len(y) == len(x)]
            want.setdefault(q, []).extend((r + 1, *s) for r, s in enumerate(sorted(score)[:5]))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><li>m</nav><div class='ad'>buy</div><article><h1>A &amp;\n b</h1><p><b>one<br>two<p>three <script>x</script></p><section class='comments'>no</section></article><footer>f</footer>"
    assert main_text.main_text(page) == "A & b\n\none two\n\nthree"
    assert main_text.main_text("") == ""
    site = [f"<body><div>Site menu all pages share</div><div><p>own text number {i} here</p></div></body>" for i in range(12)]
    rows = [(i, f"http://h.example/{i}", h, "x") for i, h in enumerate(site)] + [(50, None, None, "y"), (51, "http://o.example/", "<p>alone</p>", "z")]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[50] == "" and got[51] == "alone"
    assert all(got[i] == f"own text number {i} here" for i in range(12))  # only the tree takes the menu


def test_main_text_importance_by_brute_force(spark):
    """Noise keys against entropies worked out page by page."""
    import math

    html = [f"<body><div>menu of the site</div><div><p>words {i}</p></div><section class='s{i % 3}'><div>part {i % 3}</div></section></body>" for i in range(20)]
    rows = [(i, "http://h.example/x", h) for i, h in enumerate(html)] + [(90 + i, "http://g.example/", h) for i, h in enumerate(html[:3])]
    got = {(r.host, r.key): r.importance for r in main_text.noise_nodes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {}
    for host, pages in (("h.example", html), ("g.example", html[:3])):
        looks, said, seen = {}, {}, {}
        for h in pages:
            for path, kind, value in main_text.style_nodes(h)[1]:
                {0: looks, 3: seen}.get(kind, said).setdefault(path, []).append((kind, value))
        def entropy(values):
            n = len(values) + main_text.UNSEEN
            return (sum(-c / n * math.log(c / n) for c in map(values.count, set(values))) + main_text.UNSEEN / n * math.log(n)) / math.log(n)
        for path, values in said.items():
            look = 0.3 * entropy(looks[path])
            for kind, value in set(values):
                k = values.count((kind, value))
                own = look + 0.7 * (1 - math.log(k) / math.log(len(seen[path]) + main_text.UNSEEN))
                if k > 1 and own < 0.3 and ((kind == 2 and 2 * k >= len(seen[path])) or look + 0.7 * entropy(values) < 0.3):
                    want[host, main_text.noise_key(path, kind, value)] = own
    got = {k: v for k, v in got.items() if k[1] not in {main_text.noise_key(p, main_text.SHAPE, 0) for h in html for p, _ in main_text.style_nodes(h)[2]}}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_main_text_by_the_tree_alone(spark, monkeypatch):
    """The given pages, in which menus, adverts and footers say something else on each page, without any names of parts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.select("page_id", "html").collect()]
    want = {i: main_text.main_text(h) for i, h in rows}
    for name in ("NOISE_TAGS", "NOISE_ROLES", "NOISE_WORDS", "PLAIN_WORDS"):
        monkeypatch.setattr(main_text, name, frozenset())
    monkeypatch.setattr(main_text, "NOISE_STEMS", ())
    monkeypatch.setattr(main_text, "MAIN", {})
    noise: dict[str, set[int]] = {}

    def plain_hosts():
        """What ``noise_nodes`` finds, with the emptied names in this process."""
        import math
        from collections import Counter

        seen = Counter()
        for _, h in rows:
            seen.update((p, v) for p, v in main_text.style_nodes(h)[2])
        for path in {p for p, _ in seen}:
            shapes = [(v, k) for (p, v), k in seen.items() if p == path]
            n = sum(k for _, k in shapes)
            sizes = Counter()
            for v, k in shapes:
                sizes[v >> 8] += k
            bits = -sum(k / n * math.log2(k / n) for k in sizes.values())
            linked, share = (sum((v >> s & 15) / 10 * k for v, k in shapes) / n for s in (4, 0))
            if n >= main_text.LEAST_PAGES and share <= main_text.SHAPE_SHARE and (linked >= main_text.LINK_SHARE or bits < main_text.SHAPE_BITS):
                yield main_text.noise_key(path, main_text.SHAPE, 0)

    keys = set(plain_hosts())
    bare = {i: main_text.main_text(h) for i, h in rows}
    found = {i: main_text.main_text(h, keys) for i, h in rows}
    assert sum(bare[i] == want[i] for i in want) == 0 and sum(found[i] == want[i] for i in want) >= 0.95 * len(want)


def test_main_text_shapes_of_a_host(spark):
    """Menus and notes of unlisted names whose words differ on every page, found by the host's pages; a few pages of another host lean on them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def page(i):
        links = "".join(f"<li><a href='/{i}'>{word()}</a></li>" for _ in range(6))
        prose = "".join(f"<p>{' '.join(word() for _ in range(rng.choice([3, 12, 60, 250])))}</p>" for _ in range(rng.randrange(2, 7)))
        return f"<body><div class=x1><ul>{links}</ul></div><div class=x2>{word()} {word()}</div><div class=x3><h1>{word()}</h1>{prose}</div><div class=x4>{word()} {word()} {word()}</div></body>", prose

    made = [page(i) for i in range(43)]
    rows = [(i, f"http://{'few' if i >= 40 else 'many'}.example/{i}", h) for i, (h, _) in enumerate(made)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, prose) in enumerate(made):
        assert got[i].split("\n\n")[1:] == [p for p in prose.replace("<p>", "").split("</p>") if p] and len(got[i].split("\n\n")[0]) == 6


def test_main_text_of_many_hosts(spark, monkeypatch):
    """Beyond the list that is sent, one host holds most pages."""
    site = [f"<body><div>Site menu all pages share</div><div><p>own text number {i} here</p></div></body>" for i in range(60)]
    rows = [(i, f"http://{'hot' if i < 50 else 'cold'}.example/{i}", h) for i, h in enumerate(site)] + [(90, "http://none.example/", "<p>alone</p>"), (91, None, None)]
    monkeypatch.setattr(main_text, "BROADCAST_NODES", 0)
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text number {i} here" for i in range(60)} | {90: "alone", 91: ""}


def test_main_text_of_deep_and_broken_pages():
    import time

    begin = time.time()
    assert main_text.main_text("<div>" * 50_000 + "deep" + "</span>" * 50_000 + "</div>" * 10) == "deep"
    assert main_text.main_text("<p>" * 20_000 + "a<li>b<td>c</table></p>d" + "<b>" * 20_000) == "a\n\nb\n\nc\n\nd"
    assert main_text.main_text("<p>" + "long words " * 300_000) == ("long words " * 300_000).strip()
    assert time.time() - begin < 20
    for broken in ("<a " * 100_000, "<!--" * 100_000, "<nav>" * 60_000, "<a href=\"y " * 60_000, "<a b='x>y\"" * 60_000, "<script>" * 60_000, "<p><b>" * 60_000, "<ul><li>" * 60_000):
        main_text.style_nodes(broken)
        main_text.main_text(broken)
    assert time.time() - begin < 60
    assert main_text.main_text("<p>a<!-- b > c<p>d") == "a c\n\nd" and main_text.main_text("<p>a <b") == "a <b" and main_text.main_text("<p x='>'>a<br/>b<textarea>no</textarea><SCRIPT>no</p></Script>") == "a b"
    assert main_text.main_text("<") == "<" and main_text.main_text("&lt;&#65;&bogus; <!-- x -->") == "<A&bogus;"


def test_main_text_keeps_branches_that_hold_the_content():
    text = "own words of the page " * 5
    for wrap in ("<div class='layout with-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<body class='has-header'><div class='has-header'>{}</div>", "<form action='/'><nav>menu</nav>{}</form>", "<div class='widget'>{}</div>"):
        assert main_text.main_text(wrap.format(f"<article><h1>T</h1><p>{text}</p></article>") + "<footer>f</footer>") == f"T\n\n{text.strip()}", wrap
        assert main_text.main_text(wrap.format(f"<h1>T</h1><p>{text}</p>") + "<footer>f</footer>") == f"T\n\n{text.strip()}", wrap
    for title in ("<h1 class='post-header'>T</h1>", "<h1 class='header'>T</h1>", "<div class='article-header'><h1>T</h1></div>", "<div class='header'><h1>T</h1></div>", "<header role='banner'><h1>T</h1></header>"):
        page = f"<div class='site-header'>s</div><article>{title}<p>{text}</p><div class='share-buttons'>no</div><section id=comments><article>{text * 3}</article></section></article><aside class=related><article>tease</article></aside><div class='cookie-banner sticky'>c</div>"
        assert main_text.main_text(page) == f"T\n\n{text.strip()}", title


def test_main_text_drops_what_a_host_repeats(spark):
    box = "<div class='xyz'><h3>Read too</h3><ul><li><a href='/1'>one</a></li></ul></div>"

    def page(i, box=box):
        own = f"<h1>Title {i}</h1><h2>Summary</h2><p>own text <b>Note</b> number {i}</p><table><tr><td>Weight</td><td>{i} kg</td></tr></table>"
        return f"<body>{box}<article>{own}<p>By the staff of the site</p>{box}<section class='xyz'>{'same' if i else 'own words of page 0'}</section></article>{box}"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)]
    rows += [(20 + i, f"http://h.example/n{i}", page(20 + i).replace("article", "div")) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", page(i % 2)) for i in range(40)]  # two pages only: no statistics
    rows += [(200 + i, f"http://few.example/{i}", page(i)) for i in range(3)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in [*range(12), *range(20, 32)]:
        want = [f"Title {i}"] + ["Summary"] * (i < 12) + [f"own text Note number {i}", "Weight", f"{i} kg"] + ["own words of page 0"] * (not i)
        assert got[i].split("\n\n") == want
    for i in [*range(100, 140), *range(200, 203)]:
        assert "By the staff" in got[i] and "Read too" in got[i] and f"number {(i % 2) if i < 200 else i - 200}" in got[i]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.op1_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.95
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op2_language(spark, sf).join(langs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.95


def test_few_labels(spark, docs):
    """Labels of which none is left for the calibration still teach; fitted models take nulls, long texts and copies."""
    some = [r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(10)) < 7).select("doc_id").limit(8).collect()]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(some)], "doc_id long, quality int")
    df = docs.unionByName(docs.withColumn("text", F.repeat(F.lit("very long words "), 200_000)).limit(2))
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == df.count() and len({r.score for r in got}) > 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in quality.keep_good(df, model).collect()} == {r.doc_id for r in got if r.predicted}
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}


def test_isotonic_rises():
    s, v = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0.0, 1.0, 2.0]), np.array([1.0, 1.0, 2.0, 2.0]))
    assert (np.diff(v) >= 0).all() and (np.diff(s) >= 0).all()


def test_empty_tables(spark):
    empty = frame(spark, []).withColumn("lang", F.lit(None).cast("string"))
    path = public_tokenizers.path
    assert bpe.encode_decode(empty, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, path("word_bpe_49k.json"), 5).count() == 0
    assert packing.pack_documents(empty, path("byte_bpe_50k.json")).count() == 0
    assert exact_dedup.exact_classes(empty).count() == 0
    assert near_join.near_classes(empty).count() == 0
    assert secrets.scan_documents(empty).count() == 0
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 5).count() == 0
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokenizer_file_by_its_core():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in filter(None, TRICKY):
        assert packing.token_ids(public_tokenizers.path("byte_bpe_50k.json"), t).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert json.loads(lib.to_str())["added_tokens"]


def test_packing_of_long_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    run = {"blank": " " * 2_000_000, "mixed": " \n\t\u3000\xa0\r" * 6_000, "lines": "\n" * 30_000, "short": " \n" * 9_000}
    for w in run.values():
        for text in (f"a{w}b", f"{w}", f"{w}'s 1", f"x{w}<|endoftext|>{w}y", f"a{w}b{w}!") if len(w) < 1_000_000 else (f"a{w}b",):
            assert packing.token_ids(path, text).tolist() == lib.encode(text, add_special_tokens=False).ids


def _small_language_model(rng, hidden=4, labels=("de", "en", "fr")):
    direction = lambda: language.Direction(rng.normal(0, 1, (256, 3 * hidden)), rng.normal(0, 1, (hidden, 3 * hidden)), rng.normal(0, 1, hidden))
    return language.LanguageModel(list(labels), direction(), direction(), rng.normal(0, 1, (2 * hidden, len(labels))), rng.normal(0, 1, len(labels)))


def _plain_states(direction, raw):
    """The states after each byte of one window, a number at a time."""
    n = len(direction.new_bias)
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, out = [0.0] * n, []
    for byte in raw:
        u = [sum(h[k] * direction.hidden[k, j] for k in range(n)) for j in range(3 * n)]
        x = direction.bytes_in[byte]
        z, r = ([sig(x[g * n + j] + u[g * n + j]) for j in range(n)] for g in range(2))
        new = [np.tanh(x[2 * n + j] + r[j] * (u[2 * n + j] + direction.new_bias[j])) for j in range(n)]
        h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(n)]
        out.append(h)
    return out


def _plain_probabilities(model, raw):
    f, b = _plain_states(model.forward, raw), _plain_states(model.backward, raw[::-1])[::-1]
    e = [np.exp(np.array(x + y) @ model.out + model.bias) for x, y in zip(f, b, strict=True)]
    return np.array([x / x.sum() for x in e])


def test_language_network_against_a_plain_one():
    """Every byte of texts of all lengths around the window counts once, in windows of 16 bytes; the last one reaches back to be as long as its class."""
    rng = np.random.default_rng(5)
    model = _small_language_model(rng)
    window = 16
    raw = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*range(1, 40), 64, 100]]
    got = model.pooled(raw, window)
    for text, p in zip(raw, got, strict=True):
        whole = len(text) // window * window
        parts = [_plain_probabilities(model, text[a : a + window]) for a in range(0, whole, window)]
        rest = len(text) - whole
        if rest:
            width = -(-rest // 8) * 8
            parts.append(_plain_probabilities(model, text[max(0, len(text) - width) :])[-rest:])
        np.testing.assert_allclose(p, np.concatenate(parts).mean(axis=0), atol=1e-5)


def test_language_gradients_against_differences():
    """Backpropagation through time gives what small changes of each weight change."""
    rng = np.random.default_rng(6)
    one = _small_language_model(rng).forward
    steps = rng.integers(0, 256, (7, 3))
    weight = rng.normal(0, 1, (7, 3, 4))

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        for t, byte in enumerate(steps):
            h = one.step(byte, h)[0]
            total += float((h * weight[t]).sum())
        return total

    h, kept = np.zeros((3, 4)), []
    for byte in steps:
        new = one.step(byte, h)
        kept.append((h, *new[1:]))
        h = new[0]
    found = language._backwards(one, steps, kept, weight)
    for of, gradient in ((one.bytes_in, found.bytes_in), (one.hidden, found.hidden), (one.new_bias, found.new_bias)):
        for at in [tuple(rng.integers(0, n) for n in of.shape) for _ in range(20)] + ([(int(steps[3, 1]), 2)] if of is one.bytes_in else []):
            held = of[at]
            of[at] = held + 1e-6
            more = loss()
            of[at] = held - 1e-6
            less = loss()
            of[at] = held
            assert abs((more - less) / 2e-6 - gradient[at]) < 1e-4


def test_fitted_language_model_on_all_kinds_of_rows(spark, docs):
    """Nulls, letterless, very long and repeated rows; the model does not depend on how the rows lie in partitions."""
    lang = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")
    known = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("the and of "), "text")).otherwise(F.concat(F.lit("über für ß "), "text"))).withColumn("lang", lang)
    some = known.unionByName(known.limit(5))
    model, again = language.fit(some.repartition(7, "doc_id")), language.fit(some.repartition(3, "text").sortWithinPartitions(F.desc("doc_id")))
    for a, b in ((model.out, again.out), (model.forward.bytes_in, again.forward.bytes_in), (model.backward.hidden, again.backward.hidden)):
        assert (a == b).all()
    rows = frame(spark, [None, "", "12 .. !", "the and of " * 100_000, "über für ß", "über für ß", "x"])
    got = {r.doc_id: r for r in language.predict(rows, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[3].lang_pred == "en" and got[4].lang_pred == "de" and got[6].lang_pred in ("de", "en")
    assert got[4].score == got[5].score and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(rows.limit(0), model).count() == 0


def test_quality_fit_against_plain_sums(spark, docs):
    """Means, ridge weights and calibration from all rows at once, with the statistics and features of the operator; the isotonic steps by the least mean of all later intervals."""
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(10)) < 7).alias("fit")).orderBy("doc_id").collect()
    x, y, fit = quality.statistics([r.text for r in rows]), np.array([float(r.doc_id % 3 == 0) for r in rows]), np.array([r.fit for r in rows])
    np.testing.assert_allclose(model.mean, x.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(model.scale, x.std(axis=0) + 1e-6, atol=1e-5)
    z = quality.fourier((x - model.mean) / model.scale)
    w = np.linalg.solve(z[fit].T @ z[fit] + quality.RIDGE * len(rows) / 100 * np.eye(z.shape[1]), z[fit].T @ y[fit])
    np.testing.assert_allclose(model.weights, w, atol=1e-6)
    raw = np.round(model.raw(x[~fit]), 3)
    order = np.unique(raw)
    good, n = (np.array([v[raw == s].sum() for s in order]) for v in (y[~fit], np.ones((~fit).sum())))
    k = len(order)
    best = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    np.testing.assert_allclose(np.interp(order, model.steps, model.values), best, atol=1e-9)
