"""Operator 10: token counts by finite-state tokenizer compilation.

The tokenizer file (lower-casing BPE with word ends) is compiled into two deterministic transducers.

* The *splitter* reads character classes and annotates its transitions with the tokens' borders. It has
  seven states. A run of texts is cut into chunks of ``CHUNK`` characters wherever they fall; for each
  chunk the map from every entry state to its exit state is built in lock-step, the maps compose by a
  parallel prefix scan, and a second lock-step pass from the now known entry states writes the borders.
* The *counter* reads the bytes of a piece (its last byte as a symbol of its own, the word end) and
  annotates each transition with the change in the number of BPE tokens. A state is what the future
  depends on: for each suffix that may still grow into a token, the last token before it and the count relative to
  now. This is exact because a token sequence is the BPE result just when each neighbouring pair is the BPE
  result of its own text. States and transitions are found when first met and kept in a hash map, which is
  emptied, also within a piece, when it holds more than ``STATES``; distinct pieces run in lock-step. A piece of
  more than two ``PART`` bytes is cut into parts that run beside each other: each part's map from entry state to exit
  state and count is first taken for the state that the bytes before it lead to, then for the exits of
  the part before it, until the maps compose from the first part to the last.

Defined results: null and empty text count 0; special strings count one token each, as the library does
by default; texts of any length are counted whole; rows are independent, so ties and repeated rows need
no rule; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docbatch.llm.common import arrow_rows, slices, texts
from docbatch.llm.pieces import distinct
from docbatch.llm.u64map import U64Map

CHUNK = 64
#: States, and pairs of tokens, that a worker remembers.
STATES, PAIRS = 200_000, 1_000_000
#: Bytes of the parts of a long piece, and bytes before a part that guess its entry state.
PART, LEAD = 1024, 64

# Fixed values of the file format: the byte-level alphabet's printable ranges, and Unicode's white space.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

SPACE, LETTER, NUMBER, OTHER, APOSTROPHE = range(5)
NAMED = {c: 5 + i for i, c in enumerate("strvlmde")}
GAP, IN_LETTERS, IN_OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
START, START_BEFORE = 8, 16


def _splitter() -> np.ndarray:
    """Transition table [state * 16 + class]: next state, plus START where a piece starts here and START_BEFORE where it did one earlier.

    Pieces: the contractions 's 't 're 've 'm 'll 'd, runs of letters, single numbers, runs of others.
    After an apostrophe and r, v or l the next character decides whether they are a contraction.
    """

    def fresh(k: int) -> int:
        if k == SPACE:
            return GAP
        if k == NUMBER:
            return GAP | START
        if k == OTHER:
            return IN_OTHERS | START
        return (QUOTE if k == APOSTROPHE else IN_LETTERS) | START

    table = np.zeros((8, 16), dtype=np.uint8)
    letters = {LETTER, *NAMED.values()}
    for k in range(13):
        new = fresh(k)
        table[GAP, k] = new
        table[IN_LETTERS, k] = IN_LETTERS if k in letters else new
        table[IN_OTHERS, k] = IN_OTHERS if k in (OTHER, APOSTROPHE) else new
        table[QUOTE, k] = IN_OTHERS if k in (OTHER, APOSTROPHE) else new
        for state, last in ((QUOTE_R, "e"), (QUOTE_V, "e"), (QUOTE_L, "l")):
            table[state, k] = GAP if k == NAMED[last] else (IN_LETTERS if k in letters else new) | START_BEFORE
    for c in "stmd":
        table[QUOTE, NAMED[c]] = GAP
    for c, state in (("r", QUOTE_R), ("v", QUOTE_V), ("l", QUOTE_L)):
        table[QUOTE, NAMED[c]] = state
    return table.ravel()


@lru_cache(maxsize=1)
def later_characters() -> str:
    """Letters and numbers that Python's Unicode tables do not have yet: the tokenizer file's library is asked about these."""
    import regex

    unassigned = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")))
    return "".join(regex.findall(r"[\p{L}\p{N}\p{M}]", unassigned))


@lru_cache(maxsize=2)
def _classes(path: str) -> np.ndarray:
    """The class of each code point, as the library splits the tokenizer file's texts."""
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    kinds[[ord(c) for c in WHITE_SPACE]] = SPACE
    kinds[ord("'")] = APOSTROPHE
    for c, k in NAMED.items():
        kinds[ord(c)] = k
    # between letters, twice: one piece with them is a letter, two pieces of its own are numbers
    pieces = _library(path).pre_tokenizer.pre_tokenize_str(" ".join(f"a{c}{c}a" for c in later_characters()))
    n = np.bincount([start // 5 for _, (start, _) in pieces], minlength=len(later_characters()))
    for c, k in zip(later_characters(), n.tolist(), strict=True):
        kinds[ord(c)] = {1: LETTER, 4: NUMBER}.get(k, OTHER)
    return kinds


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


TABLE = _splitter()


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Marks where pieces start, in an array of classes of characters that ends with white space."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], chunks, axis=1)  # [entry state, chunk] -> state now
    for step in grid:
        maps = TABLE[(maps << 4) + step] & 7
    entry = np.zeros(chunks, dtype=np.uint8)
    scan, width = maps.copy(), 1
    while width < chunks:  # scan[:, i] becomes the map of chunks 0..i
        scan[:, width:] = scan[:, width:][scan[:, :-width], np.arange(chunks - width)]
        width *= 2
    entry[1:] = scan[GAP, :-1]
    out, state = np.empty_like(grid), entry
    for i, step in enumerate(grid):
        out[i] = TABLE[(state << 4) + step]
        state = out[i] & 7
    flags = out.T.ravel()[:n]
    starts = (flags & START) != 0
    starts[:-1] |= (flags[1:] & START_BEFORE) != 0
    return starts


#: Nothing read: only the empty suffix, no token before it.
START_STATE = ((0, -1, 0),)


class CountTransducer:
    """The counter of one tokenizer file, compiled as far as the pieces seen so far need it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        shown = [c for a, b in PRINTABLE for c in range(a, b + 1)]
        alphabet = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(x for x in range(256) if x not in shown)}
        self.symbol = [alphabet[c] for c in range(256)]
        tokens = {t for pair in merges for t in ("".join(pair), *pair)} | set(self.symbol) | {s + self.end for s in self.symbol}
        octet = {c: i for i, c in enumerate(self.symbol)}
        self.token: list[str] = []
        self.child: dict[int, int] = {}
        self.names, self.grows = [-1], [False]  # of each node of the trie, its token, and whether it has children
        for t in sorted(tokens):
            if len(self._bpe(t)) == 1:
                body = t.removesuffix(self.end)
                self._named([octet[c] for c in body[:-1]] + [octet[body[-1]] + (256 if body != t else 0)], t)
        self.fits: dict[int, bool] = {}
        self.reset()

    def _named(self, symbols: list[int], token: str) -> None:
        node = 0
        for symbol in symbols:
            key, self.grows[node] = node << 9 | symbol, True
            if key not in self.child:
                self.child[key] = len(self.names)
                self.names.append(-1), self.grows.append(False)
            node = self.child[key]
        self.names[node] = len(self.token)
        self.token.append(token)

    def reset(self) -> None:
        """Forgets states; used when there are more than ``STATES``, so that memory stays bounded."""
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves = U64Map(missing=-(1 << 40))
        self._state(START_STATE)

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
        return found

    def _bpe(self, word: str) -> list[str]:
        body = word.removesuffix(self.end)
        parts = list(body)
        if parts and body != word:
            parts[-1] += self.end
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = ["".join(parts[best : best + 2])]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the start of the piece)."""
        if a < 0:
            return True
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            left, right = self.token[a], self.token[b]
            found = self.fits[key] = self._bpe(left + right) == [left, right]
        return found

    def move(self, state: int, symbol: int) -> int:
        """Compiles one transition: next state << 8 | (change in count + 128). Symbols from 256 are last bytes."""
        grown, change, token = [], None, -1
        for node, before, count in self.keys[state]:  # the longest suffix first
            node = self.child.get(node << 9 | symbol, -1)
            if node < 0:
                continue
            if change is None and self.names[node] >= 0 and self._fit(before, self.names[node]):
                token, change = self.names[node], count + 1
            if self.grows[node]:
                grown.append((node, before, count))
        if change is None:
            raise ValueError("the vocabulary lacks a byte")
        if symbol >= 256:
            return change + 128
        return self._state((*((node, before, count - change) for node, before, count in grown), (0, token, 0))) << 8 | (change + 128)

    def run(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray, final: np.ndarray, entry: list[tuple] | None = None) -> tuple[np.ndarray, list[tuple | None]]:
        """The change in count over each range of bytes from its entry state (none: the start of a piece), and its exit state, in lock-step.

        The last byte of a ``final`` range ends a piece; such a range has no exit state.
        """
        if len(self.keys) > STATES:
            self.reset()
        order = np.argsort(-length, kind="stable")
        at, length, final = at[order], length[order], final[order]
        state = np.array([self._state(entry[k]) for k in order.tolist()], dtype=np.int64) if entry else np.zeros(len(order), dtype=np.int64)
        total, exits = np.zeros(len(order), dtype=np.int64), [None] * len(order)
        alive = len(order)
        for i in range(int(length[0]) if alive else 0):
            alive = int(np.searchsorted(-length[:alive], -i, side="left"))  # longer than i
            if len(self.keys) > 2 * STATES:
                held = [self.keys[k] for k in state[:alive].tolist()]
                self.reset()
                state[:alive] = [self._state(k) for k in held]
            keys = (state[:alive] << 9) + raw[at[:alive] + i] + np.where(final[:alive] & (length[:alive] == i + 1), 256, 0)
            found = self.moves.get(keys.astype(np.uint64))
            lacking = np.flatnonzero(found == self.moves.missing)
            if lacking.size:
                new = np.unique(keys[lacking])
                self.moves.put(new.astype(np.uint64), np.array([self.move(int(k) >> 9, int(k) & 511) for k in new], dtype=np.int64))
                found[lacking] = self.moves.get(keys[lacking].astype(np.uint64))
            total[:alive] += (found & 255) - 128
            state[:alive] = found >> 8
            for k in np.flatnonzero((length[:alive] == i + 1) & ~final[:alive]).tolist():
                exits[order[k]] = self.keys[int(state[k])]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total
        return out, exits

    def count(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece (a range of bytes, not empty)."""
        out = np.zeros(len(starts), dtype=np.int64)
        short = np.flatnonzero(lengths <= 2 * PART)
        out[short] = self.run(raw, starts[short], lengths[short], np.ones(len(short), dtype=bool))[0]
        long = np.flatnonzero(lengths > 2 * PART)
        if len(long):
            out[long] = self._long(raw, starts[long].tolist(), lengths[long].tolist())
        return out

    def _long(self, raw: np.ndarray, starts: list[int], lengths: list[int]) -> list[int]:
        """The tokens of long pieces, by composing the maps of their parts."""
        parts = [[(a, min(PART, start + n - a)) for a in range(start, start + n, PART)] for start, n in zip(starts, lengths, strict=True)]
        maps: list[list[dict[tuple, tuple[tuple | None, int]]]] = [[{} for _ in p] for p in parts]
        inner = [(i, j) for i, p in enumerate(parts) for j in range(1, len(p))]
        lead = np.array([parts[i][j][0] - LEAD for i, j in inner])
        _, guessed = self.run(raw, lead, np.full(len(lead), LEAD), np.zeros(len(lead), dtype=bool))
        asked = {(i, 0, START_STATE) for i in range(len(parts))} | {(i, j, g) for (i, j), g in zip(inner, guessed, strict=True)}
        while True:
            todo = sorted(asked)
            places = [parts[i][j] for i, j, _ in todo]
            final = np.array([j == len(parts[i]) - 1 for i, j, _ in todo])
            counts, exits = self.run(raw, np.array([a for a, _ in places]), np.array([n for _, n in places]), final, [e for *_, e in todo])
            for (i, j, e), n, after in zip(todo, counts.tolist(), exits, strict=True):
                maps[i][j][e] = (after, n)
            totals = [self._composed(m) for m in maps]
            if all(t is not None for t in totals):
                return totals
            asked = {(i, j + 1, after) for i, m in enumerate(maps) if totals[i] is None for j, known in enumerate(m[:-1]) for after, _ in known.values() if after not in m[j + 1]}

    @staticmethod
    def _composed(maps: list[dict[tuple, tuple[tuple | None, int]]]) -> int | None:
        """The count of a piece from its parts' maps, applied one after the other; None if a map lacks an entry."""
        state, total = START_STATE, 0
        for known in maps:
            if state not in known:
                return None
            state, n = known[state]
            total += n
        return total


class Counter:
    """Counts tokens of runs of texts."""

    def __init__(self, path: str):
        self.path = path
        self.counter = CountTransducer(path)
        self.later = np.zeros(sys.maxunicode + 1, dtype=bool)
        self.later[[ord(c) for c in later_characters()]] = True
        self.special = re.compile("|".join(map(re.escape, self.counter.specials))) if self.counter.specials else None

    def count(self, values: list[str]) -> np.ndarray:
        extra = np.zeros(len(values), dtype=np.int64)
        normal = []
        for i, v in enumerate(values):
            if self.special and any(s in v for s in self.counter.specials):
                # the strings are cut out before normalisation; line feeds keep the parts apart
                extra[i] = len(self.special.findall(v))
                normal.append("\n".join(map(self._normal, self.special.split(v))))
            else:
                normal.append(self._normal(v))
        return extra + self._plain(normal)

    def _normal(self, text: str) -> str:
        """Canonical composition, then lower case of each character by itself (a final sigma has no form of its own)."""
        if text.isascii():
            return text.lower()
        if self.later[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].any():
            return _library(self.path).normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _plain(self, values: list[str]) -> np.ndarray:
        joined = "\n".join(values) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kinds = _classes(self.path)[codes]
        starts = piece_starts(kinds)
        space = kinds == SPACE
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        if len(raw) == len(codes):
            offset = np.arange(len(codes) + 1)
        else:
            offset = np.r_[0, np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))]
        first = np.flatnonzero(starts)
        border = np.flatnonzero(starts | space)
        last = border[np.searchsorted(border, first, side="right")]  # a piece ends at the next piece or white space
        at = offset[first]
        one, number = distinct(raw, at, offset[last] - at)
        counts = self.counter.count(raw, at[one], (offset[last] - at)[one])[number]
        ends = np.cumsum([len(v) + 1 for v in values])
        running = np.r_[0, np.cumsum(counts)]
        return np.diff(running[np.r_[0, np.searchsorted(first, ends)]])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``. A map without shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for keys, values in slices(batches, 2_000_000):
            n = own.count(values)
            yield arrow_rows(keys, schema, n_bytes=[len(v.encode()) for v in values], n_tokens=n, over_limit=n > limit)

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
