"""Operator 7: secret scans by a recursive decoding worklist.

Each text is a first layer. A layer is scanned for secrets, then what is encoded in it is unwrapped into
layers of its own, which join the worklist:

* Escapes (percent escapes, and Unicode escapes with numeric character references): each stretch of words that holds
  some, with the words that a key or a value may stand in beside them, is decoded until none are left, by percent escapes
  alone, Unicode escapes alone, and both. A character that an escape gives may complete another one, at once and to
  any depth, in one pass from left to right; so the work follows the length, however deeply escapes are nested.
* Base64, also wrapped over lines: a run may begin with other characters of its alphabet (a path, a prefix and a dash), so it
  is decoded at all four alignments.
* Compressed data inside base64, wherever its first bytes stand: zlib, gzip, bz2, xz, all members to their end; and bare
  deflate, which has no such bytes, from the start of a run and after each "/", "+", "-" and "_" of its first ``LEAD`` characters.

The list is worked until it is empty: a layer that was unwrapped before from the same stretch is not unwrapped
again, in whatever order its decoders came, so cycles end and the work follows the number of different layers. Inflated
data is scanned in windows of about ``max_inflated`` characters, each cut where no secret and no encoded stretch can
continue; a window grows as long as there is no such place. Bytes that are no text are scanned too, as far as they
can be read. Each character of a layer of escapes knows its place in the first text, so a finding there is mapped to the
characters it came from; one inside base64 is mapped to the whole run, no part of which can be cut out without
spoiling the rest.

Defined results: null and empty text have no findings; a text of any length is scanned whole; equal
spans of one kind count once; rows are independent, so ties and repeated rows need no rule; an empty
table gives an empty result; extra columns are not read or, in ``redact``, passed through.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import arrow_rows, slices, texts

KINDS = ("assign", "access", "hex")
# The patterns of the contract, with their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
LEAST_VALUE = 12

#: Runs of the base64 alphabet, and escapes.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: A character reference up to its semicolon, at the end of at most so many characters.
_REFERENCE = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}))\Z")
_REFERENCE_LENGTH = 9
#: What a word beside a blank starts or ends with if a key, sign or value may stand on both sides of the blank.
_OPEN = frozenset(":=\"'%\\&")
#: Characters of escapes, also of those that decoding gives.
_ESCAPING = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz%\\&#;"
_WORD = re.compile(r"\S+")
_ENCODED_LINE = re.compile(r"[A-Za-z0-9+/_=%-]{16,}")
#: What may stand between two lines of one base64 text, and such a text's last line.
_WRAP = re.compile(r"[ \t]*\r?\n[ \t]*")
_LAST_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?![A-Za-z0-9+/_=-])")
_SEPARATOR = re.compile(r"[+/_-]")
#: What every text with something to unwrap has.
_HINT = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]|&#|[A-Za-z0-9+/_-]{16}")
#: Characters that belong to no finding and no encoded stretch, also none wrapped over lines.
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=:"'%&#;\\\s-]""")
#: Bytes that a finding or an encoded stretch needs, at least.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
# The first bytes of gzip, zlib, bz2 and xz data.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00", re.DOTALL)
#: Bytes by which most data that is not compressed shows itself.
PROBE = 512
#: Characters at the start of a run of base64 after whose separators bare deflate may begin.
LEAD = 512

MAX_INFLATED = 4_000_000
#: Bytes that are inflated at once.
CHUNK = 1 << 20

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """Base findings of one layer: (start, end, kind), leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _inflated(make: Callable[[], object], data: bytes) -> Iterator[bytes]:
    """One member in pieces, and then the rest of the data as the generator's value; None if nothing could be inflated."""
    stream, left, any_out = make(), data, False
    try:
        while not stream.eof:
            out = stream.decompress(left, CHUNK)
            # zlib hands back what it has not used, the others keep it
            left = getattr(stream, "unconsumed_tail", b"")
            any_out |= bool(out)
            if out:
                yield out
            elif not left and not stream.eof:
                break
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None  # what came before counts
    return stream.unused_data if stream.eof else b"" if any_out else None


def _maker(data: bytes, at: int) -> Callable[[], object]:
    if data.startswith(b"BZh", at):
        return bz2.BZ2Decompressor
    if data.startswith(b"\xfd7zXZ\x00", at):
        return lzma.LZMADecompressor
    return lambda: zlib.decompressobj(zlib.MAX_WBITS | 32)


def _bare_maker() -> object:
    return zlib.decompressobj(-zlib.MAX_WBITS)


def _streams(data: bytes, starts: Iterable[int]) -> Iterator[Iterator[bytes]]:
    """The content of each compressed stream in the data, in pieces. Bare deflate is looked for at ``starts``."""
    places = {m.start(): _maker(data, m.start()) for m in _MAGIC.finditer(data)}
    places |= {at: _bare_maker for at in starts if at not in places and at < len(data)}
    done = 0
    for at, make in sorted(places.items(), key=lambda p: p[0]):
        if at < done:
            continue
        try:
            make().decompress(data[at : at + PROBE], 64)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            continue
        rest = data[at:]
        if make is _bare_maker and not _bare(rest):
            continue
        left: list[bytes | None] = []

        def pieces(make=make, rest=rest, left=left) -> Iterator[bytes]:
            left.append((yield from _inflated(make, rest)))

        yield pieces()
        if left and left[0] is not None:
            done = len(data) - len(left[0])


def _bare(data: bytes) -> bool:
    """Whether the data is one deflate stream without a header, to its last byte, and no text as it is."""
    stream = zlib.decompressobj(-zlib.MAX_WBITS)
    try:
        left = data
        while not stream.eof:
            out = stream.decompress(left, CHUNK)
            left = stream.unconsumed_tail
            if not out and not left:
                return stream.eof and not stream.unused_data
        return not stream.unused_data
    except zlib.error:
        return False


def _windows(pieces: Iterable[bytes], window: int) -> Iterator[str]:
    """The text of the pieces, cut only where nothing can continue."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[str] = []
    size, least = 0, window
    for piece in pieces:
        held.append(decoder.decode(piece))
        size += len(held[-1])
        if size >= least:
            text = "".join(held)
            cut = next((m.end() for at in range(len(text) - 1, -1, -1) if (m := _BREAK.match(text, at))), 0)
            if cut:
                yield text[:cut]
            held, size = [text[cut:]], len(text) - cut
            least = max(window, 2 * size)  # a run without a cut is looked at again when it has doubled
    held.append(decoder.decode(b"", True))
    yield "".join(held)


def unwrap(stretch: str, window: int = MAX_INFLATED) -> Iterator[str]:
    """The texts inside a base64 stretch, in windows: at each alignment the bytes as they are, and what they hold compressed."""
    body = stretch.rstrip("=").replace("-", "+").replace("_", "/")
    after = [m.end() for m in _SEPARATOR.finditer(body, 0, LEAD)]
    for shift in range(4):
        part = body[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if _READABLE.search(data):
            yield from _windows([data], window)
        for pieces in _streams(data, ((at - shift) // 4 * 3 for at in [shift, *after] if at % 4 == shift)):
            yield from _windows(pieces, window)


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


#: Stands for a byte of a UTF-8 sequence that is not yet whole; no text has such characters.
_BYTE = 0xDC00


def _whole_character(out: list[str]) -> tuple[int, str]:
    """The UTF-8 sequence of bytes at the end of ``out``: how many places it takes, 0 if it is not whole, and its character."""
    codes: list[int] = []
    while len(codes) < min(4, len(out)) and 0x80 <= ord(out[-1 - len(codes)]) - _BYTE <= 0xFF:
        codes.insert(0, ord(out[-1 - len(codes)]) - _BYTE)
        if codes[0] >= 0xC0:
            try:
                return len(codes), bytes(codes).decode()
            except UnicodeDecodeError:
                return 0, ""
    return 0, ""


def unescaped(text: str, url: bool, uni: bool) -> tuple[str, list[int], list[int]]:
    """The text without its escapes, also those that decoding gives; and where each character starts and ends in ``text``."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    digits = _HEX_DIGITS
    for at, c in enumerate(text):
        out.append(c), starts.append(at), ends.append(at + 1)
        while True:
            n, new, size = 0, "", len(out)
            if c in digits:
                if url and size > 2 and out[-3] == "%" and out[-2] in digits:
                    code = int(out[-2] + c, 16)
                    n, new = 3, chr(code if code < 0x80 else _BYTE + code)
                elif uni and size > 3 and out[-2] in digits:
                    if out[-3] == "x" and out[-4] == "\\":
                        n, new = 4, _char(int(out[-2] + c, 16))
                    elif size > 5 and out[-5] == "u" and out[-6] == "\\" and out[-3] in digits and out[-4] in digits:
                        n, new = 6, _char(int("".join(out[-4:]), 16))
            elif c == ";":
                if uni and (m := _REFERENCE.search("".join(out[-1 - _REFERENCE_LENGTH : -1]))):
                    n, new = len(m[0]) + 1, _char(int(m[1]) if m[1] else int(m[2], 16))
            elif 0x80 <= ord(c) - _BYTE <= 0xFF:
                n, new = _whole_character(out)
            if not n:
                break
            start, end = starts[-n], ends[-1]
            del out[-n:], starts[-n:], ends[-n:]
            c = new
            out.append(c), starts.append(start), ends.append(end)
    return "".join("\ufffd" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in out), starts, ends


def _joined(left: str, gap: str, right: str) -> bool:
    """Whether a finding, or base64 over two lines, may go over the gap between two words."""
    if gap.strip(" ") == "":
        before = left.rstrip(_ESCAPING)
        tail = left[len(before) :]
        return right[0] in _OPEN or before[-1:] in (":", "=", '"', "'") or "%" in tail or "\\" in tail or "&" in tail
    return bool(_WRAP.fullmatch(gap) and _ENCODED_LINE.fullmatch(left) and re.fullmatch(r"[A-Za-z0-9+/_=%-]+", right))


def escaped_stretches(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, percent escapes, Unicode escapes): words with escapes and the words that belong to them."""
    start = end = -1
    last, url, uni = "", False, False
    for m in _WORD.finditer(text):
        word = m[0]
        if start < 0 or not _joined(last, text[end : m.start()], word):
            if url or uni:
                yield start, end, url, uni
            start, url, uni = m.start(), False, False
        end, last = m.end(), word
        url = url or "%" in word and bool(_PERCENT.search(word))
        uni = uni or ("\\" in word or "&#" in word) and bool(_ESCAPE.search(word))
    if url or uni:
        yield start, end, url, uni


class Layer:
    """A text, and where its places are in the first text: as they are, by lists, or all in one stretch."""

    __slots__ = ("ends", "starts", "stretch", "text")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, stretch: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.stretch = text, starts, ends, stretch

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.stretch:
            return self.stretch
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def key(self) -> tuple[int, int, bytes]:
        """What the layer holds, and the stretch of the first text that it came from."""
        return *self.place(0, len(self.text)), xxhash.xxh3_128_digest(self.text.encode("utf-8", "surrogatepass"))

    def scan(self) -> Iterator[Span]:
        """Findings with their places in the first text."""
        yield from ((*self.place(a, b), kind) for a, b, kind in scan(self.text))

    def below(self, window: int) -> Iterator[Layer]:
        text = self.text
        if "%" in text or "\\" in text or "&#" in text:
            for a, b, url, uni in escaped_stretches(text):
                for kinds in {(url, uni), (url, False), (False, uni)} - {(False, False)}:
                    yield self._unescaped(a, text[a:b], *kinds)
        for text, a, b in base64_stretches(self.text):
            at = self.place(a, b)
            for inner in unwrap(text, window):
                if inner:
                    yield Layer(inner, stretch=at)

    def _unescaped(self, offset: int, source: str, url: bool, uni: bool) -> Layer:
        text, starts, ends = unescaped(source, url, uni)
        if self.stretch:
            return Layer(text, stretch=self.stretch)
        if self.starts is None:
            return Layer(text, [s + offset for s in starts], [e + offset for e in ends])
        return Layer(text, [self.starts[s + offset] for s in starts], [self.ends[e + offset - 1] for e in ends])


def base64_stretches(layer: str) -> Iterator[tuple[str, int, int]]:
    """(base64 text, start, end): runs of the alphabet, and neighbouring lines of such runs joined."""
    run: list[tuple[int, int]] = []
    for m in _BASE64.finditer(layer):
        yield m[0], m.start(), m.end()
        if run and not _WRAP.fullmatch(layer, run[-1][1], m.start()):
            yield from _joined_lines(layer, run)
            run = []
        run.append(m.span())
    if run:
        yield from _joined_lines(layer, run)


def _joined_lines(layer: str, lines: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """The run as a whole, with and without its last line, and the parts of equal lines with the line after them.

    The first and the last line may be words of the text around.
    """
    if last := _LAST_LINE.match(layer, lines[-1][1]):
        lines = [*lines, last.span(1)]
    found = {(0, len(lines)), (0, len(lines) - 1)}
    at = 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or lines[k][1] - lines[k][0] != lines[at][1] - lines[at][0]:
            found |= {(at, k), (at, min(k + 1, len(lines)))}
            at = k
    for a, b in sorted(found):
        if b - a > 1:
            yield "".join(layer[x:y] for x, y in lines[a:b]), lines[a][0], lines[b - 1][1]


def layers(text: str, window: int = MAX_INFLATED) -> Iterator[Layer]:
    """Every layer below the text, each once. Of what is inflated, one window is held at a time."""
    first = Layer(text)
    seen, work = {first.key()}, [first.below(window)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            yield layer
            work.append(layer.below(window))


def findings(text: str, most: int = MAX_INFLATED) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the second adds those that only a lower layer shows."""
    base = scan(text)
    if not _HINT.search(text):
        return sorted(base, key=_order), sorted(set(base), key=_order)
    deep = {span for layer in layers(text, most) for span in layer.scan()}
    return sorted(base, key=_order), sorted(set(base) | deep, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = MAX_INFLATED) -> DataFrame:
    """Counts of base findings, digest of the base spans and all spans for every row. A map without shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in slices(batches):
            found = [findings(v, max_inflated) for v in values]
            counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield arrow_rows(keys, schema, **counts, base_sha256=digests, spans=[joined(every) for _, every in found])

    return texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with every span replaced; overlapping spans are replaced together."""
    out, done = [], 0
    for start, end, _ in sorted(spans):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", max_inflated: int = MAX_INFLATED) -> DataFrame:
    """``docs`` with all findings, those of lower layers too, replaced in the text; no row is dropped and null stays null."""

    @F.pandas_udf("string")
    def clean(values):
        return values.map(lambda v: v if not v else masked(v, findings(v, max_inflated)[1], mask))

    return docs.withColumn(text_col, clean(F.col(text_col)))
