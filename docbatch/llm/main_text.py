"""Operator 4: main text of web pages by a site style tree.

The different pages of a host are merged into one tree; copies of a page's text count once. A node is a path
of tag and class names from the root. It has presentations (the sequences of children that pages show there)
and contents (hashes of all text in the branch). The presentation importance of a node is the entropy of its
presentations over the host's pages, its content importance that of its contents: text that every page
repeats has importance 0, text of one page alone 1. A content has an importance of its own too, by the share
of the pages that show it. Shares are taken as if ``UNSEEN`` more pages had other contents, so that the
evidence of a few pages weighs little and grows with their number. A branch is noise on a page if the
importance of its content is below ``THRESHOLD`` and so is that of its node, or half of the pages that have
the node show that content. So a page's own text stays where other pages repeat something.

Menus, adverts and footers may have other words on every page, but they keep their shape. So a node also has shapes:
the magnitude of its text, and the share of it in links. Beside the branch that holds most of a page, a box outside articles
and main parts is noise if, over the pages, it holds little of their text and most of that is links, or its shapes have an
entropy below ``SHAPE_BITS``. A host with few pages leans on what all hosts' pages show at the same node.

Nodes whose name alone says what they are need no statistics: menus, headers, footers, side bars, forms,
scripts, styles, adverts, notices and reader comments have importance 0, an article or main part has
importance 1 and is kept whole but for branches of the first kind inside it. Where a page has such a
part, the text is what the tree leaves of that part, elsewhere of the body. The tree leaves
words within a sentence alone, and inside such a part headings, list items and cells, unless a whole box around
them goes. A name is a whole token of
class or id ("sidebar", "site-header", not "with-sidebar" or "post-header"), and it yields to what the branch
holds: see ``settle``.

Pages are read in one pass from left to right, in time that follows their length however broken they are. Counts are
aggregated by (host, node, value) before they meet, so a host that holds a third of all pages is
spread like any other, and no page is gathered with others. The list of noise nodes goes to all
executors while it is below ``BROADCAST_NODES`` rows; beyond that pages join it by host, and those of hosts with
many pages get their host's list where they are.

Defined results: null and empty html give an empty text; unclosed and stray tags are taken as browsers
do for paragraphs and lists; a comment without an end goes to the next ">", a tag without an end is text; pages of any length
are read whole; repeated pages each give their text; a null
url makes a host of its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.common import join_counted, staged
from docbatch.plans.staging import staged_with

THRESHOLD = 0.3
#: Pages with other contents that every node is taken to have besides those seen.
UNSEEN = 3
#: Weight of a node's presentation beside its content.
PRESENTATION = 0.3
BROADCAST_NODES = 200_000
#: Entropy of shapes below which a box is noise, the share of the text that it holds at most, and the share in links that needs no entropy.
SHAPE_BITS, SHAPE_SHARE, LINK_SHARE = 2.0, 0.3, 0.5
#: Pages of all hosts that count beside a host's own, at most, and pages that make evidence.
PRIOR_PAGES, LEAST_PAGES = 5, 5

# Fixed values of HTML: what ends a block, what has no content, and what never shows as text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
#: Elements whose content is no markup up to their end tag; in the second kind character references count.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_TEXT = frozenset("textarea title".split())
#: Tags and roles that name the main part of a page, the second kind may occur more than once.
MAIN = {"main": 2, "article": 1}
#: Tags, roles and words of class or id that name a part of a page by its purpose.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
NOISE_WORDS = frozenset("ad ads banner breadcrumb breadcrumbs comment comments consent disqus footer header masthead menu nav navbar navigation newsletter popup related replies respond share sharing sidebar social subscribe toolbar widget".split())
NOISE_STEMS = ("advert", "cookie", "notice", "promo", "sponsor")
#: Words that may stand beside those in a token without changing what it names ("site-header", "comment-list").
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container content form global icons inner item items left line link links list main media outer page panel post posts primary right secondary section side signup site slot text top unit wrap wrapper".split())
#: Of the tokens with such words, those that name a part of the content ("post-header", "page-header").
CONTENT_TOKEN = re.compile(r"(?:page|post|posts|content|section|block|item|box|panel|media|list|inner|form)[-_]+(?:header|banner|masthead)")
TOP_WORDS = frozenset(("header", "masthead", "banner"))
READER_WORDS = frozenset("comment comments disqus replies respond".split())
#: Blocks that are entries of something larger: what many pages call a row of a table is no noise in itself.
ENTRIES = frozenset("li dt dd tr td th thead tbody tfoot caption figcaption legend option optgroup summary h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPH, AROUND_PARAGRAPHS = frozenset(("p",)), frozenset(("td", "th", "table", "button", "caption", "object"))
CLOSE_PARAGRAPH = BLOCKS - {"html", "body", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "optgroup", "option", "legend"}

SEPARATOR = "\n\n"


class Node:
    __slots__ = ("tag", "name", "parent", "children", "noise", "main", "inside")

    #: ``noise`` is empty, "hidden", "reader" (comments of readers) or "named"; ``main`` is 2 for a main part, 1 for an article.
    def __init__(self, tag: str, name: str, parent: Node | None, noise: str, main: int):
        self.tag, self.name, self.parent, self.noise, self.main = tag, name, parent, noise, main
        self.inside = parent is not None and bool(parent.main or parent.inside)  # within a main part or article
        self.children: list[Node | str] = []


def noise_words(names: str) -> set[str]:
    """The noise words among the tokens of class and id. A token counts if all its words are noise words or plain ones."""
    found: set[str] = set()
    for token in names.lower().split():
        words = [w for w in re.split(r"[-_]+", token) if w]
        noise = {w for w in words if w in NOISE_WORDS or w.startswith(NOISE_STEMS)}
        if (noise and all(w in noise or w in PLAIN_WORDS or w[0].isdigit() for w in words) or token == "side-bar") and not CONTENT_TOKEN.fullmatch(token):
            found |= noise or {"sidebar"}
    return found


_TAG = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_STOP = re.compile(r"""[>"']""")
_END_TAGS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW | RAW_TEXT}


class Scanner:
    """Places of strings in a page, going forward; what is found, or not, is not looked for again."""

    def __init__(self, html: str):
        self.html, self.seen = html, {}

    def find(self, what: str, start: int) -> int:
        """The first place of ``what`` from ``start`` on, -1 if there is none."""
        at = self.seen.get(what)
        if at is None or 0 <= at < start:
            at = self.seen[what] = self.html.find(what, start)
        return at

    def end_of(self, tag: str, start: int) -> int:
        """The first end tag, in any case of letters."""
        at = self.seen.get(tag)
        if at is None or 0 <= at < start:
            found = _END_TAGS[tag].search(self.html, start)
            at = self.seen[tag] = found.start() if found else -1
        return at

    def tag_end(self, start: int) -> int:
        """Where the tag ends that ``start`` is in: at the first ">" outside quotes, or at any if a quote does not end; -1 if there is none."""
        end = self.find(">", start)
        if end < 0 or ('"' not in (inside := self.html[start:end]) and "'" not in inside):
            return end
        at, equals = start, self.html
        while m := _STOP.search(self.html, at):
            if m[0] == ">":
                return m.start()
            # a quote begins a value only after an equals sign
            if equals[start : m.start()].rstrip()[-1:] != "=" if m.start() - start < 200 else equals[m.start() - 200 : m.start()].rstrip()[-1:] != "=":
                at = m.end()
                continue
            close = self.find(m[0], m.end())
            if close < 0:
                return self.find(">", m.end())
            at = close + 1
        return -1


class TreeBuilder:
    """A page as a tree of nodes and strings."""

    def __init__(self) -> None:
        self.root = self.now = Node("", "", None, "", 0)
        self.open: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain

    def feed(self, html: str) -> None:
        scan, at, n = Scanner(html), 0, len(html)
        while at < n:
            lt = scan.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.handle_data(unescape(html[at:lt]))
            if lt == n:
                return
            if html.startswith("<!--", lt):
                end = scan.find("-->", lt + 2)
                end, step = (end, 3) if end >= 0 else (scan.find(">", lt), 1)
                at = end + step if end >= 0 else n
            elif html.startswith(("<!", "<?"), lt):
                end = scan.find(">", lt)
                at = end + 1 if end >= 0 else n
            elif (m := _TAG.match(html, lt + 1)) and (end := scan.tag_end(m.end())) >= 0:
                at = end + 1
                if m[0][0] == "/":
                    self.handle_endtag(m[0][1:].lower())
                else:
                    at = self._started(m[0].lower(), html[m.end() : end], at, scan)
            else:
                self.handle_data("<")
                at = lt + 1

    def _started(self, tag: str, body: str, at: int, scan: Scanner) -> int:
        """Takes a start tag, and the content of an element without markup; gives the place after it."""
        values: dict[str, str] = {}
        if body:
            for name, double, single, bare in _ATTRIBUTE.findall(body):
                values.setdefault(name.lower(), unescape(double or single or bare))
        self.handle_starttag(tag, values)
        if body and body.rstrip().endswith("/") and tag not in VOID and tag not in RAW and tag not in RAW_TEXT:
            self.handle_endtag(tag)
        elif tag in RAW or tag in RAW_TEXT:
            end = scan.end_of(tag, at)
            end = len(scan.html) if end < 0 else end
            if end > at:
                self.handle_data(unescape(scan.html[at:end]) if tag in RAW_TEXT else scan.html[at:end])
            return end
        return at

    def handle_starttag(self, tag: str, values: dict[str, str]) -> None:
        if tag in CLOSE_PARAGRAPH and self.open["p"]:
            self._close(PARAGRAPH, AROUND_PARAGRAPHS)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        if values:
            words = f"{values.get('class') or ''} {values.get('id') or ''}".strip()
            role = (values.get("role") or "").lower()
            main = max(MAIN.get(tag, 0), MAIN.get(role, 0))
            noise = self._noise(tag, role, words, values, main)
        else:
            words, main = "", MAIN.get(tag, 0)
            noise = self._noise(tag, "", "", values, main) if tag in HIDDEN or tag in NOISE_TAGS or tag == "header" else ""
        node = Node(tag, f"{tag}.{words}" if words else tag, self.now, noise, main)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def _noise(self, tag: str, role: str, words: str, values: dict[str, str | None], main: int) -> str:
        if tag in HIDDEN or "hidden" in values or values.get("aria-hidden") == "true":
            return "hidden"
        top = tag == "header" or role == "banner"
        named = noise_words(words) if words and not main and tag not in ("html", "body") else set()
        if not (top or named or tag in NOISE_TAGS or role in NOISE_ROLES):
            return ""
        # an article's own header and headings hold its titles; all other such parts are noise there too
        inside = bool(self.now.main or self.now.inside)
        if tag in HEADINGS:
            named = set() if inside else named - TOP_WORDS
        elif inside and (top or named & {"header", "masthead"}):
            named, top = named - TOP_WORDS, False
            return ("reader" if named & READER_WORDS else "named") if named else ""
        if named & READER_WORDS:
            return "reader"
        return "named" if top or named or tag in NOISE_TAGS or role in NOISE_ROLES else ""

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Closes the innermost open element with one of the tags, if no element with a tag of ``stop`` is between."""
        if not any(self.open[t] for t in tags):
            return
        node = self.now
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def _leave(self, node: Node) -> None:
        while self.now is not node.parent:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:  # the end of no paragraph is an empty one
            self.handle_starttag("p", {})
        node = self.now
        while self.open[tag] and node.parent is not None:
            if node.tag == tag:
                self._leave(node)
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parsed(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    settle(builder.root)
    return builder.root


def settle(root: Node) -> None:
    """Takes the mark of noise from branches whose content says otherwise.

    A branch that holds a <main> is never noise by its name, nor one that holds an article while no other
    article or main part stands outside noise (a teaser list or a comment may be an article too). Nor is a
    branch with more than half of the text outside links of its scope: of the page where that has no such
    part, else of its main part, where comments of readers may well be longer than the article and still go.
    """
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        if node.noise != "hidden":
            work.extend(c for c in node.children if isinstance(c, Node))
    if not any(node.noise in ("named", "reader") for node in order):
        return
    chars: dict[Node, int] = {}
    holds: dict[Node, int] = {}  # the greatest ``main`` in the branch
    for node in reversed(order):
        shown = node.noise != "hidden"
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) if shown and node.tag != "a" else 0
        below = [c for c in node.children if isinstance(c, Node) and c.noise != "hidden"] if shown else []
        chars[node] = own + (sum(chars[c] for c in below) if node.tag != "a" else 0)
        holds[node] = max([node.main, *(holds[c] for c in below)]) if shown else 0
    parts = main_parts(root)
    if holds[root] == 2 or (holds[root] and not parts):
        for node in order:
            if node.noise in ("named", "reader") and (holds[node] == 2 or (holds[node] and not parts)) and not node.inside:
                node.noise = ""
        parts = main_parts(root)
    for scope in parts or [root]:
        whole = chars[scope]
        work = [scope]
        while work:
            node = work.pop()
            if 2 * chars[node] <= whole:
                continue
            if node.noise == "named" or (node.noise == "reader" and not parts):
                node.noise = ""
            if node.noise == "":
                work.extend(c for c in node.children if isinstance(c, Node))


def blocks(node: Node) -> list[str]:
    """The text of a branch, block by block, without its noise; white space inside a block is one space."""
    out: list[str] = []
    inline: list[str] = []

    def end() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            out.append(text)

    work: list[Node | str | None] = [node]
    while work:
        item = work.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            inline.append(item)
        elif item is not node and item.noise:
            if item.tag in BLOCKS:
                end()
        elif item.tag == "br":
            inline.append(" ")
        else:
            if item.tag in BLOCKS:
                end()
                work.append(None)
            work.extend(reversed(item.children))
    end()
    return out


def main_parts(root: Node) -> list[Node]:
    """The outermost article or main nodes outside noise."""
    found, work = [], [root]
    while work:
        node = work.pop()
        if node.noise:
            continue
        if node.main:
            found.append(node)
        else:
            work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def contents(root: Node) -> dict[Node, int]:
    """The hash of all text in each branch, without its noise; branches without text are missing."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    found: dict[Node, int] = {}
    for node in reversed(order):
        said = [" ".join(c.split()) if isinstance(c, str) else str(found.get(c, "")) for c in node.children]
        if any(said):
            found[node] = xxhash.xxh3_64_intdigest("\n".join(filter(None, said))) >> 1
    return found


def tree_nodes(root: Node, content: dict[Node, int]) -> Iterator[tuple[Node, int, int]]:
    """(node, path, kind) of the branches that the tree may judge: kind 1 by their node only, 2 also by the share of pages."""
    work = [(root, 0, False, False)]
    while work:
        node, path, inside, in_prose = work.pop()
        if node not in content:
            continue
        box = node.tag in BLOCKS and node.tag not in ENTRIES
        if not node.main and node.tag not in ("", "html", "body") and not (inside and node.tag in HEADINGS):
            if box:
                yield node, path, 2
            elif (not inside or (node.tag not in BLOCKS and "." in node.name)) and (node.tag in BLOCKS or not in_prose):
                yield node, path, 1
        prose = any(isinstance(c, str) and not c.isspace() for c in node.children)
        work.extend((c, xxhash.xxh3_64_intdigest(c.name, seed=path), inside or bool(node.main), prose) for c in node.children if isinstance(c, Node) and not c.noise)


def noise_key(path: int, kind: int, content: int) -> int:
    """A key of a branch; odd for one that is noise by its shapes."""
    return xxhash.xxh3_64_intdigest(f"{path} {kind} {content}") >> 1 & ~1 | (kind == SHAPE)


#: Kind of a node that is noise by its shapes.
SHAPE = 4


def shapes(root: Node) -> Iterator[tuple[Node, int, int, int, int]]:
    """(node, path, magnitude, tenths in links, tenths of the page) of boxes outside main parts, beside the branch that holds most of the page.

    Beside paragraphs, headings or bare text a box is part of what they say.
    """
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(c for c in node.children if isinstance(c, Node) and node.noise != "hidden")
    chars: dict[Node, int] = {}
    links: dict[Node, int] = {}
    for node in reversed(order):
        below = [c for c in node.children if isinstance(c, Node)]
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) if node.noise != "hidden" else 0
        chars[node] = own + sum(chars.get(c, 0) for c in below)
        links[node] = chars[node] if node.tag == "a" else sum(links.get(c, 0) for c in below)
    whole = chars[root]
    at, path = root, 0
    while whole and not at.main and not any(c.tag == "p" or c.tag in HEADINGS if isinstance(c, Node) else not c.isspace() for c in at.children):
        most = None
        for c in at.children:
            if isinstance(c, Node):
                own_path = xxhash.xxh3_64_intdigest(c.name, seed=path)
                if 2 * chars.get(c, 0) > chars[at]:
                    most = c, own_path
                elif chars.get(c, 0) and c.tag in BLOCKS and c.tag not in ENTRIES and c.tag != "p" and not c.main:
                    yield c, own_path, chars[c].bit_length(), 10 * links[c] // chars[c], 10 * chars[c] // whole
        if most is None:
            return
        at, path = most


def main_text(html: str, noise: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text; ``noise`` are the keys of the branches that the host's tree found to be noise."""
    if not html:
        return ""
    root = parsed(html)
    parts = main_parts(root)
    marked = []
    if any(not k & 1 for k in noise):
        content = contents(root)
        marked = [node for node, path, kind in tree_nodes(root, content) if noise_key(path >> 1, kind, content[node]) in noise]
    if noise and not parts:  # shapes say nothing of what a main part holds
        marked += [node for node, path, *_ in shapes(root) if not node.noise and noise_key(path >> 1, SHAPE, 0) in noise]
    parts = parts or [root]
    for node in marked:
        node.noise = "tree"
    left = [b for part in parts for b in blocks(part)]
    if not left and marked:  # a host whose pages all say the same leaves nothing; then the names alone decide
        for node in marked:
            node.noise = ""
        left = [b for part in parts for b in blocks(part)]
    return SEPARATOR.join(left)


def style_nodes(html: str) -> tuple[int, set[tuple[int, int, int]], set[tuple[int, int]]]:
    """The hash of the page's text; (path, kind, value): presentations (0) and contents (1, 2) of its nodes, and the nodes (3); and (path, shape)."""
    root = parsed(html)
    content = contents(root)
    page = xxhash.xxh3_64_intdigest(" ".join(str(content.get(part, "")) for part in main_parts(root) or [root])) >> 1
    rows = set()
    for node, path, kind in tree_nodes(root, content):
        look = xxhash.xxh3_64_intdigest(" ".join(c.name for c in node.children if isinstance(c, Node))) >> 1
        rows |= {(path >> 1, 0, look), (path >> 1, kind, content[node]), (path >> 1, 3, 0)}
    return page, rows, {(path >> 1, (size << 8) | (linked << 4) | share) for _, path, size, linked, share in shapes(root)}


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _shape_noise(shaped: DataFrame) -> DataFrame:
    """(host, path, kind, value, importance) of nodes that are noise by their shapes, from (host, path, value, k): how many pages have a shape.

    All hosts' pages count beside a host's own, with a weight of ``PRIOR_PAGES`` at most.
    """
    own = shaped.groupBy("host", "path", "value").agg(F.sum("k").cast("double").alias("k"))
    every = own.groupBy("path", "value").agg(F.sum("k").alias("k"))
    totals = every.groupBy("path").agg(F.sum("k").alias("n"))
    prior = every.join(totals, "path").select("path", "value", (F.col("k") * F.least(F.lit(1.0), PRIOR_PAGES / F.col("n"))).alias("k"))
    both = own.unionByName(own.select("host", "path").distinct().join(prior, "path").select("host", "path", "value", "k"))
    parts = both.groupBy("host", "path", F.shiftright("value", 8).alias("size")).agg(
        F.sum("k").alias("k"), F.sum(F.col("k") * F.shiftright("value", 4).bitwiseAND(15) / 10).alias("linked"), F.sum(F.col("k") * F.col("value").bitwiseAND(15) / 10).alias("share")
    )
    k = F.sum("k")
    bits = (F.log2(k) - F.sum(F.col("k") * F.log2("k")) / k).alias("bits")
    nodes = parts.groupBy("host", "path").agg(k.alias("k"), bits, (F.sum("linked") / k).alias("linked"), (F.sum("share") / k).alias("share"))
    noisy = nodes.filter((F.col("k") >= LEAST_PAGES) & (F.col("share") <= SHAPE_SHARE) & ((F.col("linked") >= LINK_SHARE) | (F.col("bits") < SHAPE_BITS)))
    return noisy.select("host", "path", F.lit(SHAPE).alias("kind"), F.lit(0).cast("long").alias("value"), F.col("share").alias("importance"))


def noise_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html", unseen: int = UNSEEN, threshold: float = THRESHOLD) -> DataFrame:
    """(host, key, importance): branches of each host's tree that are noise."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("page", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, shaped = [], Counter()
                for host, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    page, seen, shape = style_nodes(html.as_py())
                    rows += [(host, *s, page) for s in seen]
                    shaped.update((host, *s) for s in shape)
                # of shapes only sums go on: their number stands in the place of the page
                rows += [(host, path, SHAPE, value, k) for (host, path, value), k in shaped.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = [noise_key(*k) for k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(named, pa.int64()), b.column(4)], names=["host", "key", "importance"])

    read = pages.filter(F.length(html_col) > 0).select(host_of(F.col(url_col)).alias("host"), html_col)
    seen = read.mapInArrow(run, "host string, path long, kind int, value long, page long")
    # of contents a page counts once, however often its text is there; of shapes the numbers are added up
    apart = F.when(F.col("kind") == SHAPE, F.lit(0)).otherwise(F.col("page"))
    once = seen.groupBy("host", "path", "kind", "value", apart.alias("apart")).agg(F.sum(F.when(F.col("kind") == SHAPE, F.col("page"))).alias("sum"))
    k = F.sum(F.when(F.col("kind") == SHAPE, F.col("sum")).otherwise(F.lit(1)))
    counts = staged(once.groupBy("host", "path", "kind", "value").agg(k.alias("k")), "style-tree")
    shaped = counts.filter(F.col("kind") == SHAPE).select("host", "path", "value", "k")
    counts = counts.filter(F.col("kind") != SHAPE)
    # entropy of a node's presentations, or contents, in units of its greatest value; both from sums over counts
    k_log_k = F.col("k") * F.log(F.col("k").cast("double"))

    def entropy(of: F.Column) -> F.Column:
        m = F.sum(F.when(of, F.col("k"))).cast("double") + unseen
        return 1 - F.coalesce(F.sum(F.when(of, k_log_k)), F.lit(0.0)) / m / F.log(m)

    kind = F.col("kind")
    nodes = counts.groupBy("host", "path").agg(F.max(F.when(kind == 3, F.col("k"))).alias("pages"), entropy(kind == 0).alias("look"), entropy(kind.isin(1, 2)).alias("content"))

    def importance(content: F.Column) -> F.Column:
        return F.lit(PRESENTATION) * F.col("look") + F.lit(1 - PRESENTATION) * content

    own = importance(1 - F.log(F.col("k").cast("double")) / F.log(F.col("pages") + F.lit(float(unseen))))
    often = (kind == 2) & (2 * F.col("k") >= F.col("pages"))
    judged = counts.filter(kind.isin(1, 2) & (F.col("k") > 1)).join(nodes, ["host", "path"])
    judged = judged.withColumn("importance", own).filter((F.col("importance") < threshold) & (often | (importance(F.col("content")) < threshold)))
    judged = judged.select("host", "path", "kind", "value", "importance").unionByName(_shape_noise(shaped))
    return judged.mapInArrow(keys, "host string, key long, importance double")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    noise, seen = staged_with(noise_nodes(pages, url_col, html_col), "noise-nodes")
    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    by_host = noise.groupBy("host").agg(F.collect_list("key").alias("keys"))  # branches of one host's templates
    if seen["n"] <= BROADCAST_NODES:
        joined = read.join(F.broadcast(by_host), "host", "left")
    else:
        sizes, total = staged_with(read.groupBy("host").agg(F.count(F.lit(1)).alias("m")), "hosts", rows=F.sum("m"))
        joined = join_counted(read, sizes.join(by_host, "host", "left"), "host", "m", total["rows"], "left")
    joined = joined.select("id", "url", "html", "keys")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [main_text(h.as_py(), frozenset(p.as_py() or ())) for h, p in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], schema=schema)

    return joined.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
