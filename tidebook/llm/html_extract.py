"""Main text of web pages by tag ratios.

The events of the standard library's HTML parser stream past once: no tree is built. They become lines, one for each run
of text between the borders of block elements, each with its tags and the chain of blocks it stands in. Elements that by
name, role, class or id are menus, headers, notices, forms and the like give no text; their lines stay in the row with a
ratio of 0. A line's ratio is its characters to its tags, smoothed along the page by a Gaussian kernel; lines at or above
``THRESHOLD`` standard deviations of the smoothed ratios are content, and clusters of them tell which region of the page
is its main one:

* the ``article`` elements (else ``main``) that hold a good part of the content, heads of ``main`` before them included;
* on pages without such elements, the deepest block that holds most of the content: all between its first and last
  content line but link lists, and the heads right before it.

Within the region no line is dropped for being short. Lines are trimmed, white space (as Python's ``str.split`` knows
it) in them becomes one space, character references are decoded, and lines are joined by one newline.

Pages are independent, so this is one pass of Arrow batches without a shuffle; a task holds the lines of one page.

Rows: null or empty html gives the empty text; so does a page without text outside menus and the like. Whatever is not
HTML is read as the parser reads it (plain text is one line); what a page cut off in a tag, comment or script leaves open
gives no text. Repeated rows give a row each, an empty table gives an empty one. Other columns stay, except those that
the result names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm.frames import replaced, with_field

#: Names of elements and roles that HTML and ARIA give.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("iframe noembed noframes textarea title xmp".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: No article stands in these; in a form or a page's header one may.
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer head iframe input label legend map math menu meter nav "
    "noembed noframes noscript object optgroup option output progress script search select style svg template textarea title video".split()
)
PASSED = frozenset("form header".split())
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog directory form menu menubar navigation search status tablist toolbar tooltip".split()
)
#: Words of class and id. The first kind tells adverts and readers' comments, the second parts of a page's frame.
FOREIGN = frozenset(
    "ad ads adbox adsense adslot adunit adwrap adzone comment commentary commentform commentlist comments discussion disqus "
    "outbrain popular promo promoted promotion promotions recommendations recommended related replies reply respond responses "
    "sponsor sponsored taboola teaser teasers trending".split()
)
FRAME = frozenset(
    "alert banner breadcrumb breadcrumbs colophon consent cookie cookies copyright disclaimer footer gdpr header login masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall "
    "popup register search share sharing sidebar sidebars signin signup skip social subscribe subscription toolbar topbar widget widgets".split()
)
FOREIGN_BEGIN = ("advert", "comment", "sponsor")
FRAME_BEGIN = ("breadcrumb", "cookie", "newsletter", "sidebar")
#: Before such a word it speaks of the layout around it; beside such a word a header belongs to the article.
LAYOUT = frozenset("has have no non not off show toggle with without".split())
OWN_HEADER = frozenset("article content entry post story".split())

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SIGMA = 1.0
THRESHOLD = 0.75
#: Shares of the content: of all that articles must hold, of the largest article that another must hold, of all that
#: the block of a page without articles must hold.
OF_PAGE, OF_LARGEST, OF_BLOCK = 0.3, 0.25, 0.75


class Element:
    """An open or closed element: what it drops (0 nothing, 1 unless an article begins in it, 2 everything), and the
    nearest block around it."""

    __slots__ = ("tag", "drops", "block", "number", "article")

    def __init__(self, tag: str, drops: int, block: Element | None, number: int, article: Element | None):
        self.tag, self.drops, self.block, self.number, self.article = tag, drops, block, number, article


class Line:
    __slots__ = ("text", "tags", "linked", "block")

    def __init__(self, text: str, tags: int, linked: int, block: Element):
        self.text, self.tags, self.linked, self.block = text, tags, linked, block


def hint(tag: str, names: str) -> int:
    """What class and id say that an element drops."""
    most = 0
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        for k, word in enumerate(words):
            if k and words[k - 1] in LAYOUT:
                continue
            if word in FOREIGN or word.startswith(FOREIGN_BEGIN):
                return 2
            if tag not in ("article", "main") and (word in FRAME or word.startswith(FRAME_BEGIN)):
                if not (word == "header" and OWN_HEADER.intersection(words)):
                    most = 1
    return most


class Lines(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", 0, None, 0, None)
        self.stack, self.open = [self.root], Counter()
        self.blocks = [self.root]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def read(self, html: str) -> list[Line]:
        self.feed(html)
        if self.cdata_elem or self.rawdata.startswith("<"):
            self.rawdata = ""  # the page ends inside a script, comment or tag
        self.close()
        self._flush()
        return self.lines

    def parse_html_declaration(self, i: int) -> int:
        """A comment, or whatever else begins by ``<!``: up to the next ``>``."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def _flush(self) -> None:
        top = self.stack[-1]
        words = "".join(self.parts).split()
        if words or top.drops:
            own = top if top.tag in BLOCKS or top.block is None else top.block
            self.lines.append(Line(" ".join(words), self.tags, min(self.linked, 1 << 40), own))
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        if not any(self.open[t] > 0 for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if tag == "li":
                self._close(("li",), ("ul", "ol", "menu", "dir"))
            elif tag in ("dt", "dd"):
                self._close(("dt", "dd"), ("dl",))
            elif tag in ("td", "th"):
                self._close(("td", "th"), ("tr", "table"))
            elif tag in ("tr", "tbody", "thead", "tfoot"):
                self._close(("tr",), ("table",))
            elif tag in ("option", "optgroup"):
                self._close(("option",), ("select", "datalist"))
            self._close(("p",), ("article", "aside", "blockquote", "body", "button", "dd", "div", "li", "main", "section", "table", "td", "th"))
        if self.open["head"] and tag not in IN_HEAD:
            self._close(("head",), ())
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in RAW:
            self.set_cdata_mode(tag)
        top = self.stack[-1]
        article = tag in ("article", "main")
        drops, role, names = 0, "", ""
        for name, value in attrs:
            if name in ("class", "id"):
                names += f" {value or ''}"
            elif name == "role":
                role = (value or "").strip().lower()
                article = article or role in ("article", "main")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value or "")):
                drops = 2
        if tag in NEVER or (role in ROLES and tag not in ("html", "body")):
            drops = 2
        elif tag in PASSED and not (tag == "header" and top.article is not None):
            drops = max(drops, 1)
        if names and tag not in ("html", "body"):
            found = hint("article" if article else tag, names)
            drops = max(drops, 0 if found == 1 and tag in HEADS else found)
        around = top if top.tag in BLOCKS or top.block is None else top.block
        inherited = 0 if article and top.drops == 1 else top.drops
        own = Element(tag, max(drops, inherited), around, len(self.blocks), top.article)
        if article and not own.drops:
            own.article = own
        if block:
            self.blocks.append(own)
        self.stack.append(own)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.open[tag] <= 0:
            return
        if tag in BLOCKS:
            self._flush()
        while True:
            last = self.stack[-1].tag
            if last in BLOCKS and last != tag:
                self._flush()
            self._pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.drops:
            return
        self.parts.append(data)
        if self.open["a"] > 0:
            self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Along the page by a Gaussian kernel of about three sigma to each side, its part beyond the ends left out."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def content_lines(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines are content by their smoothed ratio."""
    sizes = np.array([len(x.text) for x in lines], float)
    smooth = smoothed(sizes / np.maximum(1, [x.tags for x in lines]), sigma)
    return (sizes > 0) & (smooth >= min(threshold * smooth.std(), smooth.max()))


def sums_by_block(blocks: list[Element], lines: list[Line], weights: np.ndarray) -> np.ndarray:
    """Weight of the lines in each block, blocks in it included."""
    mass = np.zeros(len(blocks))
    for line, weight in zip(lines, weights.tolist(), strict=True):
        mass[line.block.number] += weight
    for block in reversed(blocks[1:]):
        mass[block.block.number] += mass[block.number]
    return mass


def inside(blocks: list[Element], chosen: set[int]) -> np.ndarray:
    """Which blocks are one of those chosen, or in one."""
    out = np.zeros(len(blocks), bool)
    for k, block in enumerate(blocks):
        out[k] = k in chosen or (k > 0 and out[block.block.number])
    return out


def main_lines(blocks: list[Element], lines: list[Line], content: np.ndarray) -> list[int]:
    """Numbers of the lines of the main region."""
    sizes = np.array([len(x.text) for x in lines], float)
    weights = sizes * content
    if not weights.any():
        return []
    mass = sums_by_block(blocks, lines, weights)
    for tag in ("article", "main"):
        marked = [b for b in blocks[1:] if not b.drops and b.article is b and (b.tag == "main") == (tag == "main")]
        marked = [b for b in marked if b.block.article is None or b.block.article.tag == "main"]
        if not marked or sum(mass[b.number] for b in marked) < OF_PAGE * mass[0]:
            continue
        most = max(mass[b.number] for b in marked)
        chosen = inside(blocks, {b.number for b in marked if mass[b.number] >= OF_LARGEST * most and mass[b.number] > 0})
        own = [k for k, x in enumerate(lines) if x.text and chosen[x.block.number]]
        heads = [k for k, x in enumerate(lines[: own[0]]) if x.text and x.block.tag == "h1" and x.block.article is not None]
        return heads + own

    best = 0
    for k, block in enumerate(blocks[1:], 1):  # blocks come before those in them, so the last large one is the deepest
        if block.block.number == best and mass[k] >= OF_BLOCK * mass[0] and block.tag not in ("p", "li", "td", *HEADS):
            best = k
    chosen = inside(blocks, {best})
    held = [k for k in np.flatnonzero(content).tolist() if chosen[lines[k].block.number]]
    linked = sums_by_block(blocks, lines, np.array([x.linked for x in lines], float))
    chars = sums_by_block(blocks, lines, sizes)
    lists = {b.number for b in blocks[1:] if b.number != best and mass[b.number] == 0 and 2 * linked[b.number] > chars[b.number] > 0}
    in_lists = inside(blocks, lists)
    first, last = held[0], held[-1]
    while first and (lines[first - 1].block.tag in HEADS and lines[first - 1].text):
        first -= 1
    beside = lambda k: lines[k].block.number == best or lines[k].block.block.number == best
    while last + 1 < len(lines) and lines[last + 1].text and chosen[lines[last + 1].block.number] and beside(last + 1) and lines[last + 1].block.tag in ("p", "blockquote", "pre"):
        last += 1
    while first and lines[first - 1].text and chosen[lines[first - 1].block.number] and beside(first - 1) and lines[first - 1].block.tag in ("p", *HEADS):
        first -= 1
    return [
        k
        for k in range(first, last + 1)
        if lines[k].text and (chosen[lines[k].block.number] or lines[k].block.tag in HEADS) and not (in_lists[lines[k].block.number] and not content[k])
    ]


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> tuple[str, list[tuple[int, int]]]:
    """The main text, and the clusters of content lines as ranges of line numbers."""
    parser = Lines()
    lines = parser.read(html)
    if not lines:
        return "", []
    content = content_lines(lines, sigma, threshold)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], content.astype(np.int8), [0]])))
    own = main_lines(parser.blocks, lines, content)
    return "\n".join(lines[k].text for k in own), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


REGIONS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def extract(pages: DataFrame, html: str = "html", sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``text`` and ``regions``, the ranges of lines that are content by their ratio, in place of the
    html."""
    narrow = T.StructType([f for f in pages.schema.fields if f.name != html])
    schema = with_field(with_field(narrow, "text", T.StringType()), "regions", REGIONS)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t, sigma, threshold) if t else ("", []) for t in batch.column(html).to_pylist()]
            others = [n for n in batch.schema.names if n != html]
            rows = pa.RecordBatch.from_arrays([batch.column(n) for n in others], names=others) if others else None
            text = pa.array([t for t, _ in found], pa.string())
            regions = pa.array([[{"start": a, "end": b} for a, b in r] for _, r in found], kind)
            if rows is None:
                yield pa.RecordBatch.from_arrays([text, regions], names=["text", "regions"])
            else:
                yield replaced(replaced(rows, "text", text), "regions", regions)

    return pages.mapInArrow(run, schema)
