"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams through the page.  Its events are gathered to lines as a reader
sees them, called blocks here: the text between two block-level boundaries (lines of the source say
nothing of pages that are written in one).  Of each block the text, the number of tags met, the text
within links, and where the block stands are known.  Then

1. every block's ratio of text outside links to tags is smoothed with a Gaussian over its neighbours,
   and the smoothed ratios are parted into a low and a high cluster by a threshold (two means of their
   logarithms); blocks of the high cluster whose own ratio is over the threshold are content, and
   those that only their neighbours lift over it are not thin;
2. menus, footers, sidebars and the like go by element or role.  What says so by words of class and id
   goes too, but where other words stand beside these, only if it holds no content.  Forms, page
   headers, hidden elements and what is marked by class or id stay where they wrap the page: when they
   hold over half of its text and no article or main element stands outside;
3. the region is the outermost `article` and `main` elements that hold content; on pages without them,
   the innermost container that holds all content, but no list, table, quote or the like nor a piece of
   one, since these are parts of a text.  Every block of an article or container belongs to the result,
   however short it is, but for thin blocks that are all link.  Of what stands in `main` around an
   article, blocks that are content by themselves belong to it, and headings that lead to them.

References are decoded, white space inside a block becomes one blank, blocks are joined by an empty
line.

Defined cases: null, empty or text-free pages give an empty text; broken or unclosed markup is read
as the parser reads it; nothing is cut, whatever a page's length.  Repeated rows and further columns
do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video map select option datalist textarea button".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
#: Boilerplate, unless the whole page stands in it.
WRAPPERS = frozenset("form header fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
#: Words of class and id that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion breadcrumb breadcrumbs nav navbar navigation menu sidebar aside widget footer "
    "header masthead comment comments reply replies disqus cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations pagination pager toolbar skip".split()
)
#: Words that say nothing of what is in an element.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons center col column container content fixed float footer group header hidden holder icon icons inner item items left "
    "link links list main menu middle module outer page panel primary region right row secondary section site small sticky text title top unit widget wrap wrapper zone".split()
) | MARKS
REGIONS = frozenset(("article", "main"))
#: Elements that are parts of a text and no containers of one.
PARTS = frozenset("p ul ol dl li dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption details summary address".split())
#: Elements that end where one of the named begins.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SIGMA = 1.0


#: What an element says of itself: boilerplate in any case, unless it wraps the page, and if it is thin.
ANYWHERE, UNLESS_WRAPPER, IF_THIN = 3, 2, 1


class Node:
    __slots__ = ("tag", "parent", "says", "silent", "region", "dropped", "text", "high", "inside")

    def __init__(self, tag: str, parent: "Node | None" = None):
        self.tag, self.parent = tag, parent
        self.says = 0
        self.silent = parent is not None and parent.silent
        #: the outermost article or main element around it
        self.region = parent.region if parent is not None else None
        self.dropped = False
        self.text = self.high = 0  # of the whole subtree: characters outside links, content blocks
        self.inside = False


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0
    text: str = ""
    high: bool = False
    #: its own ratio, before smoothing, is that of content
    alone: bool = False


def _says(tag: str, attrs) -> int:
    if tag in BOILERPLATE:
        return ANYWHERE
    out = UNLESS_WRAPPER if tag in WRAPPERS else 0
    for k, v in attrs:
        if k == "role" and v and v.strip().lower() in ROLES:
            return ANYWHERE
        if k == "hidden" or v and (k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.IGNORECASE)):
            out = UNLESS_WRAPPER
        elif v and k in ("class", "id"):
            for name in v.split():
                words = {w.lower() for w in _WORD.findall(name)}
                if not MARKS.isdisjoint(words):
                    out = max(out, UNLESS_WRAPPER if all(w in NEUTRAL or w.isdigit() for w in words) else IF_THIN)
    return out


class Blocks(HTMLParser):
    """Gathers blocks from parser events; nodes are listed after their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.node = Node("")
        self.nodes = [self.top]
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.opened: dict[str, int] = {}
        self.links = 0
        self.tags = 0

    def _break(self) -> None:
        self.block = None

    def _to(self, node: Node) -> None:
        """Close elements up to node."""
        while self.node is not node:
            self.opened[self.node.tag] -= 1
            self.node = self.node.parent

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in VOID:
            if tag not in INLINE:
                self._break()
            elif tag == "br":
                self._text(" ")
            return
        if tag not in INLINE:
            self._break()
            if tag in ENDS:
                self._close_implied(ENDS[tag])
        inside = Node(tag, self.node)
        inside.silent |= tag in SILENT
        inside.says = _says(tag, attrs) if tag not in ("html", "body") else 0
        if tag in REGIONS and inside.region is None:
            inside.region = inside
        self.nodes.append(inside)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.node = inside

    def _close_implied(self, ends: tuple[str, ...]) -> None:
        """A paragraph or item ends where the next one begins, up to the container of both."""
        if not any(self.opened.get(t) for t in ends):
            return
        node = self.node
        while node is not self.top and (node.tag in INLINE or node.tag in ends):
            if node.tag in ends:
                self._to(node.parent)
                return
            node = node.parent

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if tag not in INLINE:
            self._break()
        if not self.opened.get(tag):
            return
        node = self.node
        while node is not self.top:
            if node.tag == tag:
                self._to(node.parent)
                return
            if tag in INLINE and node.tag not in INLINE:
                return  # formatting does not close what it doesn't contain
            node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _text(self, data: str) -> None:
        if self.node.silent:
            return
        if self.block is None:
            if data.isspace():
                return
            self.block = Block(self.node, tags=1 + self.tags)
            self.tags = 0
            self.blocks.append(self.block)
        self.block.parts.append(data)
        if self.links:
            self.block.linked += len(data)
        self.block.tags += self.tags
        self.tags = 0

    def handle_data(self, data):
        self._text(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and normed at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Boundary between the low and the high cluster of the values (two means on one dimension)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _holder(node: Node, tags: frozenset[str]) -> Node:
    """The node, or the element of the tags that it stands in by inline elements only."""
    while node.tag in INLINE and node.tag not in tags and node.parent is not None:
        node = node.parent
    return node


def _summed(nodes: list[Node], name: str) -> None:
    """Add what every node holds to all that it stands in."""
    for node in reversed(nodes):
        if node.parent is not None:
            setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))


def _drop(nodes: list[Node], blocks: list[Block]) -> None:
    """Mark the nodes that are boilerplate."""
    never: set[int] = set()
    for node in nodes:
        if node.says == ANYWHERE or node.parent is not None and id(node.parent) in never:
            never.add(id(node))
    for b in blocks:
        if id(b.node) not in never:
            b.node.text += max(0, len(b.text) - b.linked)
        b.node.high += b.alone
    _summed(nodes, "text")
    _summed(nodes, "high")
    regions = [n for n in nodes if n.region is n]
    # regions in document order; those inside a node come right after it
    inside: dict[int, int] = {}
    for n in regions:
        up = n
        while up is not None:
            inside[id(up)] = inside.get(id(up), 0) + 1
            up = up.parent
    for node in nodes:
        parent = node.parent
        if parent is None:
            continue
        if node.says == ANYWHERE:
            node.dropped = True
        elif node.says == UNLESS_WRAPPER:
            node.dropped = not (2 * node.text > nodes[0].text and inside.get(id(node), 0) == len(regions))
        elif node.says == IF_THIN:
            node.dropped = not node.high
        if parent.dropped:
            # a heading in an article's own header belongs to the article
            node.dropped = node.dropped or not (node.tag in HEADINGS and _own_header(parent))


def _own_header(node: Node) -> bool:
    while node is not None and node.dropped and node.tag in ("header", "div", "span", "hgroup"):
        if node.tag == "header":
            return node.region is not None and not node.parent.dropped
        node = node.parent
    return False


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    for b in parser.blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in parser.blocks if b.text]
    if not blocks:
        return ""
    raw = [max(0, len(b.text) - b.linked) / b.tags for b in blocks]
    ratios = [math.log1p(r) for r in smooth(raw)]
    cut = threshold(ratios)
    thin = max(ratios) <= cut  # a single cluster
    for b, r, own in zip(blocks, ratios, raw):
        b.high = thin or r > cut
        b.alone = b.high and (thin or math.log1p(own) > cut)
    _drop(parser.nodes, blocks)
    blocks = [b for b in blocks if not b.node.dropped]
    if not blocks:
        return ""
    in_region = [b for b in blocks if b.node.region is not None]
    if in_region:
        chosen = {id(b.node.region) for b in in_region if b.alone} or {id(b.node.region) for b in in_region}
        blocks = [b for b in in_region if id(b.node.region) in chosen]
        return "\n\n".join(b.text for b in _belonging(parser.nodes, blocks))
    # without an article: the innermost container with all content blocks, or with all if none has content
    if not any(b.alone for b in blocks):
        for b in blocks:
            b.high = b.alone = True
    for node in parser.nodes:
        node.high = 0
    for b in blocks:
        b.node.high += b.alone
    _summed(parser.nodes, "high")
    best = [n for n in parser.nodes if n.high == parser.top.high][-1]  # these stand in each other
    while best.tag in INLINE or best.tag in PARTS or best.tag in HEADINGS:
        best = best.parent
    for node in parser.nodes:
        node.inside = node is best or node.parent is not None and node.parent.inside
    return "\n\n".join(b.text for b in blocks if b.node.inside and not _all_link(b))


def _all_link(b: Block) -> bool:
    """Whether a block is nothing but link, thin, and no part of a list, table or the like."""
    return not b.high and b.linked >= len(b.text) and _holder(b.node, HEADINGS).tag not in (PARTS - {"p"}) | HEADINGS


def _belonging(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """Blocks of the regions that belong to the text."""
    for node in nodes:  # in an article that stands in main
        node.inside = node.tag == "article" or node.parent is not None and node.parent.inside
    within = {id(b.node.region) for b in blocks if b.node.inside}
    out: list[Block] = []
    lead = False  # whether the block after is content
    for b in reversed(blocks):
        around = not b.node.inside and id(b.node.region) in within
        heading = _holder(b.node, HEADINGS).tag in HEADINGS
        belongs = not _all_link(b) if not around else b.alone or heading and lead
        if belongs:
            out.append(b)
        lead = belongs
    return out[::-1]


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text string and n_chars bigint."""
    kept = df.select(*[df[c] for c in keep], df[html].alias("__html"))
    fields = kept.schema[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f.name for f in fields], "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{schema}, text string, n_chars bigint")
