"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A linear classifier over a block's words, links, tags and names gives
log-odds of being content; they are the capacities to the two terminals. Blocks that follow each other
are tied the more closely the nearer they stand in the document tree, and so are neighbours among the
children of one parent. The cheapest cut of these ties separates content from boilerplate, so a doubtful
block goes with its surroundings. Pages are independent: nothing is shuffled, and a task holds one page.

Blocks that no choice of their neighbours could turn over are fixed first and their ties become
terminal capacities of the others, which leaves the exact maximum flow few blocks to decide.

Defined cases: null or empty html gives an empty text. Broken markup is read as far as it goes: a new
block element closes an open paragraph, an end tag without a start is ignored. A page without markup is
one block. A line break is white space inside its block. Repeated rows are read alike. Other columns do
not matter.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.registry import query

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("head title script style noscript template iframe object svg canvas select datalist button textarea audio video map math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: What the start of an element closes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
#: Elements that an implied end does not cross.
SCOPE = frozenset("ul ol dl table article section aside nav main header footer form div body html blockquote".split())

BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset(("article", "main"))
#: Words in a class, id or role that name boilerplate, and such that name content.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side footer "
    "foot header masthead topbar toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert popup modal "
    "overlay comment comments reply replies respond disqus discussion share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login search widget widgets copyright legal disclaimer contentinfo complementary hidden skip form tags rating".split()
)
GOOD_NAMES = frozenset("article content post entry story main text body articlebody".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: The classifier: log-odds of content; fixed parameters.
WEIGHTS = {
    "base": 0.3, "words": 1.5, "sentence": 0.4, "links": -3.5, "good_tag": 2.5, "bad_tag": -6.0, "header": -3.0, "bad_name": -5.0,
    "good_name": 0.8, "h1": 1.0, "heading": 0.3, "short": -1.0,
}
#: Ties between blocks: of neighbours in the page, and of neighbours among the children of a parent.
NEXT, SIBLING, FOREIGN = 1.2, 0.6, 0.25


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    bad: bool
    good: bool
    header: bool
    #: The nearest element that sets a region of the page apart.
    region: Element | None = None
    good_name: bool = False
    bad_name: bool = False


@dataclass
class Block:
    text: str
    link_chars: int
    holder: Element


class PageReader(HTMLParser):
    """Blocks of a page in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, 0, False, False, False)
        self.stack = [self.root]
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                holder = next(e for e in reversed(self.stack) if e.tag not in INLINE)
                self.blocks.append(Block(text, self.linked, holder))
            self.parts, self.linked = [], 0

    def pop_to(self, at: int) -> None:
        """Close every element from place ``at`` of the stack on."""
        for e in self.stack[at:]:
            if e.tag in SILENT:
                self.silent -= 1
            elif e.tag == "a":
                self.links -= 1
        del self.stack[at:]

    def close_open(self, tags: tuple[str, ...]) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                self.pop_to(at)
                return
            if self.stack[at].tag in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag not in VOID:
                self.close_open(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
            if tag in CLOSES:
                self.close_open(CLOSES[tag])
        if tag in VOID:
            return
        above = self.stack[-1]
        if tag == "a" and self.links:  # links do not nest
            self.close_open(("a",))
            above = self.stack[-1]
        names: set[str] = set()
        hidden = False
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop"):
                names.update(x.lower() for x in _NAME.findall(value or ""))
                names.add((value or "").lower())
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value or "")):
                hidden = True
        bad_name = hidden or (tag not in ("html", "body") and bool(names & BAD_NAMES))
        bad, good = tag in BAD_TAGS or bad_name, tag in GOOD_TAGS
        e = Element(tag, above, above.depth + 1, above.bad or tag in BAD_TAGS, above.good or good, above.header, above.region)
        e.bad_name = above.bad_name or bad_name
        e.good_name = above.good_name or bool(names & GOOD_NAMES)
        e.header = above.header or (tag == "header" and not above.good)
        if bad or good or tag == "header":
            e.region = e
        self.stack.append(e)
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self.pop_to(at)
                return
            if tag in INLINE and self.stack[at].tag not in INLINE:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def read_blocks(html: str) -> list[Block]:
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def log_odds(block: Block) -> float:
    """How much more likely than not the block is content, as a logarithm."""
    w, e, words = WEIGHTS, block.holder, block.text.count(" ") + 1
    z = w["base"] + w["words"] * min(1.0, words / 25) + w["links"] * min(1.0, block.link_chars / len(block.text))
    if block.text[-1] in ".!?…\"”»":
        z += w["sentence"]
    z += w["good_tag"] * e.good + w["bad_tag"] * e.bad + w["header"] * e.header + w["bad_name"] * e.bad_name + w["good_name"] * e.good_name
    if e.tag == "h1":
        z += w["h1"]
    elif e.tag in ("h2", "h3", "h4", "h5", "h6"):
        z += w["heading"]
    elif words < 4:
        z += w["short"]
    return z


def tree_distance(a: Element, b: Element, most: int = 12) -> int:
    """Steps between two elements over their nearest common ancestor, at most ``most``."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
    return steps


def ties(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness capacities between blocks."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for n, b in enumerate(blocks):
        pairs = []
        if n:
            pairs.append((n - 1, NEXT / (1 + tree_distance(blocks[n - 1].holder, b.holder))))
        under = id(b.holder.parent or b.holder)
        if under in last:
            pairs.append((last[under], SIBLING))
        last[under] = n
        for m, tie in pairs:
            apart = blocks[m].holder.region is not b.holder.region
            out[m, n] = out.get((m, n), 0.0) + tie * (FOREIGN if apart else 1.0)
    return out


def minimum_cut(odds: list[float], tied: dict[tuple[int, int], float]) -> list[bool]:
    """Which blocks are content: minimises the given-up log-odds plus the ties that are cut."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in tied.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    z = list(odds)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a block that outweighs all its ties is decided
        k = todo.popleft()
        if label[k] is None and abs(z[k]) >= sum(near[k].values()):
            label[k] = z[k] > 0
            for m, c in near[k].items():
                del near[m][k]
                z[m] += c if label[k] else -c
                if label[m] is None:
                    todo.append(m)
            near[k] = {}
    open_blocks = [k for k in range(n) if label[k] is None]
    if open_blocks:
        for k, side in zip(open_blocks, _source_side(open_blocks, z, near), strict=True):
            label[k] = side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by level graphs; True for nodes that stay with the source (content)."""
    place = {k: i for i, k in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for k in nodes:
        i = place[k]
        for m, c in near[k].items():
            room[i][place[m]] = c
        if z[k] > 0:
            room[source][i], room[i][source] = z[k], 0.0
        else:
            room[i][sink], room[sink][i] = -z[k], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(len(nodes))]
        left = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for v in left[u]:
                if room[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(html: str | None) -> str:
    """Content blocks in page order, one to a line."""
    found = read_blocks(html or "")
    content = minimum_cut([log_odds(b) for b in found], ties(found))
    return "\n".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a column ``text``; a column of that name is replaced."""

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(x.as_py()) for x in b], pa.string())

    return pages.withColumn("text", text_of(html))


@query("op4_html_cut")
def op4_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
