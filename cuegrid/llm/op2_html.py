"""Main text of web pages by composite text density.

Every element of the page's tree gets its characters, link characters, tags and link tags. The link-adjusted
(composite) density of an element with C characters, T tags, LC link characters, LT link tags is

    C/T * log_b(C/LC * T/LT),   b = ln(max(C*LC/(C-LC) + LCb/Cb * C, e)),

with LCb, Cb of the body and every count 1 at least. The density sum of an element adds up its children's
densities (its own text counts as one child). The threshold is the smallest density on the path from the
element with the largest sum up to body. The content is the subtree with the largest sum, and of the other
children of its ancestors those that reach the threshold and are not mostly links, or that are text elements
(headings, and paragraphs and lists below body). Within it blocks fall whose density is under the threshold while
links make up most of them. The tags article and main do not matter for this.

Marked parts (adverts, menus, comments, ...) are cut before the densities are summed: elements such as nav, footer
and aside by their tag, others by class, id or role. A class counts if all its words do: "ad" and "site-footer" are
names of boilerplate, "ad-hoc" and "related-work" are not. Even so a name says nothing sure: an element that is named so
but holds a main element or the only h1, or for names of a place on the page four times as much as the unmarked rest, or
without which no text is left, is layout and stays. A form is marked like a place: one that wraps the page stays. A
header stays in an article (or in the densest subtree) if it holds a heading; button and label stay where they stand in
running text.

Every step takes time in proportion to the page (choosing among marked parts: times the logarithm of their number).

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one line feed.

Defined cases: null or empty html gives empty text; very long pages are read whole; an empty table gives no rows;
unclosed and misnested tags are closed as browsers do for
p, li, td and the like; nesting may have any depth; repeated rows are kept; null page_id and url are passed on;
other columns are ignored. Plain text outside any tag counts as the body's own text.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm.common import prepare

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
HIDDEN = frozenset("head script style noscript iframe template svg math object embed input select option textarea title xmp noembed noframes nav header footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button label input select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class and id names: what an element is, where it is on the page, and words that say nothing beside them.
THINGS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments disqus replies respond cookie cookies consent gdpr notice popup newsletter subscribe signup login pagination pager recommended related".split())
PLACES = frozenset("banner nav navbar navigation menu header footer masthead sidebar side aside widget share sharing social modal overlay toolbar skip copyright legal".split())
NEUTRAL = frozenset("site page main global top bottom left right list box bar block container wrapper wrap inner outer area section panel row col column item items link links group fixed sticky primary secondary mobile desktop by has open post article entry form button text content slot unit zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: One attribute after the other, so that no name is looked for inside another's value.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'>/=]")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. ``parts``: text strings and child nodes in order. ``mark``: whether its tag or attributes say
    that it is no content."""

    __slots__ = ("chars", "density", "has", "link_chars", "link_tags", "mark", "name", "parts", "plain", "sum", "tags")

    def __init__(self, name: str, mark: int = 0):
        self.name, self.mark, self.parts = name, mark, []
        self.chars = self.link_chars = self.tags = self.link_tags = self.plain = self.has = 0
        self.density = self.sum = 0.0

    @property
    def hidden(self) -> bool:
        return self.mark > 0


#: What a node holds, itself included, outside of what is cut.
MAIN, TITLE, HEADING = 1, 2, 4
#: Marks: a name of a place, a name of a thing, a form's text element, and what is cut whatever it holds.
PLACE, THING, CONTROL, CUT = 1, 2, 3, 4


def _mark(name: str, attrs: str) -> int:
    if name in HIDDEN:
        return CUT
    out = CONTROL if name in ("button", "label") else PLACE if name == "form" else 0
    if not attrs or name in ("html", "body"):
        return out
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape(a or b or c)
        if key in ("class", "id") and name not in ("article", "main"):
            for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
                words = set(re.split(r"[_-]+", token.strip("_-")))
                if words <= THINGS | PLACES | NEUTRAL:
                    out = max(out, THING if words & THINGS else PLACE if words & PLACES else 0)
        elif key == "role" and value.lower() == "form":
            out = max(out, PLACE)
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return CUT
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return CUT
    return out


class Stack:
    """The open elements. Where each name is open is kept, so that no tag looks through all of them."""

    #: Elements that an end tag of a block does not reach across.
    WALLS = frozenset(("article", "main", "body", "table"))

    def __init__(self, root: Node):
        self.nodes, self.at, self.walls = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name in self.WALLS:
            self.walls.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """The place of the innermost open element of these names, 0 for none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().name].pop()
        while self.walls and self.walls[-1] >= k:
            self.walls.pop()

    def close(self, name: str) -> None:
        k = self.last((name,))
        if k and (name in INLINE or not self.walls or self.walls[-1] <= k):
            self.cut(k)

    def make_room(self, name: str) -> None:
        """Closes what an element of this name ends: an open item for an item, an open paragraph for a block."""
        if name in CLOSES:
            shut, until = CLOSES[name]
            wall = self.last(until)
            while (k := self.last(shut)) > wall:
                self.cut(k)
        elif name not in INLINE and name not in VOID and name not in RAW and (k := self.last(("p",))) and all(x.name in INLINE for x in self.nodes[k + 1 :]):
            self.cut(k)


def _tag_end(page: str, at: int, last: int) -> int:
    """The place of the > that ends a tag, outside of quotes; of any > where a quote is never closed. ``last`` is the
    page's last >, at or after ``at``."""
    k = at
    while (m := _STOP.search(page, k)) and m[0] != ">":
        k = page.find(m[0], m.end()) + 1
        if not k:
            return page.find(">", at)
    return m.start() if m else page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree under a root that stands for body."""
    root = Node("body")
    stack, at, n, last = Stack(root), 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack.nodes[-1].parts.append(page[at:])
            break
        if lt > at:
            stack.nodes[-1].parts.append(page[at:lt])
        if page.startswith(("<!", "<?"), lt):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                stack.nodes[-1].parts.append(html.escape(page[lt + 9 : n if end < 0 else end]))
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _OPEN.match(page, lt) if last > lt else None
        if not m:
            stack.nodes[-1].parts.append("<")
            at = lt + 1
            continue
        end = _tag_end(page, m.end(), last)
        at, name, attrs = end + 1, m[2].lower(), page[m.end() : end]
        if m[1]:
            stack.close(name)
            continue
        if name in ("html", "body"):
            continue
        stack.make_room(name)
        node = Node(name, _mark(name, attrs))
        stack.nodes[-1].parts.append(node)
        if name in VOID or attrs.rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        stack.push(node)
    return root


def _length(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip())


def _unmark_layout(root: Node) -> None:
    """Takes the marks from elements that are named like boilerplate but hold the page, and from buttons and labels
    in running text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        running = any(isinstance(x, str) and not x.isspace() for x in node.parts)
        for x in node.parts:
            if isinstance(x, Node):
                if x.mark == CONTROL and running:
                    x.mark = 0
                todo.append(x)
    for node in reversed(order):
        node.has = (MAIN if node.name == "main" else 0) | (TITLE if node.name == "h1" else 0) | (HEADING if node.name in HEADINGS else 0)
        for x in node.parts:
            if isinstance(x, str):
                node.plain += _length(x)
            elif x.mark < CUT:
                node.has |= x.has
                node.plain += 0 if x.mark else x.plain  # characters that are under no mark below the node
    rest, titles, marked = root.plain, 0, []

    def below(node: Node) -> list[Node]:
        """The marked nodes that are under no other mark below a node; counts the titles on the way."""
        nonlocal titles
        found, todo = [], [node]
        while todo:
            for x in todo.pop().parts:
                if isinstance(x, Node):
                    if not x.mark:
                        todo.append(x)
                        titles += x.name == "h1"
                    elif x.mark < CONTROL:
                        found.append(x)
        return found

    # The first to be looked at: what holds main (or the only h1), then names of places, then the longest.
    rank = lambda x: (not x.has & (MAIN if titles else MAIN | TITLE), x.mark != PLACE, -x.plain, id(x))
    waiting = below(root)
    while waiting or marked:
        known = bool(titles)
        for x in waiting:
            heapq.heappush(marked, (*rank(x), x))
        *_, node = heapq.heappop(marked)
        waiting, holds = [], node.has & (MAIN if titles else MAIN | TITLE)
        if not rest or node.mark == PLACE and node.plain > 4 * rest or holds:
            node.mark = 0
            rest += node.plain
            titles += node.name == "h1"
            waiting = below(node)
            if bool(titles) != known:  # happens once: an h1 tells nothing any more
                marked = [(*rank(x[-1]), x[-1]) for x in marked]
                heapq.heapify(marked)


def _measure(root: Node) -> None:
    """Counts and densities of all shown nodes, children before parents."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        order.append((node, link))
        for x in node.parts:
            if isinstance(x, Node) and not x.hidden:
                todo.append((x, link or x.name == "a"))
    own: dict[int, int] = {}
    for node, link in reversed(order):
        text = sum(_length(x) for x in node.parts if isinstance(x, str))
        own[id(node)] = text
        node.chars = text
        node.link_chars = text if link else 0
        for x in node.parts:
            if isinstance(x, Node) and not x.hidden:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += 1 + x.tags
                node.link_tags += (x.name == "a") + x.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node, _ in reversed(order):
        c, lc, t, lt = max(node.chars, 1), max(node.link_chars, 1), max(node.tags, 1), max(node.link_tags, 1)
        base = math.log(max(c * lc / max(c - lc, 1) + share * c, math.e)) if node.chars else 1.0
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(max(base, 1.0 + 1e-9)), 1.0) if node.chars else 0.0
        node.sum = sum(x.density for x in node.parts if isinstance(x, Node) and not x.hidden) + own[id(node)]


def _blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks under a node, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := _SPACE.sub(" ", html.unescape("".join(line))).strip():
                out.append(text)
            line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.hidden and x is not node:
            if x.name not in INLINE and x.name not in RAW:
                flush()
        elif x is not node and x.name not in INLINE and x.chars and x.density < threshold and x.link_chars > 0.5 * x.chars and x.link_tags > 1:
            flush()
        else:
            block = x.name not in INLINE
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The text of the densest subtree; see the module's docstring."""
    if not page:
        return ""
    root = parse(page)
    _unmark_layout(root)
    _measure(root)
    best, todo, parent = root, [root], {}
    while todo:
        node = todo.pop()
        if node.sum > best.sum and node.name not in INLINE:
            best = node
        for x in node.parts:
            if isinstance(x, Node) and not x.hidden:
                parent[x] = node
                todo.append(x)
    path = [best]
    while path[-1] in parent:
        path.append(parent[path[-1]])
    threshold = min(x.density for x in path)
    todo = [best]
    while todo:  # headers of the content, at any depth
        node = todo.pop()
        for x in node.parts:
            if isinstance(x, Node):
                if x.name == "header" and node is not root and (node is best or node.name in ("article", "section")) and x.has & HEADING:
                    x.mark = 0
                if not x.hidden:
                    todo.append(x)
    blocks, outer = _blocks(best, threshold), []
    for inner, node in zip(path, path[1:]):  # outwards: what stands before and after the content so far
        before, after, now = [], [], None
        for x in node.parts:
            if x is inner:
                now = after
                continue
            side = before if now is None else after
            if isinstance(x, str):
                if node is not root and (text := _SPACE.sub(" ", html.unescape(x)).strip()):
                    side.append(text)
                continue
            if x.name == "header" and node.name in ("article", "main", "section") and x.has & HEADING:
                x.mark = 0
            elif x.hidden or 2 * x.link_chars >= x.chars or not (x.density >= threshold or x.name in HEADINGS and side is before or x.name in TEXT and node is not root):
                continue
            side += _blocks(x, threshold)
        outer.append(before)
        blocks += after
    return "\n".join([*(x for before in reversed(outer) for x in before), *blocks])


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES: dict[str, str] = {}
