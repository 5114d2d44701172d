"""Main-text extraction from raw HTML by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN_END = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of HTML: elements without content, with raw content, and those that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title select canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements, and names of class, id and role, that mark what is no part of an article.
APART = frozenset("nav header footer aside form menu button dialog head".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond replies reply skip toolbar contentinfo complementary search".split()
)
#: Marks that name what an element holds, not where it stands: no text inside overrules them.
FOREIGN_WORDS = APART_WORDS - frozenset("header masthead sidebar aside widget notice alert popup modal overlay skip toolbar search navigation".split())
#: A name of several parts is a mark if its last part is one (site-header), unless it begins like a layout class
#: (no-sidebar), or if its first part is one and the last a container's (cookie-box) or a number (comment-12).
LAYOUT_FIRST = frozenset("no not has have with without is show hide".split())
CONTAINERS = frozenset("area bar block body box button buttons column container content form group icons inner item items label link links list message panel posts section slot stories text thread title toggle unit wrap wrapper zone".split())
#: Elements that group others: beside the core they stay only by their density.
GROUPS = frozenset("div section center fieldset form details dialog dl table aside".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"caption"},
}
_SCOPE = frozenset("ul ol dl table article section div td th body html main aside nav header footer form blockquote".split())

_ROW_SCOPE = _SCOPE - {"td", "th"}
_P_SCOPE = frozenset("table td th article section div body html".split())


def marks(name: str, words: frozenset[str] = APART_WORDS) -> bool:
    """Whether a class, an id or a role says, by one of ``words``, that its element is no part of an article."""
    parts = re.findall(r"[a-z]+|[0-9]+", name)
    if len(parts) < 2:
        return bool(parts) and parts[0] in words
    return parts[0] not in LAYOUT_FIRST and (parts[-1] in words or parts[0] in words and (parts[-1] in CONTAINERS or parts[-1].isdigit()))


class Node:
    """An element: its text pieces and child elements in page order, and its counts for the densities."""

    __slots__ = ("tag", "apart", "marked", "article", "items", "parent", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.apart, self.article = tag in APART or tag in RAW, tag in ("article", "main")
        self.marked = tag in APART and tag != "head"  # set apart by a mark that the text inside can overrule
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "hidden" in attributes):
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "hidden":
                    self.apart, self.marked = True, False
                    break
                elif name in ("class", "id", "role") and tag not in ("html", "body"):
                    names = "".join(values).lower().split()
                    if any(marks(n, FOREIGN_WORDS) for n in names):
                        self.apart, self.marked = True, False
                        break
                    if not self.apart and not self.article and any(map(marks, names)):
                        self.apart = self.marked = True


class Open:
    """The open elements of a page, outermost first, and where each tag stands among them."""

    def __init__(self, root: Node) -> None:
        self.path, self.places = [root], defaultdict(list, {root.tag: [0]})

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.path))
        self.path.append(node)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.path) > max(1, place):
            self.places[self.path.pop().tag].pop()

    def nearest(self, tags) -> int:
        """The place of the innermost open element of ``tags``; -1 if there is none."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=-1)

    def close_inside(self, tags, scope: frozenset[str]) -> None:
        """Close the innermost open element of ``tags`` if no element of ``scope`` stands inside it."""
        if (place := self.nearest(tags)) > 0 and self.nearest(scope) <= place:
            self.close(place)


class Tags:
    """Finds the ends of tags. Quotes may hide a ``>``; the search is linear over a whole page, hostile ones too."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.known: dict[int, int] = {}  # where a search that comes to this quote ends

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none.

        Where quotes leave no end up to the end of the page, the first ``>`` counts. A search that comes to a quote
        goes on as any other that came there, so what follows each quote is looked at once.
        """
        place, passed, found = at, [], -1
        while True:
            place = _PLAIN_END.match(self.source, place).end()
            if place == len(self.source):
                break
            if self.source[place] == ">":
                found = place
                break
            if place in self.known:
                found = self.known[place]
                break
            passed.append(place)
            place = self.source.find(self.source[place], place + 1) + 1
            if not place:
                break
        for quote in passed:
            self.known[quote] = found
        return found if found >= 0 else self.source.find(">", at)


def parse(source: str) -> Node:
    """The tree of a page. Unclosed and stray tags are taken as browsers take the common cases."""
    root = Node("html", "", None)
    opened, tags = Open(root), Tags(source)
    place, size = 0, len(source)
    while place < size:
        start = source.find("<", place)
        while start >= 0 and not (source[start + 1 : start + 2] in "!?" and start + 1 < size or (name := _NAME.match(source, start + 1))):
            start = source.find("<", start + 1)
        if start < 0:
            break
        if source[start + 1] in "!?":
            close = "-->" if source.startswith("<!--", start) else "]]>" if source.startswith("<![CDATA[", start) else ">"
            end = source.find(close, start + 2)
            end = end + len(close) if end >= 0 else size if close != ">" else -1
            attributes = tag = ""
        else:
            end = tags.end(name.end()) + 1 or -1
            tag, attributes = name[0].lower(), source[name.end() : end - 1]
        if end < 0:
            break
        if start > place:
            opened.path[-1].items.append(source[place:start])
        place = end
        if tag[:1] == "/":
            _end(opened, tag[1:])
        elif tag and tag != "html" and not (tag == "body" and opened.places["body"]):
            if tag in BLOCK:
                opened.close_inside(("p",), _P_SCOPE)
                if tag in _CLOSES:
                    opened.close_inside(_CLOSES[tag], _ROW_SCOPE if tag in ("tr", "td", "th", "tbody", "tfoot") else _SCOPE)
            node = Node(tag, attributes, opened.path[-1])
            opened.path[-1].items.append(node)
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:  # its content is no markup of this page
                inside = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.IGNORECASE).search(source, place)
                place = source.find(">", inside.end()) + 1 or size if inside else size
            else:
                opened.push(node)
    if place < size:
        opened.path[-1].items.append(source[place:])
    return root


def _end(opened: Open, tag: str) -> None:
    """What an end tag closes; without its start, or with a block around an inline start, it changes nothing."""
    place = opened.nearest((tag,))
    if place > 0 and (tag in BLOCK or opened.nearest(_SCOPE) < place):
        opened.close(place)


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def measure(node: Node, in_link: bool = False) -> None:
    """Count characters, tags, and those inside links, of every node that is not set apart; without recursion."""
    stack: list[tuple[Node, bool, bool]] = [(node, in_link, False)]
    while stack:
        node, link, done = stack.pop()
        if not done:
            link = link or node.tag == "a"
            stack.append((node, link, True))
            stack.extend((c, link, False) for c in node.items if isinstance(c, Node) and not c.apart)
            continue
        chars = sum(len(" ".join(html.unescape(t).split())) for t in node.items if isinstance(t, str))
        node.chars, node.link_chars = chars, chars if link else 0
        for c in node.items:
            if isinstance(c, Node) and not c.apart:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")


def rate(body: Node) -> None:
    """Composite text density of every node under the body: characters a tag, adjusted by links.

    C / T * log_b(C / LC * T / LT) with b = ln(C / (C - LC) * LC + LC_body / C_body * C + e), where C and T count
    the characters and tags of a node and LC and LT those in links; a zero divisor counts as one.
    """
    ratio = body.link_chars / max(1, body.chars)
    for node in _walk(body):
        if c := node.chars:
            tags = max(1, node.tags)
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + ratio * c + math.e)
            spread = math.log(max(1.0, c / max(1, node.link_chars) * tags / max(1, node.link_tags)))
            node.density = c / tags * spread / (math.log(base) if base > 1 + 1e-6 else 1.0)  # no links at all: no adjustment


def restore(body: Node) -> None:
    """Take back the marks of nodes that hold most of the body's text, or the only article or main elements.

    Text in links does not count. Elements that are navigation by their tag are taken back for an article only, and
    nothing is where an article or main element with text stands outside all marks. Comments, adverts and the like
    (``FOREIGN_WORDS``) are never taken back, however long they are beside a short article.
    """
    order: list[tuple[Node, bool]] = []  # every element that can show, parents first
    stack: list[tuple[Node, bool]] = [(body, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        stack.extend((c, link) for c in reversed(node.items) if isinstance(c, Node) and (not c.apart or c.marked))
    if not any(node.marked for node, _ in order):
        return
    size: dict[int, int] = {}
    holds: set[int] = set()
    free = False  # whether an article or main element with text stands outside all marked nodes
    for node, link in reversed(order):
        own = 0 if link else sum(len(" ".join(html.unescape(t).split())) for t in node.items if isinstance(t, str))
        below = [c for c in node.items if isinstance(c, Node) and id(c) in size]
        size[id(node)] = own + sum(size[id(c)] for c in below)
        if any(id(c) in holds or c.article and not c.apart and size[id(c)] for c in below):
            holds.add(id(node))
    inner = [body]
    while inner and not free:
        node = inner.pop()
        free = node.article and size[id(node)] > 0
        inner.extend(c for c in node.items if isinstance(c, Node) and not c.apart)
    for node, _ in order:
        if node.marked and not free and (id(node) in holds or (node.tag == "form" or node.tag not in APART) and 2 * size[id(node)] > size[id(body)]):
            node.apart = False


def in_links(node: Node) -> bool:
    """Whether links hold most of the node's text."""
    return 2 * node.link_chars > node.chars


def keep_main(root: Node) -> Node | None:
    """The body, with all but the main text set apart; None if it has no text.

    The core is the node with the greatest sum of densities over its child blocks. The threshold is the least density
    on the way from the body to the core. Beside the core each child of a node on that way counts whose own
    density reaches the threshold, and so do headings before such a child and blocks between two; of what
    remains there, titles, bylines, paragraphs and lists stay, and containers and link lists go.
    """
    body = next((n for n in _walk(root) if n.tag == "body"), root)
    restore(body)
    measure(body)
    if not body.chars:
        return None
    rate(body)
    best, most = body, 0.0
    for node in _walk(body):
        total = sum(c.density for c in node.items if isinstance(c, Node) and not c.apart and c.tag in BLOCK)
        if total > most and node.chars:
            best, most = node, total
    way = list(_path(best))
    way = way[: way.index(body) + 1]
    threshold = min(n.density for n in way)
    for below, node in zip(way, way[1:]):
        children = [c for c in node.items if isinstance(c, Node) and not c.apart]
        taken = [k for k, c in enumerate(children) if c is below or c.density >= threshold]
        first = taken[0]
        while first and (children[first - 1].tag in HEADINGS or not children[first - 1].chars):
            first -= 1
        for k, c in enumerate(children):
            if not first <= k <= taken[-1] and (c.tag in GROUPS or in_links(c)):
                c.apart = True
    return body


def _walk(node: Node) -> Iterator[Node]:
    """A node and the nodes below it, in page order, without those set apart."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.items) if isinstance(c, Node) and not c.apart)


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, with single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.apart:
            if x.tag in BLOCK:
                flush()
        else:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return out


def main_text(source: str) -> str:
    """Blocks of the article of a page, joined by line ends; empty if the page has none."""
    body = keep_main(parse(source)) if source else None
    return "\n".join(blocks(body)) if body else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, url, text, n_chars), one row per row, from whole pages.

    Null, empty and text-free pages give an empty text, an empty table an empty result; repeated rows stay. Other
    columns have no effect, whatever their names. Trees and counts are made with explicit stacks, and tags are
    found in time linear in the page, so neither deep nesting nor very long pages are a limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [main_text(page.as_py() or "") for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
