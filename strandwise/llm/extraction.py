"""Main text of HTML pages by tree scoring.

The page becomes a tree. Parts that are never the article (menus, adverts,
forms, notices, comments and the like, known by element, role or class) go
first. Inside an ``article`` a class that may as well name a part of the text
(a discussion, related work) tells nothing unless most of the part is links,
and lists of links stay. Each paragraph then gives points for its length and
its commas to its ancestors, less with each level; a container's points are
discounted by the share of its text that stands in links. The container with
most points is kept, with those of its siblings that score or read like it; an
enclosing ``article`` or ``main`` is kept whole.

Null and empty pages, and pages without text, give the empty string. Unclosed
and stray tags are read as browsers read them, as far as text goes, in time
that grows with the page's length alone. Nesting is not bounded by recursion.
Repeated rows are extracted alike; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, spread, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas dialog menu datalist label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP = frozenset("html body article main".split())
#: Words of a class or id, split at signs and case changes, that name what is not the article.
NOISE = re.compile(
    r"(ads?|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification\w*|popup|modal|overlay|newsletter|subscri\w+|share|sharing|social|sidebar|rail|widgets?|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|respond|reply|replies|disqus|discussion|related|recommend\w*|pagination|pager|toolbar|login|signup|search|copyright|disclaimer|skip|hidden)"
)
#: Those of them that in an article may name a part of its text: not dropped there unless links are most of the part.
MAYBE = re.compile(r"(banner|overlay|share|sharing|social|rail|menu\w*|respond|reply|replies|discussion|related|recommend\w*|search|disclaimer|copyright|skip|hidden|subscri\w+|modal)")
#: And those of them that on a paragraph, a heading or a cell of an article may name its matter.
MATTER = re.compile(r"(notices?|notification\w*|cookies?|consent|gdpr|promo\w*|navigation|widgets?|newsletter|login|signup|comments?|pager|pagination)")
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
#: Points of a paragraph: one, one a comma, and one for each 100 characters, ``LENGTH_POINTS`` of these at most.
LENGTH_POINTS = 3
#: How many ancestors a paragraph gives points to.
REACH = 5
HEADER = re.compile(r"(header|hdr|head)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Start tags that end an open element of the same group, up to the element that holds the group.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
SCOPE = frozenset("html body article section div main aside nav header footer form table td th ul ol blockquote figure".split())


class Node:
    __slots__ = ("tag", "parent", "children", "inside", "points", "size", "linked", "chars", "commas", "holds", "attrs")

    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list = []
        self.points = 0.0
        self.size = self.linked = self.chars = self.commas = 0
        self.holds = self.inside = False


class _Builder(HTMLParser):
    """Open elements as a path from the root; where each tag stands open in it, so that no search walks the path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.path = [self.root]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # tag -> depths, rising
        self.scopes: list[int] = [0]

    def _close(self, depth: int) -> None:
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.open[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def handle_starttag(self, tag, attrs):
        if tag == "html" and self.path[-1].tag in ("html", "body"):
            return
        if tag in BLOCK and self.open["p"] and self.open["p"][-1] > self.scopes[-1]:  # a block ends an open paragraph
            self._close(self.open["p"][-1])
        if tag in ENDS:
            group, stop = ENDS[tag]
            below = self._last(stop)
            first = min((d[i] for g in group if (d := self.open[g]) and (i := bisect_right(d, below)) < len(d)), default=0)
            if first:
                self._close(first)
        if tag == "body" and self.open["head"]:
            self._close(self.open["head"][-1])
        node = Node(tag, self.path[-1], attrs)
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.open[tag].append(len(self.path))
            if tag in SCOPE:
                self.scopes.append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open[tag] and not (tag == "p" and self.scopes[-1] > self.open[tag][-1]):
            self._close(self.open[tag][-1])

    def handle_data(self, data):
        self.path[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def walk(root: Node):
    """Nodes before their children, without recursion."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def _noisy(n: Node, inside: bool, article: bool) -> bool:
    if n.tag in GONE:
        return True
    if n.tag == "header":
        return not inside
    a = {k: v or "" for k, v in n.attrs}
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return n.tag not in KEEP
    if n.tag in ("html", "body", "main") or n.holds:
        return False
    words = [w.lower() for w in _PARTS.findall(f"{a.get('class', '')} {a.get('id', '')}")]
    if n.tag == "article":
        return any(w in ("comment", "comments", "reply", "ad", "ads", "advert") for w in words)
    said = [w for w in words if NOISE.fullmatch(w)]
    if article and density(n) < 0.5:
        said = [w for w in said if not MAYBE.fullmatch(w) and not (n.tag in PLAIN and MATTER.fullmatch(w))]
    return bool(said) or (not inside and n.tag not in HEADINGS and any(HEADER.fullmatch(w) for w in words))


def prune(root: Node) -> None:
    """Take out what is never the article; sizes are measured before."""
    order = list(walk(root))
    for n in reversed(order):
        if n.tag in ("article", "main"):
            p = n.parent
            while p is not None and not p.holds:
                p.holds = True
                p = p.parent
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        n.inside = n.inside or n.tag == "article"
        kept = []
        for c in n.children:
            if isinstance(c, Node):
                if _noisy(c, inside, n.inside):
                    kept.append(" ") if c.tag not in ("script", "style") else None
                    continue
                if c.tag == "header":  # of an article: its headings stay
                    c.children = [h for h in walk(c) if h.tag in HEADINGS]
                c.inside = n.inside
                stack.append((c, inside))
            kept.append(c)
        n.children = kept


def measure(root: Node) -> None:
    """Characters of text, of linked text and with white space, and commas, from the leaves up."""
    for n in reversed(list(walk(root))):
        said = [c for c in n.children if isinstance(c, str)]
        own = [c for c in n.children if isinstance(c, Node)]
        n.size = sum(len("".join(c.split())) for c in said) + sum(c.size for c in own)
        n.chars = sum(map(len, said)) + sum(c.chars for c in own)
        n.commas = sum(c.count(",") for c in said) + sum(c.commas for c in own)
        n.linked = n.size if n.tag == "a" else sum(c.linked for c in own)


def density(n: Node) -> float:
    return n.linked / n.size if n.size else 0.0


def _own(n: Node) -> bool:
    """A paragraph: text of its own and no blocks inside."""
    return n.tag in ("p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article") and not any(isinstance(c, Node) and c.tag in BLOCK for c in n.children) or n.tag == "p"


def best(root: Node) -> Node | None:
    """The container with most points, after the discount for links."""
    found: dict[int, Node] = {}
    for n in walk(root):
        if not n.size or not _own(n):
            continue
        points = (1 + n.commas + min(n.chars // 100, LENGTH_POINTS)) * (1 - density(n))
        p, level = n.parent or n, 0
        while p is not None and level < REACH:
            p.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            found[id(p)] = p
            p, level = p.parent, level + 1
    top, most = None, 0.0
    for n in found.values():
        score = n.points * (1 - density(n))
        if score > most:
            top, most = n, score
    return top


def _menu(n: Node) -> bool:
    """A list of three or more items that are nothing but links, outside an article."""
    if n.inside:
        return False
    items = [c for c in n.children if isinstance(c, Node) and c.tag == "li" and c.size]
    return n.tag in ("ul", "ol") and len(items) > 2 and n.linked == n.size


def kept(root: Node) -> list[Node]:
    top = best(root)
    if top is None:
        return [root] if root.size else []
    n = top
    while n is not None:
        if n.tag in ("article", "main"):
            return [n]
        n = n.parent
    inner = [x for x in walk(top) if x.tag in ("article", "main") and x.size > top.size / 2]
    if inner:
        return inner[:1]
    if top.parent is None or top.tag == "body":
        return [top]
    score, out = top.points * (1 - density(top)), []
    for c in top.parent.children:
        if c is top:
            out.append(c)
        elif isinstance(c, Node) and c.size:
            like = c.points * (1 - density(c)) >= max(3.0, 0.2 * score)
            reads = c.tag in HEADINGS or c.tag in ("p", "pre", "blockquote", "ul", "ol", "table") and density(c) < 0.25
            if (like or reads) and density(c) < 0.5:
                out.append(c)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Text of blocks in page order, white space as single spaces."""
    out: list[str] = []
    said: list[str] = []

    def flush():
        if text := " ".join("".join(said).split()):
            out.append(text)
        said.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            said.append(x)
        elif x.tag == "br":
            said.append(" ")
        elif not _menu(x):
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    measure(root)
    prune(root)
    measure(root)
    return "\n".join(blocks(kept(root)))


def extractions(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row."""

    def work(batch):
        got = [extract(x) for x in batch.column("html").to_pylist()]
        return batch.column("page_id"), batch.column("url"), got, pa.array(map(len, got), pa.int64())

    return map_texts(spread(pages.select("page_id", "url", "html")), "html", "page_id long, url string, text string, n_chars long", work)


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractions(table(spark, sf_dir, "pages"))
