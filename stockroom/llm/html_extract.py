"""Main text of web pages by wrapper induction.

Pages of one host are dealt into groups of about GROUP pages. In a group the
pages' DOM trees are aligned one after another with a growing template by
simple tree matching (equal tags match; the children of matched nodes are
aligned in order for the most matches). A template node whose text is the same
on nearly all pages that have it is part of the template; a node whose text
varies is a slot. Copies of a page, with equal outlines, count as one page, so
that a page crawled often doesn't become its own template. A page's content is what its slots hold, but for slots whose
element or class says they are not the article: menus, headers, footers,
sidebars, notices, adverts, forms, reader comments. Where the template has an
article or main element, content is what lies inside it, and there only
constant boxes (without paragraphs, headings, lists or tables, or nearly all
links) are dropped, so that a paragraph that many articles share stays.

Trees are aligned as outlines: inline markup folded into its block, runs of
equal siblings and of running text into one node. Siblings are aligned exactly
however many they are; the table of an alignment is kept in part and made again
where it is read.

Results for special rows: a null html is empty and has empty text; pages
without a usable url form a host of their own; a null or repeated ``page_id`` is
handled row by row; a page alone in its group has no template, so the element
and class rules alone decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_side, stored

GROUP = 32
CONSTANT_PAGES = 4        # a node on fewer distinct pages is never called constant
CONSTANT_SHARE = 0.8      # of the pages that have it
WIDE = 64                 # so many siblings are aligned a row at a time by numpy, fewer one by one; the pairs are the same
DEEPEST = 60              # levels of the outline

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
DROPPED = frozenset("script style textarea title noscript iframe template xmp head svg math canvas object audio video select "
                    "option button input form nav footer aside menu dialog map datalist".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
FLOW = frozenset("p h2 h3 h4 h5 h6 blockquote pre".split())
PROSE = FLOW | {"h1", "li", "ul", "ol", "dl", "dt", "dd", "table", "figure"}
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager sidebar aside widget related recommended recommendations share sharing social "
    "footer login search toolbar topbar skip".split())
COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
# These name the page's own head only outside an article.
HEADS = frozenset("header masthead".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+|[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "marks", "children", "parent", "chrome", "outline", "inside")

    def __init__(self, tag: str, parent: Node | None, marks: frozenset = frozenset()):
        self.tag, self.parent, self.marks = tag, parent, marks
        self.children: list = []  # nodes and strings
        self.chrome = False
        self.outline = None       # the outline node this element belongs to
        self.inside = parent is not None and (parent.inside or parent.tag in MAIN)


def _marks(attributes: str) -> frozenset:
    """Words of class, id and role, and ``hidden``."""
    if not attributes or ("=" not in attributes and "hidden" not in attributes):
        return frozenset()
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            out.update(x.lower() for x in _TOKENS.findall(value))
        elif name == "role":
            out.add("role=" + value.strip().lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("hidden")
    return frozenset(out)


def parse(page: str) -> Node:
    """A page's DOM tree; missing end tags are implied, stray ones ignored."""
    root = node = Node("#root", None)
    open_tags: Counter = Counter()
    at, n = 0, len(page)

    def close(to: Node) -> Node:
        here = node
        while here is not to:
            open_tags[here.tag] -= 1
            here = here.parent
        open_tags[to.tag] -= 1
        return to.parent

    while at < n:
        start = page.find("<", at)
        if start < 0:
            node.children.append(page[at:])
            break
        if start > at:
            node.children.append(page[at:start])
        m = _TAG.match(page, start)
        if m is None:  # a bare "<"
            node.children.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                here = node
                while here.tag != tag:
                    here = here.parent
                node = close(here)
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            here = node
            while here.tag != "p" and here.tag not in ("td", "th", "li", "button"):
                here = here.parent
                if here is root:
                    break
            if here.tag == "p":
                node = close(here)
        elif tag in SAME_CLOSES and open_tags[tag]:
            stop, here = SAME_CLOSES[tag], node
            while here is not root and here.tag != tag and here.tag not in stop:
                here = here.parent
            if here.tag == tag:
                node = close(here)
            if tag in ("dt", "dd"):
                other = "dd" if tag == "dt" else "dt"
                here = node
                while here is not root and here.tag not in (other, "dl"):
                    here = here.parent
                if here.tag == other:
                    node = close(here)
        new = Node(tag, node, _marks(m[3]))
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/") or tag in CLOSES_P and tag != "hr":
            node = new
            open_tags[tag] += 1
    return root


def _order(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.children) if type(x) is Node]
    return out


class Page:
    """A parsed page: its elements in order, which are chrome, and its outline."""

    def __init__(self, text: str):
        self.root = parse(text)
        self.nodes = _order(self.root)
        prose, holds_main, holds_head = self._weights()
        total = prose[id(self.root)]
        for node in self.nodes:
            # a box with most of the page's prose and its heading isn't chrome, whatever its class says
            whole = 2 * prose[id(node)] >= total > 0
            node.chrome = (node.parent is not None and node.parent.chrome) or self._chrome(
                node, id(node) in holds_main, whole and id(node) in holds_head)
        self.outline = self._outline()

    def _weights(self) -> tuple[dict, set, set]:
        """Characters of paragraphs below each element, and the elements with a main element or with a heading below."""
        prose: dict[int, int] = {}
        holds_main, holds_head = set(), set()
        for node in reversed(self.nodes):
            own = sum(len(x) for x in node.children if type(x) is str) if node.tag not in DROPPED else 0
            below = [x for x in node.children if type(x) is Node and x.tag not in DROPPED]
            flow = node.tag in FLOW or node.tag in INLINE
            prose[id(node)] = own * flow + sum(prose[id(x)] for x in below)
            if "role=main" in node.marks or node.tag in MAIN and not node.marks & COMMENT or any(
                    id(x) in holds_main and not x.marks & COMMENT for x in below):
                holds_main.add(id(node))
            if node.tag in ("h1", "main") or any(id(x) in holds_head for x in below):
                holds_head.add(id(node))
        return prose, holds_main, holds_head

    @staticmethod
    def _chrome(node: Node, holds_main: bool, whole: bool) -> bool:
        if node.tag in DROPPED or "hidden" in node.marks:
            return True
        if node.tag in ("html", "body", "#root", "main"):
            return False
        if node.tag == "header" and not node.inside and not holds_main:
            return True
        if not node.marks or whole:
            return False
        if node.marks & COMMENT or node.marks & CHROME and not holds_main:
            return True
        if any(x.startswith("role=") and x[5:] in ROLES for x in node.marks):
            return True
        return not node.inside and not holds_main and bool(node.marks & HEADS)

    def _outline(self) -> Outline:
        top = Outline("#root", None)
        self.root.outline = top
        level = {id(top): 0}
        for node in self.nodes[1:]:
            up = node.parent.outline
            if node.tag in INLINE or node.chrome or level[id(up)] >= DEEPEST:
                node.outline = up
                continue
            flow = node.tag in FLOW
            label = "#flow" if flow else node.tag
            last = up.children[-1] if up.children else None
            if last is not None and last.label == label and (flow or last.marks == node.marks):
                node.outline = last  # a run of equal siblings is one node
            else:
                node.outline = Outline(label, up, node.marks)
                level[id(node.outline)] = level[id(up)] + 1
        for node in self.nodes:
            if not node.chrome:
                for x in node.children:
                    if type(x) is str:
                        node.outline.said.append(x)
        top.close()
        return top


class Outline:
    """A node of an outline, or of the template (with what the pages' nodes say there)."""
    __slots__ = ("label", "marks", "parent", "children", "said", "text", "to", "pages", "texts", "shape")

    def __init__(self, label: str, parent: Outline | None, marks: frozenset = frozenset()):
        self.label, self.marks, self.parent = label, marks, parent
        self.children: list[Outline] = []
        self.said: list[str] = []
        self.text, self.to = 0, None
        self.pages, self.texts = 0, None
        self.shape = -id(self)  # its own until shapes are numbered
        if parent is not None:
            parent.children.append(self)

    def order(self) -> list[Outline]:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += x.children
        return out

    def close(self) -> None:
        """Reduce what was said, with all below, to one number; 0 if nothing."""
        for x in reversed(self.order()):
            own = " ".join("".join(x.said).split())
            x.said = []
            below = tuple(c.text for c in x.children)
            x.text = hash((own, below)) if own or any(below) else 0


def match(a: Outline, b: Outline, memo: dict) -> int:
    """Simple tree matching: the most pairs of equal labels in an order-preserving mapping of both trees."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    key = (a.shape, b.shape)
    if key not in memo:
        memo[key] = 1 + Alignment(a, b, memo).best
    return memo[key]


class Alignment:
    """The table of best matchings of the first children of ``a`` with the first children of ``b``.

    Every entry follows from the row before, so only each ``step``-th row is kept; the rows between
    are made again, step by step, when the pairs are read back from the end. Weights depend on the
    shapes of the two children only.
    """

    def __init__(self, a: Outline, b: Outline, memo: dict):
        self.a, self.b, self.memo = a.children, b.children, memo
        self.step = int(len(self.a) ** 0.5) + 1
        self.weights: dict = {}
        self.wide = len(self.b) >= WIDE
        row = np.zeros(len(self.b) + 1, dtype=np.int32) if self.wide else [0] * (len(self.b) + 1)
        if self.wide:
            first = {y.shape: y for y in self.b}  # one child of each shape
            place = {shape: k for k, shape in enumerate(first)}
            self.kinds, self.at = list(first.values()), np.array([place[y.shape] for y in self.b])
        self.kept = {0: row}
        for i, x in enumerate(self.a, 1):
            row = self._next(row, x)
            if i % self.step == 0:
                self.kept[i] = row
        self.best = int(row[-1])

    def _weight(self, x: Outline):
        """What pairing ``x`` with each child of ``b`` gives; 0: their labels differ."""
        if x.shape not in self.weights:
            if self.wide:
                w = np.array([match(x, y, self.memo) for y in self.kinds], dtype=np.int32)[self.at]
            else:
                w = [match(x, y, self.memo) for y in self.b]
            self.weights[x.shape] = w
        return self.weights[x.shape]

    def _next(self, above, x: Outline):
        w = self._weight(x)
        if self.wide:
            row = above.copy()
            np.maximum(row[1:], above[:-1] + w, out=row[1:])  # without a pair it is at most the entry above
            return np.maximum.accumulate(row, out=row)
        row = [0]
        for j, k in enumerate(w):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if k and above[j] + k > best:
                best = above[j] + k
            row.append(best)
        return row

    def pairs(self) -> list[tuple[Outline, Outline]]:
        m, n, out = len(self.a), len(self.b), []
        while m and n:
            first = (m - 1) // self.step * self.step
            rows = [self.kept[first]]
            for x in self.a[first:m]:
                rows.append(self._next(rows[-1], x))
            while m > first and n:
                here, above = rows[m - first], rows[m - first - 1]
                if here[n] == above[n]:
                    m -= 1
                elif here[n] == here[n - 1]:
                    n -= 1
                else:
                    m, n = m - 1, n - 1
                    out.append((self.a[m], self.b[n]))
        return out[::-1]


def _shape(top: Outline, shapes: dict) -> None:
    """Number the shapes (labels alone) of ``top`` and all below; equal shapes have equal numbers."""
    for x in reversed(top.order()):
        x.shape = shapes.setdefault((x.label, tuple(c.shape for c in x.children)), len(shapes))


def _pairs(a: Outline, b: Outline, memo: dict) -> list[tuple[Outline, Outline]]:
    """The children of matched nodes that the alignment pairs."""
    return Alignment(a, b, memo).pairs() if a.children and b.children else []


def induce(pages: list[Page]) -> Outline:
    """The template of ``pages``: their outlines aligned one by one, with a count of every node's texts.

    Pages that say the same throughout are copies: all are aligned, one counts.
    """
    template = Outline("#root", None)
    counted: set[int] = set()
    shapes: dict = {}
    memo: dict = {}
    for page in pages:
        _shape(template, shapes)
        _shape(page.outline, shapes)
        vote = page.outline.text not in counted
        counted.add(page.outline.text)
        stack = [(template, page.outline)]
        while stack:
            t, o = stack.pop()
            o.to = t
            if vote:
                t.pages += 1
                t.texts = t.texts if t.texts is not None else Counter()
                t.texts[o.text] += 1
            found = {id(y): x for x, y in _pairs(t, o, memo)}
            place = 0
            for y in o.children:
                x = found.get(id(y))
                if x is None:  # a node the template hasn't seen goes in where the page has it
                    x = Outline(y.label, None, y.marks)
                    x.parent = t
                    t.children.insert(place, x)
                    place += 1
                else:
                    place = t.children.index(x, place) + 1
                stack.append((x, y))
    return template


def _constant(t: Outline) -> bool:
    return t.pages >= CONSTANT_PAGES and t.texts is not None and max(t.texts.values()) >= CONSTANT_SHARE * t.pages


def extract(page: Page) -> str:
    """The page's main text, once its outline is aligned with the template."""
    mains = [x for x in page.nodes if (x.tag in MAIN or "role=main" in x.marks) and not x.chrome]
    if mains:
        inner = [x for x in mains if x.tag == "article"] or mains
        ids = {id(x) for x in inner}
        tops = []
        for x in inner:  # outermost ones
            here = x.parent
            while here is not None and id(here) not in ids:
                here = here.parent
            if here is None:
                tops.append(x)
        text = "\n".join(filter(None, (_text(x, inside=True) for x in tops)))
        if text:
            return text
    return _text(page.root, inside=False)


def _linked(node: Node) -> bool:
    """A list or box whose text is nearly all links, as in menus the markup doesn't name."""
    all_chars = link_chars = 0
    stack = [(node, False)]
    while stack:
        x, in_link = stack.pop()
        for c in x.children:
            if type(c) is str:
                k = len("".join(c.split()))
                all_chars += k
                link_chars += k * in_link
            elif not c.chrome:
                if c.tag in FLOW:
                    return False
                stack.append((c, in_link or c.tag == "a"))
    return all_chars > 0 and link_chars >= 0.8 * all_chars


def _prose(node: Node) -> bool:
    """Whether an element that holds running text is the node or below it."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in PROSE or x.tag in MAIN:
            return True
        stack += [c for c in x.children if type(c) is Node and not c.chrome]
    return False


def _text(top: Node, inside: bool) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = entities.unescape("".join(line)).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif type(x) is str:
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.chrome:
            block = x.tag not in INLINE
            if block and x is not top and _drop(x, inside):
                end()
                continue
            if block:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return "\n".join(blocks)


def _drop(x: Node, inside: bool) -> bool:
    own = x.outline is not None and x.parent.outline is not x.outline
    constant = own and x.outline.to is not None and _constant(x.outline.to)
    if inside:
        return constant and (not _prose(x) or x.tag not in PROSE and x.tag not in MAIN and _linked(x))
    if constant and x.tag not in ("html", "body"):
        return True
    return x.tag in ("ul", "ol", "div", "section", "table", "p") and _linked(x)


def texts_of_group(htmls: list[str]) -> list[str]:
    pages = {x: Page(x) for x in dict.fromkeys(htmls)}  # equal pages are aligned once
    if len(pages) >= CONSTANT_PAGES:
        induce(list(pages.values()))
    texts = {x: extract(p) for x, p in pages.items()}
    return [texts[x] for x in htmls]


def main_text(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html)."""

    def run(table: pa.Table) -> pa.Table:
        texts = texts_of_group(table.column("html").to_pylist())
        return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string())],
                        names=["page_id", "url", "text"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host)
    counts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).alias("groups"))
    rows = rows.join(small_side(stored(counts, "html-hosts")), "host")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.col("groups")))
    return (rows.select("host", "part", "page_id", "url", "html").groupBy("host", "part")
            .applyInArrow(run, "page_id long, url string, text string"))
