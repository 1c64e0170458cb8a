"""Main text of web pages by wrapper induction.

Pages of one host share a template. A page of median size is the reference of its host; every other page's DOM tree is aligned
with it by simple tree matching (the best order-keeping pairing of children with equal labels, recursively; runs of equal siblings count
as one node, and the texts of the single siblings are looked up in the run). A reference node whose text is the same on most pages that otherwise differ is template and is left out; pages that share
more than half of the article's text with the reference are copies of it and do not count. Varying
slots are content. Within the slots the article is what lies in the article elements, the main element or elements of a telling class if
they hold most of the text (of several, what lies in the least element around them), or else in the body, without
elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments.

All pages count towards the template: they are aligned on their own, wherever they lie, and only sums per (host, reference
node) are shuffled, combined in the task first. References and templates are one small row per host; they are broadcast if their
stored bytes are few and joined by shuffle otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .decontaminate import _small

LEAST_PAGES, CONSTANT_SHARE = 4, 0.8
DEPTH = 60
CELLS = 1 << 16  # pairs of children that are aligned with a whole table

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption""".split())
CLOSES_P = BLOCKS - {"body", "html"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# What is never article text: tags, roles, and words in class or id.
DROPPED_TAGS = frozenset("""nav footer aside form script style noscript template iframe svg button select textarea input dialog menu head title
object canvas audio video datalist""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROPPED_WORDS = frozenset("""nav navbar navigation menu masthead header footer sidebar aside ad ads advert adverts advertisement advertising sponsor
sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup share
sharing social related recommended recommendations comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager widget
toolbar search login copyright skip""".split())
# A class or id is such a word by itself, with neutral words, or at its end ("site-footer"); "related-work" and "notice-period" are not.
# A word of state makes it describe something else ("has-sidebar", "comments-open").
NEUTRAL_WORDS = frozenset("""area article articles bar block body bottom box btn button buttons card cards center column container content count desktop entry
facebook feed floating form global group heading icon icons image inline inner item items label layer left link links list local main mobile module more
outer page panel placeholder placement post posts primary right row secondary section site slot slots small stories story sticky text title top twitter
unit widgets wrap wrapper zone""".split())
STATE_WORDS = frozenset("active closed disabled enabled has hidden hide is js no not off on open show visible with without".split())
# Parts of an article may be called so: a header there has its title.
ARTICLE_PARTS = frozenset("article chapter content entry post section story title".split())
# Sections beside an article that may hold more text, even articles of their own.
REPLY_WORDS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
CONTENT_WORDS = frozenset("article articlebody post entry story".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[a-z0-9]+")


def telling(name: str) -> frozenset[str]:
    """The words by which one class or id says that its element is no article text."""
    words = _WORDS.findall(name)
    found = frozenset(words) & DROPPED_WORDS
    if not found or STATE_WORDS.intersection(words) or (words[-1] == "header" and words[0] in ARTICLE_PARTS):
        return frozenset()
    plain = all(w in found or w in NEUTRAL_WORDS or w[0].isdigit() for w in words)
    return found if plain else found & {words[-1]}


class Node:
    """An element; ``children`` are elements and strings in page order."""

    __slots__ = ("tag", "words", "telling", "role", "hidden", "children", "parent")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.parent, self.children = tag, parent, []
        self.words, self.telling, self.role, self.hidden = frozenset(), frozenset(), "", False
        if "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            self.words = frozenset(_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".lower()))
            if self.words & DROPPED_WORDS:
                names = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".lower().split()
                self.telling = frozenset(w for name in names for w in telling(name))
            self.role = found.get("role", "").strip().lower()
            self.hidden = bool(re.search(r"(?:^|\s)hidden(?:$|[\s=/])", _ATTRIBUTE.sub(" ", attributes)) or "hidden" in found)


def parse(html: str) -> Node:
    """DOM tree of a page; unclosed and stray tags are tolerated, never an error."""
    root = here = Node("#root")
    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in CLOSES_P:
            node = here
            while node is not root and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSED_BY:
            same, fence = CLOSED_BY[tag]
            node = here
            while node is not root and node.tag not in same and node.tag not in fence:
                node = node.parent
            if node.tag in same:
                here = node.parent
        child = Node(tag, attributes, here)
        here.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else size
            child.children.append(html[at:stop])
            close = html.find(">", stop)
            at = size if end is None or close < 0 else close + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            here = child
    return root


def dropped(node: Node, in_article: bool = False) -> bool:
    """Whether an element is no article text by tag, role or attribute. The header of an article stays for its headings."""
    if node.tag in DROPPED_TAGS or node.hidden or node.role in DROPPED_ROLES:
        return not (in_article and node.tag in HEADINGS and not node.hidden)
    return node.tag == "header" and not in_article


def named_dropped(node: Node, in_article: bool = False) -> bool:
    """Whether an element is no article text by class or id."""
    return bool(node.telling - {"header"} if in_article else node.telling) and not (in_article and node.tag in HEADINGS)


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main"


def left_out(body: Node) -> set[int]:
    """Elements (by identity) below the body that are dropped, the outermost ones.

    Words in class or id do not drop an element that holds an article, or more than half of the page's text, unless the page has its
    article elsewhere.
    """
    order: list[tuple[Node, bool, bool]] = []  # element, inside an article, inside one that is not below a dropped name
    stack = [(body, False, False, False)]
    while stack:
        node, inside, below, clean = stack.pop()
        if node is not body and dropped(node, inside or is_article(node)):
            continue
        inside |= is_article(node)
        below |= node is not body and named_dropped(node, inside)
        clean |= is_article(node) and not below
        order.append((node, inside, clean))
        stack.extend((c, inside, below, clean) for c in node.children if not isinstance(c, str))
    whole: dict[int, int] = {}
    plain: dict[int, int] = {}
    holds: set[int] = set()
    for node, inside, _ in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        below = [id(c) for c in node.children if not isinstance(c, str) and id(c) in whole]
        whole[id(node)] = own + sum(whole[c] for c in below)
        plain[id(node)] = 0 if node is not body and named_dropped(node, inside) else own + sum(plain[c] for c in below)
        if any(c in holds for c in below) or is_article(node) and whole[id(node)]:
            holds.add(id(node))
    elsewhere = any(is_article(n) and clean and plain[id(n)] for n, _, clean in order)
    out: set[int] = set()
    stack = [(body, False, False)]
    places = {id(n): (inside, clean) for n, inside, clean in order}
    while stack:
        node, inside, in_clean = stack.pop()
        if id(node) not in places:
            out.add(id(node))
            continue
        inside, clean = places[id(node)]
        if node is not body and named_dropped(node, inside):
            half, reply = 2 * whole[id(node)] > whole[id(body)], bool(node.telling & REPLY_WORDS)
            if elsewhere:
                stays = half and not reply and (in_clean or id(node) in holds)
            else:
                stays = half or id(node) in holds and not reply
            if not stays:
                out.add(id(node))
                continue
        stack.extend((c, inside, in_clean or clean) for c in node.children if not isinstance(c, str))
    return out


def blocks(node: Node, skip: set[int] = frozenset()) -> list[str]:
    """Text blocks below an element in page order, white space joined; elements in ``skip`` (by identity) are left out."""
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [(node, False)]
    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            line.append(unescape(item) if "&" in item else item)
        elif closing:
            flush()
        elif item is not node and id(item) in skip:
            if item.tag in BLOCKS:
                flush()
            else:
                line.append(" ")
        elif item.tag == "br" or item.tag in ("td", "th"):
            line.append(" ")
            stack.extend((c, False) for c in reversed(item.children))
        else:
            if item.tag in BLOCKS:
                flush()
                stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def article_of(root: Node, skip: set[int] = frozenset()) -> tuple[Node, set[int]]:
    """The element that holds the article, and the elements (by identity) that are left out of it.

    It is the article element, or else the main element, or else one of a telling class, if it holds more than half of the text that is
    neither dropped nor in ``skip``. If there are several of a kind, it is the least element around them all. Otherwise it is the body.
    """
    body = next((n for n in elements(root) if n.tag == "body"), root)
    out = left_out(body)
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and id(c) not in out)
    holds: set[int] = set()  # what holds an article element is never template
    sizes: dict[int, int] = {}
    for node in reversed(order):
        below = [c for c in node.children if not isinstance(c, str) and id(c) in sizes]
        if is_article(node) or any(id(c) in holds for c in below):
            holds.add(id(node))
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        sizes[id(node)] = 0 if id(node) in skip and id(node) not in holds else own + sum(sizes[id(c)] for c in below)
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main", lambda n: n.words & CONTENT_WORDS):
        marked = [n for n in order if n is not body and sizes[id(n)] and wanted(n)]
        if not marked:
            continue
        around = _ancestors(marked[0])
        for n in marked[1:]:
            own = {id(x) for x in _ancestors(n)}
            around = [x for x in around if id(x) in own]
        if 2 * sizes[id(around[0])] > sizes[id(body)]:
            return around[0], out
    return body, out


def _ancestors(node: Node) -> list[Node]:
    """An element and those around it, innermost first."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


class Shape:
    """A tree for matching: equal siblings in a row are one node; text is left out."""

    __slots__ = ("label", "children", "nodes")

    def __init__(self, label: str, nodes: list[Node], depth: int = 0):
        self.label, self.nodes, self.children = label, nodes, []
        if depth < DEPTH:
            runs: list[tuple[str, list[Node]]] = []
            for child in (c for n in nodes for c in n.children if not isinstance(c, str)):
                name = child.tag + "".join("." + w for w in sorted(child.words))
                if runs and runs[-1][0] == name:
                    runs[-1][1].append(child)
                else:
                    runs.append((name, [child]))
            self.children = [Shape(name, found, depth + 1) for name, found in runs]


def numbered(shape: Shape) -> list[Shape]:
    out, stack = [], [shape]
    while stack:
        out.append(stack.pop())
        stack.extend(reversed(out[-1].children))
    return out


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: size of the best pairing of two trees, and the pairs.

    Subtrees of equal structure are of one kind. Equal kinds pair node by node, and two different kinds are aligned once, however often they
    meet. Children of equal kind at the start and the end of two lists belong together in some best pairing, so only the stretch
    between them is searched; a long stretch is halved, in memory of its length.
    """
    if a.label != b.label:
        return 0, []
    known: dict[tuple, int] = {}
    kind: dict[int, int] = {}
    inside: list[list[int]] = []  # of each kind: kinds of its children, label, number of nodes
    labels: list[str] = []
    nodes: list[int] = []
    for root in (a, b):
        for shape in reversed(numbered(root)):
            below = tuple(kind[id(c)] for c in shape.children)
            kind[id(shape)] = k = known.setdefault((shape.label, below), len(known))
            if k == len(inside):
                inside.append(list(below))
                labels.append(shape.label)
                nodes.append(1 + sum(nodes[c] for c in below))
    aligned: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def size(x: int, y: int) -> int:
        if x == y:
            return nodes[x]
        if labels[x] != labels[y]:
            return 0
        if (x, y) not in aligned:
            found = paired(inside[x], inside[y], size)
            aligned[x, y] = 1 + sum(size(inside[x][i], inside[y][j]) for i, j in found), found
        return aligned[x, y][0]

    total, pairs, stack = size(kind[id(a)], kind[id(b)]), [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if kind[id(x)] == kind[id(y)]:
            stack.extend(zip(reversed(x.children), reversed(y.children)))
        else:
            stack.extend((x.children[i], y.children[j]) for i, j in reversed(aligned[kind[id(x)], kind[id(y)]][1]))
    return total, pairs


def paired(rows: list[int], columns: list[int], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Positions of the order-keeping pairing of two lists of kinds with the greatest sum of sizes."""
    start, most = 0, min(len(rows), len(columns))
    while start < most and rows[start] == columns[start]:
        start += 1
    end = 0
    while end < most - start and rows[-1 - end] == columns[-1 - end]:
        end += 1
    middle = between(rows[start:len(rows) - end], columns[start:len(columns) - end], size)
    tail = range(end, 0, -1)
    return ([(i, i) for i in range(start)] + [(start + i, start + j) for i, j in middle]
            + [(len(rows) - k, len(columns) - k) for k in tail])


def between(rows: list[int], columns: list[int], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The same for lists without a common start or end; more than ``CELLS`` pairs are halved where the best sums of both halves meet."""
    if not rows or not columns:
        return []
    if min(len(rows), len(columns)) > 1 and len(rows) * len(columns) > CELLS:
        half = len(rows) // 2
        cut = int(np.argmax(best_sums(rows[:half], columns, size) + best_sums(rows[half:][::-1], columns[::-1], size)[::-1]))
        return between(rows[:half], columns[:cut], size) + [(half + i, cut + j) for i, j in between(rows[half:], columns[cut:], size)]
    best = [[0] * (len(columns) + 1)]
    for x in rows:
        above, row = best[-1], [0]
        for j, y in enumerate(columns):
            row.append(max(above[j + 1], row[j], above[j] + size(x, y)))
        best.append(row)
    found, i, j = [], len(rows), len(columns)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def best_sums(rows: list[int], columns: list[int], size: Callable[[int, int], int]) -> np.ndarray:
    """Greatest sum of sizes of a pairing of all rows with the first 0, 1, 2, ... columns."""
    kinds, places = np.unique(np.array(columns), return_inverse=True)
    best, sizes = np.zeros(len(columns) + 1, np.int64), {}
    for x in rows:
        if x not in sizes:
            sizes[x] = np.array([size(x, y) for y in kinds.tolist()], np.int64)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + sizes[x][places]))
    return best


def text_of(nodes: list[Node]) -> str:
    return "\n".join(" ".join(c.split()) for n in nodes for e in elements(n) for c in e.children if isinstance(c, str) and not c.isspace())


class Texts:
    """The text of any elements of a tree, as :func:`text_of` gives it, from one pass over the tree."""

    def __init__(self, root: Node):
        self.parts: list[str] = []
        self.spans: dict[int, tuple[int, int]] = {}
        stack: list[tuple[Node, int]] = [(root, -1)]
        while stack:
            node, start = stack.pop()
            if start >= 0:
                self.spans[id(node)] = start, len(self.parts)
                continue
            stack.append((node, len(self.parts)))
            below = []
            for c in node.children:
                if not isinstance(c, str):
                    below.append((c, -1))
                elif not c.isspace():
                    self.parts.append(" ".join(c.split()))
            stack += below[::-1]

    def of(self, nodes: list[Node]) -> str:
        if len(nodes) == 1:
            start, end = self.spans[id(nodes[0])]
            return "\n".join(self.parts[start:end])
        return "\n".join([p for n in nodes for p in self.parts[slice(*self.spans[id(n)])]])


class Reference:
    """The reference tree of a host with its texts."""

    def __init__(self, html: str):
        self.root = Shape("#root", [parse(html)])
        self.nodes = numbered(self.root)
        self.place = {id(s): i for i, s in enumerate(self.nodes)}
        texts = Texts(self.root.nodes[0])
        self.texts = [texts.of(s.nodes) for s in self.nodes]
        self.blocks = article_blocks(self.root.nodes[0])
        # siblings that a run joins have places of their own, after those of the nodes
        self.singles: dict[int, list[tuple[int, str]]] = {}
        place = len(self.nodes)
        for i, s in enumerate(self.nodes):
            if len(s.nodes) > 1:
                singles = sorted({texts.of([n]) for n in s.nodes} - {""})
                self.singles[i] = [(place + k, t) for k, t in enumerate(singles)]
                place += len(singles)


def article_blocks(root: Node) -> list[str]:
    article, out = article_of(root)
    return blocks(article, out)


def near_copy(own: list[str], reference: list[str]) -> bool:
    """Whether blocks that stand in the reference's article hold more than half of the text of either article."""
    known = set(reference)
    shared = sum(len(b) for b in own if b in known)
    return 2 * shared > min(sum(map(len, own)), sum(map(len, reference)))


def extract(html: str, reference: Reference | None = None, constant: frozenset[int] = frozenset()) -> str:
    """Article text of a page; blocks on lines of their own."""
    root = parse(html)
    skip: set[int] = set()
    if reference is not None and constant:
        texts = Texts(root)
        for r, own in match(reference.root, Shape("#root", [root]))[1]:
            single = {t for p, t in reference.singles.get(reference.place[id(r)], ()) if p in constant}
            if single:
                skip |= {id(n) for n in own.nodes if texts.of([n]) in single}
            if reference.place[id(r)] in constant:
                skip |= {id(n) for n in own.nodes if texts.of([n]) in reference.texts[reference.place[id(r)]]}
    article, out = article_of(root, skip)
    above = article
    while above is not None:  # what holds the article is never template
        skip.discard(id(above))
        above = above.parent
    return "\n".join(blocks(article, skip | out))


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; others, also null, share the empty host."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, constant): the reference page of each host and its template nodes, from all pages."""
    named = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    named = named.where(F.length("html") > 0)
    typical = materialize(named.groupBy("host").agg(F.percentile_approx(F.length("html"), 0.5).alias("size")), "reference-sizes")
    references = named.join(_small(typical), "host").where(F.length("html") == F.col("size")).groupBy("host").agg(F.min("html").alias("reference"))
    references = materialize(references, "references")

    def align(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reference] = {}
        for batch in incoming:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, html, source in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = Reference(source)
                reference = known[host]
                shape = Shape("#root", [parse(html)])
                texts = Texts(shape.nodes[0])
                if texts.of(shape.nodes) == reference.texts[0] or near_copy(article_blocks(shape.nodes[0]), reference.blocks):
                    continue  # a copy or near copy of the reference says nothing about what varies
                for r, own in match(reference.root, shape)[1]:
                    place = reference.place[id(r)]
                    count = sums.setdefault((host, place), [0, 0])
                    count[0] += 1
                    # the roots are at place 0, and that the whole texts differ is known here
                    count[1] += place > 0 and bool(reference.texts[place]) and texts.of(own.nodes) == reference.texts[place]
                    if place in reference.singles:
                        found = {texts.of([n]) for n in own.nodes}
                        for p, t in reference.singles[place]:
                            count = sums.setdefault((host, p), [0, 0])
                            count[0] += 1
                            count[1] += t in found
            rows = [(h, p, *c) for (h, p), c in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "place", "pages", "same"])

    joined = named.join(_small(references), "host").select("host", "html", "reference")
    sums = joined.mapInArrow(align, "host string, place int, pages long, same long").groupBy("host", "place").agg(
        F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = sums.where((F.col("pages") >= LEAST_PAGES) & (F.col("same") >= F.col("pages") * CONSTANT_SHARE))
    constant = constant.groupBy("host").agg(F.collect_list("place").alias("constant"))
    return references.join(constant, "host", "left").select("host", "reference", F.coalesce("constant", F.array().cast("array<int>")).alias("constant"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty html give an empty text; repeated rows each get theirs; pages without a host share one template. Extra
    columns are not looked at.
    """
    wrappers = materialize(induce(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(_small(wrappers), "host", "left").select("page_id", "url", "html", "host", "reference", "constant")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in incoming:
            texts = []
            for html, host, source, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = (Reference(source), frozenset(constant)) if source and constant else (None, frozenset())
                texts.append(extract(html or "", *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
