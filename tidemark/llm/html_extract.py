"""Main-text extraction by composite text density.

A page is read into a tree. Every node gets the characters and tags of its subtree, and how many of
them belong to links. Its density is characters per tag, adjusted by links: a node whose text is
mostly link text falls towards zero. A text node is a node without tags, so its density is its characters, and
nothing inside a link. Each element is scored by the sum of its child nodes' densities; the
node with the largest sum marks the article, and an article or main element around it is taken whole.
Where there is none, the smallest density on the path from the body to that node is the threshold: from
the body down, every node that reaches it gives the node of the largest sum in its subtree, so an article
that is spread over several siblings stays whole, with what stands between them, and nodes below the threshold stay out.
Inside, menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by
their elements, roles and class names, and link lists by their density. Class names are a weak signal: they don't
count for headings and inline elements, around nearly all of the text, or if they only say what a page has or
lacks (``has-``, ``no-``, ``with-``), and those of related matter count only where links hold most of the text.

Defined results: null or empty html, or a page without text, gives an empty text. Unclosed and
misnested elements are closed as browsers do (a paragraph ends where the next block begins, the head
where the first content does); quotes in a tag count only after an equals sign. Broken
markup never raises: a ``<`` that opens no tag is text. Whole pages are read at any length, in time in
proportion to it.
"""

from __future__ import annotations

import heapq
import html as entities
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches

# Element names by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style noscript template head title svg math canvas object iframe audio video select option datalist textarea xmp noembed noframes button".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCK - frozenset("td th tr tbody thead tfoot body html".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
WHOLE = frozenset("body html article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = HEADINGS | frozenset("p blockquote li pre ul ol dl figure".split())
SCOPE = frozenset("table ul ol dl article section main div body html td th blockquote nav aside header footer form".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-?bar|widget\w*|menu\w*|nav\w*|breadcrumbs?|footer|masthead|comments?|respond|disqus|reply|replies|cookie\w*|consent|notice|notification|alert|popup|modal|newsletter|subscribe|subscription|signup|share|sharing|social\w*|related|recommend\w*|toolbar|pagination|pager|skip-?link\w*|login|search-?(?:form|box))(?:$|[\s_-])",
    re.I,
)
OTHERS_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|respond|disqus|reply|replies)(?:$|[\s_-])", re.I)
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
HEAD = frozenset("base basefont bgsound link meta noscript script style template title head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
LINKED_NAMES = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*)(?:$|[\s_-])", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VALUE = r"\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
TAG = re.compile(rf"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|={VALUE}|=)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(rf"([^\s=/]+)(?:\s*+=({VALUE})?)?", re.S)
NAMED = re.compile(r"class|id|role|hidden", re.I)


class Node:
    __slots__ = ("tag", "names", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "top", "bad", "named")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.kids = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.bad = tag in HIDDEN or tag in BOILERPLATE
        self.named = ""  # why the node is bad, where that is only a name or a form
        if tag == "form":
            self.bad, self.named = False, tag
        if attributes and not self.bad and NAMED.search(attributes):
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip().strip("\"'")
                if name in ("class", "id"):
                    if tag not in WHOLE and tag not in HEADINGS and tag not in INLINE and BAD_NAMES.search(value := LAYOUT_NAMES.sub("", value)):
                        self.named += " " + value
                elif name == "role":
                    self.bad = self.bad or value.lower() in BAD_ROLES
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.bad = True
        if self.bad:
            self.named = ""
        self.bad = self.bad or bool(self.named)


class Parser:
    """Open elements of a page while it is read; those of each name are on a stack, so no search walks up the tree."""

    def __init__(self):
        self.root = Node("html", None)
        self.node, self.level = self.root, 0
        self.open: dict[str, list[tuple[int, Node]]] = {}  # by name: depth and node

    def push(self, node: Node) -> None:
        self.node, self.level = node, self.level + 1
        self.open.setdefault(node.tag, []).append((self.level, node))

    def up_to(self, node: Node) -> None:
        """Close all elements below a node that is open."""
        while self.node is not node:
            self.open[self.node.tag].pop()
            self.node, self.level = self.node.parent, self.level - 1

    def deepest(self, names: Iterable[str]) -> tuple[int, Node | None]:
        return max((self.open[n][-1] for n in names if self.open.get(n)), key=lambda x: x[0], default=(0, None))

    def close(self, names: Iterable[str], stop: Iterable[str]) -> None:
        """Close the innermost open element of these names, if none of ``stop`` is inside it."""
        level, found = self.deepest(names)
        if found is not None and level > self.deepest(stop)[0]:
            self.up_to(found.parent)


LISTS = frozenset(("table", "ul", "ol", "dl"))


def parse(html: str) -> Node:
    """Tree of a page; text is kept as strings among the children, entities decoded."""
    p, at, n, begun = Parser(), 0, len(html), False  # begun: the head ended without a body tag

    def text(raw: str) -> None:
        nonlocal begun
        if p.node.tag == "head" and raw and not raw.isspace():
            p.up_to(p.root)
            begun = True
        if raw:
            p.node.kids.append(entities.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            _, found = p.deepest((name,))
            if found is not None:
                p.up_to(found.parent)
            continue
        if p.node.tag == "head" and name not in HEAD:
            p.up_to(p.root)
            begun = name not in ("html", "body", "frameset")
        if name in ("html", "body") and (p.node is p.root or begun):
            if name == "body" and not begun:
                p.node.kids.append(new := Node("body", p.node, m[3]))
                p.push(new)
            continue
        if name in CLOSES_PARAGRAPH:
            p.close(("p",), SCOPE)
        if name in CLOSED_BY:
            p.close(CLOSED_BY[name], LISTS - {name} if name not in ("dt", "dd") else ("dl",))
        p.node.kids.append(new := Node(name, p.node, m[3]))
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        p.push(new)
    return p.root


def measure(root: Node) -> Node:
    """Counts, densities and density sums of every node, bottom up; returns the body (or the root)."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if not isinstance(k, str)]
    body = next((x for x in order if x.tag == "body"), root)
    for x in reversed(order):
        if x.tag in HIDDEN and x is not root:
            continue
        link = x.tag == "a"
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(k) - sum(map(str.isspace, k)) if len(k) < 64 else len("".join(k.split()))
            elif k.tag not in HIDDEN:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
        if link:
            x.link_chars = x.chars
    whole = max(1, body.chars)
    slope = body.link_chars / whole
    for x in order:
        if x.tag in HIDDEN or not x.chars:
            continue
        plain = x.chars / max(1, x.tags)
        if x.link_chars:
            rest = max(1, x.chars - x.link_chars)
            base = math.log(x.chars * x.link_chars / rest + slope * x.chars + math.e)
            plain *= math.log(max(1.0, x.chars / x.link_chars * max(1, x.tags) / max(1, x.link_tags)) + 1e-9, base) if base > 1 else 1.0
        x.density = max(0.0, plain)
    for x in order:
        if x.named and x.bad and 2 * x.link_chars < x.chars and not BAD_NAMES.search(LINKED_NAMES.sub(" ", x.named)) and x.tag != "form":
            x.bad = False
    free_wrappers(body)
    for x in order:
        below = [k for k in x.kids if not isinstance(k, str)]
        own = x.chars - sum(k.chars for k in below if k.tag not in HIDDEN) if x.chars and x.tag != "a" else 0
        x.total = sum(k.density for k in below if not k.bad) + own
    return body


def free_wrappers(body: Node) -> None:
    """Names count only for nodes that hold little: what is named bad but holds nearly all text, or half of it and the page's heading or article, is a wrapper."""
    plain = lambda x: x.chars - x.link_chars

    def scan(top: Node) -> int:
        """Plain text below a node that is outside the bad ones, whose named ones become candidates."""
        rest, stack = plain(top), [k for k in top.kids if not isinstance(k, str)]
        while stack:
            x = stack.pop()
            if x.tag in HIDDEN:
                continue
            if not x.bad:
                stack += [k for k in x.kids if not isinstance(k, str)]
                continue
            rest -= plain(x)
            if x.named and plain(x) > 0:
                heapq.heappush(heap, (-plain(x), next(number), x))
        return rest

    heap, number = [], itertools.count()
    rest = scan(body)
    while heap:
        size, _, x = heapq.heappop(heap)
        if -size < rest:
            return
        others = OTHERS_NAMES.search(x.named)
        if 4 * rest <= -size and not others or _encloses(x, ("h1", "main") if others else ("h1", "main", "article")):
            x.bad = False
            rest += scan(x)


def _encloses(x: Node, tags: tuple[str, ...]) -> bool:
    stack = [x]
    while stack:
        x = stack.pop()
        if x.tag in tags:
            return True
        stack += [k for k in x.kids if not isinstance(k, str) and (not k.bad or k.named)]
    return False


def _raised(x: Node, stop: set[Node]) -> Node:
    """One paragraph outweighs the sum of its siblings: its container holds the article. Stops below the nodes of ``stop``."""
    while x.parent is not None and x.parent not in stop and (x.tag not in BLOCK or x.tag in ("p", "blockquote", "li", "pre")):
        x = x.parent
    return x


def select(body: Node) -> Node:
    """The article or main element around the largest density sum, or else the body pruned to the subtrees that reach the threshold of the path."""
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [k for k in x.kids if not isinstance(k, str) and not k.bad]
    for x in reversed(order):
        x.top = max([x, *(k.top for k in x.kids if not isinstance(k, str) and not k.bad)], key=lambda t: t.total)
    best = body.top
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    home = best if best.tag in ("article", "main") else None
    for x in path[1:]:
        home = x if x.tag in ("article", "main") else home
        if x.tag == "article":
            break
    if home is not None:
        return home
    threshold = min(x.density for x in path)
    for x in path[1:]:  # an ancestor that adds little to the best sum is its frame
        if x.tag not in ("body", "html") and x.total >= 0.5 * path[0].total:
            best = x
    best = _raised(best, set())
    if best is body:
        return best
    above, marked = set(path[path.index(best) + 1 :]), {best}
    stack = [body] if threshold > 0 else []
    while stack:
        x = stack.pop()
        if x in marked:
            continue
        if x not in above:
            marked.add(_raised(x.top, above))
        stack += [k for k in x.kids if not isinstance(k, str) and not k.bad and k.density >= threshold]
    _prune(body, marked)
    return body


def _prune(body: Node, marked: set[Node]) -> None:
    """Leaves below the body the marked subtrees, what stands between them, and the headings and loose text that belong to them."""
    holds = set()
    for x in marked:
        while x is not None and x not in holds:
            holds.add(x)
            x = x.parent
    stack = [body]
    while stack:
        x = stack.pop()
        if x in marked:
            continue
        at = [i for i, k in enumerate(x.kids) if not isinstance(k, str) and k in holds]
        first, last = at[0], at[-1]
        stack += [x.kids[i] for i in at]
        if first < last:  # the article is spread over this node
            x.kids = [k for i, k in enumerate(x.kids) if first <= i <= last or isinstance(k, str) or k.tag in TEXTUAL and 2 * k.link_chars <= k.chars]
            continue
        while first and (isinstance(k := x.kids[first - 1], str) and not k.strip() or not isinstance(k, str) and k.tag in HEADINGS):
            first -= 1
        x.kids = x.kids[first : last + 1]


def blocks(top: Node) -> list[str]:
    """Text of the blocks below a node in page order, white space made single, boilerplate left out."""
    out, now = [], []

    def flush() -> None:
        line = " ".join("".join(now).split())
        if line:
            out.append(line)
        now.clear()

    stack: list = [(top, 0)]
    while stack:
        node, at = stack.pop()
        if at == 0 and node.tag in BLOCK:
            flush()
        kids = node.kids
        while at < len(kids):
            k = kids[at]
            at += 1
            if isinstance(k, str):
                now.append(k)
            elif k.tag == "br":
                now.append(" ")
            elif k.tag == "hr":
                flush()
            elif not k.bad and not _link_list(k):
                stack.append((node, at))
                stack.append((k, 0))
                break
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return out


def _link_list(x: Node) -> bool:
    return x.tag in ("ul", "ol", "div", "section", "table") and x.link_tags >= 3 and x.link_chars >= 0.8 * x.chars


def main_text(html: str | None) -> str:
    """Main text of a page: its blocks joined by an empty line."""
    if not html:
        return ""
    return "\n\n".join(blocks(select(measure(parse(html)))))


EXTRACT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_column(html: Column) -> Column:
    """Struct (text, n_chars) of every page's html, as a column."""
    bound_batches()

    @F.pandas_udf(EXTRACT)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            texts = [main_text(h) for h in pages]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return extract(html)
