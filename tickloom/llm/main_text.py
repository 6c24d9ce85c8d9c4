"""Main text of HTML pages by tree scoring.

The markup is read once, from front to back, into a tree with the usual repairs for tag soup. Paragraphs pass points, for
their length and their commas, to their ancestors, the nearer the more; each container's sum is discounted by the share of
its text that is inside links. The article or main element around the best container is kept whole, and with an article those beside
it that have points of its order; where there is none, the best container and those siblings that score near it or read like text. Menus,
page headers, footers, sidebars, scripts and styles are taken out by element and role wherever they stand, forms unless they hold the
page's article; formulas are text.

A class or id alone takes little out: names of adverts, notices, menus, sidebars and comments do, unless the element holds an article,
main or h1 element, or most of the points of a page that has none; names such as `social` or `related` only if the
element reads like boilerplate (links, scraps).

Cases: null, empty and text-free pages give an empty string; a page without any paragraph gives the blocks of its body;
unclosed and stray tags are repaired; pages of any length and depth are read whole, in time in proportion to their length;
of containers with equal points the first in page order is the best; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.shared import bounded_batches, slices

#: Element names of HTML, by the part that they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
#: Of these the content is never markup: without an end tag they take the rest of the page.
OPAQUE = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside annotation annotation-xml button select option input label fieldset dialog menu search script style noscript template textarea title iframe svg object head xmp noembed noframes".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
#: Siblings of the best container that are kept for what they are, if they aren't mostly links.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup ul ol dl pre table blockquote figure".split())
LISTS = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"])}
CONTAINERS = frozenset(x for names in LISTS.values() for x in names)
TABULAR = frozenset("table caption tbody thead tfoot tr td th body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id names, whole or as first or last part of a hyphenated one, that say what an element is.
NAMED = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|comments?|comment-?list|disqus\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|pager|pagination)"
    r"(?:[-_](?:\w+[-_])*(?:ad|ads|area|banner|bar|block|box|container|content|form|inner|item|items|left|right|links?|list|main|menu|message|notice|outer|panel|section|slot|thread|top|bottom|unit|widget|wrap|wrapper|\d+))?"
    r"|(?:\w+[-_])+(?:ad|ads|advert|comments|nav|navbar|menu|breadcrumbs?|sidebar|footer|cookies|newsletter|pagination)"
    r"|(?:page|site|global|top)[-_]header",
    re.I,
)
#: Names that say what a page has or lacks, not what an element is.
STATE = re.compile(r"(?:has|no|not|is|with|without)[-_].*", re.I)
SUSPECT = re.compile(r"(?:promo\w*|banner|reply|replies|respond|header|foot|signup|login|social|share|sharing|share-?(?:bar|buttons?|links?)|social-?(?:bar|buttons?|links?|share)|related\w*|related-(?:posts|articles|links)|recommend\w*|widgets?|toolbar|legal|copyright|hidden|skip)", re.I)
_SPACE = re.compile(r"[\s/]*")
_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_AHEAD = {what: re.compile(re.escape(what), re.I | re.A) for what in ["-->", *(f"</{tag}" for tag in RAW)]}
_ENDS = frozenset(".!?…。\"”»")
#: Of how many ancestors a paragraph's points are passed to.
LEVELS = 6
#: An article beside the best one is kept too from this share of its points on.
NEAR = 0.2


class Node:
    """An element: its items are texts and elements in page order; `name` is 2 if its class says what it is, 1 if it is suspect."""

    __slots__ = ("tag", "parent", "items", "drop", "name", "points", "share", "heads", "length", "linked", "commas", "last")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, name: int = 0):
        self.tag, self.parent, self.drop, self.name = tag, parent, drop, name
        self.items: list = []
        self.points = self.share = 0.0
        self.length = self.linked = self.commas = self.heads = 0
        self.last = ""


@lru_cache(10_000)
def _kind(tag: str, attributes: tuple[tuple[str, str], ...]) -> tuple[bool, int]:
    """Whether an element is boilerplate for certain, and what its names say."""
    drop, name = tag in DROPPED, 0
    for key, value in attributes:
        if key in ("class", "id"):
            for word in value.split():
                if not STATE.fullmatch(word):
                    name = max(name, 2 if NAMED.fullmatch(word) else 1 if SUSPECT.fullmatch(word) else 0)
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            drop = True
    if tag == "form":  # it may be around the whole page: its text decides
        name = 2
    return (False, 0) if tag in ("html", "body", "article", "main") else (drop, name)


class _Reader:
    """Reads a page once: whatever is looked for and not there is looked for one time only."""

    def __init__(self, page: str):
        self.page = page
        self.final = {c: page.rfind(c) for c in "\"'>"}
        self.missing: set[str] = set()
        self.root = Node("html", None)
        self.open = [self.root]
        self.scopes = [Counter()]  # open elements since the nearest open table, td or th
        self.opened: Counter = Counter()
        self.lists: list[tuple[int, list[int]]] = [(0, [])]  # depth of each open list, and of its open items
        self.cells: list[int] = []  # depths of open tables and cells

    def _ahead(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = _AHEAD[what].search(self.page, at)
        if not found:
            self.missing.add(what)
        return found.start() if found else -1

    def _push(self, node: Node) -> None:
        tag, depth = node.tag, len(self.open)
        self.open.append(node)
        self.opened[tag] += 1
        if tag in ("table", "td", "th"):
            self.cells.append(depth)
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1
        if tag in CONTAINERS:
            self.lists.append((depth, []))
        elif tag in LISTS:
            self.lists[-1][1].append(depth)

    def _pop(self) -> None:
        node = self.open.pop()
        tag, depth = node.tag, len(self.open)
        self.opened[tag] -= 1
        self.scopes[-1][tag] -= 1
        if tag in ("table", "td", "th"):
            self.cells.pop()
            self.scopes.pop()
        if tag in CONTAINERS:
            self.lists.pop()
        elif tag in LISTS and self.lists[-1][1] and self.lists[-1][1][-1] == depth:
            self.lists[-1][1].pop()

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def _pop_tag(self, tag: str) -> None:
        while self.open[-1].tag != tag:
            self._pop()
        self._pop()

    def _make_room(self, tag: str) -> None:
        """Closes what a start tag closes without an end tag."""
        if tag in BLOCK and self.scopes[-1]["p"]:
            self._pop_tag("p")
        if tag in LISTS:
            items, cell = self.lists[-1][1], self.cells[-1] if self.cells else 0
            if items and items[-1] > cell and (self.open[items[-1]].tag == tag or tag != "li" and self.open[items[-1]].tag in ("dt", "dd")):
                self._pop_to(items[-1])
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            if self.cells and self.open[self.cells[-1]].tag != "table":
                self._pop_to(self.cells[-1])
            if tag not in ("td", "th") and self.scopes[-1]["tr"]:
                self._pop_tag("tr")

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes of a start tag, and where it ends. A quote that is never closed ends with the tag."""
        page, found, size = self.page, [], len(self.page)
        while True:
            at = _SPACE.match(page, at).end()
            if at >= size or page[at] == ">":
                return found, min(at + 1, size)
            m = _NAME.match(page, at)
            name, at = m[0].lower(), m.end()
            value = ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ("'", '"') and at < self.final[quote]:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            found.append((name, value))

    def _start(self, at: int) -> tuple[tuple[tuple[str, str], ...], int]:
        """Attributes of a start tag whose name ends at `at`, and where it ends; what has no attributes is done at once."""
        if self.page.startswith(">", at):
            return (), at + 1
        found, end = self._attributes(at)
        return tuple(found), end

    def read(self) -> Node:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self.open[-1].items.append(page[at:mark])
            if mark == size:
                break
            at = self._markup(mark)
        self._pop_to(1)
        return self.root

    def _markup(self, at: int) -> int:
        """Takes in the markup at a `<`; the place after it."""
        page, size, then = self.page, len(self.page), self.page[at + 1 : at + 2]
        if at > self.final[">"] and then != "!":
            self.open[-1].items.append(page[at:])  # no tag ends any more: the rest is text
            return size
        if page.startswith("<!--", at):
            end = self._ahead("-->", at + 4)
            return size if end < 0 else end + 3
        if then in ("!", "?"):
            end = page.find(">", at)
            return size if end < 0 else end + 1
        closing = then == "/"
        m = _TAG.match(page, at + 1 + closing)
        if not m:
            if closing:
                return page.find(">", at) + 1
            self.open[-1].items.append("<")
            return at + 1
        tag = m[0].lower()
        if closing:
            if tag not in ("html", "body") and (self.scopes[-1][tag] or tag in TABULAR and self.opened[tag]):
                self._pop_tag(tag)
            return page.find(">", m.end()) + 1
        attributes, end = self._start(m.end())
        if tag in ("html", "body"):
            if tag == "body" and self.opened["head"]:
                self._pop_tag("head")
            return end
        closed = page.endswith("/>", at, end)
        self._make_room(tag)
        node = Node(tag, self.open[-1], *_kind(tag, attributes))
        self.open[-1].items.append(node)
        if tag in RAW and not closed:
            stop = self._ahead(f"</{tag}", end)
            if stop >= 0:
                after = page.find(">", stop)
                return size if after < 0 else after + 1
            return size if tag in OPAQUE else end
        if tag not in VOID and not (closed and tag not in BLOCK and tag != "a"):
            self._push(node)
        return end


def parse(page: str) -> Node:
    return _Reader(page).read()


def _in_order(root: Node) -> list[tuple[Node, bool]]:
    """Elements that aren't dropped, in page order, and whether each is inside a link or is one."""
    order, stack = [], [(root, False)]
    while stack:  # without recursion: nesting may be deep
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack.extend((x, linked) for x in reversed(node.items) if isinstance(x, Node) and not x.drop)
    return order


def _measure(order: list[tuple[Node, bool]]) -> None:
    """Length, linked length, commas, last character, paragraph points and article, main and h1 elements of each element, summed from children to parents.

    An article inside an article, as reader comments are, doesn't count as one.
    """
    nested: set[int] = set()
    for node, linked in order:
        if node.parent and (node.parent.tag == "article" or id(node.parent) in nested):
            nested.add(id(node))
        node.length = node.commas = 0
        node.heads = int(node.tag in ("main", "h1") or node.tag == "article" and id(node) not in nested)
        node.last = ""
        for x in node.items:
            if isinstance(x, str) and (words := x.split()):
                node.length += sum(map(len, words)) + len(words) - 1
                node.commas += x.count(",") + x.count("、") + x.count("，")
                node.last = words[-1][-1]
        node.linked = node.length if linked else 0
        node.share = 0.0
    for node, linked in reversed(order):  # children come before parents
        node.share += 0.0 if linked else _paragraph(node)
        if up := node.parent:
            up.length += node.length
            up.linked += node.linked
            up.commas += node.commas
            up.share += node.share
            up.heads += node.heads
            up.last = up.last or node.last


def _paragraph(node: Node) -> float:
    """Points of a block with text of its own, or of a paragraph; 0 for all else."""
    if node.length < 25 or node.tag not in BLOCK and node.parent or node.tag not in PARAGRAPH and not any(isinstance(x, str) and not x.isspace() for x in node.items):
        return 0.0
    return (1 + node.commas + min(node.length / 100, 3)) * (1 - node.linked / node.length)


def _density(node: Node) -> float:
    return node.linked / max(node.length, 1)


def _take_out(order: list[tuple[Node, bool]]) -> bool:
    """Drops elements by their names, and page headers, as far as their text and their place bear it out; whether any went."""
    whole, heads, any_ = order[0][0].share, order[0][0].heads, False
    inside: set[int] = set()  # elements inside an article or main
    for node, _ in order:
        if node.parent and (node.parent.tag in ("article", "main") or id(node.parent) in inside):
            inside.add(id(node))
        if node.tag == "header" and id(node) not in inside:
            node.drop = any_ = True
        elif node.name and not node.heads and (heads or node.share <= whole / 2):
            links = _density(node) >= 0.25
            scrap = node.length < 40 or node.last not in _ENDS
            node.drop = node.name == 2 or links or scrap and node.tag not in PARAGRAPH
            any_ = any_ or node.drop
    return any_


def _score(order: list[tuple[Node, bool]]) -> list[Node]:
    """Containers in the order that points first reach them, with their points."""
    found: list[Node] = []
    for node, linked in order:
        if linked or not (points := _paragraph(node)):
            continue
        up, far = node.parent or node, 0
        while up and far < LEVELS:
            if up.points == 0.0:
                found.append(up)
                up.points = 8.0 if up.tag in ("article", "main") else 2.0 if up.tag in ("section", "div") else 1e-9
            up.points += points / (1 if far == 0 else 2 * far)
            up, far = up.parent, far + 1
    for node in found:
        node.points *= 1 - _density(node)
    return found


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of kept elements in page order."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop:
            continue
        elif x.tag in ("br", "wbr"):
            run.append(" " if x.tag == "br" else "")
        elif x.tag in BLOCK or not x.parent:
            close()
            stack.append(None)
            stack.extend(reversed(x.items))
        else:
            stack.extend(reversed(x.items))
    close()
    return out


def _kept(best: Node, scored: list[Node]) -> list[Node]:
    """The article around the best container, or else the container with those siblings that belong to it."""
    around, holder = best, None
    while around and (not holder or holder.tag != "article"):
        if around.tag in ("article", "main"):
            holder = holder if holder and around.tag == "main" else around
        around = around.parent
    if holder:
        siblings = [x for x in holder.parent.items if isinstance(x, Node) and not x.drop] if holder.parent else [holder]
        # articles beside it that are not much less of an article
        parts = [x for x in siblings if x is holder or x.tag == holder.tag == "article" and x.share >= NEAR * holder.share and _density(x) < 0.25]
        before = siblings[: next(i for i, x in enumerate(siblings) if x is parts[0])]
        titles = [x for x in before if x.tag in ("h1", "hgroup")]
        return [*([] if any(x.tag == "h1" for x, _ in _in_order(parts[0])) else titles), *parts]
    if not best.parent:
        return [best]
    points = {id(x): x.points for x in scored}
    least, kept = max(10.0, 0.2 * best.points), []
    for x in best.parent.items:
        if not isinstance(x, Node) or x.drop:
            continue
        density = _density(x)
        prose = x.tag == "p" and (x.length > 80 and density < 0.25 or 0 < x.length <= 80 and density == 0 and x.last in _ENDS)
        if x is best or points.get(id(x), 0.0) >= least or prose or x.tag in TEXTUAL and x.length and density < 0.25:
            kept.append(x)
    return kept


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    order = _in_order(root)
    _measure(order)
    if _take_out(order):
        order = _in_order(root)
        _measure(order)
    found = _score(order)
    if not found:
        articles = [x for x, _ in order if x.tag in ("article", "main")]
        return "\n".join(_blocks(articles[:1] or [root]))
    best = max(found, key=lambda x: x.points)
    return "\n".join(_blocks(_kept(best, found)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of pages, text, and n_chars; columns of these two names are replaced."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    names = [f"c{i}" for i in range(len(keep))]
    fields = [f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "page"):
            out = [main_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*names, "text", "n_chars"])

    source = bounded_batches(pages).select(*[f"`{c}`" for c in keep], f"`{html}`").toDF(*names, "page")
    return source.mapInArrow(run, ", ".join([*fields, "text string", "n_chars bigint"])).toDF(*keep, "text", "n_chars")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html"))
