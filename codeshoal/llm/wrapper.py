"""Main text of web pages: wrapper induction by simple tree matching of same-host pages."""

from __future__ import annotations

import hashlib
import html as markup
import math
import re
from collections import Counter
from collections.abc import Generator, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noscript", "iframe"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
# Elements that an element closes when it begins.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Elements that hold others back from closing what lies outside, and these with all that is closed.
LISTS = frozenset(("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot"))
PARTS = LISTS | CLOSES.keys()
NEVER = frozenset(
    "script style noscript template head nav footer aside form button select option iframe svg "
    "canvas object embed audio video dialog menu textarea input label title".split())
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog",
                   "alert", "alertdialog", "menu", "menubar", "form"))
# Whole class names of what is no text of an article, and of parts of a page outside articles.
ASIDE = re.compile(
    r"ads?|adverts?|advertisements?|adsense|ad-(?:slot|banner|container|unit|wrapper)|"
    r"cookies?|cookie-(?:notice|banner|bar|consent)|newsletter|newsletter-(?:signup|form|box)|"
    r"comments|comments?-(?:list|area|section|form)", re.I)
FRAME = re.compile(
    r"(?:main-|site-|page-|top-|left-|right-)?(?:sidebar|menu|nav|navbar|navigation|footer)|"
    r"breadcrumbs?|pagination|pager|toolbar|popup|modal|overlay", re.I)
# Elements whose id names a place on the page rather than an anchor in the text.
PLACES = frozenset(("div", "ul", "ol", "table", "ins"))
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(
    r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# A node counts as template if its text is the same on this share of a host's distinct articles, of
# which there must be so many.
CONSTANT_SHARE, LEAST_PAGES = 0.9, 8
# A page is a copy of another if no more than this share of its article is not in the other.
NEAR_SHARE = 0.1
# Pairs of children up to which a table of all of them is kept; of longer lists some rows are.
CELLS = 1 << 16
# What is remembered: sizes of pairs of subtrees; rows of sizes of a long list, and cells of more rows.
MOST_SIZES, MOST_ROWS, ROW_CELLS = 1 << 18, 64, 1 << 24
# Cells of paths of tags that bound sizes, and turns in which bounds may decide a long list.
PATHS, TURNS = 64, 6
# Bytes of templates that are broadcast at most; more are joined by shuffling.
BROADCAST_BYTES = 16 << 20


class Node:
    """An element with children, or a text (tag None)."""

    __slots__ = ("tag", "text", "children", "attributes", "shape", "count", "number", "constant")

    def __init__(self, tag: str | None, attributes: dict | None = None, text: str = ""):
        self.tag, self.attributes, self.text = tag, attributes or {}, text
        self.children: list[Node] = []
        self.shape, self.count, self.number, self.constant = 0, 1, -1, False


class _TagEnds:
    """Where the tags of a page end: at the first > outside quotes.

    Each quoted value of tags that never end is walked once, so a page of unclosed tags is
    read in linear time.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {mark: page.rfind(mark) for mark in ">\"'"}
        self.first = -1
        self.lost: set[int] = set()

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``, or -1; ``at`` only ever grows."""
        if at > self.last[">"]:
            return -1
        if self.first < at:
            self.first = self._special(at)
        place, quotes = self.first, []
        while place < len(self.page) and place not in self.lost:
            mark = self.page[place]
            if mark == ">":
                return place + 1
            quotes.append(place)
            if place >= self.last[mark]:
                break
            place = self._special(self.page.index(mark, place + 1) + 1)
        self.lost.update(quotes)
        return -1

    def _special(self, at: int) -> int:
        found = _SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)


class _Stack:
    """Open elements, each with the nearest block and the nearest part of a list at or above it."""

    def __init__(self, root: Node):
        self.nodes, self.block, self.part = [root], [0], [0]
        self.open: Counter[str | None] = Counter()

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.block.append(at if node.tag in BLOCKS else self.block[-1])
        self.part.append(at if node.tag in PARTS else self.part[-1])
        self.open[node.tag] += 1

    def cut(self, at: int) -> None:
        """Close the elements from a place on."""
        self.open.subtract(node.tag for node in self.nodes[at:])
        del self.nodes[at:], self.block[at:], self.part[at:]

    def close(self, name: str) -> None:
        """Close the last open element of a name, if there is one."""
        if self.open[name]:
            at = len(self.nodes) - 1
            while self.nodes[at].tag != name:
                at -= 1
            self.cut(at)

    def imply(self, name: str) -> None:
        """Close what an element closes when it begins."""
        # A paragraph ends where a block begins, and so do inline elements left open in it.
        if name in BLOCKS and self.nodes[self.block[-1]].tag == "p":
            self.cut(self.block[-1])
        if name in CLOSES:
            at = self.part[-1]
            while at and self.nodes[at].tag not in LISTS:
                if self.nodes[at].tag in CLOSES[name]:
                    self.cut(at)
                    break
                at = self.part[at - 1]


def parse(page: str) -> Node:
    """The element tree of a page; unclosed elements are closed where HTML implies it."""
    root = Node("#root")
    stack, ends, at = _Stack(root), _TagEnds(page), 0
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            stack.nodes[-1].children.append(Node(None, text=markup.unescape(page[at:end])))
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), at) and at < ends.last[">"]:
            at = page.index(">", at) + 1
            continue
        found = _NAME.match(page, at + 1)
        end = ends.after(found.end()) if found else -1
        if end < 0:
            stack.nodes[-1].children.append(Node(None, text="<"))
            at += 1
            continue
        name, given = found[1].lower(), page[found.end():end - 1]
        closing, at = page[at + 1] == "/", end
        if closing:
            stack.close(name)
            continue
        stack.imply(name)
        node = Node(name, _attributes(given) if given else None)
        stack.nodes[-1].children.append(node)
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
        elif name not in VOID and not given.rstrip().endswith("/"):
            stack.push(node)
    _number(root)
    return root


def _attributes(source: str) -> dict[str, str]:
    return {
        m[1].lower(): markup.unescape(m[2] or m[3] or m[4] or "")
        for m in _ATTRIBUTE.finditer(source)}


def _walk(root: Node) -> list[Node]:
    """Nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    return order


def _number(root: Node) -> None:
    """Number the nodes in page order, count those below, give equal subtree shapes equal values."""
    order = _walk(root)
    for i, node in enumerate(order):
        node.number = i
    for node in reversed(order):
        node.shape = hash((node.tag, tuple(c.shape for c in node.children)))
        node.count = 1 + sum(c.count for c in node.children)


Pairs = list[tuple[Node, Node]]
Lists = tuple[list[Node], list[Node]]
Sizes = dict[tuple[int, int], int]
Task = Generator["Task", Any, Any]


def align(left: Node, right: Node) -> Pairs:
    """Pairs of nodes that simple tree matching maps to each other.

    Roots with the same tag match; their children are aligned in order so that most nodes
    match.  Equal shapes at both ends of the child lists are paired first: nothing matches more.
    """
    pairs: Pairs = []
    todo = [(left, right)]
    sizes: Sizes = {}
    while todo:
        a, b = todo.pop()
        if a.tag != b.tag:
            continue
        pairs.append((a, b))
        if a.children and b.children:
            equal, part = _split(a.children, b.children)
            todo.extend(equal)
            if part[0] and part[1]:
                todo.extend(_run(_best(part, sizes) if _small(part) else _best_of_long(part, sizes)))
    return pairs


def _split(a: list[Node], b: list[Node]) -> tuple[Pairs, Lists]:
    """Children at both ends that are paired for their equal shapes, and the lists left to align."""
    most = min(len(a), len(b))
    head = 0
    while head < most and a[head].shape == b[head].shape:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail].shape == b[-1 - tail].shape:
        tail += 1
    equal = list(zip(a[:head], b[:head]))
    if tail:
        equal += list(zip(a[-tail:], b[-tail:]))
    return equal, (a[head:len(a) - tail], b[head:len(b) - tail])


def _small(part: Lists) -> bool:
    return len(part[0]) * len(part[1]) <= CELLS


def _run(task: Task):
    """What a task returns; tasks that it yields are run first, however deep, and sent back to it."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _open(part: Lists) -> Pairs:
    """Pairs between two lists whose size takes a look at their children."""
    return [(x, y) for x in part[0] if x.children for y in part[1]
            if y.children and x.tag == y.tag and x.shape != y.shape]


def _measured(pairs: Pairs, sizes: Sizes) -> Task:
    """The sizes of some pairs; ``sizes`` remembers them for others and may forget."""
    own: Sizes = {}
    for a, b in pairs:
        key = a.shape, b.shape
        if key not in own:
            if key not in sizes:
                found = yield _below(a, b, sizes)
                if len(sizes) >= MOST_SIZES:
                    sizes.clear()
                sizes[key] = found
            own[key] = sizes[key]
    return own


def _below(a: Node, b: Node, sizes: Sizes) -> Task:
    """Number of nodes that match below and with two nodes of one tag."""
    equal, part = _split(a.children, b.children)
    found = 1 + sum(x.count for x, _ in equal)
    if part[0] and part[1]:
        found += yield (_total if _small(part) else _total_of_long)(part, sizes)
    return found


def _size(a: Node, b: Node, sizes: Sizes) -> int:
    """Number of nodes that match below and with two nodes."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.count
    if not a.children or not b.children:
        return 1
    return sizes[a.shape, b.shape]


def _total(part: Lists, sizes: Sizes) -> Task:
    """Number of nodes that match at best between two lists."""
    own = yield from _measured(_open(part), sizes)
    above = [0] * (len(part[1]) + 1)
    for x in part[0]:
        row = [0]
        for j, y in enumerate(part[1]):
            row.append(max(above[j + 1], row[j], above[j] + _size(x, y, own)))
        above = row
    return above[-1]


def _best(part: Lists, sizes: Sizes) -> Task:
    """The pairs of children with the most matching nodes."""
    own = yield from _measured(_open(part), sizes)
    a, b = part
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        above, row = best[i], best[i + 1]
        for j, y in enumerate(b):
            row[j + 1] = max(above[j + 1], row[j], above[j] + _size(x, y, own))
    i, j = len(a), len(b)
    chosen = []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((a[i], b[j]))
    return chosen


def _profile(node: Node) -> np.ndarray:
    """How many nodes below and with a node have each path of tags, in PATHS cells by hash.

    Only nodes with equal paths of tags match, so the sum of the lesser cells bounds a size.
    """
    cells = np.zeros(PATHS, np.int32)
    stack = [(node, 0)]
    while stack:
        at, path = stack.pop()
        path = hash((path, at.tag))
        cells[path % PATHS] += 1
        stack.extend((c, path) for c in at.children)
    return cells


class _Long:
    """The table that ``_best`` keeps, for long lists: made row by row, from bounds of sizes at first."""

    def __init__(self, part: Lists, sizes: Sizes):
        self.a, self.b = part
        self.sizes, self.whole = sizes, False
        # A size depends on shapes only.
        kinds = {y.shape: y for y in self.b}
        self.place = {shape: i for i, shape in enumerate(kinds)}
        self.kinds = list(kinds.values())
        self.index = np.array([self.place[y.shape] for y in self.b])
        self.profiles = np.stack([_profile(y) for y in self.kinds])
        self.learned: dict[int, dict[int, int]] = {}
        self.rows: dict[int, np.ndarray] = {}
        self.most_rows = max(MOST_ROWS, ROW_CELLS // len(self.kinds))

    def _weights(self, x: Node) -> Task:
        """For each kind of the second list the size with ``x``, or a bound where it is not known."""
        if x.shape not in self.rows:
            if self.whole:
                own = yield from _measured(_open(([x], self.kinds)), self.sizes)
                row = np.array([_size(x, y, own) for y in self.kinds], np.int32)
            else:
                row = np.minimum(self.profiles, _profile(x)).sum(axis=1, dtype=np.int32)
                row[[y.tag != x.tag for y in self.kinds]] = 0
                for kind, size in self.learned.get(x.shape, {}).items():
                    row[kind] = size
            if len(self.rows) >= self.most_rows:
                self.rows.pop(next(iter(self.rows)))
            self.rows[x.shape] = row
        return self.rows[x.shape]

    def _after(self, above: np.ndarray, x: Node) -> Task:
        """The row of ``x`` below the row ``above``."""
        weights = yield from self._weights(x)
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights[self.index]), out=row[1:])
        return row

    def _trace(self) -> Task:
        """The total and the pairs of the table; some rows are kept, and those between made again."""
        step, above, kept = math.isqrt(len(self.a)) + 1, np.zeros(len(self.b) + 1, np.int64), []
        for i, x in enumerate(self.a):
            if i % step == 0:
                kept.append(above)
            above = yield from self._after(above, x)
        total, j, chosen = int(above[-1]), len(self.b), []
        for turn in range(len(kept) - 1, -1, -1):
            block = [kept.pop()]
            for x in self.a[turn * step:(turn + 1) * step]:
                block.append((yield from self._after(block[-1], x)))
            i = len(block) - 1
            while i and j:
                if block[i][j] == block[i - 1][j]:
                    i -= 1
                elif block[i][j] == block[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    chosen.append((self.a[turn * step + i], self.b[j]))
        return total, chosen

    def best(self) -> Task:
        """The total and the pairs with the most matching nodes.

        Pairs that are best by bounds, and whose sizes reach these, are best.  Otherwise their
        sizes take the place of the bounds; after some turns all sizes are measured.
        """
        for _ in range(TURNS):
            total, chosen = yield from self._trace()
            own = yield from _measured(
                [p for x, y in chosen for p in _open(([x], [y]))], self.sizes)
            if sum(_size(x, y, own) for x, y in chosen) == total:
                return total, chosen
            for x, y in chosen:
                kind, size = self.place[y.shape], _size(x, y, own)
                self.learned.setdefault(x.shape, {})[kind] = size
                if x.shape in self.rows:
                    self.rows[x.shape][kind] = size
        self.whole = True
        self.rows.clear()
        return (yield from self._trace())


def _total_of_long(part: Lists, sizes: Sizes) -> Task:
    """``_total``, in memory that grows with one list."""
    total, _ = yield from _Long(part, sizes).best()
    return total


def _best_of_long(part: Lists, sizes: Sizes) -> Task:
    """``_best``, in memory that grows with one list."""
    _, chosen = yield from _Long(part, sizes).best()
    return chosen


def _content(node: Node) -> str:
    return " ".join(node.text.split())


def _aside(node: Node, framed: bool) -> bool:
    """Whether a class or id says that an element is no main text.

    Headings and texts are named after their subjects, so only whole class names count there, and
    ids nowhere but on plain containers that are no sections.
    """
    classes = node.attributes.get("class", "").split()
    names = list(classes)
    if node.tag in PLACES and not any(c.lower() == "section" for c in classes):
        names.append(node.attributes.get("id", "").strip())
    if any(ASIDE.fullmatch(name) for name in names):
        return True
    return framed and node.tag in PLACES and any(FRAME.fullmatch(name) for name in names)


def _kept(node: Node, inside: bool, framed: bool) -> bool:
    """Whether an element may hold main text.

    ``inside`` is true below the element that was chosen, ``framed`` outside article and main ones.
    """
    if node.tag in NEVER or (node.tag == "header" and not inside):
        return False
    given = node.attributes
    if not given:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true":
        return False
    if given.get("role", "").lower() in ROLES:
        return False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return False
    if node.tag in ("html", "body", "article", "main") or not ("class" in given or "id" in given):
        return True
    return not _aside(node, framed)


def _named(node: Node) -> bool:
    """Whether an element is marked as main text."""
    return node.tag in ("article", "main") or node.attributes.get("role") == "main"


def _articles(root: Node) -> list[Node]:
    """The outermost article elements, else main ones, else the densest container."""
    for wanted in (("article",), ("main",), ()):
        found: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag in wanted or (node.attributes.get("role") == "main" and "main" in wanted):
                found.append(node)
            elif node.tag is not None and _kept(node, False, True):
                stack.extend(reversed(node.children))
        if found:
            return found
    node, total = root, len("".join(_blocks([root], True)))
    while total:
        heavy = [c for c in node.children if c.tag is not None and _kept(c, False, True)
                 and len("".join(_blocks([c], True))) >= 0.7 * total]
        if not heavy or heavy[0].tag not in BLOCKS or heavy[0].tag == "p":
            break
        node = heavy[0]
    return [node]


def _blocks(roots: list[Node], constants: bool) -> list[str]:
    """Texts of the blocks below some nodes; those of template texts only if ``constants``."""
    blocks: list[str] = []
    line: list[str] = []
    varies = constants

    def end() -> None:
        nonlocal varies
        if varies and (text := " ".join("".join(line).split())):
            blocks.append(text)
        line.clear()
        varies = constants

    for root in roots:
        framed = not _named(root)
        stack: list[Node | None] = [None, root]
        stack.reverse()
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif node.tag is None:
                line.append(node.text)
                varies = varies or not (node.constant or node.text.isspace())
            elif node.tag == "br":
                line.append("\n")
            elif node is root or _kept(node, True, framed):
                if node.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(node.children))
        end()
    return blocks


def main_text(page: str | None, template: tuple[Node, set[int]] | None = None) -> str:
    """Main text of a page; ``template`` is a tree of its host and its constant nodes.

    Texts aligned with a constant node of the template, and equal to it, are left out, unless
    little else would be left: then the article is itself in the template.
    """
    if not page:
        return ""
    root = parse(page)
    if template is not None and template[1]:
        for own, other in align(root, template[0]):
            if own.tag is None and other.number in template[1]:
                own.constant = _content(own) == _content(other)
    own, whole = _parts(root)
    return "\n".join(whole if _is_copy(own, whole) else own)


def _parts(root: Node) -> tuple[list[str], list[str]]:
    """Blocks of the main text of a page: those that are not all constant, and all."""
    roots = _articles(root)
    return _blocks(roots, False), _blocks(roots, True)


def _is_copy(own: list[str], whole: list[str]) -> bool:
    """Whether the blocks of its own are but a small part of an article."""
    return sum(map(len, own)) <= NEAR_SHARE * sum(map(len, whole))


def _with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host); a page without a host gets the empty one."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def _join(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Give each page its host's template; broadcast only what was measured to be small."""
    size = templates.agg(F.sum(F.length("template") + 64)).first()[0] or 0
    return pages.join(
        F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")


class _Trees:
    """The last templates that a task has parsed."""

    def __init__(self, most: int = 64):
        self.most, self.trees = most, {}

    def get(self, template: str) -> Node:
        if template not in self.trees:
            if len(self.trees) >= self.most:
                self.trees.pop(next(iter(self.trees)))
            self.trees[template] = parse(template)
        return self.trees[template]


def _agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which texts of a host's template are the same on its pages, once for each article.

    The article is known by the longest of its blocks that are not in the template; copies of the
    template's page are article 0.
    """
    trees = _Trees()
    for batch in batches:
        least: dict[tuple[str, int], list[int]] = {}
        for page, host, template in zip(batch["html"], batch["host"], batch["template"]):
            if not page or not template:
                continue
            root, same = parse(page), []
            for other, own in align(trees.get(template), root):
                if other.tag is None and (text := _content(other)) and text == _content(own):
                    same.append(other.number)
                    own.constant = True
            own, whole = _parts(root)
            article = 0 if _is_copy(own, whole) else int.from_bytes(hashlib.blake2b(
                max(own, key=lambda t: (len(t), t)).encode("utf-8", "replace"),
                digest_size=8).digest(), "big", signed=True)
            same.sort()
            least[host, article] = min(same, least.get((host, article), same))
        yield pd.DataFrame(
            [(h, a, s) for (h, a), s in least.items()], columns=["host", "article", "same"])


def induce(pages: DataFrame) -> DataFrame:
    """(host, template, constants): a page of each host and its constant texts' numbers.

    The template is the page of least id (of least text among equal ones); all pages of the host
    are aligned with it, and pages with the same article count once.  ``constants`` is null where
    nothing is constant.
    """
    hosted = pages.where("html IS NOT NULL AND html <> ''")
    chosen = stash(hosted.groupBy("host").agg(
        F.min_by("html", F.struct("page_id", "html")).alias("template")), "templates")
    # One row for each article, so copies count once.
    agreed = stash(_join(hosted, chosen).select("html", "host", "template").mapInPandas(
        _agreement, "host string, article long, same array<long>"
    ).groupBy("host", "article").agg(F.min("same").alias("same")), "agreement")
    totals = agreed.groupBy("host").agg(F.count("*").alias("all")).where(
        F.col("all") >= LEAST_PAGES)
    constants = (
        agreed.select("host", F.explode("same").alias("number"))
        .groupBy("host", "number").agg(F.count("*").alias("same"))
        .join(totals, "host").where(F.col("same") >= F.col("all") * CONSTANT_SHARE)
        .groupBy("host").agg(F.collect_list("number").alias("constants"))
    )
    return stash(chosen.join(constants, "host", "left"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page.

    A null html counts as empty and gives an empty text.  Pages without a host share the
    empty one.  Repeated rows each get a row; other columns are ignored.
    """
    hosted = _with_host(pages)
    joined = _join(hosted, induce(hosted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            texts = []
            for page, template, constants in zip(*(
                    batch.column(c).to_pylist() for c in ("html", "template", "constants"))):
                known = (trees.get(template), set(constants)) if constants else None
                texts.append(main_text(page, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
