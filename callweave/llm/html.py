"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are reduced to block elements. The commonest tree of the
host, counted over all its pages, is its wrapper; every page is aligned with it by simple
tree matching. A text that stands in one node of the wrapper on nearly all pages of the
host (SHARE) is constant, so it is template; what varies fills slots and is content. A
page's text is what its slots hold, in page order, without the elements that are furniture
by HTML itself (navigation, footers, asides, forms, scripts).

Two cases are left open by that, and each has a rule. Text that varies may still be
furniture: an element goes if all words of its class, id and role are names of furniture or
of mere boxes, so one word never removes a part of an article. And pages may be copies of
each other, so that the article is constant too: what would remove nearly all of a page's
text (MOST) is no template. Where a page has article or main elements, these hold its
text, unless slots outside of them hold more.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, small_enough

#: Share of the pages with a node on which a template text stands in it, and the fewest pages to tell.
SHARE, LEAST_PAGES = 0.9, 4
#: Share of a page's text that neither names nor template may take away.
MOST = 0.8
#: Cells of a matching table that is kept whole; a larger one is split, with the same result.
CELLS = 4_000_000
#: Rows that a task counts before it hands them on.
HELD = 100_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
#: Elements that end an open element of the same group, up to the barrier.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are furniture by HTML itself, and names that class, id and role give to
#: furniture and to mere boxes.
DROPPED = frozenset("nav footer aside form script style noscript iframe template textarea title head button select dialog svg math menu".split())
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments respond reply replies commentlist disqus discussion pagination pager widget toolbar skip complementary contentinfo search "
    "kommentar kommentare werbung anzeige hinweis menue seitenleiste commentaires publicite comentarios anuncio publicidad".split()
)
BOXES = frozenset("area articles author block body bottom box button buttons col column container content count feed form group icon icons inner item items label left link links list main meta middle outer page panel part placeholder posts primary reader readers right row secondary section site slot space stories text thread title top trail unit user users wrap wrapper".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def named(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)} if self.attrs.strip() else {}

    def sign(self, names: dict[str, str]) -> str:
        """Element and first class or id, without digits: what makes nodes comparable."""
        mark = (names.get("class", "").split() or [""])[0] or names.get("id", "")
        return f"{self.tag}.{re.sub('[0-9]+', '', mark)}" if mark else self.tag

    def furniture(self, names: dict[str, str], inside: bool) -> bool:
        """Whether all its names are those of furniture and boxes; the header of an article is its own."""
        words = {w.lower() for v in names.values() for w in _PARTS.findall(v)}
        return bool(words & FURNITURE - ({"header"} if inside else set())) and words <= FURNITURE | BOXES and self.tag not in ("body", "html", "article", "main")


def parse(page: str) -> Node:
    """A forgiving tree of a page; its text nodes are strings with references decoded."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    opened: Counter = Counter()
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            text = page[at:upto]
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1].children.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            _close(stack, opened, tag)
            continue
        if tag in CLOSES_P:
            _close(stack, opened, "p", implied=True)
        if tag in SIBLINGS:
            group, barrier = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in group:
                    _cut(stack, opened, i)
                    break
        node = Node(tag, m[4])
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and (tag in BLOCKS or not m[4].endswith("/")):
            stack.append(node)
            opened[tag] += 1
    return root


def _cut(stack: list[Node], opened: Counter, i: int) -> None:
    for node in stack[i:]:
        opened[node.tag] -= 1
    del stack[i:]


def _close(stack: list[Node], opened: Counter, tag: str, implied: bool = False) -> None:
    """Pop up to the open element of this name; an inline end tag does not cross a block."""
    if not opened[tag]:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            _cut(stack, opened, i)
            return
        if (tag not in BLOCKS or implied) and stack[i].tag in BLOCKS and stack[i].tag != "p":
            return


# ---------------------------------------------------------------- outlines


class Outline:
    """The block elements of a page as a tree, and the texts in them in page order.

    signs and kids have one entry a node, parents before children. Neighbours of equal sign
    without children are one repeated node. A text has its node, whether an element around
    it is furniture by name, and whether it is inside an article.
    """

    def __init__(self, signs: list[str], kids: list[list[int]]):
        self.signs, self.kids, self.texts = signs, kids, []
        self.kinds, self.sizes = [0] * len(signs), [1] * len(signs)

    def number(self, known: dict) -> Outline:
        """Gives equal subtrees equal kinds, by a table that several outlines share."""
        for i in range(len(self.signs) - 1, -1, -1):
            own = self.kids[i]
            self.kinds[i] = known.setdefault((self.signs[i], *[self.kinds[k] for k in own]), len(known))
            self.sizes[i] = 1 + sum(self.sizes[k] for k in own)
        return self

    def dump(self) -> str:
        return json.dumps([self.signs, self.kids], separators=(",", ":"), ensure_ascii=False)


def outline(page: str | None) -> Outline:
    root = parse(page or "")
    signs, kids, texts, text = ["#root"], [[]], [], []
    stack = [(iter(root.children), 0, False, False, True)]

    def flush(node: int, named: bool, inside: bool) -> None:
        own = " ".join("".join(text).split())
        if own:
            texts.append((own, node, named, inside))
        text.clear()

    while stack:
        children, node, named, inside, block = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if block:
                flush(node, named, inside)
                if stack and not kids[node]:
                    _merge(signs, kids, texts, stack[-1][1], node)
        elif isinstance(c, str):
            text.append(c)
        elif c.tag in RAW or c.tag in DROPPED or (c.tag == "header" and not inside):
            if c.tag in BLOCKS:
                flush(node, named, inside)
        elif c.tag in BLOCKS:
            flush(node, named, inside)
            names = c.named()
            signs.append(c.sign(names))
            kids.append([])
            kids[node].append(len(signs) - 1)
            stack.append((iter(c.children), len(signs) - 1, named or c.furniture(names, inside), inside or c.tag in ("article", "main"), True))
        elif not c.furniture(c.named(), inside):
            if c.tag == "br":
                text.append(" ")
            stack.append((iter(c.children), node, named, inside, False))
    out = Outline(signs, kids)
    out.texts = texts
    return out


def _merge(signs: list[str], kids: list[list[int]], texts: list[tuple], parent: int, node: int) -> None:
    """Makes a childless node, the last one so far, one with its left neighbour if they are alike."""
    own = kids[parent]
    if len(own) > 1 and node == len(signs) - 1 and signs[own[-2]] == signs[node] and not kids[own[-2]]:
        for i in range(len(texts) - 1, -1, -1):
            if texts[i][1] != node:
                break
            texts[i] = (texts[i][0], own[-2], *texts[i][2:])
        own.pop(), signs.pop(), kids.pop()


# ---------------------------------------------------------------- simple tree matching


class Matching:
    """Simple tree matching: the greatest matching of two trees that keeps order and levels."""

    def __init__(self, a: Outline, b: Outline, cells: int = CELLS):
        self.a, self.b, self.cells = a, b, cells
        self.known: dict[tuple[int, int], int] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * (min(len(a.signs), len(b.signs)) + 1000)))

    def weight(self, i: int, j: int) -> int:
        """Size of the greatest matching of two subtrees whose roots match; 0 if these differ."""
        a, b = self.a, self.b
        if a.signs[i] != b.signs[j]:
            return 0
        if a.kinds[i] == b.kinds[j]:
            return a.sizes[i]
        if not a.kids[i] or not b.kids[j]:
            return 1
        key = (a.kinds[i], b.kinds[j])
        if key not in self.known:
            left, right, total = self._trim(a.kids[i], b.kids[j])
            self.known[key] = 1 + total + (int(self._row(left, right)[-1]) if left and right else 0)
        return self.known[key]

    def _trim(self, left: list[int], right: list[int], pairs: list | None = None) -> tuple[list[int], list[int], int]:
        """Without equal subtrees at both ends, which some greatest matching pairs."""
        a, b, lo, hi, total = self.a, self.b, 0, 0, 0
        n = min(len(left), len(right))
        while lo < n and a.kinds[left[lo]] == b.kinds[right[lo]]:
            total += a.sizes[left[lo]]
            lo += 1
        while hi < n - lo and a.kinds[left[-1 - hi]] == b.kinds[right[-1 - hi]]:
            total += a.sizes[left[-1 - hi]]
            hi += 1
        if pairs is not None:
            pairs += [*zip(left[:lo], right[:lo], strict=True), *zip(left[len(left) - hi :], right[len(right) - hi :], strict=True)]
        return left[lo : len(left) - hi], right[lo : len(right) - hi], total

    def _weights(self, i: int, right: list[int]) -> np.ndarray:
        out = np.zeros(len(right), np.int64)
        for k, j in enumerate(right):
            if self.a.signs[i] == self.b.signs[j]:
                out[k] = self.weight(i, j)
        return out

    def _rows(self, left: list[int], right: list[int]) -> Iterator[np.ndarray]:
        """Sizes of the best matching of the first nodes of left with each start of right."""
        row = np.zeros(len(right) + 1, np.int64)
        for i in left:
            new = np.maximum(row[1:], row[:-1] + self._weights(i, right))
            row = np.concatenate(([0], np.maximum.accumulate(new)))
            yield row

    def _row(self, left: list[int], right: list[int]) -> np.ndarray:
        row = np.zeros(len(right) + 1, np.int64)
        for row in self._rows(left, right):
            pass
        return row

    def _pairs(self, left: list[int], right: list[int], out: list[tuple[int, int]]) -> None:
        """Appends the pairs of a greatest matching of two lists of siblings."""
        left, right, _ = self._trim(left, right, out)
        if not left or not right:
            return
        if len(left) * len(right) > self.cells and len(left) > 1:  # halves, joined where both are best
            half = len(left) // 2
            ahead, behind = self._row(left[:half], right), self._row(left[half:][::-1], right[::-1])[::-1]
            cut = int(np.argmax(ahead + behind))
            self._pairs(left[:half], right[:cut], out)
            self._pairs(left[half:], right[cut:], out)
            return
        rows = [np.zeros(len(right) + 1, np.int64), *self._rows(left, right)]
        i, j = len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j]))

    def nodes(self) -> dict[int, int]:
        """Node of b to the node of a that it is matched with."""
        found, todo = {}, [(0, 0)] if self.a.signs[0] == self.b.signs[0] else []
        while todo:
            i, j = todo.pop()
            found[j] = i
            self._pairs(self.a.kids[i], self.b.kids[j], todo)
        return found


# ---------------------------------------------------------------- extraction


class Wrapper:
    """A host's tree and the keys of its template texts."""

    def __init__(self, tree: str | None = None, template: list[int] | None = None):
        signs, kids = json.loads(tree) if tree else (["#root"], [[]])
        self.kinds: dict = {}
        self.tree = Outline(signs, kids).number(self.kinds)
        self.template = frozenset(template or ())

    def placed(self, page: Outline) -> list[tuple[int, tuple[int, ...]]]:
        """For each text of a page its node in the wrapper and the keys of node and text: as
        it is, and without its figures if it has any; -1 and none if its node is not there."""
        if len(self.kinds) > 1_000_000:  # kinds of nodes that only other pages have
            self.kinds = {}
            self.tree.number(self.kinds)
        found, out = Matching(self.tree, page.number(self.kinds)).nodes(), []
        for text, node, _, _ in page.texts:
            if node not in found:
                out.append((-1, ()))
                continue
            bare = _FIGURES.sub("0", text)
            keys = [xxhash.xxh64_intdigest(f"{found[node]} {t}") - (1 << 63) for t in ((text,) if bare == text else (text, f"#{bare}"))]
            out.append((found[node], tuple(keys)))
        return out


_FIGURES = re.compile(r"[0-9]+")


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page: what fills the slots of its host's wrapper, if there is one."""
    read = outline(page)
    texts = read.texts
    keys = [k for _, k in wrapper.placed(read)] if wrapper and wrapper.template else [()] * len(texts)
    exact = [bool(k) and k[0] in wrapper.template for k in keys]
    alike = [any(x in wrapper.template for x in k) for k in keys]
    size = lambda chosen: sum(len(texts[i][0]) for i in chosen)

    inside = [i for i, t in enumerate(texts) if t[3]]
    outside = [i for i, t in enumerate(texts) if not t[3] and not t[2] and not alike[i]]
    chosen = inside if inside and size(outside) <= size(inside) else list(range(len(texts)))
    for gone in ([t[2] for t in texts], alike, exact):  # furniture by name, template but for figures, template
        left = [i for i in chosen if not gone[i]]
        if size(left) >= (1 - MOST) * size(chosen):
            chosen = left
            if gone is alike:
                break
    return "\n\n".join(texts[i][0] for i in chosen)


def _host() -> Column:
    return F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def _counted(rows: DataFrame, make, fields: str) -> DataFrame:
    """Rows (host, key, times, further fields) that make(row values) gives as (key, *further)
    for the rows (host, ..), counted in each task, HELD at a time."""
    bounded_batches(rows.sparkSession)
    names = ["host", "key", "times", *[f.split()[0] for f in fields.split(", ") if f]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*((host, key, n, *more) for (host, key, *more), n in held.items()), strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 3)], strict=True)], names=names)
            held.clear()
            return batch

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in make(*values):
                    held[values[0], *found] = held.get((values[0], *found), 0) + 1
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, ", ".join(["host string, key long, times long", *([fields] if fields else [])]))


class _Wrappers:
    """The wrappers that a task has met last, by host."""

    def __init__(self):
        self.by_host: dict[str, Wrapper] = {}

    def of(self, host: str, tree: str | None, template: list[int] | None) -> Wrapper:
        if host not in self.by_host:
            if len(self.by_host) >= 1000:
                self.by_host.clear()
            self.by_host[host] = Wrapper(tree, template)
        return self.by_host[host]


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(found) if small_enough(found) else found, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree, template) of the hosts of pages (url, html) that have template texts.

    Everything is counted over all pages, in the tasks first: trees by host for the
    commonest one (of several, that of the least hash), then texts by host and node of that
    tree. A host's template is no larger than a page or two, however many pages it has.
    """
    rows = pages.where("html is not null").select(_host().alias("host"), "html").where("host <> ''")

    def layouts(_: str, page: str) -> list[tuple]:
        tree = outline(page).dump()
        return [(xxhash.xxh64_intdigest(tree) - (1 << 63), tree)]

    trees = materialise(_counted(rows, layouts, "tree string").groupBy("host", "key").agg(F.sum("times").alias("times"), F.first("tree").alias("tree")), "layouts")
    hosts = trees.groupBy("host").agg(F.sum("times").alias("pages"), F.min_by("tree", F.struct(-F.col("times"), "key")).alias("tree"))
    hosts = materialise(hosts.where(F.col("pages") >= LEAST_PAGES), "hosts")

    known = _Wrappers()

    def texts(host: str, page: str, tree: str) -> set[tuple]:
        placed = known.of(host, tree, None).placed(outline(page))
        return {(k, str(node)) for node, own in placed for k in own} | {(None, str(node)) for node, own in placed if own}

    aligned = _joined(rows, hosts.select("host", "tree")).where("tree is not null").select("host", "html", "tree")
    times = materialise(_counted(aligned, texts, "node string").groupBy("host", "node", "key").agg(F.sum("times").alias("times")).where((F.col("times") >= LEAST_PAGES)), "times")
    held = times.where("key is null").join(hosts.select("host", "pages"), "host").where(F.col("times") * 2 >= F.col("pages")).select("host", "node", F.col("times").alias("held"))
    same = times.where("key is not null").join(held, ["host", "node"]).where(F.col("times") >= F.col("held") * SHARE).groupBy("host").agg(F.collect_set("key").alias("template"))
    return hosts.select("host", "tree").join(same, "host")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, blocks joined by two \\n.

    Null html gives an empty text; a null url or one without host has no wrapper, nor has a
    host of fewer than LEAST_PAGES pages. n_chars counts code points. Repeated rows give
    repeated results, an empty table gives none; other columns of pages are ignored.
    """
    found = materialise(wrappers(pages), "wrappers")
    rows = _joined(pages.select("page_id", "url", "html", _host().alias("host")), found).select("page_id", "url", "html", "host", "tree", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            texts = [extract(page, known.of(host, tree, template) if tree else None) for page, host, tree, template in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
