"""Main text of HTML pages by wrapper induction over same-host pages.

Each page is parsed into a tree of block elements whose leaves are runs of text. A host's wrapper is
grown from some of its pages: of CANDIDATES pages, drawn by hash, the one most like the others, into
which the others are merged by simple tree matching, node by node, so that it has the slots of all
their layouts. Every page of the host is then aligned with the wrapper. Texts are counted by slot (leaf
of the wrapper) and by host, each different page content once. A text that hardly ever differs in its
slot is template; so is one that most pages of the host have, wherever it stands. What varies is
content, unless its element, by its name, its role or a whole class name of its own, is
boilerplate: adverts and comments vary too. Such names never rule out an element that holds the
article, or, on pages without one, most of the text.

The wrapper table (one row a host) is broadcast only when its measured size is small; beyond that
pages meet it in an equi-join on the host, whose hot keys adaptive execution splits on the page side.
Evidence is pre-aggregated before its shuffle. Hosts with fewer than LEAST_PAGES pages have no wrapper.

Defined cases: null or empty html gives empty text, as does html without text. Broken or cut
markup is read as far as it goes. A null url is a host of its own. Rows repeat as they come; pages
with equal html are drawn as one, and of pages equally like the others the first by html is the
wrapper's root. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, small_enough

# Element names and the words of class names and ids that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe canvas".split())
UNSHOWN = frozenset("svg object select option button".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mspace mstyle semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav footer aside form head dialog menu fieldset audio video".split()) | RAW | UNSHOWN
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus footer footnav gdpr "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Marks of what readers and other pages say, which may be longer than the article, and of the articles among them.
OTHERS = frozenset("ad ads advert advertisement comment comments commentlist disqus promo promoted recommended related replies reply respond sponsored".split())
NEGATED = frozenset("has is js no not show with without".split())
HOLDERS = frozenset("area bar block box bottom button buttons card container content form inner item items left link links list panel posts right section slot text top unit wrap wrapper".split())
GROUPS = frozenset("div section ul ol dl table header center".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"]),
}

#: Depth below which elements are put beside each other, and the bytes of wrappers that may be broadcast.
DEEPEST, BROADCAST_BYTES = 120, 32 << 20
#: Share of same texts, and pages seen, that make a slot template; and share of the host's pages that makes a text template.
SAME_SHARE, LEAST_PAGES, HOST_SHARE = 0.9, 5, 0.5
#: Pages that a host's wrapper is grown from.
CANDIDATES = 6

# Quoted values may hold marks as long as what follows them is an attribute or the end; else the tag ends at the first bracket.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
_PARTS = re.compile(r"[-_]+")


class Node:
    """A block element, or (tag '#') a run of text."""

    __slots__ = ("tag", "label", "children", "text", "linked", "mark", "skip", "depth", "shape", "content", "number", "size", "told", "titled")

    def __init__(self, tag: str, label: str, depth: int, mark: int = 0):
        self.tag, self.label, self.depth, self.mark = tag, label, depth, mark
        self.children: list[Node] = []
        self.text, self.linked, self.skip, self.size, self.told, self.titled = "", 0, False, 0, 0, False
        self.shape = self.content = self.number = -1


# Kinds of boilerplate: never shown, by element or role, by a whole class name, by a compound class name.
HIDDEN, KIND, NAMED, COMPOUND = 1, 2, 3, 4
def _compound(name: str) -> bool:
    """Whether a class name such as cookie-banner or share_buttons says boilerplate; has-sidebar says nothing of the element."""
    parts = _PARTS.split(name)
    if len(parts) < 2 or parts[0] in NEGATED:
        return False
    return parts[-1] in MARKS or (parts[0] in MARKS and parts[-1] in HOLDERS)


def _mark(tag: str, attributes: dict[str, str]) -> int:
    """The kind of boilerplate that an element is by its own name and attributes; 0 for none."""
    if tag in RAW or tag in UNSHOWN or tag == "head":
        return HIDDEN
    if attributes and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""))):
        return HIDDEN
    if tag in SKIPPED or tag == "header" or attributes.get("role", "").lower() in ROLES:
        return KIND
    names = [n.lower() for k in ("class", "id") for n in attributes.get(k, "").split()]
    if tag == "article":
        return NAMED if any(_PARTS.split(n)[0] in OTHERS for n in names) else 0
    if tag in ("main", "body", "html"):
        return 0
    if any(n in OTHERS for n in names):
        return KIND
    if any(n in MARKS for n in names):
        return NAMED
    return COMPOUND if tag in GROUPS and any(map(_compound, names)) else 0


@lru_cache(1 << 13)
def _told(tag: str, raw: str) -> tuple[int, str, bool]:
    """What a start tag says by its attributes: its kind of boilerplate, its label, and whether it is a main region. The same tags come again and again."""
    attributes = {}
    if raw and not raw.isspace():
        attributes = {(a[1] or a[5]).lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(raw)}
    classes = ".".join(sorted(attributes.get("class", "").lower().split()))
    main = attributes.get("role", "").lower() == "main" or "articlebody" in attributes.get("itemprop", "").lower()
    return _mark(tag, attributes) if attributes or tag not in INLINE else 0, f"{tag}.{classes}" if classes else tag, main


def parse(source: str) -> Node:
    """The block tree of a page."""
    root = Node("#root", "#root", 0)
    stack, pieces, linked, links = [root], [], [], 0
    skip_inline: list[str] = []
    last_end: dict[str, int] = {}

    def closes(tag: str) -> bool:
        """Whether an end tag is still to come; an element without one must not swallow the page."""
        if tag not in last_end:
            ends = [m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", source, re.I)]
            last_end[tag] = ends[-1] if ends else -1
        return last_end[tag] >= at

    def close_run() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                leaf = Node("#", "#", stack[-1].depth + 1)
                leaf.text, leaf.linked = text, len(" ".join("".join(linked).split())) if linked else 0
                stack[-1].children.append(leaf)
            pieces.clear()
            linked.clear()

    at, n = 0, len(source)
    while at < n:
        found = _TOKEN.search(source, at)
        upto = found.start() if found else n
        if upto > at and not skip_inline:
            part = source[at:upto]
            pieces.append(part)
            if links:
                linked.append(part)
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if skip_inline:
                if tag == skip_inline[-1]:
                    skip_inline.pop()
                continue
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_run()
                    del stack[k:]
                    break
            continue
        raw = found[3]
        if tag in RAW:
            if raw.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at) if closes(tag) else None
            at = end.end() if end else n
            continue
        if skip_inline and skip_inline[-1] in ("button", "select", "option") and tag not in INLINE and tag not in UNSHOWN and tag not in VOID and tag != "optgroup":
            skip_inline.clear()  # a block ends what was left open
        if tag in UNSHOWN:
            if not raw.endswith("/") and tag != "option" and closes(tag):
                skip_inline.append(tag)
            continue
        if skip_inline:
            if tag == skip_inline[-1] and not raw.endswith("/"):
                skip_inline.append(tag)
            continue
        if tag == "br" or tag == "img":
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if raw and tag not in VOID and (_told if len(raw) < 512 else _told.__wrapped__)(tag, raw)[0] and not raw.endswith("/") and closes(tag):
                skip_inline.append(tag)
            continue
        close_run()
        if tag in VOID:
            continue
        links = 0
        if stack[-1].tag == "p":  # a block ends an open paragraph
            stack.pop()
        ends = CLOSES.get(tag)
        if ends:
            while len(stack) > 1 and stack[-1].tag in ends:
                stack.pop()
        parent = stack[-1]
        mark, label, main = (_told if len(raw) < 512 else _told.__wrapped__)(tag, raw)
        node = Node(tag, label, parent.depth + 1, mark)
        if main:
            node.tag = "main"
        parent.children.append(node)
        stack.append(node)
        if len(stack) > DEEPEST:  # deeper ones become siblings
            del stack[DEEPEST - 1]
    if not skip_inline:
        close_run()
    _decide(root)
    return root


def _decide(root: Node) -> None:
    """Characters of all elements and of the articles in them, and which elements are skipped as boilerplate."""
    order, todo = [], [root]
    while todo:
        at = todo.pop()
        order.append(at)
        todo += at.children
    for at in reversed(order):
        if not at.children and at.tag != "h1" and at.tag not in MAIN:
            at.size = len(at.text)
            continue
        shown = [c for c in at.children if c.mark != HIDDEN]
        at.size = len(at.text) + sum(c.size for c in shown)
        at.told = at.size if at.tag in MAIN and not at.mark else sum(c.told for c in shown)
        at.titled = at.tag == "h1" or any(c.titled for c in shown)
    todo = [(root, False)]
    while todo:
        at, inside = todo.pop()
        inside = inside or (at.tag in MAIN and not at.skip)
        for c in at.children:
            c.skip = at.skip or (c.mark > 0 and _ruled_out(c, inside, root))
            if c.children:
                todo.append((c, inside))


def _ruled_out(at: Node, inside: bool, root: Node) -> bool:
    if not at.mark or at.mark == HIDDEN:
        return at.mark == HIDDEN
    if at.tag == "header" and at.mark == KIND and inside:  # an article's own head
        return False
    if at.mark != KIND or at.tag in ("form", "header"):  # names don't rule out what holds the article, or most of a page without one
        if not inside and (2 * at.told > root.told if root.told else 2 * at.size > root.size):
            return False
    return at.mark != COMPOUND or not at.titled


class Matcher:
    """Simple tree matching between pages and one reference: labels must agree, children match in order."""

    def __init__(self, reference: Node):
        self.shapes: dict[tuple, int] = {}
        self.samples: list[Node] = []
        self.score: dict[tuple[int, int], float] = {}
        self.reference = reference
        self._describe(reference)
        for k, leaf in enumerate(leaves(reference)):
            leaf.number = k

    def _describe(self, node: Node) -> None:
        for c in node.children:
            self._describe(c)
        key = (node.label, *[c.shape for c in node.children])
        node.shape = self.shapes.setdefault(key, len(self.shapes))
        if node.shape == len(self.samples):
            self.samples.append(node)
        node.content = hash((node.text, *[c.content for c in node.children]))

    def _weight(self, a: int, b: int) -> float:
        """Matched nodes of two shapes."""
        got = self.score.get((a, b))
        if got is None:
            x, y = self.samples[a], self.samples[b]
            got = 0.0 if x.label != y.label else 1.0 + sum(self._weight(p.shape, q.shape) for p, q in self._align(x.children, y.children, False))
            self.score[(a, b)] = got
        return got

    def _align(self, xs: list[Node], ys: list[Node], texts: bool) -> list[tuple[Node, Node]]:
        """The matched children of two nodes."""
        texts = texts and not {x.content for x in xs}.isdisjoint(y.content for y in ys)
        lo, hi, most = 0, 0, min(len(xs), len(ys))
        if not texts:  # equal shapes at either end match best with each other
            while lo < most and xs[lo].shape == ys[lo].shape:
                lo += 1
            while hi < most - lo and xs[-1 - hi].shape == ys[-1 - hi].shape:
                hi += 1
        pairs = list(zip(xs[:lo], ys[:lo], strict=True))
        tail = list(zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True))
        xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
        if xs and ys:
            t = self._table(xs, ys, texts)
            i, j, middle = len(xs), len(ys), []
            while i and j:
                if t[i][j] == t[i - 1][j]:
                    i -= 1
                elif t[i][j] == t[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    middle.append((xs[i], ys[j]))
            pairs += reversed(middle)
        return pairs + tail

    def _table(self, xs: list[Node], ys: list[Node], texts: bool) -> list:
        """Best scores of the first i and first j children; of equally good matches the one with equal texts is better."""
        if len(xs) * len(ys) <= 64:
            rows = [[0.0] * (len(ys) + 1)]
            for x in xs:
                row, above = [0.0], rows[-1]
                for j, y in enumerate(ys):
                    w = self._weight(x.shape, y.shape)
                    row.append(max(row[j], above[j + 1], above[j] + w + 0.5 * (texts and w > 0 and x.content == y.content)))
                rows.append(row)
            return rows
        a, b = np.asarray([x.shape for x in xs]), np.asarray([y.shape for y in ys])
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        weights = np.asarray([[self._weight(p, q) for q in ub.tolist()] for p in ua.tolist()])[ia][:, ib]
        if texts:
            same = np.asarray([x.content for x in xs])[:, None] == np.asarray([y.content for y in ys])
            weights = weights + 0.5 * same * (weights > 0)
        out = np.zeros((len(xs) + 1, len(ys) + 1))
        for i in range(len(xs)):
            out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + weights[i]))
        return out

    def match(self, page: Node) -> list[tuple[Node, Node]]:
        """Matched leaves (of the reference, of the page)."""
        self._describe(page)
        pairs, todo = [], [(self.reference, page)]
        while todo:
            x, y = todo.pop()
            if x.tag == "#":
                pairs.append((x, y))
            if x.children and y.children:
                todo += self._align(x.children, y.children, True)
        if len(self.samples) > 50_000:  # a bounded memory of shapes
            self.__init__(self.reference)
        return pairs


def leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at.tag == "#":
            out.append(at)
        todo += reversed(at.children)
    return out


def main_leaves(root: Node) -> list[Node]:
    """Leaves of the page's main region outside boilerplate.

    That is the main element with most text, or the article with most text and others beside it of a third of
    that, or else all blocks; outside of articles without those that are mostly links.
    """
    regions, todo = [], [root]
    while todo:
        at = todo.pop()
        if at.tag in MAIN and not at.skip:
            regions.append(at)
        else:
            todo += reversed(at.children)
    sized = [(sum(len(x.text) for x in leaves(at) if not x.skip), at) for at in regions]
    best = max((size for size, _ in sized), default=0)
    if not best:
        return [x for x in leaves(root) if not x.skip and 2 * x.linked < len(x.text)]
    first = next(at for size, at in sized if size == best)
    chosen = [first] if first.tag == "main" else [at for size, at in sized if at.tag == "article" and 3 * size >= best]
    return [x for at in chosen for x in _shown(at, at.tag == "article")]


def _shown(node: Node, in_article: bool) -> list[Node]:
    out, todo = [], [(node, in_article)]
    while todo:
        at, inside = todo.pop()
        if at.skip:
            continue
        if at.tag == "#" and (inside or 2 * at.linked < len(at.text)):
            out.append(at)
        todo += [(c, inside or at.tag == "article") for c in reversed(at.children)]
    return out


def content_blocks(source: str, wrapper: Matcher | None) -> list[tuple[str, int]]:
    """Content blocks of a page by its own marks, each with its slot in the wrapper (-1: none)."""
    root = parse(source)
    kept = main_leaves(root)
    slot = {id(y): x.number for x, y in wrapper.match(root)} if wrapper else {}
    return [(x.text, slot.get(id(x), -1)) for x in kept]


# Wrappers.


def _likeness(a: Matcher, page: Node) -> float:
    """Share of leaves that match."""
    return 2 * len(a.match(page)) / max(1, len(leaves(a.reference)) + len(leaves(page)))


def grown(sources: list[str]) -> Node:
    """The wrapper of some pages: the page most like the others, with what it lacks inserted from them, most alike first."""
    pages = [parse(x) for x in sorted(set(sources))]
    alike = [[_likeness(Matcher(a), b) if a is not b else 1.0 for b in pages] for a in pages]
    root = max(range(len(pages)), key=lambda k: sum(alike[k]))
    for k in sorted((k for k in range(len(pages)) if k != root), key=lambda k: -alike[root][k]):
        matcher = Matcher(pages[root])
        matcher._describe(pages[k])
        _merge(matcher, pages[root], pages[k])
    return pages[root]


def _merge(matcher: Matcher, x: Node, y: Node) -> None:
    """Insert the children of y that match none of x behind the one that stands before them, and so on below."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if not y.children:
            continue
        pairs = matcher._align(x.children, y.children, True)
        partner = {id(b): a for a, b in pairs}
        children, at = list(x.children), 0
        for child in y.children:
            if id(child) in partner:
                at = next(k for k, c in enumerate(children) if c is partner[id(child)]) + 1
            else:
                children.insert(at, child)
                at += 1
        todo += [(a, b) for a, b in pairs if a.tag != "#"]
        x.children = children


def packed(node: Node) -> str:
    def plain(at: Node):
        return at.text if at.tag == "#" else [at.label, [plain(c) for c in at.children]]

    return json.dumps(plain(node), ensure_ascii=False)


def unpacked(source: str) -> Node:
    def made(x, depth: int) -> Node:
        if isinstance(x, str):
            out = Node("#", "#", depth)
            out.text = x
        else:
            out = Node(x[0].split(".")[0], x[0], depth)
            out.children = [made(c, depth + 1) for c in x[1]]
        return out

    return made(json.loads(source), 0)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of the hosts with pages enough. `pages` has host and html; a host's drawn pages meet in one task."""
    some = pages.where(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("draw"))
    # Only hashes are ranked, and as many of a host as are drawn leave a task; the pages drawn then move, equal ones once.
    place = F.row_number().over(Window.partitionBy("host").orderBy("draw"))
    ranked = some.select("host", "draw").distinct().withColumn("place", place).where(F.col("place") <= max(CANDIDATES, LEAST_PAGES))
    enough = ranked.where(F.col("place") == LEAST_PAGES).select("host")
    keys = cut(ranked.where(F.col("place") <= CANDIDATES).join(enough, "host", "left_semi").select("host", "draw"), "drawn")
    small = F.broadcast(keys) if small_enough(keys, ["host"], BROADCAST_BYTES) else keys
    drawn = some.join(small, ["host", "draw"]).groupBy("host", "draw").agg(F.min("html").alias("html"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "reference": [packed(grown(frame["html"].tolist()))]})

    return drawn.select("host", "html").groupBy("host").applyInPandas(run, "host string, reference string")


_BLOCKS = "page_id long, url string, host string, blocks array<struct<text:string,anywhere:long,placed:long>>"
_SEEN = "host string, slot int, text long, content long"


def _hash(*parts: str | int) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(page_id, url, host, content blocks) of each page, some at a time."""
    matchers: dict[str, Matcher | None] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = []
            for page, url, host, source, ref in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns[:5]), strict=True):
                if host not in matchers:
                    if len(matchers) >= 64:
                        matchers.clear()
                    matchers[host] = Matcher(unpacked(ref)) if ref else None
                rows.append((page, url, host, content_blocks(source, matchers[host]) if source else []))
            yield rows


def _met(pages: DataFrame, references: DataFrame, broadcast: bool) -> DataFrame:
    return pages.join(F.broadcast(references) if broadcast else references, "host", "left").select("page_id", "url", "host", "html", "reference")


def slot_evidence(met: DataFrame) -> DataFrame:
    """host, slot (-1: any place), key of slot and text, pages that have the text there, and pages that have the slot; of different contents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _aligned(batches):
            seen: dict[tuple, None] = {}
            for _, _, host, blocks in rows:
                if blocks:
                    content = _hash(*(t for t, _ in blocks))
                    seen[host, -1, None, content] = None
                    for text, slot in blocks:
                        seen[host, -1, _hash(-1, text), content] = None
                        if slot >= 0:
                            seen[host, slot, None, content] = None
                            seen[host, slot, _hash(slot, text), content] = None
            columns = zip(*seen, strict=True) if seen else ((), (), (), ())
            kinds = pa.string(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "slot", "text", "content"])

    counts = cut(met.mapInArrow(run, _SEEN).distinct().groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_PAGES)), "evidence")
    pages = counts.where("text is null").select("host", "slot", F.col("n").alias("pages"))
    return counts.where("text is not null").join(pages, ["host", "slot"]).select("host", "slot", F.col("text").alias("key"), F.col("n").alias("same"), "pages")


def page_blocks(met: DataFrame) -> DataFrame:
    """The content blocks of every page, with the keys of their text anywhere and in their slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("anywhere", pa.int64()), ("placed", pa.int64())]))
        for rows in _aligned(batches):
            listed = [[{"text": t, "anywhere": _hash(-1, t), "placed": _hash(s, t)} for t, s in r[3]] for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))), pa.array(listed, block)], ["page_id", "url", "host", "blocks"])

    return met.mapInArrow(run, _BLOCKS)


def extract_main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.coalesce(F.regexp_extract(pages["url"].cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    mine = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"), host.alias("host"))
    references = cut(wrappers(mine), "references")
    # Pages are read twice, so that no copy of their texts is stored between evidence and extraction.
    both = _met(mine, references, small_enough(references, ["host", "reference"], broadcast_bytes))
    share = F.when(F.col("slot") < 0, HOST_SHARE).otherwise(SAME_SHARE)
    template = slot_evidence(both).where(F.col("same") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("template"))
    template = cut(template, "template")
    small = small_enough(template.select("host", F.array_join(F.transform("template", lambda x: x.cast("string")), ",").alias("slots")), ["host", "slots"], broadcast_bytes)
    met = page_blocks(both).join(F.broadcast(template) if small else template, "host", "left")
    known = F.coalesce("template", F.array().cast("array<bigint>"))
    varying = F.filter("blocks", lambda b: ~(F.array_contains(known, b["anywhere"]) | F.array_contains(known, b["placed"])))
    kept = F.when(F.size(varying) > 0, varying).otherwise(F.col("blocks"))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n"), F.lit(""))
    return met.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
