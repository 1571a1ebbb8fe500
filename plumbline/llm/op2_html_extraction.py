"""Main text of web pages by wrapper induction.

1. Every page becomes a DOM tree. Runs of equal siblings such as paragraphs or list items count as one repeated slot,
   which knows the members that all pages have.
2. Trees of one host are folded into a wrapper by simple tree matching: an order-preserving alignment of children with
   the most matched nodes. A wrapper node knows in how many pages it was met, whether its text was always the same and
   how much of its text is links. Folding is associative up to ties, so each task folds the pages it meets, then
   partial wrappers are folded by (host, salt) and last by host: a host with a third of all pages sends one small
   partial wrapper from each task.
3. Each page is aligned with its host's wrapper. Nodes that are constant over the host become template. Among the
   varying slots the article is the one with most of the text that is not links; where a host has too little evidence,
   it is the element marked as such, if there is one. Menus, notices, adverts, forms or comments that vary from page to
   page are told by tag or class and left out.

Wrappers count by lossy counting: nodes that under a share of RARE of the pages have met so far are dropped after each
fold, at every size, so a node's count is off by at most that share of the pages.

Constancy counts as evidence only where at least EVIDENCE different pages of the host agree, and not where it would
leave less than a share of LEAST_LEFT of the article (hosts of copies); pages of hosts without such evidence are read by
step 3's slots alone.

Cases: a null or empty html gives the empty text; a null url belongs to no host; text without markup is one block;
elements nested deeper than MAX_DEPTH are flattened into their ancestor there, block by block, and what is beside the
article stays apart at any depth; reading takes time in proportion to the html, however broken; repeated rows give repeated results; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, sliced, table

MAX_DEPTH = 150
#: Different pages that must agree before a node counts as template, and the least share of the host's pages.
EVIDENCE, SUPPORT = 3, 0.6
#: The share of the article that the template has to leave.
LEAST_LEFT = 0.1
#: The share of a host's pages below which a node is not counted on.
RARE = 1 / 50
SALTS = 16
#: Hosts that a task folds at once; beyond it partial wrappers are handed on.
TASK_HOSTS = 4000
#: Bytes of wrappers that are sent to every task; beyond it pages and wrappers are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Children compared pair by pair at most; in longer lists those of one kind are compared once.
MATCH_CELLS = 4096

# Fixed values of HTML: elements without an end tag, with raw text, without text of the page, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg canvas object audio video select button form input datalist map".split())
FURNITURE = frozenset("nav header footer aside dialog menu".split())
BLOCKS = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr address details summary fieldset center nav header footer aside".split())
CONTAINERS = frozenset("html body article section main div table tbody header footer aside nav form".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPES = frozenset("ul ol dl table html body article section main div".split())
#: Words in a class or id that name a part of the page beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion sidebar rail widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu masthead header footer pagination pager toolbar skip".split()
)
BODY_CLASSES = frozenset(["article-body", "article-content", "post-content", "post-body", "entry-content", "story-body", "page-content", "main-content"])

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])([\w-]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_ENDS = {t: re.compile(rf"</{t}(?![a-z0-9])", re.I | re.A) for t in RAW}
_PIECES = re.compile(r"[^a-z]+")


class Node:
    """An element; holder is the node that takes what stands in it: itself, or an ancestor where it is nested too deep."""

    __slots__ = ("holder", "kids", "label", "marks", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.marks, self.holder = tag, tag, frozenset(), self
        self.kids: list[Node | str] = []
        if attributes and not attributes.isspace():
            self.label, self.marks = _marks(tag, attributes)


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    """The label by which nodes match, and the words and names in class, id and role."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    label = tag + "".join(f".{re.sub(r'[0-9]+', '0', n)}" for n in sorted(names))
    words = {w for n in names for w in _PIECES.split(n) if w}
    extra = {f"={n}" for n in names} | {f"role={found[k]}" for k in ("role", "itemprop") if k in found} | ({"hidden"} if "hidden" in found or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) else set())
    return label, frozenset(words | extra)


class _Open:
    """The open elements, with the places in the stack of each tag, of blocks and of scopes (but the root's): the nearest is found at once."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)
        self.blocks: list[int] = [0]
        self.scopes: list[int] = [0]

    def push(self, node: Node) -> None:
        top = self.stack[-1]
        if len(self.stack) < MAX_DEPTH:
            top.holder.kids.append(node)
        else:
            # too deep: its text goes to the holder above, as blocks of its own, but for what is beside the article
            apart = node.tag in NO_TEXT or _is_beside(node)
            if top.holder is self.stack[MAX_DEPTH - 1] and apart:
                top.holder.kids.append(node)
            else:
                node.holder = top.holder
                self._break(node)
        for at in self._lists(node.tag):
            at.append(len(self.stack))
        self.stack.append(node)

    def _lists(self, tag: str) -> list[list[int]]:
        return [self.places[tag], *([self.blocks] if tag in BLOCKS else []), *([self.scopes] if tag in _SCOPES else [])]

    def _break(self, node: Node) -> None:
        if node.tag in BLOCKS:
            node.holder.kids.append(Node("div"))

    def cut(self, at: int) -> None:
        """Close everything from a place on."""
        for node in self.stack[at:]:
            for places in self._lists(node.tag):
                places.pop()
            if node.holder is not node:
                self._break(node)
        del self.stack[at:]

    def _nearest(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def make_room(self, tag: str) -> None:
        """Close what a start tag ends without an end tag: a paragraph before a block, an item before an item."""
        if tag in BLOCKS and (p := self._nearest("p")) and p >= self.blocks[-1]:
            self.cut(p)
        if tag in _CLOSED_BY:
            while (at := self._nearest(_CLOSED_BY[tag])) and at >= self.scopes[-1]:
                self.cut(at)
                if tag not in ("tr", "tbody"):
                    break

    def close(self, tag: str) -> None:
        at = self._nearest([tag])
        if at and (tag in BLOCKS or self.blocks[-1] < at):  # an inline element's end tag closes no block
            self.cut(at)


def _tag_end(html: str, at: int, missing: dict[str, int]) -> int:
    """The place of the > that ends a tag, quoted ones left out; -1 if there is none. missing: from where on there is no such quote."""
    first = html.find(">", at)
    if first < 0:
        return -1
    while True:
        stop = _STOP.search(html, at)
        if stop is None:
            return first
        mark, at = stop[0], stop.end()
        if mark == ">":
            return at - 1
        if at >= missing.get(mark, len(html) + 1):
            continue
        close = html.find(mark, at)
        if close < 0:
            missing[mark] = at
            return first  # an open quote: the tag ends where it looks as if it did
        at = close + 1


def parse(html: str) -> Node:
    """The tree below a root node; never fails, whatever the markup."""
    root = Node("html")
    doors = _Open(root)
    stack = doors.stack
    at, end, missing = 0, len(html), {}

    def say(text: str) -> None:
        stack[-1].holder.kids.append(entities.unescape(text))

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        match = _TAG.match(html, lt)
        gt = _tag_end(html, match.end(), missing) if match else -1
        if match and gt < 0:
            say(html[lt:])  # no tag ends any more
            break
        if match is None:
            stack[-1].holder.kids.append("<")
            at = lt + 1
            continue
        at, tag, attributes = gt + 1, match[2].lower(), html[match.end() : gt]
        if match[1]:
            doors.close(tag)
            continue
        if tag == "html" or tag == "body" and doors.places["body"]:
            continue
        doors.make_room(tag)
        node = Node(tag, attributes)
        if tag in RAW:
            stack[-1].holder.kids.append(node)
            stop = _ENDS[tag].search(html, at)
            close = html.find(">", stop.start()) if stop else -1
            at = end if close < 0 else close + 1
        elif tag in VOID or attributes.endswith("/"):
            stack[-1].holder.kids.append(node)
        else:
            doors.push(node)
    return root


class Slot:
    """A node of a wrapper: pages that have it, its text's hash (0: varies), characters in text and in links, children, and the hashes of members that all of its pages have; of a page also its DOM nodes and their hashes."""

    __slots__ = ("chars", "hash", "hashes", "kids", "label", "links", "members", "nodes", "pages")

    def __init__(self, label: str, pages: int, hash_: int, chars: int, links: int, kids: list[Slot], nodes: list[Node] | None = None, members: frozenset[int] = frozenset()):
        self.label, self.pages, self.hash, self.chars, self.links, self.kids, self.nodes, self.members = label, pages, hash_, chars, links, kids, nodes, members
        self.hashes = [hash_] if nodes else []

    def packed(self) -> list:
        return [self.label, self.pages, self.hash, self.chars, self.links, [k.packed() for k in self.kids], sorted(self.members)]

    @staticmethod
    def unpacked(x: list) -> Slot:
        return Slot(*x[:5], [Slot.unpacked(k) for k in x[5]], members=frozenset(x[6]))


def _is_beside(node: Node) -> bool:
    return node.tag in FURNITURE or not BESIDE.isdisjoint(node.marks) or "hidden" in node.marks or not {"role=navigation", "role=banner", "role=contentinfo", "role=complementary", "role=search", "role=dialog", "role=alert"}.isdisjoint(node.marks)


def slots(node: Node, link: bool = False) -> Slot:
    """The page's tree as slots, with runs of equal siblings taken together."""
    link = link or node.tag == "a"
    kids: list[Slot] = []
    code, chars, links = 1, 0, 0
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if not text:
                continue
            n = len(text)
            own = Slot("#", 1, zlib.crc32(text.encode("utf-8", "replace")) + 1, n, n if link else 0, [], [])
        elif kid.tag in NO_TEXT:
            continue
        else:
            own = slots(kid, link)
        code = (code * 1_000_003 + own.hash) % 0xFFFFFFFFFFFF + 1
        chars, links = chars + own.chars, links + own.links
        last = kids[-1] if kids else None
        if last is not None and last.label == own.label and own.label.split(".")[0] not in CONTAINERS:
            last.hash = (last.hash * 1_000_003 + own.hash) % 0xFFFFFFFFFFFF + 1
            last.chars, last.links, last.kids = last.chars + own.chars, last.links + own.links, []
            last.nodes += own.nodes
            last.hashes += own.hashes
            last.members |= own.members
        else:
            kids.append(own)
    # containers are never taken together, so that their hash is enough
    return Slot(node.label, 1, code, chars, links, kids, [node], frozenset() if node.label.split(".")[0] in CONTAINERS else frozenset([code]))


def _matched(a: Slot, b: Slot, known: dict) -> float:
    """Simple tree matching: the most nodes that an alignment of both trees has in common; equal texts break ties."""
    if a.label != b.label:
        return 0.0
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1.0 + 0.25 * (a.hash == b.hash != 0) + (sum(w for _, _, w in _aligned(a.kids, b.kids, known)) if a.kids and b.kids else 0.0)
    return known[key]


def _aligned(a: list[Slot], b: list[Slot], known: dict) -> list[tuple[int, int, float]]:
    """Pairs of places in both lists, in order, with the largest sum of matched nodes."""
    labels = [x.label for x in a]
    if len(a) == len(b) and labels == [x.label for x in b] and len(set(labels)) == len(labels):
        return [(i, i, _matched(x, y, known)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    if len(a) * len(b) > MATCH_CELLS:
        return _aligned_long(a, b, known)
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            w = _matched(x, y, known) if x.label == y.label else 0.0
            row[j + 1] = max(above[j + 1], row[j], above[j] + w)
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1, best[i][j] - best[i - 1][j - 1]))
            i, j = i - 1, j - 1
    return out[::-1]


def _aligned_long(a: list[Slot], b: list[Slot], known: dict) -> list[tuple[int, int, float]]:
    """The same for long lists: equal ends are paired, which loses nothing; between them, children are compared by kind and row by row."""
    shared = _hashes(a) & _hashes(b)
    ids: dict = {}
    of_a, of_b = [_kind(x, shared, ids) for x in a], [_kind(x, shared, ids) for x in b]
    # an end is paired if both are equal and no text varies: neither has a better partner
    firm = {k for k, x in zip(of_a, a, strict=True) if _firm(x, shared)} & {k for k, y in zip(of_b, b, strict=True) if _firm(y, shared)}
    short = min(len(a), len(b))
    front = next((i for i in range(short) if of_a[i] != of_b[i] or of_a[i] not in firm), short)
    back = next((i for i in range(short - front) if of_a[-1 - i] != of_b[-1 - i] or of_a[-1 - i] not in firm), short - front)
    x, y = of_a[front : len(a) - back], of_b[front : len(b) - back]
    rows, columns = dict(zip(x, a[front:], strict=False)), dict(zip(y, b[front:], strict=False))
    place = {k: i for i, k in enumerate(columns)}
    taken = np.array([place[k] for k in y], dtype=np.int64)
    weights = {k: np.array([_matched(p, q, known) for q in columns.values()])[taken] for k, p in rows.items()} if y else {}
    above = np.zeros(len(y) + 1)
    up, left = [], []
    for k in x:
        row = np.zeros(len(y) + 1)
        if y:
            row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights[k]))
        up.append(np.packbits(row[1:] == above[1:]))
        left.append(np.packbits(row[1:] == row[:-1]))
        above = row
    bit = lambda bits, j: bits[j >> 3] >> (7 - (j & 7)) & 1
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if bit(up[i - 1], j - 1):
            i -= 1
        elif bit(left[i - 1], j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((front + i, front + j))
    pairs = [(i, i) for i in range(front)] + pairs[::-1] + [(len(a) - i, len(b) - i) for i in range(back, 0, -1)]
    return [(i, j, _matched(a[i], b[j], known)) for i, j in pairs]


def _hashes(slots_: list[Slot]) -> set[int]:
    found: set[int] = set()
    stack = list(slots_)
    while stack:
        x = stack.pop()
        found.add(x.hash)
        stack += x.kids
    return found - {0}


def _kind(slot: Slot, shared: set[int], ids: dict) -> int:
    """A number for all that _matched sees of a slot: labels, and the hashes that both sides have."""
    key = (slot.label, slot.hash if slot.hash in shared else 0, *[_kind(k, shared, ids) for k in slot.kids])
    return ids.setdefault(key, len(ids))


def _firm(slot: Slot, shared: set[int]) -> bool:
    return slot.hash in shared and all(_firm(k, shared) for k in slot.kids)


def merged(a: Slot, b: Slot, known: dict | None = None) -> Slot:
    """Fold two wrappers with the same label."""
    known = {} if known is None else known
    kids, i, j = [], 0, 0
    for x, y, _ in _aligned(a.kids, b.kids, known):
        kids += a.kids[i:x] + b.kids[j:y] + [merged(a.kids[x], b.kids[y], known)]
        i, j = x + 1, y + 1
    kids += a.kids[i:] + b.kids[j:]
    return Slot(a.label, a.pages + b.pages, a.hash if a.hash == b.hash else 0, a.chars + b.chars, a.links + b.links, kids, members=a.members & b.members)


class Wrapper:
    """A host's folded tree and the hashes of up to EVIDENCE different pages."""

    def __init__(self, root: Slot, different: set[int]):
        self.root, self.different = root, different

    @staticmethod
    def of(root: Slot) -> Wrapper:
        return Wrapper(root, {root.hash})

    def fold(self, other: Wrapper) -> Wrapper:
        root = merged(self.root, other.root)
        _prune(root, root.pages * RARE)
        return Wrapper(root, set(sorted(self.different | other.different)[:EVIDENCE]))

    def packed(self) -> bytes:
        return zlib.compress(json.dumps([sorted(self.different), self.root.packed()], separators=(",", ":")).encode())

    @staticmethod
    def unpacked(data: bytes) -> Wrapper:
        different, root = json.loads(zlib.decompress(data))
        return Wrapper(Slot.unpacked(root), set(different))


def _prune(slot: Slot, least: float) -> None:
    slot.kids = [k for k in slot.kids if k.pages >= least]
    for k in slot.kids:
        _prune(k, least)


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and k.tag not in NO_TEXT]


def _chars(node: Node) -> int:
    return sum(len(k.strip()) for x in _walk(node) for k in x.kids if isinstance(k, str))


def _marked(root: Node) -> Node | None:
    """The element that says it is the article; of several the one with most text."""
    kinds = (lambda x: x.tag == "article", lambda x: "role=articlebody" in x.marks or any(f"={c}" in x.marks for c in BODY_CLASSES), lambda x: x.tag == "main" or "role=main" in x.marks)
    outer: list[Node] = []
    stack = [root]
    while stack:  # elements beside the article are not entered
        x = stack.pop()
        outer.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and k.tag not in NO_TEXT and not (_is_beside(k) and not _holds_article(k))]
    for kind in kinds:
        found = [x for x in outer if kind(x)]
        if found:
            return max(found, key=_chars)
    return None


def _holds_article(node: Node) -> bool:
    return any(x.tag in ("article", "main") and BESIDE.isdisjoint(x.marks) for x in _walk(node))


class _Reader:
    def __init__(self, root: Node, wrapper: Wrapper | None):
        self.root, self.wrapper = root, wrapper
        self.constant: set[int] = set()
        self.weight: dict[int, float] = {}
        self.own = slots(root)
        proven = wrapper is not None and len(wrapper.different) >= EVIDENCE
        self._align(self.own, wrapper.root if proven else None, {})
        self.region = self._slot(self.own) if proven else _marked(root) or self._slot(self.own)
        if self.constant and self._text(self.region, True) < LEAST_LEFT * self._text(self.region, False):
            self.constant = set()

    def _align(self, own: Slot, slot: Slot | None, known: dict) -> None:
        """Note for the page's nodes whether they are template, and the text that their slot has on average."""
        common = slot is not None and slot.pages >= SUPPORT * self.wrapper.root.pages
        fixed = common and slot.hash != 0 and slot.hash == own.hash
        for node, hash_ in zip(own.nodes, own.hashes, strict=True):
            constant = fixed or common and hash_ in slot.members
            self.weight[id(node)] = 0.0 if constant else (slot.chars - slot.links) / slot.pages if slot is not None and len(own.nodes) == 1 else float(own.chars - own.links) / len(own.nodes)
            if constant:
                self.constant.add(id(node))
        pairs = {x: y for x, y, _ in _aligned(own.kids, slot.kids, known)} if slot is not None else {}
        for i, kid in enumerate(own.kids):
            self._align(kid, slot.kids[pairs[i]] if i in pairs else None, known)

    def _slot(self, own: Slot) -> Node:
        """Go down as long as one varying child has most of the text that is not links."""
        node = own.nodes[0]
        while True:
            kids = [k for k in node.kids if isinstance(k, Node) and k.tag in BLOCKS and k.tag not in NO_TEXT and not (_is_beside(k) and not _holds_article(k))]
            loose = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
            total = loose + sum(self.weight.get(id(k), 0.0) for k in kids)
            best = max(kids, key=lambda k: self.weight.get(id(k), 0.0), default=None)
            if best is None or best.tag not in CONTAINERS or self.weight.get(id(best), 0.0) < 0.7 * total:
                return node
            node = best

    def _skipped(self, node: Node, inside_header: bool) -> bool:
        if node.tag in NO_TEXT or id(node) in self.constant:
            return True
        if node is self.region or not _is_beside(node):
            return False
        # a header that holds the article's title is read for its headings
        return not (not inside_header and (node.tag == "header" or "header" in node.marks) and any(x.tag in ("h1", "h2") for x in _walk(node)))

    def blocks(self) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def flush() -> None:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                out.append(text)

        def read(node: Node, header: bool) -> None:
            block = node.tag in BLOCKS
            if block:
                flush()
            titles = header and node.tag not in ("h1", "h2", "h3")
            for kid in node.kids:
                if isinstance(kid, str):
                    if not titles:
                        line.append(kid)
                elif kid.tag == "br":
                    line.append(" ")
                elif not self._skipped(kid, header):
                    read(kid, (header and titles) or (_is_beside(kid) and (kid.tag == "header" or "header" in kid.marks)))
            if block:
                flush()

        read(self.region, False)
        flush()
        return out

    def _text(self, node: Node, without: bool) -> int:
        kept, self.constant = self.constant, self.constant if without else set()
        region, self.region = self.region if hasattr(self, "region") else node, node
        try:
            return sum(map(len, self.blocks()))
        finally:
            self.constant, self.region = kept, region


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The article's blocks, one in a line."""
    if not html:
        return ""
    return "\n".join(_Reader(parse(html), wrapper).blocks())


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for every host with several pages; pages has host and html."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([w.packed() for w in held.values()], pa.binary())], ["host", "salt", "wrapper"])
            held.clear()
            return found

        for batch in sliced(batches):
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Wrapper.of(_bare(slots(parse(text))))
                held[host] = held[host].fold(own) if host in held else own
                if len(held) >= TASK_HOSTS:
                    yield out()
        if held:
            yield out()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in rows["wrapper"]:
            own = Wrapper.unpacked(data)
            total = own if total is None else total.fold(own)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [total.root.pages], "wrapper": [total.packed()]})

    schema = "host string, pages long, wrapper binary"
    partials = arrow_map(pages.filter("host <> '' and html <> ''").select("host", "html"), partial, "host string, salt int, wrapper binary")
    salted = partials.groupBy("host", "salt").applyInPandas(fold, schema)
    return salted.select("host", "wrapper").groupBy("host").applyInPandas(fold, schema).filter("pages > 1").select("host", "wrapper")


def _bare(slot: Slot) -> Slot:
    """Without the page's nodes, which a wrapper does not keep."""
    slot.nodes = None
    for kid in slot.kids:
        _bare(kid)
    return slot


@lru_cache(maxsize=512)
def _wrapper(data: bytes) -> Wrapper:
    return Wrapper.unpacked(data)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    wrappers = materialize(induce(pages), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    joined = pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(html, _wrapper(w) if w is not None else None) for html, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(joined.select("page_id", "url", "html", "wrapper"), read, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
