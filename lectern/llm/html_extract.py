"""Main text of HTML pages by minimum-cut labelling.

A page becomes a graph. Its nodes are the text blocks (cut at block-level tags)
and the containers, elements that say something of what is in them: ``article``,
``nav``, a class or id such as ``comments``, a role. A linear classifier over a
block's text (length, sentence end, share of linked text; weights learned by
``learn``) and graded values of tags, roles and names of containers give each
node's evidence for content or boilerplate, always finite; the two become its
capacities to source and sink. Smoothness edges follow adjacency and nearness in
the DOM: blocks next to each other, weaker the more steps apart and across a
container's edge; a block and its container; a container and the one around it
(content inside boilerplate costs far more than boilerplate inside content).
The minimum cut, by maximum flow, labels all nodes of the page at once, so a
short line inside an article stays and a long comment below it goes. Nodes whose
evidence outweighs all their edges are settled first, which changes no minimum
cut.

Content blocks are joined by one line feed in page order; inside a block
character references are decoded, runs of white space become one space, and the
ends are trimmed. ``br`` counts as white space.

Defined results: null or empty html gives the empty text; a page without content
blocks too; pages of any length and depth are read whole, in about linear time up
to the flow of the blocks that their own evidence doesn't settle; bytes that are no UTF-8 read as
U+FFFD; equal costs fall to boilerplate;
unclosed or stray tags are repaired as browsers do for paragraphs, list items
and table cells; CDATA sections are markup; repeated rows each get a row; an
empty table gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_bytes

# Names of HTML elements, and words of class and id attributes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and no text of the page.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
#: Their text is never shown as part of an article.
DROPPED_TAGS = frozenset("head svg template object canvas audio video button select datalist map".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names of boilerplate. A name made of these and of ``PLAIN_WORDS`` is one; in
#: company of other words (``share-of-market``) it is a hint.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notification sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup signin login register popup modal overlay widget widgets toolbar pagination pager paging outbrain taboola disclaimer copyright skip".split()
)
PLAIN_WORDS = frozenset(
    "area article articles bar block body box btn button buttons container content entry inner item items js left level line link links list main menu outer page panel post posts primary reader right row secondary section shell site slot text thread title top bottom unit user users wrap wrapper".split()
)
#: Boilerplate only outside an article.
HEADER_WORDS = frozenset("header head topbar top".split())
CONTENT_WORDS = frozenset("article content post entry story main maincontent text prose".split())
#: A name that begins so tells of the page, not of the element (``has-comments``).
STATE_WORDS = frozenset("has is no not with without".split())

#: Evidence is in sixteenths of a natural logarithm, so that capacities are whole
#: numbers. Of containers: content elements, elements and roles of boilerplate,
#: names of boilerplate, hints of a name.
CONTENT, BOILERPLATE, NAMED, HINT = 400, -480, -400, 24
#: Of a page on which nothing names an article, and of its hints where no element is
#: one; and the tie of a block to such a page.
WHOLE, WHOLE_TIE = 120, 24
#: What a word of boilerplate in company of others says.
PART_NAMED = -28
#: Of blocks, by ``Block.features``: ``learn`` found them from ``PRIOR`` and the
#: 250 pages of a small table (a test learns them again).
PRIOR = (-18, 44, 15, -62)
WEIGHTS = (-13, 45, 6, -65)
MOST = 90
LENGTH_WORDS = 20
NOTICE = -48
#: Edges: neighbours with one parent (halved for each step apart in the tree and
#: twice more across a container's edge); block and container, of strong evidence
#: or a hint; boilerplate in a container of content, and content in boilerplate.
SMOOTH, TIE, HINT_TIE, NEST, NEST_CONTENT = 24, 96, 32, 40, 600

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LEGAL = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)
#: A start tag closes these open elements first (up to a boundary).
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}


class Node:
    """An open element: what it says about the text below it."""

    __slots__ = ("tag", "parent", "depth", "evidence", "inside", "dropped", "linked", "container", "block", "outside_form")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = bool(parent and parent.dropped) or tag in DROPPED_TAGS
        self.linked = bool(parent and parent.linked) or tag == "a"
        self.inside = bool(parent and parent.inside)
        self.evidence = _evidence(tag, attributes, self.inside)
        if self.evidence == BOILERPLATE and tag not in BLOCK_TAGS and tag not in BOILERPLATE_TAGS:
            self.dropped = True  # hidden within a line
        if self.evidence >= CONTENT:
            self.inside = True
        # the closest block element and the closest one that says something, this one included
        self.block: Node = self if tag in BLOCK_TAGS or parent is None else parent.block
        self.container: Node | None = self if self.evidence else parent and parent.container
        self.outside_form: Node | None = self if self.evidence and tag != "form" else parent and parent.outside_form

    def around(self) -> "Node | None":
        """The container that this container is in; a form around content (a
        whole page may be one) doesn't count."""
        return self.parent and (self.parent.outside_form if self.evidence >= CONTENT else self.parent.container)


def _evidence(tag: str, attributes: str, inside: bool) -> int:
    """What an element says by itself: above 0 for content."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside:
        return BOILERPLATE
    found = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return BOILERPLATE
    role = found.get("role", "").lower()
    if role in BOILERPLATE_ROLES:
        return BOILERPLATE
    if tag in ("html", "body"):
        return 0
    named = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        named = min(named, _named(name, inside)) if named < 0 else _named(name, inside) or named
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return CONTENT if named >= PART_NAMED else named
    return named


def _named(name: str, inside: bool) -> int:
    """What a class or id says."""
    said = [w.lower() for w in _WORD.findall(name)]
    if not said or said[0] in STATE_WORDS:
        return 0
    bad = [w for w in said if w in BOILERPLATE_WORDS or not inside and w in HEADER_WORDS]
    if bad:
        whole = all(w in BOILERPLATE_WORDS or w in HEADER_WORDS or w in PLAIN_WORDS or len(w) == 1 for w in said)
        return NAMED if whole else PART_NAMED
    return HINT if any(w in CONTENT_WORDS for w in said) else 0


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # characters of linked text

    def features(self) -> tuple[float, float, float, float]:
        """One, length (in words, up to ``LENGTH_WORDS``), sentence end, share of linked text."""
        words = self.text.count(" ") + 1
        ends = self.text[-1] in ".!?…:;\"'”’»)]" and words > 1
        return 1.0, min(words, LENGTH_WORDS) / LENGTH_WORDS, float(ends), min(1.0, self.linked / len(self.text))

    def evidence(self) -> int:
        """What the text says: positive for content, negative for boilerplate."""
        e = round(sum(w * x for w, x in zip(WEIGHTS, self.features())))
        if len(self.text) < 300 and not self.node.inside and _LEGAL.search(self.text):
            e += NOTICE
        return max(-MOST, min(MOST, e))


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    node = Node("#root", None)
    parts: list[str] = []
    linked = 0
    owner = node  # the block element that the open text belongs to

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, owner, linked))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if node.dropped:
            return
        raw = unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if node.linked:
            linked += len(raw.strip())

    open_tags: Counter[str] = Counter()  # a tag that isn't open need not be looked for

    def pop_to(target: Node) -> None:
        nonlocal node, owner
        while node is not target:
            open_tags[node.tag] -= 1
            node = node.parent
        owner = target.block

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            if tag in BLOCK_TAGS or tag == "head":
                flush()
            found = node if open_tags[tag] else None
            while found is not None and found.tag != tag:
                # inline end tags don't close blocks, cells don't close tables
                if tag not in BLOCK_TAGS and tag not in DROPPED_TAGS and found.tag in BLOCK_TAGS:
                    found = None
                    break
                found = found.parent
            if found is not None and found.parent is not None:
                pop_to(found.parent)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            if parts:
                parts.append("\n")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in _CLOSES:
                closes, stop = _CLOSES[tag]
                found, last = node if any(open_tags[c] for c in closes) else None, None
                while found is not None and found.tag not in stop:
                    if found.tag in closes:
                        last = found
                    found = found.parent
                if last is not None and last.parent is not None:
                    pop_to(last.parent)
            elif tag != "option":
                if node.block.tag == "p" and node.block.parent is not None:
                    pop_to(node.block.parent)  # a block ends an open paragraph
            if tag == "body":
                while node.tag == "head" and node.parent is not None:
                    pop_to(node.parent)
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "head":
            flush()
        node = Node(tag, node, attributes)
        open_tags[tag] += 1
        if tag in BLOCK_TAGS:
            owner = node
    flush()
    return out


def graph(found: list[Block]) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """(evidence of every node, edges); the blocks are the first nodes, their
    containers follow. An edge (i, j, a, b) costs a when only i is content, and
    b when only j is."""
    evidence, edges = [b.evidence() for b in found], []
    place: dict[int, int] = {}

    says = [b.node.container.evidence for b in found if b.node.container is not None]
    unnamed = not any(e >= CONTENT for e in says)  # then a hint is the best name there is

    def container(node: Node) -> int:
        chain = []
        while id(node) not in place:
            place[id(node)] = len(evidence)
            evidence.append(WHOLE if unnamed and node.evidence == HINT else node.evidence)
            chain.append(node)
            node = node.around()
            if node is None:
                break
        for inner in chain:
            outer = inner.around()
            if outer is not None:
                edges.append((place[id(outer)], place[id(inner)], NEST, NEST_CONTENT))
        return place[id(chain[0] if chain else node)]

    whole = None
    if not any(e > 0 for e in says):
        whole = len(evidence)  # nothing names an article: the page itself may be one
        evidence.append(WHOLE)
    for i, block in enumerate(found):
        own = block.node.container
        if own is not None:
            tie = TIE if abs(own.evidence) >= CONTENT else HINT_TIE
            edges.append((i, container(own), tie, tie))
        elif whole is not None:
            edges.append((i, whole, WHOLE_TIE, WHOLE_TIE))
        if i:
            before = found[i - 1].node
            near = SMOOTH >> _apart(before, block.node) + (2 if before.container is not own else 0)
            if near:
                edges.append((i - 1, i, near, near))
    return evidence, edges


def _apart(a: Node, b: Node) -> int:
    """Steps from the blocks' parents to their closest common ancestor, up to as
    many as leave nothing of an edge."""
    a, b, steps = a.parent or a, b.parent or b, 0
    while a is not b and steps < SMOOTH.bit_length():
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(evidence: list[int], edges: list[tuple[int, int, int, int]]) -> list[bool]:
    """True for the source (content) side of a minimum cut. Terminal capacities
    are the positive and negative evidence; ties fall to the sink side."""
    n, e = len(evidence), list(evidence)
    around: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for i, j, a, b in edges:
        around[i].append((j, a, b))
        around[j].append((i, b, a))
    label: list[bool | None] = [None] * n
    up = [sum(a for _, a, _ in near) for near in around]  # most that content can cost a node
    down = [sum(b for _, _, b in near) for near in around]  # and boilerplate
    queue = deque(range(n))
    while queue:  # settle what no neighbour can turn
        i = queue.popleft()
        if label[i] is None and (e[i] > up[i] or e[i] <= -down[i]):
            label[i] = e[i] > up[i]
            for j, a, b in around[i]:
                if label[j] is None:
                    e[j] += a if label[i] else -b
                    up[j] -= b
                    down[j] -= a
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, e, around)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(rest: list[int], e: list[int], around: list[list[tuple[int, int, int]]]) -> list[bool]:
    """Maximum flow by levels: all shortest paths between source and sink over the
    unsettled nodes are filled before the levels are told anew; the source side is
    what the residual graph still reaches."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    head: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((there, back))

    for i, k in place.items():
        if e[i] > 0:
            join(source, k, e[i], 0)
        elif e[i] < 0:
            join(k, sink, -e[i], 0)
        for j, a, b in around[i]:
            if j in place and i < j:
                join(k, place[j], a, b)
    while True:
        level = [-1] * len(out)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for x in out[a]:
                if room[x] > 0 and level[head[x]] < 0:
                    level[head[x]] = level[a] + 1
                    queue.append(head[x])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        following, path, a = [iter(x) for x in out], [], source
        while True:  # all shortest paths of this length, each edge left behind once
            if a == sink:
                flow = min(room[x] for x in path)
                for x in path:
                    room[x] -= flow
                    room[x ^ 1] += flow
                full = next(k for k, x in enumerate(path) if not room[x])
                a = head[path[full] ^ 1]
                del path[full:]
                continue
            x = next((x for x in following[a] if room[x] > 0 and level[head[x]] == level[a] + 1), None)
            if x is not None:
                path.append(x)
                a = head[x]
            elif a == source:
                break
            else:
                a = head[path.pop() ^ 1]


def labelled(html: str | None) -> list[tuple[Block, bool]]:
    """The page's blocks, True for content."""
    found = blocks(html or "")
    return list(zip(found, minimum_cut(*graph(found))))


def extract(html: str | None) -> str:
    """The main text of a page."""
    return "\n".join(b.text for b, keep in labelled(html) if keep)


def learn(pages: Iterable[str], prior: tuple[int, ...] = PRIOR, worth: float = 200.0, trust: float = 4.0, rounds: int = 40) -> tuple[int, ...]:
    """Weights of the text features by logistic regression (Newton's method) on
    blocks that their containers label, content elements against boilerplate,
    around a ``prior`` of precision ``trust``. Both classes weigh the same, all
    blocks together as ``worth`` of them. What a container says is no feature, so
    the weights speak of texts alone."""
    x, y = [], []
    for page in pages:
        for block in blocks(page or ""):
            said = block.node.container
            if said is not None and abs(said.evidence) >= CONTENT:
                x.append(block.features())
                y.append(said.evidence > 0)
    x, y = np.array(x, float).reshape(-1, 4), np.array(y, float)
    if not len(y) or not 0 < y.sum() < len(y):
        raise ValueError("pages must hold content and boilerplate")
    each = worth * np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    start = np.array(prior) / 16
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (each * (y - p)) - trust * (w - start)
        w += np.linalg.solve((x.T * (each * p * (1 - p))) @ x + trust * np.eye(4), slope)
    return tuple(int(round(16 * v)) for v in w)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(h.decode("utf-8", "replace")) for h in text_bytes(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, f"page_id {kind}, url string, text string, n_chars bigint")
