"""Main text of pages by site style trees (operator 7).

The block elements of a host's pages are merged by their path of tags and marks into one
tree.  Each node has two importances, the entropy of its presentation (the sequences of its
children) and of its content (the text below it) over the host's different pages, each
between 0 and 1.  Branches of low importance in both respects are the site's, not the
page's, and are removed.  Copies of one article count as one page.

Entropy needs repetition: a menu or advert that differs on every page is as surprising as
an article.  So elements whose tag, role or mark says that they are no content (a fixed
list) are left out, and where a page marks its article, other parts are.  Marks are whole
names of a class or id, and html, body, main and article are never furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import look_up, stored

# Different pages of a host that show a node, at least, and the importance of a noisy one.
MIN_PAGES = 5
LOW_IMPORTANCE = 0.2

# HTML's elements by role, and usual marks of page furniture.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
NO_CONTENT = frozenset("head nav footer aside form menu dialog button select option input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner menu navbar nav navigation breadcrumb "
    "breadcrumbs sidebar footer cookie cookies consent notice newsletter subscribe popup modal overlay comment "
    "comments respond disqus share sharing social related widget toolbar pagination pager skip".split()
)
# Whole names of several words; their first word alone says little (``social-policy``).
COMPOUNDS = frozenset(
    "ad-banner ad-container ad-slot ad-unit ad-wrapper ads-container banner-ad comment-form comment-list "
    "comments-area comments-list comments-section cookie-banner cookie-bar cookie-consent cookie-notice "
    "footer-menu footer-nav footer-widgets menu-bar menu-container menu-item menu-main nav-bar nav-links nav-menu "
    "newsletter-form newsletter-signup related-articles related-links related-posts share-buttons share-links "
    "sidebar-left sidebar-right sidebar-widget site-footer page-footer skip-link skip-to-content social-icons "
    "social-links social-media social-share sponsored-content widget-area".split()
)
HEADERS = frozenset("header masthead site-header page-header topbar".split())
ARTICLE = frozenset(("article", "main"))
# Elements that hold the page's content whatever their class or id says.
HOLDERS = frozenset(("html", "body", *ARTICLE))
CLOSES_P = BLOCK - {"html", "body", "head"}
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([/]?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _hash(value: str) -> int:
    number = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return number - (1 << 64) if number >> 63 else number


def _marks(attributes: str) -> tuple[str, str]:
    """The class, id and role of a tag as one string of words, and its role."""
    found, role = [], ""
    for name, a, b, c in _MARK.findall(attributes):
        value = (a or b or c).lower()
        found += value.split()
        role = value if name.lower() == "role" else role
    return " ".join(found), role


def _furniture(tag: str, marks: str, role: str, in_article: bool) -> bool:
    if tag in NO_CONTENT or role in ROLES:
        return True
    if tag in HOLDERS:
        return False
    words = marks.split()
    if not in_article and (tag == "header" or HEADERS.intersection(words)):
        return True
    return any(w in MARKS or w.replace("_", "-") in COMPOUNDS for w in words)


# Texts below a node are hashed as a polynomial over the hashes of blocks, so a node needs only
# the places of its first and last block.
_PRIME = (1 << 61) - 1
_BASE = 0x5851F42D4C957F2D % _PRIME


class _Page:
    """Blocks of text in page order, and the nodes they lie in, each with its parent.

    Time and memory grow with the page alone, however deep its elements are nested.
    """

    def __init__(self, html: str):
        self.stack: list[dict] = []
        # Places in the stack by tag.
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        # Node (-1: none), text, and whether it lies in an article.
        self.blocks: list[tuple[int, str, bool]] = []
        self.prefix, self.powers = [0], [1]
        self.index: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.names: list[int] = []
        self.children: list[list[str]] = []
        self.contents: list[int] = []
        position, raw = 0, ""
        while True:
            if raw:
                # Nothing but its own end tag ends such an element.
                end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(html, position)
                position, raw = end.start() if end else len(html), ""
            found = _TAG.search(html, position)
            self._words(html[position : found.start() if found else len(html)])
            if not found:
                break
            position = found.end()
            if found[2]:
                raw = self._tag(found[2].lower(), bool(found[1]), found[3])
        self._flush()
        self._cut(0)

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _cut(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.places[e["tag"]].pop()
            if not e["out"]:
                blocks = len(self.blocks) - e["start"]
                power = self.powers[blocks]
                inside = self.prefix[-1] - self.prefix[e["start"]] * power
                self.contents[e["node"]] = (self.contents[e["node"]] * power + inside) % _PRIME

    def _end_head(self) -> None:
        """Text and elements of a body end a head whose end tag is left out."""
        if self.stack and self.stack[-1]["tag"] == "head":
            self._cut(len(self.stack) - 1)

    def _words(self, text: str) -> None:
        if text.strip():
            self._end_head()
        if text and not (self.stack and self.stack[-1]["out"]):
            self.text.append(unescape(text))

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if not text or (self.stack and self.stack[-1]["out"]):
            return
        inner = self.stack[-1] if self.stack else {"node": -1, "article": False}
        self.blocks.append((inner["node"], text, inner["article"]))
        self.prefix.append((self.prefix[-1] * _BASE + (_hash(text) & ((1 << 64) - 1)) + 1) % _PRIME)
        self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _tag(self, tag: str, closing: bool, attributes: str) -> str:
        """Take in a tag; the name of a raw element that it opens."""
        if closing:
            self._close(tag)
            return ""
        if tag in VOID or tag not in BLOCK and tag not in RAW and tag not in NO_CONTENT:
            if tag in ("br", "img"):
                self._words(" ")
            elif tag == "hr":
                self._flush()
            return ""
        if tag in RAW:
            return "" if attributes.endswith("/") and tag in ("svg", "math") else tag
        self._flush()
        self._end_head()
        if tag in CLOSES_P and self.stack and self.stack[-1]["tag"] == "p":
            self._cut(len(self.stack) - 1)
        if tag in PEERS:
            peer = self._last(PEERS[tag])
            if peer > self._last(FENCES[tag]):
                self._cut(peer)
        self._open(tag, attributes)
        return ""

    def _open(self, tag: str, attributes: str) -> None:
        above = self.stack[-1] if self.stack else {"node": -1, "out": False, "article": False}
        marks, role = _marks(attributes) if attributes.strip(" /") else ("", "")
        out = above["out"] or _furniture(tag, marks, role, above["article"])
        article = not out and (above["article"] or tag in ARTICLE or role == "main")
        node = -1 if out else self._node(above["node"], f"{tag}.{marks}")
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append({"tag": tag, "node": node, "out": out, "article": article, "start": len(self.blocks)})

    def _node(self, parent: int, label: str) -> int:
        """The node of a label below a parent; a parent has a lower number than its children."""
        if parent >= 0:
            self.children[parent].append(label)
        node = self.index.setdefault((parent, label), len(self.parents))
        if node == len(self.parents):
            self.parents.append(parent)
            self.names.append(_hash(f"{self.names[parent] if parent >= 0 else ''}/{label}"))
            self.children.append([])
            self.contents.append(0)
        return node

    def _close(self, tag: str) -> None:
        place = self._last((tag,)) if tag in BLOCK or tag in NO_CONTENT else -1
        if place >= 0:
            self._flush()
            self._cut(place)


def parse(html: str | None) -> tuple[list[dict], list[dict], int]:
    """Blocks that may be main text, the nodes of the page's tree, and a hash of the text.

    A block names its node, a node its parent, by their places among the nodes (-1: none).
    """
    page = _Page(html or "")
    blocks = page.blocks
    if any(inside for *_, inside in blocks):
        blocks = [b for b in blocks if b[2]]
    used: set[int] = {-1}
    for node, *_ in blocks:
        while node not in used:
            used.add(node)
            node = page.parents[node]
    place = {node: i - 1 for i, node in enumerate(sorted(used))}
    nodes = [
        {
            "parent": place[page.parents[n]],
            "node": page.names[n],
            "presentation": _hash("|".join(page.children[n])),
            "content": page.contents[n],
        }
        for n in place
        if n >= 0
    ]
    rows = [{"node": place[node], "text": text} for node, text, _ in blocks]
    return rows, nodes, _hash("\n".join(b["text"] for b in rows))


def _without(blocks: list[dict], parents: list[int], names: list[int], noise: list[int] | None) -> str:
    """The texts of the blocks that lie below none of the noisy nodes."""
    noisy = set(noise or ())
    gone = [False] * (len(names) + 1)
    for i, (parent, name) in enumerate(zip(parents, names)):
        # The last place stands for no node.
        gone[i] = gone[parent] or name in noisy
    return "\n\n".join(b["text"] for b in blocks if not gone[b["node"]])


_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
_NODES = pa.list_(pa.struct([("parent", pa.int32()), ("node", pa.int64()), ("presentation", pa.int64()), ("content", pa.int64())]))
_PARSED = (
    "row bigint, page_id bigint, url string, blocks array<struct<node:int,text:string>>, "
    "nodes array<struct<parent:int,node:bigint,presentation:bigint,content:bigint>>, key bigint"
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        found = [parse(h) for h in batch.column(2).to_pylist()]
        if not found:
            continue
        blocks, nodes, keys = zip(*found)
        rows = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        arrays = [rows, batch.column(0), batch.column(1)]
        arrays += [pa.array(blocks, _BLOCKS), pa.array(nodes, _NODES), pa.array(keys, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "page_id", "url", "blocks", "nodes", "key"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_without(*page) for page in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text"])


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _entropy(nodes: DataFrame, feature: str) -> DataFrame:
    """Entropy of a feature of each node over the pages of its host, between 0 and 1."""
    counted = nodes.groupBy("host", "node", feature).agg(F.count("*").cast("double").alias("n"))
    sums = counted.groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s")
    )
    spread = F.log("pages") - F.col("s") / F.col("pages")
    return sums.select("host", "node", "pages", F.when(F.col("pages") > 1, spread / F.log("pages")).alias(feature))


def low_importance(parsed: DataFrame) -> DataFrame:
    """``(host, node)`` of the branches that are the same on nearly all pages of a host."""
    nodes = parsed.select("host", "key", F.explode("nodes").alias("n")).select("host", "key", "n.*")
    pages = nodes.groupBy("host", "key", "node").agg(
        F.min("presentation").alias("presentation"), F.min("content").alias("content")
    )
    pages = stored(pages, "tree-nodes")
    shown, said = _entropy(pages, "presentation"), _entropy(pages, "content").drop("pages")
    both = shown.join(said, ["host", "node"])
    low = F.greatest("presentation", "content") < LOW_IMPORTANCE
    return stored(both.where(F.col("pages") >= MIN_PAGES).where(low).select("host", "node"), "tree-noise")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Null pages have no text; pages without url form one host.  Repeated rows are kept and
    count as one page of the tree.  Hosts with fewer different pages than MIN_PAGES lose
    nothing by importance.  Other columns are not looked at.
    """
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    parsed = stored(narrow.mapInArrow(_parse_batches, _PARSED).withColumn("host", _host()), "tree-pages")
    noise = low_importance(parsed)
    seen = parsed.select("row", "host", F.explode("nodes.node").alias("node"))
    cut = look_up(seen, noise, ["host", "node"], spread=["row"], how="inner")
    cut = stored(cut.groupBy("row").agg(F.collect_set("node").alias("cut")), "tree-cuts")
    tree = [F.col("nodes.parent").alias("parents"), F.col("nodes.node").alias("names")]
    narrow = parsed.select("row", "page_id", "url", "blocks", *tree)
    joined = look_up(narrow, cut, ["row"], spread=["row"], weight=F.size("cut"))
    texts = joined.select("page_id", "url", "blocks", "parents", "names", "cut").mapInArrow(
        _text_batches, "page_id bigint, url string, text string"
    )
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
