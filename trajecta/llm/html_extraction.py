"""Main text of raw HTML pages by tag-path ratios.

A page is cut into blocks (the text between two block-level tags), each with its
root-to-leaf path of block-level tags and class names.  Per path the mean text
length and the mean number of punctuation marks of its blocks are taken, both
sequences are smoothed over the blocks in page order, multiplied, and averaged
per path; paths at or above ``SPREAD`` standard deviations are content, and every
block on them is returned, wherever it stands.  Where article or main elements hold
half of the text, paths outside them count half.  Headings, list items, cells and
the like that a path rejects for being short come along next to content.

Elements that never hold article text (navigation, forms, scripts, adverts,
comments, ...) are left out by tag, role, or class word.  Names that pages also give
to wrappers of everything (``SOFT``) leave nothing out where the element holds half
of the text.  One pass over the page; time and memory grow with its length only.

Defined cases: NULL, empty and text-free pages give an empty text; unclosed and
misnested tags are closed as browsers do for paragraphs, list items and cells,
else at their ancestor's end; after a tag whose quotes never close, quotes are no
longer obeyed; a page without any punctuation falls back to all
its blocks; repeated rows are extracted alike; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import map_slices

SPREAD = 0.5
SHORT = 120
INLINE_DEPTH = 64

# Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math canvas "
                "object audio video select datalist".split())
NEVER = frozenset("nav header footer aside form menu dialog button fieldset head label".split())
ALONG = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre legend summary".split())
ROOTS = frozenset("article main".split())
NO_CLASS_RULE = frozenset("html body main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table select body html div article section main td th".split())
# Words in class, id or role that mark what is no article text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos "
    "promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header "
    "masthead comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social "
    "related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer skip form search "
    "tagcloud complementary contentinfo hidden dialog".split())
# Those of the marks above that may stand at a wrapper of the whole page, too.
SOFT_TAGS = frozenset("form header aside fieldset dialog".split())
SOFT = frozenset(
    "banner promo promoted nav navigation menu sidebar sidebars aside footer header masthead notice notices alert popup modal "
    "overlay share sharing social related widget widgets toolbar search form dialog skip discussion login hidden".split())
NEGATIONS = frozenset("no not has with without".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？«»„“”\"()]")


class Node:
    """An element: its nearest block-level element, the number of its path, and its marks."""

    __slots__ = ("tag", "parent", "block", "path", "mark", "soft", "link", "root", "held")

    def __init__(self, tag: str, parent: Node | None, path: int, mark: bool, soft: bool, link: bool, root: bool):
        self.tag, self.parent, self.path, self.mark, self.soft, self.link, self.root = (
            tag, parent, path, mark, soft, link, root)
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.held = 0


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label of the path, whether the element is marked as no article text, whether only softly)."""
    hard, soft, label = tag in NEVER and tag not in SOFT_TAGS, tag in SOFT_TAGS, tag
    if attributes:
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        if names:
            label = f"{tag}.{names}"
        if tag not in NO_CLASS_RULE:
            words = {w.lower() for w in _WORD.findall(names)}
            if not words & NEGATIONS:
                hard = hard or bool(words & (BOILERPLATE - SOFT))
                soft = soft or bool(words & SOFT & BOILERPLATE)
            hard = hard or bool(_HIDDEN.search(attributes))
    return label, hard or soft, soft and not hard


class Tags:
    """The tags of a page from left to right: (start, end, name or None, closing, attributes)."""

    def __init__(self, page: str):
        self.page, self.obey = page, True
        self.last = page.rfind(">")

    def end_of(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends: the next > outside quotes."""
        page, start = self.page, at
        while self.obey:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at
            closing = page.find(page[at], at + 1)
            if closing < 0:
                break
            at = closing + 1
        self.obey = False
        return page.find(">", start)

    def after(self, at: int):
        """The first tag from ``at`` on, or None."""
        page = self.page
        while 0 <= (start := page.find("<", at)) < self.last:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, None, False, ""
            closing = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + closing)
            if name:
                end = self.end_of(name.end())
                return start, end + 1, name[0].lower(), closing, page[name.end():end]
            if page[start + 1:start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, None, False, ""
            at = start + 1
        if start >= 0 and page.startswith("<!--", start):
            return start, len(page), None, False, ""
        return None


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """(innermost block-level element, text, characters in links) in page order."""
    out: list[tuple[Node, str, int]] = []
    root = Node("", None, 0, False, False, False, False)
    stack, text, linked, at, n = [root], [], 0, 0, len(page)
    nodes, open_tags, paths = [root], Counter(), {}
    tags = Tags(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((stack[-1].block, joined, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    def pop(since: int) -> None:
        for node in stack[since:]:
            open_tags[node.tag] -= 1
        del stack[since:]

    while at < n:
        found = tags.after(at)
        if found is None:
            add(page[at:])
            break
        start, end, tag, closing, attributes = found
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if tag in BLOCKS:
                flush()
                if open_tags[tag]:
                    pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif open_tags[tag]:
                for i in range(len(stack) - 1, max(len(stack) - 1 - INLINE_DEPTH, 0), -1):
                    if stack[i].tag in BLOCKS:
                        break
                    if stack[i].tag == tag:
                        open_tags[tag] -= 1
                        del stack[i]
                        break
            continue
        if tag in BLOCKS:
            flush()
            closes = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):  # what this start tag ends
                here = stack[i].tag
                if here == "p" and tag != "option" or here in closes:
                    pop(i)
                elif here in SCOPE or (here in BLOCKS and not closes):
                    break
        if tag == "br":
            add(" ")
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        label, mark, soft = _marks(tag, attributes)
        above = stack[-1]
        path = paths.setdefault((above.path, label), len(paths) + 1) if tag in BLOCKS else above.path
        node = Node(tag, above, path, mark, soft, tag == "a" or above.link, tag in ROOTS or above.root)
        nodes.append(node)
        stack.append(node)
        open_tags[tag] += 1
    flush()
    return _unmarked(nodes, out)


def _unmarked(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside marked elements.  Parents come before their children in ``nodes``."""
    hard = {}
    for node in nodes:
        hard[node] = node.mark and not node.soft or (node.parent is not None and hard[node.parent])
    total = 0
    for block, text, _ in blocks:
        if not hard[block]:
            block.held += len(text)
            total += len(text)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.held += node.held
    cut = {}
    for node in nodes:
        own = node.mark and not (node.soft and 2 * node.held >= total)
        cut[node] = own or (node.parent is not None and cut[node.parent])
    return [b for b in blocks if not cut[b[0]]]


def smooth(values: np.ndarray) -> np.ndarray:
    padded = np.pad(values, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def content_paths(blocks: list[tuple[Node, str, int]], spread: float = SPREAD) -> np.ndarray:
    """Which blocks lie on a content path."""
    index: dict[int, int] = {}
    path = np.array([index.setdefault(b[0].path, len(index)) for b in blocks])
    count = np.bincount(path)
    free = np.array([max(len(t) - linked, 0) for _, t, linked in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) if linked * 2 < len(t) else 0 for _, t, linked in blocks], float)
    ratio = (np.bincount(path, free) / count)[path]
    punct = (np.bincount(path, marks) / count)[path]
    fused = smooth(ratio) * smooth(punct)
    score = np.bincount(path, fused) / count
    rooted = np.array([b[0].root for b in blocks])
    sizes = np.array([len(b[1]) for b in blocks])
    if 2 * sizes[rooted].sum() >= sizes.sum():
        score = np.where(np.bincount(path, rooted) > 0, score, score / 2)
    told = punct > 0 if punct.any() else np.ones(len(path), bool)  # no sentence on a whole path: no content
    return (score >= spread * fused.std())[path] & told


def main_text(page: str | None, spread: float = SPREAD) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    linked = [2 * links >= len(t) for _, t, links in blocks]
    keep = [bool(ok) and not l for ok, l in zip(content_paths(blocks, spread), linked)]
    along = [not l and not k and len(t) <= SHORT and b.tag in ALONG for (b, t, _), l, k in zip(blocks, linked, keep)]
    # runs of short blocks of their own kind stand before or after what they belong to
    for order, heads in ((range(len(blocks)), False), (range(len(blocks) - 1, -1, -1), True)):
        near = None
        for i in order:
            if keep[i]:
                near = blocks[i][0]
            elif near is not None and along[i] and (not heads or blocks[i][0].tag[0] == "h") and beside(near, blocks[i][0]):
                keep[i] = True
            else:
                near = None
    return "\n".join(t for (_, t, _), k in zip(blocks, keep) if k)


def beside(content: Node, other: Node, up: int = 4) -> bool:
    """Whether the element around a content block is around the other block, too (``up`` elements above it at most)."""
    home = content.parent.block if content.parent is not None else content
    for _ in range(up):
        if other.parent is None:
            return other is home
        other = other.parent.block
        if other is home:
            return True
    return False


def extract(pages: DataFrame, spread: float = SPREAD) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    types = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x, spread) for x in batch.column("text").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": texts, "n_chars": [len(t) for t in texts]}

    return map_slices(pages.select("page_id", "url", F.col("html").alias("text")), run, types)
