"""Main-text extraction by tag-path ratios.

A page is read as a run of text nodes, each with its root-to-leaf tag path (names and
classes). Nodes of the same path are taken together: their characters and their
punctuation marks, both per node. Both ratios are smoothed along the page with a Gaussian,
fused by a product of logarithms, and each path gets the mean of its nodes, times a weight:
menus, footers, sidebars, forms and page headers, told by their element, weigh nothing;
article and main weigh more; an element whose class, id or role has more words of page
furniture than of articles weighs less. A form, a header or such a class that holds all the
prose of a page is its wrapper, and lowers nothing. Paths at or above a share of the standard deviation
(and of the best path) are content.

The text is made of the content paths' nodes. The smallest element with nearly all of them
is the article's home; shorter lines inside it (of the whole home, if that is a part of the
page, else between the first and the last content node) belong to the text as well, unless
something below the home lowers their path's weight.

Character references are decoded; white space inside a block (line breaks too) becomes one
space; blocks are trimmed and joined in page order by a newline. A null or empty page, or
one without text, gives an empty string. Unclosed tags close as HTML's own rules have it
(a paragraph ends at the next block); a tag without its end stops at the next one; scripts and
styles that never end hide the rest of the page, other elements without text don't. Time
grows with the page's length, however its tags are nested or broken. Pages don't depend on
each other, so repeated rows get equal results. A column main_text gives way to the result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coverscope.llm.shared import schema_of

ATTRS = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|(?=<)|\Z)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>?"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>{ATTRS})",
    re.S | re.I,
)
#: Elements whose content is no text of the page, and the end of each.
RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template textarea svg iframe object select title".split()}
#: Of these, the ones that last to the end of the page if they are never closed; of a title that is not, the text up to the next tag goes; of the others only the tag.
CODE = ("script", "style")
HINT = re.compile(r"(?<!\S)(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SHUTS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that by HTML's own meaning hold no article.
NEVER = frozenset("nav footer aside form button menu dialog".split())
#: Of what lowers a path, the elements that can wrap a whole page.
WRAPS = frozenset(("form", "header"))
#: Blocks that are a part of an article, not its home.
PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr tbody pre dd dt caption figcaption".split())
WHOLE = frozenset(("", "html", "body"))
#: Words of a class, id or role that speak against an article, and for one.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices alert disclaimer comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination pager copyright".split()
)
FOR = frozenset("article body content contents entry main page post story text".split())
HINTED, CONTAINER = 0.05, 4.0
MARKS = ".,;:!?"
#: Characters of a block (with a mark) that read like prose; prose that a page has at least where it has an article; how many times more of it than there is other text a lowered element must have to be taken for the article.
PROSE, ENOUGH, MORE = 40, 100, 4


class Node:
    """An element: path is a number, equal for equal paths; own is its factor and weight that of its path; low is the nearest element that lowers it, itself included, barred whether one of those can be no article's home."""

    __slots__ = ("tag", "path", "own", "wraps", "weight", "low", "barred", "parent", "depth", "block", "inner", "chars", "inside")

    def __init__(self, tag: str, path: int, own: float, wraps: bool, parent: Node | None, inner: bool):
        self.tag, self.path, self.own, self.wraps, self.parent, self.inner = tag, path, own, wraps, parent, inner
        self.weight, self.low, self.barred = 1.0, None, False
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.chars, self.inside = 0, False


def hint(attrs: str) -> int:
    """Words for an article less words against one."""
    words = [w for m in HINT.finditer(attrs) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower())]
    return sum(w in FOR for w in words) - sum(w in AGAINST for w in words)


def own_weight(tag: str, attrs: str, inner: bool) -> tuple[float, bool]:
    """What an element multiplies the weight of paths through it by, and whether it may be a mere wrapper of the article; inner: it is inside an article or main element."""
    if tag in NEVER or tag == "header" and not inner:
        return 0.0, tag in WRAPS
    low = HINTED if attrs and tag not in ("html", "body", "main") and hint(attrs) < 0 else 1.0
    return low * (CONTAINER if tag in ("article", "main") and not inner else 1.0), low < 1


def weigh(every: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Gives each element the weight of its path.

    A form, a page header or a class word lowers what it holds only beside something else that reads like an article: on a
    page with hardly any prose elsewhere, the lowered element with the most of it is taken for a wrapper and lowers nothing."""

    def settle(free: set[Node]) -> None:
        for node in every[1:]:
            up, lowers = node.parent, node.own < 1 and node not in free
            node.weight = up.weight * (1.0 if node in free else node.own)
            node.low = node if lowers else up.low
            node.barred = up.barred or lowers and not node.wraps

    settle(set())
    size: Counter = Counter()
    marked = set()
    for _, t, block in found:
        size[block] += len(t.strip())
        if any(c in t for c in MARKS):
            marked.add(block)
    prose = [(n, len(t.strip())) for n, t, block in found if size[block] >= PROSE and block in marked]
    plain, lowered = sum(k for n, k in prose if n.low is None), Counter()
    text = sum(len(t.strip()) for n, t, _ in found if n.low is None)
    for n, k in prose:
        if n.low is not None and not n.barred:
            lowered[n.low] += k
    if plain < ENOUGH and lowered:
        best, most = max(lowered.items(), key=lambda x: x[1])
        if MORE * text < most:
            free, node = set(), best
            while node is not None:
                free.add(node)
                node = node.parent.low
            settle(free)


def nodes(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements, parents first, and the text nodes: element, decoded text, number of the block."""
    top = Node("", 0, 1.0, False, None, False)
    every, found, paths, open_ = [top], [], {}, Counter()
    at, block, last = top, 0, 0

    def text(end: int) -> None:
        if end > last and not page[last:end].isspace():
            t = page[last:end]
            found.append((at, html.unescape(t) if "&" in t else t, block))
        elif end > last and found and found[-1][2] == block:
            found.append((at, " ", block))

    def leave(node: Node) -> Node:
        """Closes all elements from the present one up to node; its parent."""
        up = at
        while up is not node.parent:
            open_[up.tag] -= 1
            up = up.parent
        return up

    never_closed: set[str] = set()
    start = 0
    while m := TOKEN.search(page, start):
        text(m.start())
        start = last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag == "head":  # what is in a head is told by its own elements, wherever the head ends
            continue
        if tag in RAW:
            if not m["end"]:
                shut = None if tag in never_closed else RAW[tag].search(page, last)
                if shut:
                    start = last = shut.end()
                else:
                    never_closed.add(tag)
                    if tag in CODE:
                        start = last = len(page)
                    elif tag == "title":
                        start = last = (page.find("<", last) + 1 or len(page) + 1) - 1
            continue
        if tag in BLOCK:
            block += 1
        if m["end"]:
            if open_[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up)
            continue
        if tag == "br":
            if found and found[-1][2] == block:
                found.append((at, " ", block))
            continue
        if tag in VOID:
            continue
        shut = SHUTS.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        up = at.block if tag != "option" else at
        while up is not top and any(open_[t] for t in shut):  # an open paragraph or item ends here, unless a container stands between
            if up.tag in shut:
                at = leave(up)
                break
            if up.tag in BLOCK and up.tag != "p" or tag == "option":
                break
            up = up.parent.block
        attrs = m["attrs"]
        classes = next((x[2] or x[3] or x[4] or "" for x in HINT.finditer(attrs) if x[1].lower() == "class"), "") if "lass" in attrs.lower() else ""
        path = paths.setdefault((at.path, tag, re.sub(r"[0-9]+", "", classes)), len(paths) + 1)
        at = Node(tag, path, *own_weight(tag, attrs, at.inner), at, at.inner or tag in ("article", "main"))
        every.append(at)
        open_[tag] += 1
    text(len(page))
    weigh(every, found)
    return every, found


def path_scores(path: np.ndarray, chars: np.ndarray, marks: np.ndarray, width: float) -> np.ndarray:
    """For each text node its path's mean of the smoothed and fused ratios. Nodes without a character don't count in the ratios."""
    real = np.bincount(path, chars > 0)
    kernel = np.exp(-(np.arange(-np.ceil(2 * width), np.ceil(2 * width) + 1) ** 2) / (2 * width**2))
    around = lambda x: np.convolve(x, kernel)[len(kernel) // 2 :][: len(x)]
    ratios = [(np.bincount(path, x) / np.maximum(real, 1))[path] for x in (chars, marks)]
    smooth = [around(r) / around(np.ones(len(path))) for r in ratios]
    fused = np.log1p(smooth[0]) * np.log(2 + smooth[1])
    return (np.bincount(path, fused) / np.maximum(np.bincount(path), 1))[path]


def selected(found: list[tuple[Node, str, int]], width: float, cut: float, least: float) -> np.ndarray:
    """Which of the text nodes stand on a content path."""
    chars = np.array([len(t.strip()) for _, t, _ in found], float)
    marks = np.array([sum(map(t.count, MARKS)) for _, t, _ in found], float)
    _, path = np.unique([n.path for n, _, _ in found], return_inverse=True)
    score = path_scores(path, chars, marks, width) * np.array([n.weight for n, _, _ in found])
    return (score > 0) & (score >= max(cut * score.std(), least * score.max()))


def main_text(page: str | None, width: float = 1.0, cut: float = 0.8, least: float = 0.1) -> str:
    every, found = nodes(page or "")
    if not any(t.strip() for _, t, _ in found):
        return ""
    good = selected(found, width, cut, least)
    if not good.any():
        return ""
    for (node, t, _), own in zip(found, good, strict=True):
        node.chars += len(t) if own else 0
    for node in reversed(every[1:]):
        node.parent.chars += node.chars
    home = max((n for n in every if n.chars >= 0.9 * every[0].chars and n.tag not in PARTS and (n.tag in BLOCK or n is every[0])), key=lambda n: n.depth)
    for node in every:
        node.inside = node is home or node.parent is not None and node.parent.inside
    first, last = (0, len(found)) if home.tag not in WHOLE else (int(good.argmax()), len(good) - 1 - int(good[::-1].argmax()))
    while first > 0 and home.tag in WHOLE and re.fullmatch("h[1-6]", found[first - 1][0].block.tag):
        first -= 1  # a heading belongs to the text under it
    blocks: dict[int, list[str]] = {}
    for i, (node, t, block) in enumerate(found):
        if good[i] or node.inside and node.weight >= home.weight and first <= i <= last:
            blocks.setdefault(block, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with main_text in place of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x) for x in b[page].to_pylist()], pa.string())
            rest = [n for n in b.schema.names if n != page]
            yield pa.RecordBatch.from_arrays([*[b[n] for n in rest], texts], [*rest, "main_text"])

    kept = pages.drop("main_text")
    rest = schema_of(kept.drop(page))
    return kept.mapInArrow(run, f"{rest}, main_text string" if rest else "main_text string")
