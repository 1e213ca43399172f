"""Main text of web pages: flat text blocks classified by a decision tree.

The markup is read once, forgivingly and in linear time.  Text between block-level tags
is a block.  A decision tree grown by Gini impurity on a small labelled table (part of
this module; nothing is fitted to the pages at hand) decides which blocks are main text.
It sees the words and the link density of the block and of its neighbours, whether it is
a heading, and where it stands: in an ``article`` or ``main`` element, how much of the
page's text such elements hold, and the share of the page's text in the smallest box
around it that may be furniture (an element such as ``nav`` or ``aside``, or one whose
class, id or role names one).  A box with nearly all of the text is a wrapper, whatever
its name.  A ``header`` within an article is a part of it and stays, byline included.
"""

from __future__ import annotations

import math
import re
from functools import cache as once
from html import unescape
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|(?P<cdata><!\[CDATA\[)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)(?:>|(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Elements by their part in a page.
_RAW = frozenset("script style noscript template textarea svg math iframe object canvas select audio video title".split())
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form button menu dialog fieldset head".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name page furniture.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus dialog discussion "
    "footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup site-header social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets "
    "alert complementary toc tags skip".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Share of a page's text from which on a box around an article is no furniture.
WRAPPER = 0.3
#: Where the search for an open element of a kind ends.
_LIMITS = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}


class Block:
    __slots__ = ("text", "words", "linked", "main", "boxes", "around", "heading")

    def __init__(self, text: str, linked: int, main: bool, boxes: tuple[int, ...], around: tuple[int, ...], heading: bool):
        """``boxes``: numbers of the boxes that hold the block; ``around``: those that hold its whole article."""
        self.text, self.linked, self.main, self.boxes, self.around, self.heading = text, linked, main, boxes, around, heading
        self.words = len(text.split())

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0


def _kind(name: str, rest: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """(main, box, hidden) that an opening tag begins."""
    main, box, hidden = name in ("article", "main"), name in _FURNITURE or (name == "header" and not inside_main), False
    if rest and "=" in rest or " hidden" in rest:
        for m in _ATTR.finditer(rest):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
            elif key in ("class", "id", "role") and not box and name not in ("article", "main", "body", "html"):
                box = not _HINTS.isdisjoint(w.lower() for part in value.split() for w in (part, *_SPLIT.split(part)))
    return main, box, hidden


class _Open:
    """The open elements: name, main, box, hidden of each, with the places of every name, so that no search walks over them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places of block elements other than p
        self.boxes: list[int] = []
        self.main = self.hidden = self.links = self.headings = self.n_boxes = self.outer = 0

    def push(self, name: str, main: bool, box: bool, hidden: bool) -> None:
        place = len(self.stack)
        if main and not self.main:
            self.outer = len(self.boxes)
        self.places.setdefault(name, []).append(place)
        if name in _BLOCK and name != "p":
            self.walls.append(place)
        if box:
            self.n_boxes += 1
            self.boxes.append(self.n_boxes)
        self.stack.append((name, main, box, hidden))
        self._count(name, main, hidden, 1)

    def _count(self, name: str, main: bool, hidden: bool, by: int) -> None:
        self.main += by * main
        self.hidden += by * hidden
        self.links += by * (name == "a")
        self.headings += by * (name in _HEADING)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            name, main, box, hidden = self.stack.pop()
            self.places[name].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()
            if box:
                self.boxes.pop()
            self._count(name, main, hidden, -1)

    def held(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        outer = self.outer if self.main else 0
        return tuple(self.boxes[outer:]), tuple(self.boxes[:outer])

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, name: str) -> None:
        place = self.last(name)
        # an inline element is not closed across a block that began in it
        if place >= 0 and (name in _BLOCK or not self.walls or self.walls[-1] < place):
            self.cut(place)

    def close_sibling(self, name: str) -> None:
        """End an element of this kind that is still open, up to the element that such elements stand in."""
        place = self.last(*(_HEADING if name in _HEADING else (name,)))
        limits = _LIMITS.get(name)
        if place < 0 or (limits and self.last(*limits) > place):
            return
        walls = self.walls
        above = walls[-2] if len(walls) > 1 and walls[-1] == place else walls[-1] if walls else -1
        if limits or above < place:
            self.cut(place)


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked: list[str] = []

    def end() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not open_.hidden:
                n = len(unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(text, n, open_.main > 0, *open_.held(), open_.headings > 0))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if open_.links:
                linked.append(text)

    at, n, cdata_end = 0, len(html), -2
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            tail = html[at:]
            cut = re.search(r"<[/!?a-zA-Z][^<]*\Z", tail)  # a tag that the page's end cuts off
            add(tail[: cut.start()] if cut else tail)
            break
        add(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            if cdata_end != -1 and cdata_end < at:
                cdata_end = html.find("]]>", at)
            stop = cdata_end if cdata_end >= 0 else n
            add(html[at:stop].replace("&", "&amp;"))
            at = stop + 3
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _RAW and not m["close"]:
            if not m["rest"].rstrip().endswith("/"):
                close = _raw_end(name).search(html, at)
                at = close.end() if close else n
            if name in ("title", "iframe", "textarea", "select", "svg", "video", "audio", "canvas", "object"):
                end()
            continue
        if name in _BLOCK:
            end()
        if m["close"]:
            open_.close(name)
        elif name not in _VOID:
            if name in ("p", "option", "a") or name in _HEADING or name in _LIMITS:
                open_.close_sibling(name)
            if name == "body":
                open_.cut(0)
            if not m["rest"].endswith("/") or name in _BLOCK or name == "a":
                open_.push(name, *_kind(name, m["rest"], open_.main > 0))
    end()
    return out


@once
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)


#: What the tree sees of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "main", "main_share", "box_share")

# Labelled blocks of typical pages, in page order.  + is main text, - is not; then the words, after a
# slash the link density, h for a heading, m within article or main, b and the box's share of the page's text.
_PAGES = """
-1/1b.02 -1/1b.02 -1/1b.02 -2/1b.02 -1/1b.02 -9b.04 +10hm +70m +40m +22m +5m +90m -12b.05
-1/1 -2/1 -1/1 -3/1 -1/1 -8 +11h +70 +40 +14 +60 +35 -14
-1/1 -1/1 -1/1 -1/1 -12 +9h +18 +80 +9 +55 +120 -11
-1/1b.02 -1/1b.02 -3/1b.02 -20 +9hm +60m +30m +22m -12b.05
-1/1b.02 -2/1b.02 -13 +9hm +40m +5m +22m -12
-1/1b.02 -2/1b.02 -6 +9hm +14m +12m +8m -9
-1/1 -7 +12hm +16m -25
-1/1 -30 +12hm +16m +60m -14
+9hm +40m +70m
+9hm +40m +12m
+9hm +40m +3m
+9hm +60m +14m -9
+9hm +60m +30m -9
+9hm +20m +8m -30
+9hm +60m +25m +4m -9
+9hm +60m +90m +5m -9b.05
+9hm +30m +55m -20
-1/1b.03 -1/1b.03 -10 +9hm +9m +6m +20m +2m +53m +51m +1m +17m -12b.05
-1/1b.03 -1/1b.03 -13 +5hm +5m +104m +24m +41m +3m +12m -14b.04
-1/1b.03 -6 +7hm +7m +25m +25m +3m +106m +41m -10b.04
-2/1 -1/1 -1/1 -5 +12h +13 +60 +25 -16
-1/1 -1/1 -1/1 -7 +10h +13 +7 +14 +16 -9
-1/1 -1/1 -6 +10h +8 +60 +40 +3 +50 +6 +4 +70 -13
+8h +30 +45 +120 +33 +9h +50 +40 -2/1 -2/1 -2/1 -3/1
+6hm +3m +2m +4m +1m +12m +2m -10b.1
+9hm +4m +60m +1m +1m +2m +80m +30m -20 -3/1 -30
-18b.05 -2/1b.05 -1/1b.02 -1/1b.02 +12h +90 +30 +50 +25 -10/.5b.02
-25b.06 -1/1b.06 +12h +90 +30 +80 +25
+9hm +80m +60m -4hb.1 -6/1b.1 -7/1b.1 -20b.1 -15b.1
+9h +80 +60 +70 -4hb.1 -6/1b.1 -7/1b.1 -30b.1 -15/.4b.1
+9hm +80m +60m -2hb.3 -3b.3 -25b.3 -3b.3 -40b.3 -2b.3 -70b.3
+9h +80 +60 -2hb.5 -3b.5 -25b.5 -3b.5 -40b.5 -2b.5 -60b.5
+9hm +80m +60m -2h -3 -25 -3 -40 -60
+70 +50 +90 -1b.02 -1b.02 -2b.02 -1/1b.02
+9hb.97 +60b.97 +80b.97 +12b.97 +33b.97 +5b.97 +41b.97
+80b1
+20b1 +6b1
+40mb.99 +9mb.99 +60mb.99
+50m +6/.9m +7/1m +40m +12/.5m +30m
+9hm +40m -3mb.03 +50m -6/1mb.03 +30m -12mb.05 +30m -30mb.1
+5
+3
+1
+16
+8 +20
+60 +40 -3h -8/1 -9/1 -7/1 -6/1
+20 +8 +6 +15 +30 +4 +25
+40 +30 +60 -4 -9/.6 -12/.4 -3/1
+25/.3 +40/.1 +18/.2 +60 +50/.05
-20/.8 -15/.9 +60 +30 -18/.9
-1/1 -1/1 +60 -1/1 +70 +45 -2/1 -1/1
-2 -1/1 -2/1 -3 -1/1 -4/1
+30m +1m +2m +1m +3m +2m +25m +3m +2m +2m
"""
#: Lengths of the texts of a labelled page, over the given ones.
SCALES = (0.5, 0.75, 1, 1.5, 2.5)


def labelled() -> list[tuple]:
    """The labelled table: FEATURES and label, the neighbours being those on the page; each page with shorter and longer texts too."""
    rows = []
    for line, scale in product(_PAGES.split("\n")[1:-1], SCALES):
        page = [re.fullmatch(r"([+-])(\d+)(?:/([\d.]+))?(h?)(m?)(?:b([\d.]+))?", x).groups() for x in line.split()]
        look = [(math.ceil(int(w) * (scale if int(w) > 8 else 1)), float(d or 0)) for _, w, d, _, _, _ in page]
        main = sum(x[0] for x, p in zip(look, page) if p[4]) / sum(x[0] for x in look)
        for k, (label, _, _, h, m, b) in enumerate(page):
            before, after = look[k - 1] if k else (0, 0.0), look[k + 1] if k + 1 < len(page) else (0, 0.0)
            rows.append((*look[k], *before, *after, bool(h), bool(m), main, float(b or 1), int(label == "+")))
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 3):
    """A decision tree by Gini impurity: (feature, threshold, below or at, above), or a label at a leaf of ``least`` rows or more."""
    ones = int(y.sum())
    best = None
    if depth and ones not in (0, len(y)):
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, found = x[order, f], np.cumsum(y[order])[:-1]
            k = np.arange(1, len(y))
            p, q = found / k, (ones - found) / (len(y) - k)
            cost = 2 * (k * p * (1 - p) + (len(y) - k) * q * (1 - q))
            cost[(v[1:] == v[:-1]) | (k < least) | (len(y) - k < least)] = np.inf
            at = int(np.argmin(cost))
            if cost[at] < np.inf and (best is None or cost[at] < best[0] - 1e-9):
                best = (cost[at], f, float((v[at] + v[at + 1]) / 2))
    if best is None:
        return int(2 * ones >= len(y))
    _, f, cut = best
    left = x[:, f] <= cut
    return f, cut, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@once
def tree():
    table = np.array(labelled(), float)
    return grow(table[:, :-1], table[:, -1])


def _keeps(node, x: tuple) -> bool:
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return bool(node)


def features(found: list[Block]) -> list[tuple]:
    """FEATURES of the blocks of a page."""
    total = sum(b.words for b in found) or 1
    main = sum(b.words for b in found if b.main) / total
    held: dict[int, int] = {}
    for b in found:
        for box in (*b.boxes, *b.around):
            held[box] = held.get(box, 0) + b.words
    look = [(0, 0.0), *((b.words, b.density) for b in found), (0, 0.0)]

    def share(b: Block) -> float:
        # a box around an article is a wrapper unless it holds little: a teaser in a sidebar
        boxes = [*b.boxes, *(x for x in b.around if held[x] < WRAPPER * total)]
        return min((held[x] / total for x in boxes), default=1.0)

    return [(*look[k + 1], *look[k], *look[k + 2], b.heading, b.main, main, share(b)) for k, b in enumerate(found)]


def main_text(html: str | None, classifier=None) -> str:
    """Main text of a page, blocks joined by one space; empty if it has none."""
    found, classifier = blocks(html or ""), classifier or tree()
    return " ".join(b.text for b, x in zip(found, features(found)) if _keeps(classifier, x))


def _extract(classifier):
    def run(it):
        import pyarrow as pa

        for batch in it:
            ids, urls, pages = batches(batch, ["page_id", "url", "html"])
            for i in range(0, len(ids), 500):
                texts = [main_text(p, classifier) for p in pages.slice(i, 500).to_pylist()]
                yield pa.record_batch([ids.slice(i, 500), urls.slice(i, 500), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text.  Blocks that the tree takes for main text stay
    whole, however long; scripts, styles, markup and hidden elements are no blocks.  Repeated rows are treated alike; other columns
    are not read.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(_extract(tree()), "page_id long, url string, text string, n_chars long")
