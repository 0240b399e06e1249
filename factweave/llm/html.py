"""Main text of web pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lots, table

# Elements of the HTML standard by what they mean for blocks of text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style title textarea iframe noembed noframes xmp template svg canvas audio video".split())
APART = frozenset("aside button dialog footer menu nav noscript search select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES_APART = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: What an open element of a name is closed by, and where the search for it ends.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
          "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
# Words in class and id names that pages use for parts beside the text, and for the text.
BESIDE = frozenset("""ad ads adsense advert advertisement adverts alert anuncio anzeige banner breadcrumb breadcrumbs byline comment commentaire commentaires
commentarea commentlist comments comentario comentarios consent cookie cookies copyright cta disclaimer discussion disqus dialog feedback flash footer form gdpr
kommentar kommentare legal login menu message meta modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination paywall popup
promo promotion publicidad publicite recommended related replies reply respond responses search share sharing shoutbox sidebar sidenav signup skip social sponsor
sponsored subscribe subscription tagcloud tags talkback toolbar tooltip warning werbung widget""".split())
HEADER = frozenset("header masthead topbar pagehead".split())
TEXT = frozenset("article articlebody body content entry main post story text".split())
PLAIN = ("has", "no", "not", "with", "without", "is")

_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|svg(?=[\s/])" + _ATTRS + r"(?<=/)>|(" + "|".join(sorted(DROPPED)) + r")(?=[\s/>])" + _ATTRS + r"(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|[!?][^>]*+(?:>|\Z)|(/?)([a-z][^\s/>]*+)(" + _ATTRS + r")(?:>|\Z)|/[^>]*+(?:>|\Z))", re.S | re.I)
_NAMED = re.compile(r"class|\bid\b|role|hidden|display|itemprop", re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")


@lru_cache(maxsize=4_096)
def named(attrs: str, anchors: bool = False) -> tuple[bool, bool, bool]:
    """(beside, header, text): what an element's class, id and role say of it. The
    ids of headings are ``anchors`` and say nothing."""
    beside = header = text = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "class" or name == "id" and not anchors:
            for word in value.split():
                parts = re.findall(r"[a-zß-ÿ]+", word)
                if not parts or parts[0] in PLAIN:
                    continue
                if any(p in BESIDE for p in parts):
                    beside = True
                elif any(p in HEADER for p in parts):
                    header = True
                elif any(p in TEXT for p in parts):
                    text = True
        elif name == "role":
            beside, text = beside or value in ROLES_APART, text or value in ("main", "article")
        elif name == "itemprop":
            text = text or value == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            beside = True
    return beside, header, text


@dataclass
class Block:
    """Text between two block boundaries, and where it stands."""

    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    text_part: bool
    apart: bool
    beside: bool
    header: bool
    form: bool


@dataclass
class _Open:
    """An open element; flags are those of all open elements up to it."""

    name: str
    text_part: bool = False
    apart: bool = False
    beside: bool = False
    header: bool = False
    heading: bool = False
    item: bool = False
    link: bool = False
    form: bool = False


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    names: Counter = field(default_factory=Counter)

    def close(self, names: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """Close up to the innermost open element of one of ``names``, unless one of
        ``until`` is open within it."""
        for n in names:
            if self.names[n]:
                break
        else:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                for o in self.stack[k:]:
                    self.names[o.name] -= 1
                del self.stack[k:]
                return
            if self.stack[k].name in until:
                return

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            if self.names["p"]:
                self.close(("p",), ("button",))
            if name in CLOSES:
                self.close(*CLOSES[name])
        beside, header, text = named(attrs, name in HEADINGS) if attrs and name not in ("html", "body") and _NAMED.search(attrs) else (False, False, False)
        if name not in BLOCK and name != "a" and not (beside or header or self.names[name]):
            return
        up = self.stack[-1]
        here = _Open(name, up.text_part or text or name in ("article", "main"), up.apart or name in APART, up.beside or beside, up.header or header or name == "header",
                     up.heading or name in HEADINGS, up.item or name in ("li", "td", "th", "dt", "dd"), up.link or name == "a", up.form or name == "form")
        if name == "main":
            here.beside = beside  # a page's one main part, whatever its wrappers are called
        self.stack.append(here)
        self.names[name] += 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. A block element's start or end and two line
    breaks together end a block; other elements and single breaks don't. Scripts,
    styles, titles and comments, closed or not, are no text; elements left open end
    with those around them; character references are decoded."""
    out, parts, linked, breaks, at = [], [], 0, 0, _Page()

    def flush(o: _Open) -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), o.heading, o.item, o.text_part, o.apart, o.beside, o.header, o.form))
        parts, linked = [], 0

    def add(s: str) -> None:
        nonlocal linked, breaks
        if "&" in s:
            s = "&".join(html.unescape(x) if "&" in x else x for x in s.split("&amp;"))
        if breaks and not s.isspace():
            breaks = 0
        if at.stack[-1].link:
            linked += len(s.split())
        parts.append(s)

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            add(page[end : m.start()])
        end = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush(at.stack[-1])
            continue
        if name in BLOCK:
            if parts:
                flush(at.stack[-1])
            breaks = 0
        if m[2]:
            at.close((name,))
        elif name not in VOID:
            if name == "a":
                at.close(("a",), ())
            at.open(name, m[4])
    if end < len(page):
        add(page[end:])
    flush(at.stack[-1])
    # a form around most of what isn't beside the text anyway is the page's frame
    plain = [b for b in out if not (b.apart or b.beside)]
    framed = 2 * sum(b.words for b in plain if b.form) > sum(b.words for b in plain)
    for b in out:
        b.apart |= b.form and not framed
    return out


#: Columns of the labelled table: of the block itself, then of the blocks around it.
FEATURES = ("words", "links", "heading", "item", "ended", "text_part", "apart", "beside", "header", "words_before", "links_before", "words_after", "links_after")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block of a page; at its ends there are no words around."""
    own = np.array([[b.words, b.linked / b.words, b.heading, b.item, b.text[-1:] in ".!?:;…\"”»)", b.text_part, b.apart, b.beside, b.header] for b in found], np.float64).reshape(len(found), 9)
    around = np.zeros((len(found), 4))
    around[1:, :2], around[:-1, 2:] = own[:-1, :2], own[1:, :2]
    return np.hstack([own, around])


@dataclass
class Tree:
    """A binary decision tree by Gini impurity: node -> feature (-1 at a leaf),
    threshold, children, share of label 1."""

    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 12) -> Tree:
        nodes: list[list] = []

        def grow(rows: np.ndarray, left: int) -> int:
            at, p = len(nodes), float(y[rows].mean()) if len(rows) else 0.5
            nodes.append([-1, 0.0, at, at, p])
            best = (1e-9, -1, 0.0)
            if left and 0 < p < 1 and len(rows) > 1:
                for f in range(x.shape[1]):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    n = np.arange(1, len(order))
                    a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                    gain = p * (1 - p) - (n * a * (1 - a) + (len(order) - n) * b * (1 - b)) / len(order)
                    gain[(v[1:] == v[:-1]) | (n < least) | (len(order) - n < least)] = 0
                    i = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[i] > best[0] + 1e-12:
                        best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[at][0], nodes[at][1] = best[1], best[2]
                nodes[at][2], nodes[at][3] = grow(rows[go], left - 1), grow(rows[~go], left - 1)
            return at

        grow(np.arange(len(y)), depth)
        f, limit, a, b, p = map(np.array, zip(*nodes, strict=True))
        return cls(f.astype(int), limit.astype(float), np.column_stack([a, b]).astype(int), p.astype(float))

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = self.feature[at]
            if not len(x) or (f < 0).all():
                return self.share[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.limit[at]
            at = np.where(f < 0, at, self.child[at, right.astype(int)])


# The labelled pages, written by hand: {a-b} stands for a to b words, a full stop behind
# them if it is {a-b.}; blocks that hold a "+" are main text. Each is filled VARIANTS times.
_NAV = "<nav><ul><li><a>{1-2}</a><li><a>{1-2}</a><li><a>{1-3}</a><li><a>{1-2}</a></ul></nav>"
_SOUP = "<div><a>{1-2}</a> | <a>{1-3}</a> | <a>{1-2}</a></div>"
_FOOT = "<footer>&copy; {1-4} &middot; {3-12.}</footer>"
_ENDS = "<footer><p>{4-14.}</p><ul><li><a>{1-3}</a><li><a>{1-3}</a></ul></footer>"
_TEXT = "<h1>+{1-40}</h1><p>+{20-90.}</p><p>+{1-12.}</p><p>+{30-150.}</p><h2>+{1-6}</h2><p>+{8-60.}</p><ul><li>+{1-9}</li><li>+{2-20.}</li></ul><blockquote>+{8-40.}</blockquote><p>+{5-70.}</p>"
_LINKS = "<p>+{3-9} <a>{1-4}</a> {3-40.}</p><p>+<a>{2-6}</a></p><p>+{1-3}</p><table><tr><th>+{1-2}</th><td>+{1-4}</td></tr></table><pre>+{2-30}</pre><figure><figcaption>+{2-14.}</figcaption></figure>"
_NOTES = "<div class='comments'><h3>{1-3}</h3><article><p>{1-60.}</p></article><div><p>{2-80.}</p></div><form><label>{1-3}</label><button>{1-2}</button></form></div>"
LABELLED = (
    f"{_NAV}<div class=ad>{{1-14.}}</div><article>{_TEXT}</article>{_FOOT}",
    f"<header><a>{{1-3}}</a><p>{{2-8}}</p></header>{_NAV}<main><article><header><h1>+{{3-14}}</h1><p>+{{15-40.}}</p></header>{_LINKS}{_TEXT}</article><aside><h3>{{1-3}}</h3><p>{{10-60.}}</p><ul><li><a>{{2-9}}</a></ul></aside></main>{_ENDS}",
    f"{_NAV}<aside><h2>{{1-3}}</h2><p>{{6-90.}}</p></aside><article>{_LINKS}<div class='ad'><p>{{2-30.}}</p></div><p>+{{4-40.}}</p><aside><p>{{5-40.}}</p></aside><p>+{{1-30.}}</p></article>{_NOTES}{_ENDS}",
    f"<div class='notice'><p>{{5-40.}}</p><button>{{1-2}}</button></div><div class=header><a>{{1-3}}</a></div><div class=content>{_TEXT}</div><div class=sidebar><p>{{6-60.}}</p><ul><li><a>{{2-8}}</a></ul></div><div class=footer>{{4-14}}</div>",
    f"<div id=menu><a>{{1-2}}</a> <a>{{1-2}}</a></div><div class=post><h2>+{{2-12}}</h2><p>+{{1-10.}}</p>{_LINKS}<div class=share><a>{{1-2}}</a> <a>{{1}}</a></div></div><section id=comments><h2>{{1-3}}</h2><ol><li><p>{{3-80.}}</p><li><p>{{1-50.}}</p></ol></section>",
    f"<form><input><label>{{1-4}}</label><p>{{4-40.}}</p></form><section><h1>+{{1-12}}</h1><p>+{{25-90.}}</p><p>+{{12-60.}}</p><p>+{{4-9.}}</p><p>+{{25-70.}}</p></section><div>{_SOUP}</div>",
    f"{_SOUP}<h1>+{{1-12}}</h1><p>+{{18-80.}}</p><p>+{{16-90.}}</p><p>+{{6-12.}}</p><p>+{{30-90.}}</p><p>{{2-8}}</p><p><a>{{1-3}}</a> <a>{{1-3}}</a></p><p>{{2-7}}</p>",
    f"<table><tr><td>{_SOUP}</td><td><p>+{{30-120.}}</p><p>+{{22-80.}}</p><p>+{{22-60.}} <a>{{1-4}}</a> {{4-20.}}</p></td></tr></table><div>{{2-9}}</div><div><a>{{2-5}}</a></div>",
    f"{_NAV}<ul><li><a>{{4-14}}</a></li><li><a>{{4-16}}</a></li></ul><article><p>+{{1-8.}}</p><p>+{{1-5}}</p><p>+{{1-15.}}</p></article><div><p>{{2-6}}</p></div>{_FOOT}",
    f"{_NAV}<article><section class=meta><p>{{2-8}}</p></section><p>+{{12-80.}}</p><p>+{{1-4.}}</p><nav><a>{{1-4}}</a></nav><footer><p>{{3-30.}}</p></footer><form><p>{{3-30.}}</p></form></article><dialog><p>{{4-40.}}</p></dialog>{_ENDS}",
    f"<div role=banner><p>{{2-20.}}</p></div><div role=main><p>+{{1-80.}}</p><h3>+{{1-8}}</h3><dl><dt>+{{1-4}}<dd>+{{2-30.}}</dl></div><div role=complementary><p>{{5-60.}}</p></div><div role=contentinfo>{{3-20}}</div>",
    f"<div><p><a>{{2-7}}</a></p><p>{{1-6}}</p></div><div class=article><div class='article-header'><h1>+{{2-12}}</h1><p>{{2-5}}</p></div>{_TEXT}</div><div><h4>{{1-3}}</h4><p><a>{{5-14}}</a></p><p><a>{{5-14}}</a></p></div>",
    f"<div><ul><li><a>{{1-2}}</a></li><li><a>{{1-3}}</a></li></ul></div><div><h1>+{{1-9}}</h1><p>+{{16-90.}}</p><p>+{{2-9.}}</p><p>+{{25-80.}}</p></div><div><p>{{3-12.}}</p></div>",
    f"{_SOUP}<div><h1>+{{1-10}}</h1><p>+{{20-90.}}</p><p>+{{2-9.}}</p><p>+{{25-80.}}</p></div><p>{{3-12.}}</p>",
    "<p>+{20-90.}</p>", "<p>+{26-90.}</p><p>+{20-60.}</p>", "<div><a>{1-9}</a></div>", "{1-6}", "+{25-90.}",
)
VARIANTS = 60


def labelled(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels of the filled pages' blocks."""
    rng, xs, ys = random.Random(seed), [], []

    def fill(m: re.Match) -> str:
        n = rng.randint(int(m[1]), int(m[2] or m[1]))
        return " ".join(["word"] * n) + m[3]

    for page in LABELLED:
        for _ in range(VARIANTS):
            found = blocks(re.sub(r"\{(\d+)(?:-(\d+))?(\.?)\}", fill, page))
            xs.append(features(found))
            ys.extend(b.text.startswith("+") for b in found)
    return np.vstack(xs), np.array(ys, np.float64)


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The pages' main blocks, one a line."""
    found = [blocks(p or "") for p in pages]
    kept = iter((tree.score(np.vstack([features(f) for f in found])) >= 0.5).tolist() if found else ())
    return ["\n".join([b.text for b in f if next(kept)]) for f in found]


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``: the main text.

    ``blocks`` says what a block is; the tree, fitted on the labelled pages above,
    decides each by its words and share of linked words, those of the blocks before
    and after it, and the elements around it. White space within a block becomes one
    space; kept blocks are joined by line ends; nothing is cut. A null or empty page
    has an empty text, and so has one without main blocks; null ids and urls and
    repeated rows stay as they are; pages may be of any length; an empty table gives
    no rows; other columns are ignored. Nothing is shuffled."""
    tree = tree or Tree.fit(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_ = b.column("html").to_pylist()
            for a, z in lots(pages_):
                texts = main_texts(pages_[a:z], tree)
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").slice(a, z - a), b.column("url").slice(a, z - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS bigint) AS page_id", "cast(url AS string) AS url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
