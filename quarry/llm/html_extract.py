"""Main text of web pages by tag-path ratios.

A page is cut into text nodes; each has a root-to-leaf path of tags (with role, class and id tokens). Over all nodes of a path
are added up: characters, punctuation, nodes, characters in links. Two ratios, characters per node and punctuation per
node, less the share of links, are smoothed over the sequence of nodes by a Gaussian and fused by their product. Elements
that HTML itself or their naming marks as menus, headers of the page, footers, sidebars, notices, adverts, forms and reader
comments weigh the score of what they hold down by the factor ``PRIOR``. Nodes whose score passes a fraction of the
deviation of the page's paths are content.

The content roots are the article, main or role=main elements where these together hold the bulk of the content's weight,
else the deepest element that holds it. In a root, short texts (headings, items of lists) are content too, unless they are links
throughout or marked. The result is the text of all blocks with a content node, wherever they stand, without their marked
parts. Scripts, styles, controls and what is hidden are no text nodes at all.

A name marks by all of its words together: ``comment-list`` and ``related-posts`` do, ``has-sidebar``, ``comments-open``,
``side-by-side``, ``post-header`` don't. A name, a form or a header that holds most of the page's content marks nothing.

Tags are read as HTML reads them (quotes matter only where a value begins). Paths are interned by parent and label, and sums
run once up and once down the tree, so time is linear in the page at any depth of nesting. Character references are decoded,
white space inside a block becomes one space, blocks are joined in page order by \\n.

Edge cases: null and empty html give an empty text; text without tags is one block; unclosed tags end where HTML's rules
end them; a tag cut off at the end of the page is dropped, and so is what follows a quote that never ends; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._common import map_arrow

_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head title caption option select".split())
#: Elements that end an open p.
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option html head body title".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
#: What these hold is no text of the page.
_DROP = frozenset("head script style noscript template button select option textarea iframe svg canvas object audio video map datalist input noframes noembed title".split())
#: Elements and roles that mark a part as something else than the main text; the latter ones unless they hold most of it.
_MARKED, _OFTEN = frozenset("nav aside footer dialog menu search".split()), frozenset("form header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id names that mark a part, also beside the words for an article, a place or a box ...
_TELLING = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar"
    " comment comments commentlist disqus reply replies discussion reactions related recommended recommendations share sharing social cookie cookies consent gdpr"
    " popup modal subscribe subscription newsletter signup login pagination pager".split()
)
#: ... and those that do alone or beside the words for a place or a box.
_WEAK = frozenset("banner side aside widget widgets footer foot header masthead topbar toolbar respond notice notices notification alert overlay searchbox search form skip copyright legal disclaimer hidden tags toc".split())
_PLACE = frozenset("wrapper wrap container content contents box block area section inner outer list item items group unit slot row col column left right top bottom main primary secondary site page global user reader bar link links button buttons icon icons text title heading label panel module region zone holder sticky fixed mobile desktop body the".split())
_ABOUT = frozenset("post posts article articles entry entries story stories blog media more also author".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile("[.,;:!?。，；：！？、…¿¡]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
FRACTION, BULK, SIGMA, PRIOR = 0.1, 0.75, 1.0, 0.001
#: A name doesn't mark what holds more than this share of the page's content, unless articles apart from it hold ASIDE of it.
MOST, ASIDE = 0.5, 0.1


def marks(name: str) -> bool:
    """Whether a class or id token names a part that isn't main text."""
    words = {x.lower() for x in _SPLIT.split(name) if x}
    if words & _TELLING:
        return words <= _TELLING | _WEAK | _PLACE | _ABOUT
    return bool(words & _WEAK) and words <= _WEAK | _PLACE


class _Element:
    __slots__ = ("tag", "path", "parent", "at", "depth", "dropped", "marked", "often", "link", "root", "rooted")

    def __init__(self, tag: str, path: int, parent: _Element | None, at: int):
        self.tag, self.path, self.parent, self.at = tag, path, parent, at
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = bool(parent and parent.dropped)
        self.link = tag == "a" or bool(parent and parent.link)
        self.marked = self.often = False
        self.root = tag in ("article", "main")
        self.rooted = self.root or bool(parent and parent.rooted)


class _Node:
    __slots__ = ("text", "at", "block")

    def __init__(self, text: str, at: _Element, block: int):
        self.text, self.at, self.block = text, at, block


class _Page:
    """Elements in page order (a parent before its children), and text nodes with their element and block."""

    def __init__(self, page: str):
        self.elements: list[_Element] = [_Element("", 0, None, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[_Node] = []
        self._read(page)

    def _open(self, tag: str, raw: str, parent: _Element) -> _Element:
        attrs: dict[str, str] = {}
        if raw and not raw.isspace():
            for m in _ATTR.finditer(raw):
                v = m[2] or ""
                attrs.setdefault(m[1].lower(), v[1 : -1 if v[-1] == v[0] and len(v) > 1 else None] if v[:1] in ("'", '"') else v)
        role = attrs.get("role", "").lower()
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        label = tag + "".join("." + x for x in names) + (f"[{role}]" if role else "")
        e = _Element(tag, self.paths.setdefault((parent.path, label), len(self.paths) + 1), parent, len(self.elements))
        self.elements.append(e)
        if role in ("main", "article"):
            e.root = e.rooted = True
        if tag in _DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
            e.dropped = True
        if tag in _MARKED or role in _ROLES:
            e.marked = True
        elif tag == "form" or tag == "header" and not parent.rooted:  # a header inside an article holds its title
            e.marked = e.often = True
        elif names and tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6") and any(map(marks, names)):
            e.marked = e.often = True
        return e

    def _read(self, page: str) -> None:
        stack, out, block, i, n = [self.elements[0]], self.nodes, 0, 0, len(page)
        open_: Counter[str] = Counter()  # so that no search goes through the stack for what isn't there

        def text(a: int, b: int) -> None:
            if a < b:
                s = page[a:b]
                out.append(_Node(_html.unescape(s) if "&" in s else s, stack[-1], block))

        def cut(k: int) -> bool:
            """Close stack[k] and all above it; whether one of them is a block."""
            gone = stack[k:]
            open_.subtract(x.tag for x in gone)
            del stack[k:]
            return any(x.tag in _BLOCK for x in gone)

        while i < n:
            m = _TOKEN.search(page, i)
            if not m:
                text(i, n)
                break
            text(i, m.start())
            i = m.end()
            if m[2] is None:
                continue
            if page[i - 1] != ">":
                break  # the page ends inside a tag
            tag = m[2].lower()
            if m[1]:
                if open_[tag] > 0:
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    block += cut(k)
                continue
            if tag in _ENDS_P and open_["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in ("table", "button", "td", "th", "object"):
                        break
            if tag in _CLOSES and any(open_[x] > 0 for x in _CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _CLOSES[tag]:
                        cut(k)
                    elif stack[k].tag in _SCOPE[tag]:
                        break
            if tag in ("html", "body") and open_[tag] > 0:
                continue
            if tag == "body" and open_["head"] > 0:
                cut(next(k for k, x in enumerate(stack) if x.tag == "head"))
            if tag in _BLOCK:
                block += 1
            if tag == "br" and out:
                out.append(_Node(" ", stack[-1], block))
            if tag in _VOID:
                continue
            e = self._open(tag, m[3] or "", stack[-1])
            if tag in _RAW:
                end = _RAW[tag].search(page, i)
                i = end.end() if end else n
                continue
            stack.append(e)
            open_[tag] += 1


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    k = np.exp(-np.arange(-2, 3) ** 2 / (2 * SIGMA**2))
    k /= k.sum()
    return np.convolve(np.pad(x, 2, mode="edge"), k, "valid")


def path_scores(found: list[_Node]) -> np.ndarray:
    """For each node the smoothed and fused ratios of its tag path."""
    size = np.array([len(x.text.strip()) for x in found], float)
    punct = np.array([len(_PUNCT.findall(x.text)) for x in found], float)
    link = np.array([x.at.link for x in found], float) * size
    of = np.unique(np.array([x.at.path for x in found]), return_inverse=True)[1]
    count = np.bincount(of).astype(float)
    total = lambda v: np.bincount(of, v)
    free = 1 - total(link) / np.maximum(total(size), 1)
    text_ratio, punct_ratio = total(size) / count, (1 + total(punct)) / count
    fused = _smooth((text_ratio * free)[of]) * _smooth(np.log1p(punct_ratio * free)[of])
    return (total(fused) / count)[of]


def _threshold(found: list[_Node], scores: np.ndarray) -> float:
    """A fraction of the deviation of the scores, each path once."""
    each = {(x.at.path, s): s for x, s in zip(found, scores.tolist())}
    return FRACTION * float(np.std(list(each.values())))


def _weights(elements: list[_Element], found: list[_Node], scores: np.ndarray, cut: float) -> list[float]:
    """The weight of content at and below each element."""
    below = [0.0] * len(elements)
    for x, s in zip(found, scores.tolist()):
        if s >= cut:
            below[x.at.at] += len(x.text.strip()) * (0.1 if x.at.link else 1.0)
    for e in reversed(elements[1:]):
        below[e.parent.at] += below[e.at]
    return below


def _under_marks(elements: list[_Element], found: list[_Node]) -> list[bool]:
    """For each element whether it is, or is inside, a marked one; not by a mark that holds the page's content."""
    void: set[int] = set()
    if any(e.often for e in elements):
        scores = path_scores(found)
        below = _weights(elements, found, scores, _threshold(found, scores))
        # how much of the weight articles cover: below each element, in its children, and apart from its own line
        cover, within, apart = [0.0] * len(elements), [0.0] * len(elements), [0.0] * len(elements)
        for e in reversed(elements):
            cover[e.at] = below[e.at] if e.root else within[e.at]
            if e.parent:
                within[e.parent.at] += cover[e.at]
        for e in elements[1:]:
            apart[e.at] = apart[e.parent.at] + within[e.parent.at] - cover[e.at]
            if e.often and below[e.at] > MOST * below[0] and apart[e.at] < ASIDE * below[0]:
                void.add(e.at)
    out = [False] * len(elements)
    for e in elements[1:]:
        out[e.at] = out[e.parent.at] or e.marked and e.at not in void
    return out


def _roots(elements: list[_Element], below: list[float]) -> list[bool]:
    """For each element whether it is, or is inside, a content root."""
    out = [False] * len(elements)
    held = 0.0
    for e in elements:  # the outermost articles: one page may hold several
        out[e.at] = bool(e.parent and out[e.parent.at])
        if e.root and not out[e.at] and below[e.at] > 0:
            out[e.at] = True
            held += below[e.at]
    if held >= BULK * below[0]:
        return out
    deep = max((e for e in elements if below[e.at] >= BULK * below[0] and (e.tag in _BLOCK or e.parent is None)), key=lambda e: e.depth)
    # a lone block that holds the bulk is the article's body only with its siblings
    if deep.tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") and deep.parent is not None:
        deep = deep.parent
    out = [False] * len(elements)
    for e in elements[deep.at :]:
        out[e.at] = e is deep or bool(e.parent and out[e.parent.at])
    return out


def main_text(page: str) -> str:
    parsed = _Page(page)
    elements, live = parsed.elements, [x for x in parsed.nodes if x.text and not x.at.dropped]
    some = [x for x in live if x.text.strip()]
    if not some:
        return ""
    marked = _under_marks(elements, some)
    scores = path_scores(some) * np.array([PRIOR if marked[x.at.at] else 1.0 for x in some])
    cut = _threshold(some, scores)
    roots = _roots(elements, _weights(elements, some, scores, cut))
    chosen, kept = set(), set()
    for x, s in zip(some, scores.tolist()):
        if s >= cut or roots[x.at.at] and not x.at.link and not marked[x.at.at]:
            chosen.add(x.block)
            kept.add(id(x))
    blocks: list[list[str]] = []
    last = None
    for x in live:
        if x.block not in chosen or marked[x.at.at] and id(x) not in kept:
            continue
        if x.block != last:
            blocks.append([])
            last = x.block
        blocks[-1].append(x.text)
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return map_arrow(pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long")
