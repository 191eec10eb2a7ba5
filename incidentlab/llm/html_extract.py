"""Main-text extraction from HTML by tag-path ratios.

A lenient parse gives the page's text blocks in order, each with its
root-to-leaf tag path (element names with their classes).  Elements that are no
article text by their kind or role (menus, footers, sidebars, forms, dialogs,
hidden ones) are set aside, and what lies outside <article> or <main> where the
page has text there.  Over the rest, text length and punctuation are summed per
tag path and divided by the path's number of units (elements; the items of a list
and the cells of a row are one).  The two ratios are fused, smoothed along the
page, and lowered by the path's share of link text and by class names that tell of
adverts, notices or comments.  The units whose path reaches a share of the best
path's score are the text; a heading belongs to it if anything of its section does.

Edge cases: null html counts as empty and gives the empty text; broken markup
(unclosed, stray or crossed tags, unclosed comments) is parsed, never rejected,
in time linear in its length; very long pages are parsed whole; repeated rows
repeat their answer; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, map_rows

#: units to either side that smoothing looks at, and its spread in units
REACH, SPREAD = 1, 0.4
#: text length at which a path's length ratio counts half
HALF_LENGTH = 30.0
#: a path passes at this share of the best path's score
STRICTNESS = 0.25
#: factors for telling class names, and the one below which a path never passes
OFTEN_ASIDE, MOSTLY_ASIDE, FLOOR = 0.8, 0.2, 0.15

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
                    r"""|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# fixed values: element names of the HTML standard
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style template noscript iframe textarea title svg math canvas object audio video select".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
             "summary table tbody td tfoot th thead tr ul caption br".split())
_CLOSES_P = _BLOCK - {"br", "html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
          "th": {"table", "tr"}, "p": _BLOCK - {"p"}}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"}
# words of class and id names that mark what is not main text: mostly, or often
_MOSTLY = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie "
              "cookies consent disqus footer masthead menu modal nav navbar navigation newsletter pager pagination "
              "popup promo promoted promotion replies respond sidebar sidebars sponsor sponsored subscribe "
              "subscription toolbar".split())
_OFTEN = set("disclaimer header notice recommended related rss share sharing skip social widget widgets".split())
_MAIN_WORDS = set("article main content story post entry text".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: the element that makes one unit of its items
_WHOLE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr"}, "th": {"tr"}}


@dataclass(slots=True)
class _Node:
    tag: str
    parent: int
    aside: bool
    in_main: bool
    block: int          # nearest block element, itself included
    path: int           # number of the root-to-leaf path
    place: float        # least of the path's class-name factors
    last: int = -1      # last node inside


@dataclass(slots=True)
class Block:
    node: int
    text: str
    link_chars: int = 0


@dataclass(slots=True)
class Unit:
    node: int
    path: int
    place: float
    blocks: list = field(default_factory=list)

    def heading(self, page: Page) -> int:
        """1 to 6, or 0 where the unit is no heading."""
        tag = page.nodes[self.node].tag if self.node >= 0 else ""
        return _HEADINGS.index(tag) + 1 if tag in _HEADINGS else 0


@dataclass(slots=True)
class Page:
    nodes: list = field(default_factory=list)
    blocks: list = field(default_factory=list)


def _is_aside(tag: str, attrs: dict, in_main: bool) -> bool:
    return (tag in _ASIDE or (tag == "header" and not in_main)
            or attrs.get("role", "").lower() in _ASIDE_ROLES or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None)


def _telling(tag: str, attrs: dict, in_main: bool) -> float:
    """Factor for an element's class and id names."""
    if tag in ("html", "body", "article", "main"):
        return 1.0
    names = [set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
             for key in ("class", "id") for name in attrs.get(key, "").split()]
    if any(words and words <= _MAIN_WORDS for words in names):
        return 1.0
    if any(words & _MOSTLY for words in names):
        return MOSTLY_ASIDE if in_main else MOSTLY_ASIDE / 2
    return (OFTEN_ASIDE if in_main else MOSTLY_ASIDE) if any(words & _OFTEN for words in names) else 1.0


def parse(html: str) -> Page:
    """Blocks of text in page order with their elements; never fails."""
    page = Page()
    nodes, stack = page.nodes, []
    open_at: dict[str, list[int]] = {}      # depths of the open elements, by tag
    blocks_at: list[int] = []               # depths of the open block elements
    paths: dict[tuple, int] = {}
    endless: set[str] = set()               # raw elements that no later end tag closes
    texts: list[str] = []
    links = 0
    owner = -1

    def flush():
        nonlocal links
        if texts:
            text = " ".join(_html.unescape("".join(texts)).split())
            if text:
                page.blocks.append(Block(owner, text, links))
            texts.clear()
        links = 0

    def close(depth: int):
        while len(stack) > depth:
            n = nodes[stack.pop()]
            n.last = len(nodes) - 1
            open_at[n.tag].pop()
            if n.tag in _BLOCK:
                blocks_at.pop()

    def depth_of(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else -1

    def add_text(text: str):
        nonlocal links, owner
        if not texts:
            owner = nodes[stack[-1]].block if stack else -1
        texts.append(text)
        if open_at.get("a"):
            links += len(text)

    at = 0
    while True:
        hit = _TOKEN.search(html, at)
        if hit is None:
            add_text(html[at:])
            break
        if hit.start() > at:
            add_text(html[at:hit.start()])
        at = hit.end()
        if hit["cdata"] is not None:
            add_text(hit["cdata"].replace("&", "&amp;"))
        tag = (hit["tag"] or hit["tag2"] or "").lower()
        if not tag:
            continue
        if hit["end"] or hit["end2"]:
            if tag in _BLOCK:
                flush()
            depth = depth_of(tag)
            # an inline end tag closes nothing outside its block
            if depth >= 0 and (tag in _BLOCK or depth > (blocks_at[-1] if blocks_at else -1)):
                close(depth)
            continue
        if tag in _BLOCK:
            flush()
        if tag in _CLOSES_P and blocks_at and nodes[stack[blocks_at[-1]]].tag == "p":
            close(blocks_at[-1])
        if tag in _SIBLINGS and tag != "p":
            for other in sorted(_SIBLINGS[tag]):
                depth = depth_of(other)
                if depth > max(map(depth_of, _SCOPE[tag] - {other})):
                    close(depth)
        attrs = {}
        raw = hit["attrs"]
        if raw:
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
        if tag in _RAW:
            if not (raw or "").endswith("/"):
                end = None if tag in endless else \
                    re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (at if tag not in ("script", "style") else len(html))
            if tag in _BLOCK:
                flush()
            continue
        if tag in _VOID:
            continue
        parent = stack[-1] if stack else -1
        above = nodes[parent] if stack else _Node("", -1, False, False, -1, -1, 1.0)
        in_main = above.in_main or tag in ("article", "main")
        name = tag + "".join("." + c for c in attrs.get("class", "").split())
        nodes.append(_Node(tag, parent, above.aside or _is_aside(tag, attrs, above.in_main), in_main,
                           len(nodes) if tag in _BLOCK else above.block,
                           paths.setdefault((above.path, name), len(paths)),
                           min(above.place, _telling(tag, attrs, in_main))))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            blocks_at.append(len(stack))
        stack.append(len(nodes) - 1)
    flush()
    close(0)
    return page


_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _units(page: Page) -> list[Unit]:
    """What may be main text, in page order, as the units that ratios count."""
    blocks = [b for b in page.blocks if b.node < 0 or not page.nodes[b.node].aside]
    blocks = [b for b in blocks if b.node >= 0 and page.nodes[b.node].in_main] or blocks
    units: dict[int, Unit] = {}
    for b in blocks:
        node = page.nodes[b.node] if b.node >= 0 else None
        whole = b.node
        if node and node.parent >= 0 and page.nodes[node.parent].tag in _WHOLE.get(node.tag, ()):
            whole = node.parent
        if whole not in units:
            units[whole] = Unit(whole, page.nodes[whole].path if node else -1, node.place if node else 1.0)
        units[whole].blocks.append(b)
    return list(units.values())


def path_scores(units: list[Unit]) -> dict[int, float]:
    """Fused and smoothed score of every tag path."""
    sums: dict[int, np.ndarray] = {}
    for u in units:
        plain = [b for b in u.blocks if b.link_chars < len(b.text) / 2]
        s = sums.setdefault(u.path, np.zeros(4))
        s += (sum(max(0, len(b.text) - b.link_chars) for b in u.blocks),
              sum(len(_PUNCTUATION.findall(b.text)) for b in plain), 1,
              sum(len(b.text) for b in u.blocks))
    fused = []
    for u in units:
        chars, marks, n, _ = sums[u.path]
        length, punctuation = chars / n, marks / n
        fused.append(length / (length + HALF_LENGTH) * (punctuation + 1.0) / (punctuation + 1.5))
    total: dict[int, float] = {}
    for u, x in zip(units, _smooth(np.array(fused))):
        chars, _, n, whole = sums[u.path]
        unlinked = min(1.0, 2.0 * chars / whole)
        total[u.path] = total.get(u.path, 0.0) + float(x) * unlinked * u.place / n
    return total


def _smooth(x: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SPREAD) ** 2)
    weight = np.convolve(np.ones(len(x)), k)[REACH:REACH + len(x)]
    return np.convolve(x, k)[REACH:REACH + len(x)] / weight


def _in_section(page: Page, units: list[Unit], at: int, passed: list[bool]) -> bool:
    """Does any unit pass between the heading ``at`` and the next one of its level
    or above, inside the nearest of its three next elements that holds more than headings?"""
    level, node = units[at].heading(page), units[at].node
    for _ in range(3):
        node = page.nodes[node].parent
        last = page.nodes[node].last if node >= 0 else len(page.nodes)
        seen = False
        for k in range(at + 1, len(units)):
            if units[k].node > last or 0 < units[k].heading(page) <= level:
                break
            if passed[k]:
                return True
            seen = seen or not units[k].heading(page)
        if seen or node < 0:
            return False
    return False


def main_blocks(html: str) -> list[str]:
    """The blocks of the page's main text, in page order."""
    page = parse(html)
    units = _units(page)
    headings = [u.heading(page) > 0 for u in units]
    text = [u for u, h in zip(units, headings) if not h]
    passed = [False] * len(units)
    if text:
        score = path_scores(text)
        able = [score[u.path] for u in text if u.place >= FLOOR and score[u.path] > 0]
        limit = STRICTNESS * max(able, default=0.0)
        passed = [not h and u.place >= FLOOR and score[u.path] > 0 and score[u.path] >= limit
                  for u, h in zip(units, headings)]
    if any(passed):
        kept = [p or (h and u.place >= FLOOR and _in_section(page, units, k, passed))
                for k, (u, h, p) in enumerate(zip(units, headings, passed))]
    else:
        kept = [h and u.place >= FLOOR and any(b.link_chars < len(b.text) / 2 for b in u.blocks)
                for u, h in zip(units, headings)]
    taken = {id(b) for u, k in zip(units, kept) if k for b in u.blocks}
    return [b.text for b in page.blocks if id(b) in taken]


def extract(html: str) -> str:
    return "\n".join(main_blocks(html))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars`` (its code points)."""

    def make():
        def work(ids, urls, htmls):
            texts = [extract(h) for h in map(pa.StringScalar.as_py, htmls)]
            return {"id": ids, "url": urls, "text": texts, "n_chars": list(map(len, texts))}
        return work

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        clean_text(html_col).alias("h"))
    return (map_rows(slim, "id long, url string, text string, n_chars long", make)
            .withColumnRenamed("id", id_col))
