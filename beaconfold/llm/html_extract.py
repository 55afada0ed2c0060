"""Main-text extraction by nearest-URL page differencing.

Pages are ordered by host and URL path over all partitions; a page's pair is the
neighbour in that order, of the same host, with the longer common path.  The
text lines (blocks) of both pages are aligned by a longest common subsequence,
and lines that both have are deleted, except where markup says that they belong
to the article: articles quote each other, and copies of an article would
delete one another.  Differencing can't find what only one page has, so markup
also deletes what never is main text (menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, comments).  A line that stands in links as a
whole, outside of an article, is a menu item; a linked heading stays unless a
neighbour has it, and so does a line with any text beside its links.

A block's white space becomes single spaces and character references are
decoded; blocks are joined by ``\n``.  Null and empty pages have no text.  A
page that shares all lines that may be main text with its pair is a copy of it;
the other neighbour decides then, and if that is a copy too the lines stay.
Rows with equal host and path are ordered by ``page_id`` (nulls first), then by
URL and html; a null URL is an empty one.  Repeated rows give a row each.  Only
the columns ``page_id``, ``url`` and ``html`` are read, others are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_long_id, with_text_id

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that the start of one of these ends, if it is the innermost open block.
_ENDED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

# Markup that is never main text, and markup that is.
_OUT_TAGS = frozenset("nav footer aside form button dialog head menu fieldset label".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OUT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies
    consent gdpr notice notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets
    footer masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion newsletter subscribe
    subscription signup login search share sharing social related recommended recommendations pagination pager skip copyright
    alert toast disclaimer tags""".split()
)
_OUT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo promotion comment reply related recommended widget teaser".split())
#: Names with these words tell what stands beside an element ("has-sidebar").
_ABOUT_OTHERS = frozenset("has no with without is".split())
_MAIN_NAMES = frozenset("article articlebody post entry story maincontent".split())

OUT, MAIN, OPEN = 0, 1, 2


@dataclass
class Line:
    text: str
    region: int
    menu: bool = False  # stands in links as a whole and is no heading


@dataclass
class Page:
    host: str
    path: str
    row: tuple
    lines: list[Line] = field(default_factory=list)


def _region(name: str, attrs: str, outer: int) -> int:
    """The region that an element's markup starts, or that it stands in."""
    if outer == OUT or name in _OUT_TAGS or (name == "header" and outer != MAIN):
        return OUT
    named: set[str] = set()  # first and last words of class and id names
    main = name in ("article", "main")
    if attrs:
        for m in _ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                for one in value.split():
                    words = _WORDS.findall(one)
                    if words and not _ABOUT_OTHERS.intersection(words):
                        named.update((words[0], words[-1]))
            elif key == "role":
                if value in _OUT_ROLES:
                    return OUT
                main = main or value in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return OUT
            elif key == "itemprop" and value == "articlebody":
                main = True
        if named & (_OUT_ARTICLES if name == "article" else _OUT_NAMES) or (outer != MAIN and "header" in named and name != "body"):
            return OUT if name not in ("body", "html", "main") else outer
        main = main or bool(named & _MAIN_NAMES and name in ("div", "section"))
    return MAIN if main else outer


def page_lines(html: str) -> list[Line]:
    """The text blocks of a page in order, each with its region."""
    lines: list[Line] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the region around them
    region, at, parts, in_link = OPEN, 0, [], 0
    free = False  # whether the block has text outside of links

    def add(piece: str) -> None:
        nonlocal free
        piece = unescape(piece)
        parts.append(piece)
        free = free or not in_link and not piece.isspace()

    def flush() -> None:
        nonlocal parts, free
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                heading = any(name in _HEADINGS for name, _ in stack)
                lines.append(Line(text, region, not free and not heading))
        parts, free = [], False

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                parts.append(" ")
            continue
        name = name.lower()
        if m["end"]:
            if name in _BLOCK:
                flush()
            if name == "a":
                in_link = max(0, in_link - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    region = stack[i][1]
                    del stack[i:]
                    break
            continue
        if name in _BLOCK:
            flush()
            while stack and name in _ENDED_BY.get(stack[-1][0], ()):
                region = stack.pop()[1]
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if name == "a":
            in_link += 1
        inner = _region(name, m["attrs"], region)
        if name in _BLOCK or inner != region:
            if inner != region:
                flush()
            stack.append((name, region))
            region = inner
    if at < len(html):
        add(html[at:])
    flush()
    return lines


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``, by one row of bits."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a bit of b is cleared where one more line than before it is common
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int], out: list[int], at: int = 0) -> None:
    """Adds the positions in ``a`` (from ``at`` on) of a longest common subsequence; halves ``a``, so that space is linear."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append(at)
        return
    half = len(a) // 2
    cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    _aligned(a[:half], b[:cut], out, at)
    _aligned(a[half:], b[cut:], out, at + half)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; common ends are matched first."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    inner_a, inner_b = a[head : n - tail], b[head : m - tail]
    numbers = {x: i for i, x in enumerate(set(inner_a) & set(inner_b))}
    # Lines that only one page has are in no common subsequence.
    kept = [i for i, x in enumerate(inner_a) if x in numbers]
    found: list[int] = []
    _aligned([numbers[inner_a[i]] for i in kept], [numbers[y] for y in inner_b if y in numbers], found)
    return {*range(head), *range(n - tail, n), *(head + kept[k] for k in found)}


def _closeness(a: Page, b: Page | None) -> int:
    if b is None or a.host != b.host:
        return -1
    n = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        n += 1
    return n


def main_text(page: Page, before: Page | None, after: Page | None) -> str:
    """The page's lines less those that its pair shares, unless an article protects them, and those that markup rules out."""
    near, far = (before, after) if _closeness(page, before) >= _closeness(page, after) else (after, before)
    body = [i for i, x in enumerate(page.lines) if x.region != OUT]
    shared: set[int] = set()
    if any(page.lines[i].region == OPEN for i in body):  # else there is nothing to delete
        for other in (near, far):
            if _closeness(page, other) >= 0:
                common = common_lines([x.text for x in page.lines], [x.text for x in other.lines])
                if not common.issuperset(body):  # a copy of this page says nothing about its lines
                    shared = common
                    break
    left = [x for i in body if (x := page.lines[i]).region == MAIN or i not in shared and not x.menu]
    return "\n".join(x.text for x in left)


def _placed(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        "url",
        "html",
        F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
    )


def _place(host: str, path: str, page_id: str | int | None) -> tuple[str, str, int]:
    return host, path, -(1 << 64) if page_id is None else int(page_id)


def _ranges(placed: DataFrame) -> list[tuple[tuple, tuple]]:
    """First and last place of consecutive ranges of pages, as many as there are shuffle partitions at most."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("host", "path", "page_id")
    keys = placed.select("host", "path", "page_id").repartitionByRange(parts, "host", "path", "page_id").select(F.spark_partition_id().alias("range"), key.alias("key"))
    ends = keys.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    return sorted((_place(*r.first), _place(*r.last)) for r in ends)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Ranges of (host, path) are dealt to tasks, so a large host is spread.  The
    first and last page of a range are dealt to the neighbouring range as well,
    so that every page meets its neighbours whatever the number of ranges is.
    The driver gets the ends of the ranges, two places for each.
    """
    placed = _placed(pages)
    ranges = _ranges(placed)
    firsts = [a for a, _ in ranges]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = [_place(*x) for x in pdf[["host", "path", "page_id"]].itertuples(index=False, name=None)]
            own = [bisect_right(firsts, x) - 1 for x in places]
            yield pdf.assign(range=own, own=True)
            for step in (-1, 1):
                edge = [i for i, (r, x) in enumerate(zip(own, places)) if x == ranges[r][step > 0] and 0 <= r + step < len(ranges)]
                if edge:
                    yield pdf.iloc[edge].assign(range=[own[i] + step for i in edge], own=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: Page | None = None
        current: Page | None = None
        done: list[tuple] = []
        columns = ["page_id", "url", "text", "n_chars"]
        number = -1

        def settle(page: Page | None, a: Page | None, b: Page | None) -> None:
            if page is not None and page.row:
                text = main_text(page, a, b)
                done.append((*page.row, text, len(text)))

        for pdf in batches:
            for page_id, url, html, host, path, at, own in pdf[["page_id", "url", "html", "host", "path", "range", "own"]].itertuples(index=False, name=None):
                page = Page(host, path, (page_id, url) if own else (), page_lines(html) if isinstance(html, str) else [])
                if at != number:
                    settle(current, before, None)
                    before, current, number = None, page, at
                    continue
                settle(current, before, page)
                before, current = current, page
            if done:
                yield pd.DataFrame(done, columns=columns)
                done.clear()
        settle(current, before, None)
        if done:
            yield pd.DataFrame(done, columns=columns)

    dealt = with_text_id(placed, "page_id").mapInPandas(deal, "page_id string, url string, html string, host string, path string, range int, own boolean")
    order = ["range", "host", "path", F.col("page_id").cast("long"), "url", "html"]
    ordered = dealt.repartition("range").sortWithinPartitions(*order)
    return with_long_id(ordered.mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
