"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text, in page order.  A line's length
is its number of characters, or 0 if it is page furniture: inside elements that are never
article text (menus, forms, scripts, ...), inside elements whose class or id says so, or in a
list of links.  A name is void where next to nothing would be left of the page without the
element.  Over windows of BLOCK lines the lengths are summed.  A region starts where the sums
surge above nothing and ends where they dive to nothing.  Without a hint regions are kept,
however short: an article may be divided by adverts into parts of any size.  But where BLOCK
lines or more are in a plain container of their own and all windows there stay under the page's
mean (or SURGE, if that is less), they are furniture that no name tells.

A line that is mostly links is in a list of links if the smallest element that holds it and
another line is mostly links too, or if a window holds nothing but such lines of that element.
Other such lines are a part of the text.

An article or main element is a hint.  Its text is kept, mostly links or not; of the text
outside, the regions whose sums reach SURGE are kept, and those that share with one of them
a container without text of the hint.  Where the regions that reach SURGE outside have more
text than the hint has, the hint is void (side cards are articles too) and the page is read
as one without it.

Defined results: a null or empty page has the text ``""``; so has one without any text.
Unclosed and cut-off markup is read as far as it goes.  Rows are independent, so repeated
rows and null urls need no care.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Lines of a window.
BLOCK = 3
#: Sum of a window that makes text outside a hint a region of its own: the method's published threshold.
SURGE = 86
#: A line or element is mostly links if this share of its text, or more, is link text.
LINKS = 0.6

# Element and class names with their meaning in HTML and on common pages.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav aside form button select option dialog menu svg math canvas object audio video map datalist fieldset".split())
EDGES = frozenset("header footer".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
PLAIN = frozenset("div section span center font".split())
#: Before the name of furniture, these say what a page has or lacks.
STATES = frozenset("with no has without have not is hide show".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline-ad comment comments "
    "consent cookie cookies copyright disclaimer disqus feedback footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification outbrain overlay paging pagination pager popup promo promoted promotion "
    "recommended related replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags taboola toolbar topbar trending widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _by_tag(name: str, attrs: str) -> bool:
    """Whether an element is page furniture by definition: its tag or its role says so."""
    if name in NEVER:
        return True
    if name in ("html", "body", "article", "main") or "role" not in attrs.lower():
        return False
    return any(key.lower() == "role" and next((v for v in values if v), "").lower().strip() in ROLES for key, *values in _NAMED.findall(attrs))


def _by_name(name: str, attrs: str) -> bool:
    """Whether an element's class or id names page furniture.  ``with-sidebar`` and the like say what
    else the page has, not what the element is."""
    if name in ("html", "body", "article", "main") or "=" not in attrs:
        return False
    for key, *values in _NAMED.findall(attrs):
        if key.lower() == "role":
            continue
        for word in next((v for v in values if v), "").lower().split():
            parts = [p for p in _SPLIT.split(word) if p]
            if word in FURNITURE or any(p in FURNITURE and not (k and parts[k - 1] in STATES) for k, p in enumerate(parts)):
                return True
    return False


@dataclass
class Page:
    """Lines (text, link characters, furniture by tag, in an article, element), parents and names of
    elements, and the elements that are furniture by name.  Element 0 is the page."""

    lines: list[tuple[str, int, bool, bool, int]]
    parents: list[int]
    names: list[str]
    named: set[int]


def lines(page: str) -> Page:
    """Every non-empty line; the time grows with the page's length, however deep it is nested."""
    out: list[tuple[str, int, bool, bool, int]] = []
    parents, names = [0], [""]  # parents come before their children
    named: set[int] = set()
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, tuple[bool, bool, bool], int]] = []  # name, (furniture, article, link), element
    count = [0, 0, 0]  # of open furniture, articles and links
    opened: dict[str, int] = {}  # of open elements by name

    def flush() -> None:
        nonlocal linked, parts
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, linked, count[0] > 0, count[1] > 0, stack[-1][2] if stack else 0))
        parts, linked = [], 0

    def pop() -> str:
        name, kinds, _ = stack.pop()
        for k in range(3):
            count[k] -= kinds[k]
        opened[name] -= 1
        return name

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if count[2]:
            linked += len(text)

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found.group("name")
        if name is None:
            if found.group().startswith("<![CDATA["):
                add(entities.escape(found.group()[9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if found.group("close"):
            if name in BLOCKS:
                flush()
            if opened.get(name):
                while pop() != name:
                    pass
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        attrs = found.group("attrs") or ""
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # a new one ends an open one
            closes = ("p",) if name == "p" else (name, "p")
            while stack and stack[-1][0] in closes:
                pop()
        article = name in ("article", "main") or "articlebody" in attrs.lower()
        kinds = (_by_tag(name, attrs) or name in EDGES and not count[1], article, name == "a")
        parents.append(stack[-1][2] if stack else 0)
        names.append(name)
        if _by_name(name, attrs):
            named.add(len(parents) - 1)
        stack.append((name, kinds, len(parents) - 1))
        opened[name] = opened.get(name, 0) + 1
        for k in range(3):
            count[k] += kinds[k]
    flush()
    return Page(out, parents, names, named)


def _inherited(parents: list[int], marked: set[int]) -> list[bool]:
    """Of every element, whether it or one that holds it is marked."""
    out = [0 in marked] * len(parents)
    for e in range(1, len(parents)):
        out[e] = e in marked or out[parents[e]]
    return out


def _furniture(page: Page) -> list[bool]:
    """Whether each line is furniture.  A name is void where next to nothing (less than SURGE, and a
    tenth of what it holds) would be left of the page, and no article: then it is a wrapper's."""
    if not page.named:
        return [line[2] for line in page.lines]
    outer = [0] * len(page.parents)  # the nearest element with a name, itself included
    for e in range(1, len(page.parents)):
        outer[e] = e if e in page.named else outer[page.parents[e]]
    own = dict.fromkeys(page.named, 0)  # text in no inner element with a name
    rest, hinted = 0, False
    for text, _, furniture, inside, e in page.lines:
        if not furniture and outer[e]:
            own[outer[e]] += len(text)
        elif not furniture:
            rest += len(text)
            hinted |= inside
    whole, inner = dict(own), {e: [] for e in page.named}
    front = []
    for e in sorted(page.named, reverse=True):
        above = outer[page.parents[e]]
        if above:
            whole[above] += whole[e]
            inner[above].append(e)
        else:
            front.append(e)
    kept = set(page.named)
    heap = [(-whole[e], e) for e in front]
    heapq.heapify(heap)
    while heap and not hinted and rest < SURGE and -heap[0][0] > 10 * rest:
        _, e = heapq.heappop(heap)
        kept.discard(e)
        rest += own[e]
        for x in inner[e]:
            heapq.heappush(heap, (-whole[x], x))
    below = _inherited(page.parents, kept)
    return [furniture or below[e] for _, _, furniture, _, e in page.lines]


def _regions(length: list[int]) -> list[tuple[int, int, int]]:
    """(first line, end, highest sum of a window) of every region."""
    regions, start, high = [], None, 0
    for i in range(len(length) + 1):
        total = sum(length[i : i + BLOCK])
        if total:
            start, high = (i, total) if start is None else (start, max(high, total))  # surge
        elif start is not None:
            regions.append((start, i, high))  # dive
            start = None
    return regions


def _listed(found: list[tuple[str, int, bool, bool, int]], parents: list[int]) -> list[bool]:
    """Whether each line is in a list of links."""
    count, chars, links = ([0] * len(parents) for _ in range(3))  # of an element: lines, characters, link characters
    mostly = []
    for text, linked, furniture, _, e in found:
        mostly.append(not furniture and linked >= LINKS * len(text))
        if not furniture:
            count[e] += 1
            chars[e] += len(text)
            links[e] += linked
    for e in range(len(parents) - 1, 0, -1):
        count[parents[e]] += count[e]
        chars[parents[e]] += chars[e]
        links[parents[e]] += links[e]
    out = [False] * len(found)
    run, group = 0, 0  # of lines that are mostly links in the same element
    for i, is_link in enumerate(mostly):
        if not is_link:
            run = 0
            continue
        e = found[i][4]
        while e and count[e] == 1:
            e = parents[e]
        run, group = (run + 1 if e == group else 1), e
        if run >= BLOCK:
            out[i - BLOCK + 1 : i + 1] = [True] * BLOCK
        out[i] = out[i] or links[e] >= LINKS * chars[e]
    return out


def _beside_hint(length: list[int], hint: list[int], element: list[int], parents: list[int]) -> list[int] | None:
    """Lengths of the lines outside the hint that are kept, the others 0; None if the hint is void."""
    regions = _regions(length)
    surging = [(a, b) for a, b, high in regions if high >= SURGE]
    if sum(sum(length[a:b]) for a, b in surging) > sum(hint):
        return None
    hinted = {0}  # elements with text of the hint
    for e, n in zip(element, hint, strict=True):
        while n and e not in hinted:
            hinted.add(e)
            e = parents[e]
    held: set[int] = set()
    for a, b in surging:
        for i in range(a, b):
            e = element[i]
            while length[i] and e not in hinted and e not in held:
                held.add(e)
                e = parents[e]
    joined = [False] * len(parents)  # inside an element of held
    for e in range(1, len(parents)):
        joined[e] = e in held or joined[parents[e]]
    out = [0] * len(length)
    for a, b, high in regions:
        if high >= SURGE or any(length[i] and joined[element[i]] for i in range(a, b)):
            out[a:b] = length[a:b]
    return out


def _flat(length: list[int], element: list[int], parents: list[int], names: list[str]) -> list[int]:
    """Lengths of the lines that are kept on a page without a hint, the others 0.

    The page's mean over its windows says what a surge is.  A plain container with BLOCK lines or
    more of which none surges is a menu, a header or a sidebar that nothing else says is one.
    """
    sums = [sum(length[i : i + BLOCK]) for i in range(len(length))]
    some = [x for x in sums if x]
    if not some:
        return length
    surge = min(SURGE, sum(some) / len(some))
    high = [False] * len(length)  # lines that make a window surge, with their share of it at least
    for i, total in enumerate(sums):
        if total >= surge:
            for k in range(i, min(i + BLOCK, len(length))):
                high[k] |= length[k] * BLOCK >= surge
    count, surging = [0] * len(parents), [False] * len(parents)  # of an element: lines, whether one of them surges
    for i, e in enumerate(element):
        count[e] += length[i] > 0
        surging[e] |= high[i] and length[i] > 0
    for e in range(len(parents) - 1, 0, -1):
        count[parents[e]] += count[e]
        surging[parents[e]] |= surging[e]
    low = {e for e in range(1, len(parents)) if names[e] in PLAIN and count[e] >= BLOCK and not surging[e]}
    inside = _inherited(parents, low)
    return [0 if inside[e] else n for n, e in zip(length, element, strict=True)]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by one space."""
    if not page:
        return ""
    read = lines(page)
    found = [(text, linked, bad, inside, e) for (text, linked, _, inside, e), bad in zip(read.lines, _furniture(read), strict=True)]
    parents, element = read.parents, [line[4] for line in found]
    length = [0 if bad or listed else len(text) for (text, _, bad, _, _), listed in zip(found, _listed(found, parents), strict=True)]
    hint = [len(text) if inside and not bad else 0 for text, _, bad, inside, _ in found]
    if any(hint):
        outside = [0 if inside else n for n, (_, _, _, inside, _) in zip(length, found, strict=True)]
        beside = _beside_hint(outside, hint, element, parents)
        if beside is not None:
            return " ".join(line[0] for line, n, m in zip(found, hint, beside, strict=True) if n or m)
    length = _flat(length, element, parents, read.names)
    return " ".join(found[i][0] for a, b, _ in _regions(length) for i in range(a, b) if length[i])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
