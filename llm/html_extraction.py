"""The main text of web pages by tree scoring.

1. *Tree.*  Block elements form a tree; missing end tags are filled in the usual way (a paragraph ends where a block begins, a cell where
   the next one does).  Inline elements only mark links, comments and scripts are passed over.  Text between two block tags is a block.
2. *Left out at once:* menus, headers and footers of the page, sidebars, forms and the like by their tags, roles and ``hidden``; adverts, notices and reader
   comments by the words in their class or id.  If nothing were left, the words in class and id don't count.
3. *Points.*  A block of text has a point, one for each comma and one for each 100 characters, less its share of link text.  They go to the element around it,
   half to the next and 1 / (3 * level) beyond, for ``LEVELS`` levels.  An element's score is its points less its own share of links.
4. *Choice.*  The element with the best score (of equal ones the first) is the container; an ``article`` around it takes its place, and so does what it is a row, list or item of, or an element of
   whose points it has less than half.  Siblings that score well, and paragraphs and titles beside it, stay.  Lists in it that are mostly links go.

Character references are decoded (``html.unescape``); runs of white space, as Unicode has it and no-break spaces included, become one space; blocks are joined by one space in page
order.  Null and empty pages, and those without text, give an empty text.  An unclosed comment or script lasts to the end of the page; an unclosed tag is text.
Rows pass through one by one, repeated ones too; a column of the result's name is replaced, others pass; an empty table gives no rows.  A page is
handled whole, in time proportional to its length for all but deeply broken nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 6
KEEP = 0.2  # of the best score, for siblings
LINK_LIST = 0.75
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = set("aside audio button canvas dialog footer form head iframe menu nav noscript object search select svg template textarea video".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = set("p pre blockquote li dd dt td th figcaption summary".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = PARAGRAPHS - {"td", "th"} | set("dl figure ol tbody tfoot thead tr ul".split())  # never the container itself
LISTS = set("ul ol dl table div section".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOISE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation"
    " newsletter notice notices overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT = set("article body content entry main post story text".split())
#: start tag -> open elements that it ends, and those beyond which it doesn't look
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= {"tr": ({"tr"}, {"table"})} | {x: ({"thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
SCOPE = {"table", "td", "th", "caption", "html", "template"}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.IGNORECASE) for x in RAW}
_NAMED = re.compile(r"\b(class|id|role|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMA = re.compile("[,，、،]")
_SENTENCE = re.compile("[.!?。！？…][\"'»”)]*$")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


@dataclass
class Block:
    node: int
    text: str
    links: int  # characters of link text
    points: float


@dataclass
class Page:
    """Elements by number, parents before children; ``hinted``: left out for the words in its class or id."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [0])
    out: list[bool] = field(default_factory=lambda: [False])
    hinted: list[bool] = field(default_factory=lambda: [False])
    blocks: list[Block] = field(default_factory=list)


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): ``text``, ``start`` and ``end`` in page order."""
    at, tag = 0, _TAG
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            break
        after = html[begin + 1 : begin + 2]
        if after.isalpha() or after == "/" and html[begin + 2 : begin + 3].isalpha():
            found = tag.match(html, begin)
            if found is None and tag is _TAG:  # a quote or tag isn't closed: from here on quotes don't count
                tag = _PLAIN_TAG
                found = tag.match(html, begin)
            if found is None:  # no > in the rest
                break
            yield "text", html[at:begin], ""
            end, name, attributes = found.groups()
            name, at = name.lower(), found.end()
            yield ("end" if end else "start"), name, attributes
            if name in RAW and not end:
                closing = _RAW_END[name].search(html, at)
                at = closing.end() if closing else len(html)
                yield "end", name, ""
        elif after in ("!", "?", "/"):
            yield "text", html[at:begin], ""
            comment = html.startswith("<!--", begin)
            close = begin + 4 if html.startswith(("<!-->", "<!--->"), begin) else html.find("-->" if comment else ">", begin + 4 if comment else begin)
            at = len(html) if close < 0 else html.find(">", close) + 1
        else:
            yield "text", html[at : begin + 1], ""
            at = begin + 1
    yield "text", html[at:], ""


def _noisy(names: str) -> bool:
    """Whether class names or an id say that an element isn't part of the text."""
    noisy = False
    for name in names.split():
        words = [w.lower() for w in _PART.findall(name)]
        if words and words[0] not in ("has", "with", "no", "without"):
            if words[0] in NOISE or words[-1] in NOISE:
                noisy = True
            elif CONTENT.intersection(words):
                return False
    return noisy


def _parse(html: str) -> Page:
    page, stack, opened = Page(), [0], Counter()
    held: list[str] = []
    links, link_from = 0, 0  # link_from: how deep the stack was where the open link began; 0 for none

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(held)).split())
        if text:
            share = min(1.0, links / len(text))
            page.blocks.append(Block(stack[-1], text, min(links, len(text)), (1 + len(_COMMA.findall(text)) + len(text) / 100) * (1 - share)))
        held.clear()
        links = 0

    def pop(to: int) -> None:
        """Close elements until the stack has ``to``."""
        nonlocal link_from
        while len(stack) > to:
            opened[page.tag[stack.pop()]] -= 1
        if len(stack) < link_from:
            link_from = 0

    def find(wanted: set[str], stop: set[str]) -> int:
        """Where the innermost open element of ``wanted`` is in the stack; 0 if none is before one of ``stop``."""
        if any(opened[x] for x in wanted):
            for i in range(len(stack) - 1, 0, -1):
                name = page.tag[stack[i]]
                if name in wanted:
                    return i
                if name in stop:
                    return 0
        return 0

    for kind, value, attributes in _tokens(html):
        if kind == "text":
            if value:
                held.append(value)
                if link_from:
                    links += len(unescape("".join(value.split())))
            continue
        if kind == "end":
            if value == "a":
                link_from = 0
            if opened[value]:
                at = find({value}, SCOPE - {value} if value in BLOCKS or value in LEFT_OUT else BLOCKS)
                if at:
                    flush()
                    pop(at)
            continue
        if value == "br":
            held.append(" ")
        elif value == "a":
            link_from = len(stack)
        named = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
        hidden = bool(named) and (named.get("role", "").lower() in ROLES or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower())
        hidden = hidden or "hidden" in attributes.lower() and bool(_HIDDEN.search(_QUOTED.sub("", attributes)))
        names = f"{named.get('class', '')} {named.get('id', '')}" if value not in ("html", "body", "main", "article") or "comment" in attributes else ""
        noisy = _noisy(names)
        if value in VOID or value in ("svg", "math") and attributes.endswith("/"):
            if value == "hr":
                flush()
            continue
        if not (value in BLOCKS or value in LEFT_OUT or hidden or noisy):
            continue  # inline
        if value in BLOCKS:
            flush()
            at = find({"p"}, SCOPE)
            if at:
                pop(at)
            if value in HEADINGS and page.tag[stack[-1]] in HEADINGS:
                pop(len(stack) - 1)
            at = find(*ENDS[value]) if value in ENDS else 0
            if at:
                pop(at)
        else:
            flush()
        top = stack[-1]
        within = opened["article"] or opened["main"]
        noisy = noisy or not within and "header" in _PART.findall(names.lower())[-1:]
        page.tag.append(value)
        page.parent.append(top)
        page.out.append(page.out[top] or value in LEFT_OUT or hidden or value == "header" and not within)
        page.hinted.append(page.hinted[top] or noisy)
        stack.append(len(page.tag) - 1)
        opened[value] += 1
    flush()
    return page


def main_text(html: str | None) -> str:
    page = _parse(html or "")
    left = [b for b in page.blocks if not page.out[b.node]]
    blocks = [b for b in left if not page.hinted[b.node]] or left
    if not blocks:
        return ""
    n, tag, parent = len(page.tag), page.tag, page.parent
    points, total, length, links, chained = [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
    for b in blocks:
        length[b.node] += len(b.text)
        links[b.node] += b.links
        chained[b.node] += b.links > 0
        if tag[b.node] in HEADINGS:
            continue
        total[b.node] += b.points
        at = parent[b.node] if tag[b.node] in PARAGRAPHS else b.node
        for level in range(LEVELS):
            points[at] += b.points / (1, 2, *(3 * k for k in range(2, LEVELS)))[level]
            if not at:
                break
            at = parent[at]
    for x in range(n - 1, 0, -1):
        for sums in (total, length, links, chained):
            sums[parent[x]] += sums[x]
    score = [p * (1 - links[x] / length[x]) if length[x] else 0.0 for x, p in enumerate(points)]
    best = max(range(n), key=lambda x: (score[x] * (1.25 if tag[x] in ("article", "main") else 1), -x))
    high = score[best]
    if not high:  # titles or links alone
        best = 0
    at = best
    while at and tag[at] != "article":
        at = parent[at]
    best = at or best
    while tag[best] in PARTS:
        best = parent[best]
    while best and 2 * total[best] < total[parent[best]]:
        best = parent[best]

    kept = [x == best for x in range(n)]
    if best:
        about = [0.0] * n
        for b in blocks:  # text of paragraphs beside the container
            if parent[b.node] == parent[best] and b.node != best and (tag[b.node] in HEADINGS or tag[b.node] == "p" and b.links * 4 < len(b.text) and (len(b.text) > 80 or not b.links and _SENTENCE.search(b.text))):
                about[b.node] = 1
        for x in range(1, n):
            if parent[x] == parent[best] and x != best:
                kept[x] = bool(about[x]) or score[x] >= max(10, KEEP * high)
    for x in range(1, n):
        kept[x] = kept[x] or kept[parent[x]] and not (tag[x] in LISTS and x != best and chained[x] >= 3 and links[x] >= LINK_LIST * length[x])
    return " ".join(b.text for b in blocks if kept[b.node])


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html``, with the main text of each."""
    fields = [f for f in pages.schema.fields if f.name not in (html, into)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*names, into])

    rows = pages.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col(html).cast("string").alias("page"))
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.StringType())]))
