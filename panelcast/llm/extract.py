"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block element is a line of text, and each change of a structural
container, or a removed part (script, style, menu, form, advert and the like), leaves a valley of
empty lines. An element is removed by its name, or where a whole class or id word names a menu, an
advert and the like, but not if it holds the article or most of the unlinked text. Where the page
marks its article, all lines left inside are the result. Otherwise the lengths of a sliding window
of ``BLOCK`` lines give a distribution over the lines, in which link text weighs nothing: a region
runs from its surge point (the first line whose window rises above zero) to its dive point (the
window falls back to zero). The highest region, all lines of the element around it, and all regions
that come near it are kept.

Defined cases: null and empty html, or html without text, gives the empty string; unclosed and
stray tags, comments and raw text elements are tolerated to the end of the page; pages of any length
are read whole; rows are independent, so repeated rows, null ids and urls and extra columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import ship

BLOCK = 3                      # lines in the sliding window
VALLEY = BLOCK                 # empty lines at a structural border: windows on both sides do not meet
NEAR_PEAK = 0.2                # regions whose highest window reaches this share of the page's highest are kept
# fixed values: element names and the words of class, id and role that mark what is not the article
RAW = "script style noscript template svg iframe object canvas textarea title"
DROPPED = "head nav footer aside select button menu dialog"
PROMPTS = "label legend"        # dropped inside a form only
CONTROLS = "head select button label legend"   # their words are no evidence of an article
BLOCKS = ("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre section article main header figure hr address "
          "details summary fieldset form center body html")
BORDERS = "div section article main header table ul ol dl body figure details form"
HOLDERS = "div form body header"   # containers of blocks; the other borders are blocks of an article themselves
VOID = "area base br col embed hr img input link meta param source track wbr"
ARTICLE = "article main"
MARKED = ("nav menu navbar breadcrumb breadcrumbs sidebar side footer header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo "
          "cookie cookies consent notice gdpr comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe signup "
          "login popup modal widget pagination pager toolbar copyright disclaimer")
REMARKS = "comment comments commentlist reply replies respond disqus cookie cookies consent gdpr"   # may well be longer than the article
PLACES = ("site page main top bottom left right upper lower primary secondary global wrap wrapper container box bar slot block list links link item items area "
          "section inner outer row col unit panel posts post articles stories form")
AROUND_REMARKS = "content thread body text author meta holder entry"   # beside a word of remarks, as in comment-content
CONTENT = "content article post entry story text maintext"
_RAW, _DROPPED, _PROMPTS, _CONTROLS, _BLOCKS, _BORDERS, _HOLDERS, _VOID, _ARTICLE, _MARKED, _REMARKS, _PLACES, _CONTENT, _AROUND = (
    frozenset(x.split()) for x in (RAW, DROPPED, PROMPTS, CONTROLS, BLOCKS, BORDERS, HOLDERS, VOID, ARTICLE, MARKED, REMARKS, PLACES, CONTENT, AROUND_REMARKS))
_NONE, _NAMED, _WORDED, _REMARK = range(4)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)  # a quote counts right after = only
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _words(attrs: str) -> list[str]:
    """The words of class and id."""
    return [word for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id") for word in (m[2] or "").strip("\"'").lower().split()]


def _kind(name: str, attrs: str, in_article: bool, in_form: bool) -> int:
    """Whether an element is something other than the article: by its name, by class, id or role, or as remarks and notices."""
    if name in ("html", "body", "main"):
        return _NONE
    if name in _DROPPED or name == "header" and not in_article or name in _PROMPTS and in_form:
        return _NAMED
    found = _NONE
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "article" and key in ("hidden", "aria-hidden"):
            continue
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return _NAMED
        if key == "role" and value in _ROLES:
            found = max(found, _WORDED)
        if key in ("class", "id"):
            for word in value.split():
                parts = {x for x in re.split(r"[^a-z0-9]+", word) if x}
                marks = parts & _MARKED
                # the whole word must name it: "site-footer" does, "has-sidebar" does not; a "header" inside the article is a part of it
                if marks and parts <= (_MARKED | _PLACES | _AROUND if marks & _REMARKS else _MARKED | _PLACES) and not (in_article and marks == {"header"}):
                    found = max(found, _REMARK if marks & _REMARKS else _WORDED)
    return found if name != "article" or found == _REMARK else _NONE


class Node:
    """An element: ``text`` and ``marked`` are the unlinked characters below it, all and those of articles."""
    __slots__ = ("name", "attrs", "up", "inside", "in_form", "kind", "out", "text", "marked", "first", "last")

    def __init__(self, name: str, attrs: str, up: Node | None):
        self.name, self.attrs, self.up = name, attrs, up
        self.inside = up is not None and (up.inside or up.name in _ARTICLE)
        self.in_form = up is not None and (up.in_form or up.name == "form")
        self.kind = _kind(name, attrs, self.inside, self.in_form)
        self.out, self.text, self.marked, self.first, self.last = False, 0, 0, 0, 0


class Line(NamedTuple):
    text: str                  # empty in a valley
    weight: int                # characters outside links
    article: Node | None       # outermost article or main
    node: Node | None          # innermost border element


def _parse(html: str) -> tuple[list, list[Node]]:
    """Events of a page and its elements: text, None at the end of a line, (True, node) and (False, node)."""
    events: list = []
    nodes: list[Node] = []
    stack: list[Node] = []
    open_names: Counter[str] = Counter()
    at, size = 0, len(html)

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack[-1].name] -= 1
            events.append((False, stack.pop()))

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            events.append(html[at:])
            break
        if m.start() > at:
            events.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name in _BLOCKS:
                events.append(None)
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None) if open_names[name] else None
            if depth is not None:
                close(depth)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name == "br":
            events.append(" ")
            continue
        if name == "body":
            head = next((k for k, x in enumerate(stack) if x.name == "head"), None)  # left open
            if head is not None:
                close(head)
        if name in _BLOCKS:
            events.append(None)
            # a new paragraph or item ends an open one, and with it inline elements left open inside
            ends = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name in _BORDERS or stack[k].name in _DROPPED:
                    break
        if name in _VOID or m[3].endswith("/") and name not in _BLOCKS:
            continue
        nodes.append(Node(name, m[3], stack[-1] if stack else None))
        stack.append(nodes[-1])
        open_names[name] += 1
        events.append((True, nodes[-1]))
    close(0)
    return events, nodes


def _judge(events: list, nodes: list[Node]) -> None:
    """Set ``out`` of the elements to drop: those of a kind, but none that holds the article or most of the unlinked text."""
    text = marked = links = unread = remarks = article = 0
    for e in events:
        if isinstance(e, str):
            if not (links or unread or remarks):
                n = len("".join(e.split()))
                text += n
                marked += n if article else 0
        elif e is not None:
            opened, x = e
            step = 1 if opened else -1
            links += step * (x.name == "a")
            unread += step * (x.name in _CONTROLS)
            remarks += step * (x.kind == _REMARK)
            article += step * (x.name in _ARTICLE)
            x.text, x.marked = (text, marked) if opened else (text - x.text, marked - x.marked)
    for x in nodes:
        if x.kind == _REMARK:
            x.out = text > 0    # nothing else on the page otherwise
        elif x.kind:
            holds = not x.inside and 2 * x.marked > marked if marked else x.kind == _WORDED and 2 * x.text > text
            x.out = not (holds or x.inside and x.kind == _WORDED and 2 * x.text > marked > 0)


def lines_of(html: str) -> list[Line]:
    """Strip markup into lines, with empty ones at valleys."""
    events, nodes = _parse(html)
    _judge(events, nodes)
    lines: list[Line] = []
    text: list[str] = []
    linked = dropped = links = 0
    holders: list[Node] = []   # open border elements
    articles: list[Node] = []

    def flush() -> None:
        nonlocal linked
        line = " ".join(unescape("".join(text)).split())
        if line:
            lines.append(Line(line, max(0, len(line) - linked), articles[0] if articles else None, holders[-1] if holders else None))
        text.clear()
        linked = 0

    for e in events:
        if isinstance(e, str):
            if not dropped:
                text.append(e)
                if links:
                    linked += len(e.strip())
        elif e is None:
            flush()
        else:
            opened, x = e
            structural = x.out or x.name in _BORDERS
            if structural:
                flush()
                x.last = len(lines)
                lines.extend([Line("", 0, None, None)] * VALLEY)
                if opened:
                    x.first = len(lines)
            step = 1 if opened else -1
            dropped += step * x.out
            links += step * (x.name == "a")
            for names, at in ((_BORDERS, holders), (_ARTICLE, articles)):
                if x.name in names:
                    at.append(x) if opened else at.pop()
    flush()
    return lines


def _container(lines: list[Line], at: int) -> range:
    """The lines of the element whose blocks belong together with line ``at``."""
    node = lines[at].node
    texts, solid, chars = ([0, *accumulate(f(x) for x in lines)] for f in (lambda x: x.text != "", lambda x: x.weight, lambda x: len(x.text)))

    def sums(r: range) -> tuple[int, int, int]:
        return texts[r.stop] - texts[r.start], solid[r.stop] - solid[r.start], chars[r.stop] - chars[r.start]

    while node is not None:
        up = node.up
        while up is not None and up.name not in _BORDERS:
            up = up.up
        own, around = range(node.first, node.last), range(up.first, up.last) if up is not None else range(len(lines))
        n, weight, size = sums(own)
        n_up, weight_up, size_up = sums(around)
        if n_up > n:
            block = node.name not in _HOLDERS or n == 1   # a part of an article, not a container
            page = up is None or up.name == "body"
            named = any(x in _CONTENT for word in _words(node.attrs) for x in re.split(r"[^a-z0-9]+", word))
            if node.name == "body" or named or page and not block or 2 * (weight_up - weight) < size_up - size:
                break
        node = up
    if node is not None and node.name != "body":
        return range(node.first, node.last)
    # the page itself: links before and after all text are no part of it
    found = [k for k in (range(node.first, node.last) if node is not None else range(len(lines))) if lines[k].weight]
    return range(found[0], found[-1] + 1)


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    weight: dict[Node, int] = {}
    for x in lines:
        if x.article is not None:
            weight[x.article] = weight.get(x.article, 0) + x.weight
    if any(weight.values()):   # the page marks its article: all that is inside and not dropped
        return "\n".join(x.text for x in lines if x.text and x.article is not None and weight[x.article])
    total = sum(x.weight for x in lines[:BLOCK])
    window = []                # sums over lines i .. i + BLOCK - 1
    for i in range(len(lines)):
        window.append(total)
        total += (lines[i + BLOCK].weight if i + BLOCK < len(lines) else 0) - lines[i].weight
    peak = max(window, default=0)
    if not peak:
        return ""
    kept: set[int] = set()
    i = 0
    while i < len(window):
        if not window[i]:
            i += 1
            continue
        surge = i
        while i < len(window) and window[i]:
            i += 1
        top = max(range(surge, i), key=window.__getitem__)
        if window[top] < NEAR_PEAK * peak:
            continue
        kept.update(range(surge, i))
        if window[top] == peak:
            heaviest = max(range(top, min(top + BLOCK, len(lines))), key=lambda k: lines[k].weight)
            kept.update(_container(lines, heaviest))
    return "\n".join(lines[k].text for k in sorted(kept) if lines[k].text)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        make, "page_id long, url string, text string, n_chars long")
