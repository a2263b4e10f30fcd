"""Main text of web pages: text-to-tag ratio per line, smoothed and cut by a threshold, over the events of the standard parser.

A line is the text of one block (paragraph, heading, list item, cell, ...); its ratio is the number of characters outside
links by the number of tags since the line before. Ratios are smoothed by a Gaussian kernel; lines above the standard
deviation of the smoothed ratios form the content clusters. The region of a page is what its clusters lie in: the
articles that hold some, else the main element, else the smallest container that holds nearly all of them. Lines of the
region are kept whole and in order, short ones as well. Outside articles, lines that are mostly links go, and so do lines
of containers in which no cluster lies, but for headings.

Never part of the text: what is not shown (scripts, styles, templates, hidden elements, comments of the markup) and
elements that are by tag, role, class or id menus, page headers, footers, sidebars, notices, adverts, forms or comments
of readers. A page on which that leaves nothing is read once more with only the first of these left out.

A null or empty page has an empty text. What is cut off (an open tag, comment or script at the end) gives no text. A line
break inside a block is white space. Repeated rows give repeated results; other columns go along unread. Work is linear
in the length of a page; a task holds one page and its lines at a time.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split())
_CONTAINERS = frozenset("article aside body center details dd div fieldset figure form html main section table tbody td tr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template svg math iframe object canvas video audio head title".split())
_OUT = frozenset("nav menu aside footer form button select option textarea dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset("""ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
breadcrumbs sidebar sidenav aside footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices newsletter subscribe
subscription signup login share sharing social related recommended popup modal overlay pagination pager skip toolbar widget search form""".split())
_READERS = frozenset("comment comments disqus reply replies respond".split())
_HEADERS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ends of open elements that a start tag does not reach over.
_SCOPES = frozenset("ul ol dl table div article section main body td th blockquote".split())
_AGAIN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SPREAD, REACH = 1.0, 2
NEARLY_ALL = 0.8


class _Lines(HTMLParser):
    """Lines of a page and the tree of its elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.unseen, self.out = ["#page"], [-1], [False], [False]
        self.open, self.count = [0], {}
        self.parts, self.tags, self.linked, self.links = [], 0, 0, 0
        self.lines = []  # (text, tags, linked characters, element)

    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                element = self.open[-1]
                while self.tag[element] not in _BLOCKS and element:
                    element = self.parent[element]
                self.lines.append((text, self.tags, min(self.linked, len(text)), element))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _pop(self, to):
        """Close open elements from place ``to`` on."""
        for element in self.open[to:]:
            tag = self.tag[element]
            self.count[tag] -= 1
            self.links -= tag == "a"
        del self.open[to:]

    def _close_same(self, tags):
        if any(self.count.get(t) for t in tags):
            for k in range(len(self.open) - 1, 0, -1):
                tag = self.tag[self.open[k]]
                if tag in tags:
                    self._pop(k)
                    return
                if tag in _SCOPES:
                    return

    def handle_starttag(self, tag, attrs):
        block = tag in _BLOCKS
        if block:
            self.flush()
            if self.count.get("p"):
                self._close_same(("p",))
            if tag in _AGAIN:
                self._close_same(_AGAIN[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        above = self.open[-1]
        unseen, out, named = tag in _UNSEEN, tag in _OUT, False
        inside = bool(self.count.get("article") or self.count.get("main"))
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                unseen = unseen or tag not in ("html", "body")
            elif name == "role" and value:
                out = out or value.strip().lower() in _ROLES
            elif name in ("class", "id") and value:
                words = {w.lower() for w in _TOKEN.findall(value)}
                if words & _READERS if tag in ("article", "main") else tag not in ("html", "body") and words & _NAMES:
                    named = True
                elif words & _HEADERS and not inside and tag not in ("html", "body", "article", "main"):
                    named = True
        if tag == "header" and not inside:
            out = True
        self.tag.append(tag)
        self.parent.append(above)
        self.unseen.append(self.unseen[above] or unseen)
        self.out.append(self.out[above] or out or named)
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        self.tags += 1
        if self.count.get(tag):
            k = len(self.open) - 1
            while self.tag[self.open[k]] != tag:
                k -= 1
            self._pop(k)

    def handle_data(self, data):
        if not self.unseen[self.open[-1]]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def _whole(page: str) -> str:
    """A page without what is cut off at its end; the parser would try such a piece again at every mark in it."""
    start = page.find("<!--", page.rfind("-->") + 3 if "-->" in page else 0)
    if start >= 0:
        page = page[:start]
    end = page.rfind(">") + 1
    cut = re.compile("<[a-zA-Z/!?]").search(page, end)
    return page[:cut.start()] if cut else page


def smoothed(ratios: list[float]) -> list[float]:
    """Ratios under a Gaussian kernel; at the ends its weights are those inside."""
    weights = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(-REACH, REACH + 1)]
    out, n = [], len(ratios)
    for k in range(n):
        total = whole = 0.0
        for d, weight in zip(range(k - REACH, k + REACH + 1), weights):
            if 0 <= d < n:
                total, whole = total + weight * ratios[d], whole + weight
        out.append(total / whole)
    return out


def _within(page: _Lines, is_goal) -> list[int]:
    """The outermost element of the kind asked for around every element, 0 if there is none."""
    goal = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        goal[e] = goal[page.parent[e]] or (e if is_goal(page.tag[e]) else 0)
    return goal


def _container(page: _Lines, content) -> int:
    """The smallest container of two lines or more that holds nearly all content."""
    mass, lines = [0] * len(page.tag), [0] * len(page.tag)
    for k in content:
        text, _, linked, element = page.lines[k]
        mass[element] += len(text) - linked + 1
    for _, _, _, element in page.lines:
        lines[element] += 1
    best = 0
    for e in range(len(page.tag) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        lines[page.parent[e]] += lines[e]
    at = {0}
    for e in range(1, len(page.tag)):  # parents come before their children
        if page.parent[e] in at:
            if page.tag[e] not in _CONTAINERS or mass[e] >= NEARLY_ALL * mass[0]:
                at.add(e)
                if page.tag[e] in _CONTAINERS and lines[e] > 1 and mass[e] >= NEARLY_ALL * mass[0]:
                    best = e
    return best


def _under(page: _Lines, top: int) -> list[bool]:
    out = [e == top for e in range(len(page.tag))]
    for e in range(1, len(page.tag)):
        out[e] = out[e] or out[page.parent[e]]
    return out


def main_text(html: str | None) -> str:
    """The main text of one page: its lines joined by line feeds."""
    if not html:
        return ""
    page = _Lines()
    page.feed(_whole(html))
    page.close()
    page.flush()
    lines = page.lines
    level = smoothed([(len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines])
    mean = sum(level) / max(1, len(level))
    threshold = math.sqrt(sum((x - mean) ** 2 for x in level) / max(1, len(level)))
    shown = [k for k, line in enumerate(lines) if not page.out[line[3]]] or list(range(len(lines)))
    content = [k for k in shown if level[k] >= threshold and lines[k][2] < len(lines[k][0])] or shown
    for kind in ("article", "main"):
        region = _within(page, kind.__eq__)
        held = {region[lines[k][3]] for k in content} - {0}
        if held:
            return "\n".join(lines[k][0] for k in shown if region[lines[k][3]] in held)
    inside = _under(page, _container(page, content))
    chosen = set(content)
    holding = {page.parent[lines[k][3]] for k in content}
    kept = [k for k in shown if inside[lines[k][3]] and (k in chosen or 2 * lines[k][2] < len(lines[k][0]) and (
        page.parent[lines[k][3]] in holding or page.tag[lines[k][3]] in _HEADINGS))]
    return "\n".join(lines[k][0] for k in kept)


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with its html replaced by the main text."""
    from pyspark.sql import types as T

    kept = [k for k, f in enumerate(pages.schema.fields) if f.name not in ("html", text)]
    at_html, names = pages.columns.index("html"), [pages.columns[k] for k in kept] + [text]
    plain = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))])  # inside, columns go by place: names may hold dots

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = pa.array([main_text(h.as_py()) for h in rows.column(at_html)], pa.string())
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], texts], [*[f"c{k}" for k in kept], "text"])

    schema = T.StructType([*[plain.schema.fields[k] for k in kept], T.StructField("text", T.StringType())])
    return plain.mapInArrow(work, schema).toDF(*names)
