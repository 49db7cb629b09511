"""Layout-aware HTML to text: a tree builder with implied tags, then a renderer.

Pages are cut into tags, comments and text; elements that HTML closes by itself
(paragraphs before blocks, list items, cells, rows, options) are closed, stray
end tags are ignored, and what a page leaves open ends with it. Elements that are
not shown (head, scripts, styles, templates, ``hidden``, ``display:none`` ...)
are left out with all they hold. What is shown is laid out in plain text: blocks
on lines of their own with blank lines where browsers leave space, list items
with bullets or numbers and indents, preformatted text as written, and table cells
padded to columns. Both passes use explicit stacks, so depth is no limit. Where each
open element stands is known by its name, so a stray end tag costs no search, and time
and output are linear in the page: beyond ``DEEPEST`` levels lists and quotations are
not indented any more, and a column is as wide as its widest cell that keeps the
padding of its table within ``PADDING`` times its text and ``WIDEST`` characters a cell.

Defined results: a null page is an empty one and gives an empty text, as does one
with nothing to show. Malformed markup never fails. Repeated rows give repeated
results, as no page depends on another: there are no ties. Only the named columns are read, so others may have any names. A cell that spans rows keeps its columns free in these; ``colspan`` and
``rowspan`` are bounded as in HTML.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST, PADDING, DEEPEST = 60, 4, 12
# Fixed sets of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes audio video canvas datalist desc metadata defs".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption".split()
)
#: Besides blocks, what stands on a line of its own.
LINES = BLOCK | {"option", "optgroup"}
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir hr".split())
CLOSES_P = BLOCK - frozenset("html body dialog caption legend".split())
# An element that starts closes these open ones, up to the nearest of the limits.
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "thead": (frozenset("tr td th thead tbody tfoot caption".split()), frozenset(["table"])),
    "tbody": (frozenset("tr td th thead tbody tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tr td th thead tbody tfoot caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
P_LIMITS = frozenset("table td th caption button object html body".split())
END_LIMITS = frozenset("table td th caption html body".split())
HEAD_PARTS = frozenset("head title meta link base script style template noscript html body".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
HIDDEN = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
ENDS = {t: re.compile(rf"(?i)</{t}(?=[\s/>])[^>]*(?:>|\Z)") for t in RAW}
GAP = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace() or raw == "/":
        return {}
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" and v[:1] else v) for k, v in ATTR.findall(raw)}


def parse(page: str) -> Element:
    """The tree of a page; its root stands for the document."""
    root = Element("")
    stack = [root]
    # Places in the stack of the open elements of each name, from the outermost.
    places: dict[str, list[int]] = {}

    def pop_to(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()

    def innermost(names: frozenset) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=0)

    def find(names: frozenset, limits: frozenset) -> int:
        """Place of the outermost open element of these names above the nearest limit; 0 if none."""
        limit = innermost(limits)
        return min((p[k] for x in names if (p := places.get(x)) and (k := bisect_right(p, limit)) < len(p)), default=0)

    def text(raw: str) -> None:
        if raw:
            if places.get("head") and not raw.isspace():
                pop_to(find(frozenset(["head"]), frozenset()))
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    pos = 0
    while pos < len(page):
        m = TAG.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[1] is not None:
            text(m[1].replace("&", "&amp;"))
            continue
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2] or m[5])
        if closing:
            if tag in VOID and tag != "br" or not places.get(tag):
                if tag == "br":
                    stack[-1].children.append(Element("br"))
                elif tag == "p":
                    stack[-1].children.append(Element("p"))
                continue
            limits = END_LIMITS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else frozenset(["table"]) - {tag}
            if places[tag][-1] > innermost(limits):
                pop_to(places[tag][-1])
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if places.get("head") and tag not in HEAD_PARTS:
            pop_to(find(frozenset(["head"]), frozenset()))
        if tag in CLOSES_P and places.get("p") and (at := find(frozenset(["p"]), P_LIMITS)):
            pop_to(at)
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            if any(places.get(x) for x in names) and (at := find(names, limits)):
                pop_to(at)
        element = Element(tag, _attributes(m[4] if m[3] else m[7]))
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = ENDS[tag].search(page, pos)
            body = page[pos : end.start() if end else len(page)]
            element.children.append(unescape(body) if tag in ("textarea", "title") else body)
            pos = end.end() if end else len(page)
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
    return root


def shown(e: Element) -> bool:
    if e.tag in UNSEEN or "hidden" in e.attrs:
        return False
    return not ("style" in e.attrs and HIDDEN.search(e.attrs["style"]))


class Page:
    """Lines of text as they grow. ``prefix``: what later lines of the block begin with."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.prefix: list[str] = []
        self.mark = ""
        self.gap = self.blank = False

    def inline(self, raw: str) -> None:
        parts = GAP.split(raw)
        if len(parts) == 1:
            if parts[0]:
                self._add(parts[0])
            return
        if parts[0]:
            self._add(parts[0])
        body = [p for p in parts[1:] if p]
        if not body:
            self.gap = True
            return
        self.gap = True
        self._add(" ".join(body))
        if not parts[-1]:
            self.gap = True

    def _add(self, s: str) -> None:
        if self.gap and self.words:
            self.words.append(" ")
        self.gap = False
        self.words.append(s)

    def flush(self) -> None:
        if self.words:
            self._put("".join(self.words))
            self.words = []
        self.gap = False

    def _put(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = "".join(self.prefix[:DEEPEST])
        if self.mark:
            lead = lead[: len(lead) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((lead + s).rstrip())

    def new_line(self) -> None:
        if self.words:
            self.flush()
        elif self.lines and not self.blank:
            self._put("")

    def space(self) -> None:
        self.flush()
        self.blank = True

    def block(self, text: str) -> None:
        for s in text.split("\n"):
            self._put(s)

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def _rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """Captions and the cells of each row that is shown, nested tables left to their cells."""
    captions, rows, stack = [], [], [iter(table.children)]
    loose: list[Element] | None = None
    while stack:
        e = next(stack[-1], None)
        if e is None:
            stack.pop()
        elif isinstance(e, str):
            if not e.isspace():
                cell = Element("td")
                cell.children.append(e)
                captions.append(cell)
        elif not shown(e):
            continue
        elif e.tag == "tr":
            cells = []
            for c in e.children:
                if isinstance(c, str):
                    if c.isspace():
                        continue
                    cell = Element("td")
                    cell.children.append(c)
                    c = cell
                if shown(c):
                    cells.append(c)
            rows.append(cells)
            loose = None
        elif e.tag in ("td", "th"):
            if loose is None:
                loose = []
                rows.append(loose)
            loose.append(e)
        elif e.tag in ("thead", "tbody", "tfoot"):
            stack.append(iter(e.children))
        else:
            captions.append(e)
    return captions, rows


def _span(e: Element, name: str, most: int) -> int:
    v = e.attrs.get(name, "1")
    return min(max(int(v[:9]), 1), most) if v.isascii() and v.isdigit() else 1


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """The lines of a table from its cells (text, columns, rows), each column padded to one width.

    Cells that span rows keep at most ``PADDING`` places free for each cell of the table; further ones span none.
    """
    budget = PADDING * sum(map(len, rows))
    # Cells with the columns they begin at; columns that a cell above takes are passed.
    placed: list[list[tuple[int, int, str]]] = []
    taken: list[tuple[int, int, int]] = []  # (first column, end, last row) of cells that span rows, in order
    for y, row in enumerate(rows):
        taken = [t for t in taken if t[2] >= y]
        line, more, at, k = [], [], 0, 0
        for text, columns, height in row:
            while k < len(taken) and taken[k][0] < at + 1:
                at = max(at, taken[k][1])
                k += 1
            line.append((at, columns, text))
            last = min(y + height, len(rows)) - 1
            if last > y and (last - y) * columns <= budget:
                budget -= (last - y) * columns
                more.append((at, at + columns, last))
            at += columns
        taken = sorted(taken + more)
        placed.append(line)
    cells = [(at, len(text)) for line in placed for at, columns, text in line if columns == 1]
    bound = WIDEST + PADDING * sum(n for _, n in cells) // max(1, len(cells))
    widths: dict[int, int] = {}
    for at, n in cells:
        if n <= bound:
            widths[at] = max(widths.get(at, 0), n)
    order = sorted(widths)
    out = []
    for line in placed:
        if not any(text for _, _, text in line):
            continue
        parts, k = [], 0
        for at, columns, text in line:
            while k < len(order) and order[k] < at:  # columns that a cell above takes, or no cell
                parts.append(" " * widths[order[k]])
                k += 1
            while k < len(order) and order[k] < at + columns:
                k += 1
            parts.append(text.ljust(widths.get(at, 0) if columns == 1 else 0))
        out.append("  ".join(parts).rstrip())
    return out


def render(root: Element) -> str:
    """The text that a tree shows."""
    # Steps wait on a stack: an element to enter, one to leave, or a table whose parts have been rendered.
    out = Page()
    todo: list[tuple[str, object, Page]] = [("enter", root, out)]
    counters: list[list] = []
    while todo:
        step, e, page = todo.pop()
        if step == "enter":
            if isinstance(e, str):
                page.inline(e)
                continue
            if not shown(e):
                continue
            tag = e.tag
            if tag == "br":
                page.new_line()
                continue
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and counters):
                page.space()
            elif tag in LINES:
                page.flush()
            if tag == "pre":
                raw, stack = [], [iter(e.children)]
                while stack:
                    c = next(stack[-1], None)
                    if c is None:
                        stack.pop()
                    elif isinstance(c, str):
                        raw.append(c)
                    elif c.tag == "br":
                        raw.append("\n")
                    elif shown(c):
                        stack.append(iter(c.children))
                body = "".join(raw).replace("\r\n", "\n").strip("\n")
                if body.strip():
                    page.block(body)
                page.space()
                continue
            if tag == "table":
                captions, rows = _rows(e)
                parts = [(c, Page()) for c in captions]
                cells = [[(c, Page()) for c in row] for row in rows]
                todo.append(("table", (parts, cells), page))
                for c, p in [*parts, *(x for row in cells for x in row)]:
                    todo.extend(("enter", k, p) for k in reversed(c.children))
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                start = e.attrs.get("start", "1")
                counters.append([tag, int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1])
            elif tag == "li":
                mark = "- "
                if counters and counters[-1][0] == "ol":
                    mark = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                page.prefix.append(" " * len(mark))
                page.mark = mark
            elif tag in ("dd", "blockquote"):
                page.prefix.append("  ")
            todo.append(("leave", e, page))
            todo.extend(("enter", c, page) for c in reversed(e.children))
        elif step == "leave":
            tag = e.tag
            if tag in LINES:
                page.flush()
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            elif tag == "li":
                page.prefix.pop()
                page.mark = ""
            elif tag in ("dd", "blockquote"):
                page.prefix.pop()
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and counters):
                page.space()
        else:
            parts, cells = e
            for _, p in parts:
                if t := p.text():
                    page.block(t)
            for line in _aligned([[(" ".join(p.text().split("\n")).strip(), _span(c, "colspan", 1000), _span(c, "rowspan", 65534)) for c, p in row] for row in cells]):
                page.block(line)
            page.space()
    return out.text()


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "text": [extract(h) for h in frame["html"]]})

    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInPandas(run, f"id {pages.schema[id_col].dataType.simpleString()}, text string")
