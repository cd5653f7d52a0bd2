"""Layout-aware text of web pages: a tree of elements with implied tags, rendered with block spacing, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_pandas

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript iframe object audio video canvas datalist title desc defs metadata annotation annotation-xml".split())
TABLE_PARTS = set("table tbody thead tfoot tr".split())
IN_TABLE = TABLE_PARTS | set("td th caption colgroup col".split())
#: What may stand between the parts of a table without being moved out before it.
STAYS = IN_TABLE | {"script", "style", "template"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul caption".split())
#: Blocks with an empty line before and after.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre figure table hr".split())
HEAD_ONLY = set("base link meta title style script".split())
# An opening tag closes these open elements, looked for up to the scope elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "colgroup": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
CLOSE_P = (BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "dt", "dd", "li"}) | {"li", "dt", "dd"}
BARRIER = {"table", "td", "th", "caption", "html", "button", "object", "template"}
#: A column is padded to this width at most; a wider cell shifts the rest of its row.
COLUMN = 200
#: Tables nested deeper than this show their cells one below another instead of in columns.
NESTED_TABLES = 60
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    """An element with its children, elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree: html, head and body are implied, as are the ends of paragraphs, list items and table parts. What does not belong between the parts of a table goes before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.body: Node | None = None
        self.stack = [self.root]
        self.open: Counter = Counter()  # of the tags on the stack, so that deep pages are not searched for what is not there

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1

    def _cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _close_within(self, tags: set[str], scope: set[str]) -> None:
        i = len(self.stack) - 1
        while i > 0 and any(self.open[t] for t in tags):
            if self.stack[i].tag in scope:
                return
            if self.stack[i].tag in tags:
                self._cut(i)
                if len(tags) == 1:
                    return
            i -= 1

    def _need_body(self) -> None:
        if self.body is None:
            self.body = Node("body", {})
            self.root.children.append(self.body)
            self._cut(1)
            self._push(self.body)

    def _before_table(self, child: Node | str) -> None:
        """Puts a child before the innermost open table."""
        at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == "table" or i == 0)
        siblings = self.stack[max(0, at - 1)].children
        place = next((i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is self.stack[at]), len(siblings))
        siblings.insert(place, child)

    def _leave_colgroup(self, foreign: bool) -> None:
        """What does not belong into a column group ends it."""
        if foreign and self.stack[-1].tag == "colgroup":
            self._cut(len(self.stack) - 1)

    def _open(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        if self.stack[-1].tag in TABLE_PARTS and self.open["table"] and tag not in STAYS:
            if tag == "form":  # a form between table parts holds nothing
                return
            self._before_table(node)
        else:
            self.stack[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        if tag == "html":
            self.root.attrs |= known
            return
        if tag == "body":
            self._need_body()
            self.body.attrs |= known
            return
        if tag == "head":
            if self.body is None and len(self.stack) == 1:
                self._open("head", known)
            return
        if self.body is None and not (tag in HEAD_ONLY or any(n.tag in HIDDEN for n in self.stack)):
            self._need_body()
        self._leave_colgroup(tag not in ("col", "template"))
        if tag == "table" and self.stack[-1].tag in TABLE_PARTS and self.open["table"]:  # a table straight within table parts ends the one it stands in
            self._cut(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == "table"))
        if tag in IN_TABLE - {"table"} and self.open["table"]:  # back to the table from what was put before it
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag in IN_TABLE)
            if self.stack[at].tag in TABLE_PARTS:
                self._cut(at + 1)
        if tag in CLOSE_P:
            self._close_within({"p"}, BARRIER)
        if tag in CLOSES:
            self._close_within(*CLOSES[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._open("tr", {})
        self._open(tag, known)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack[-1].tag == tag and (self.open["svg"] or self.open["math"]):  # there, a closed tag has no content
            self._cut(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._need_body()
            self._open("br", {})
            return
        if tag == "p" and not self.open["p"]:
            self._need_body()
            self._open("p", {})
        if not self.open[tag]:
            return
        scope = BARRIER - {tag} if tag not in ("table", "html") else set()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if self.stack[i] is not self.body:
                    self._cut(i)
                return
            if self.stack[i].tag in scope and tag not in ("tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.body is None:
            if self.stack[-1].tag in HIDDEN - {"head"}:
                self.stack[-1].children.append(data)
                return
            if not data.strip(" \t\n\r\f"):
                return
            self._need_body()
        self._leave_colgroup(bool(data.strip(" \t\n\r\f")))
        if self.stack[-1].tag in TABLE_PARTS and self.open["table"] and data.strip(" \t\n\r\f"):
            self._before_table(data)
        else:
            self.stack[-1].children.append(data)


def _boxless(node: Node) -> bool:
    """Whether an element is not laid out at all, with all that it holds."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return True
    return bool(a.get("style") and _NO_BOX.search(a["style"]))


def _seen(node: Node, seen: bool) -> bool:
    """Whether an element's own text shows, given whether its parent's does: visibility is inherited, and a child may turn it on again."""
    own = _VISIBILITY.search(node.attrs.get("style") or "")
    return seen if not own or own[1].lower() in ("inherit", "unset") else own[1].lower() not in ("hidden", "collapse")


def _laid_out(node: Node) -> list:
    """The children of an element that are laid out: of closed details only the first summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of text in the making, with white space collapsed and at most one empty line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap = "", False, 0

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in more:
                self.feed()
                self._add(x)
            return
        words = _SPACE.split(data)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                self._add((" " if self.space and self.line else "") + word)
                self.space = False

    def _add(self, text: str) -> None:
        if text:
            if not self.line and self.lines and self.gap:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line += text

    def feed(self) -> None:
        """Ends the line, even an empty one."""
        if self.line or self.lines:
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def block(self, gap: int) -> None:
        """Ends the line if it has text; asks for ``gap`` line ends before the next text."""
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False
        self.gap = max(self.gap, gap)

    def rows(self, lines: list[str]) -> None:
        for x in lines:
            self.block(1)
            self._add(x)
        self.block(1)

    def done(self) -> list[str]:
        self.block(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _table_rows(node: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    for child in node.children:
        if isinstance(child, Node) and not _boxless(child):
            if child.tag == "tr":
                yield child, _seen(child, seen)
            elif child.tag in ("tbody", "thead", "tfoot"):
                yield from _table_rows(child, _seen(child, seen))


def _render_table(node: Node, seen: bool, nested: int) -> list[str]:
    """Cells in columns, padded to the widest, two spaces apart; the lines of a cell stay below one another."""
    lines: list[str] = []
    for child in node.children:
        if isinstance(child, Node) and child.tag == "caption" and not _boxless(child):
            lines += _render(child, _seen(child, seen), nested)
    table: list[list[list[str]]] = []
    below: dict[int, int] = {}
    for row, row_seen in _table_rows(node, seen):
        cells: list[list[str]] = []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and not _boxless(cell):
                while below.get(len(cells), 0):
                    below[len(cells)] -= 1
                    cells.append([])
                span = [int(v) if (v := cell.attrs.get(k) or "").isdecimal() and 0 < int(v) < 1000 else 1 for k in ("colspan", "rowspan")]
                for i in range(span[0]):
                    if span[1] > 1:
                        below[len(cells)] = span[1] - 1
                    cells.append(_render(cell, _seen(cell, row_seen), nested) if i == 0 else [])
        table.append(cells)
    widths: dict[int, int] = {}
    for cells in table:
        for i, cell in enumerate(cells):
            widths[i] = min(COLUMN, max([widths.get(i, 0), *map(_width, cell)]))
    for cells in table:
        for k in range(max(map(len, cells), default=0)):
            line = "".join((x := cell[k] if k < len(cell) else "") + " " * max(2, widths[i] - _width(x) + 2) for i, cell in enumerate(cells))
            lines.append(line.rstrip())
    return [x for x in lines if x]


LISTS = ("ul", "ol", "menu", "dir")


def _render(top: Node, seen: bool = True, nested: int = 0) -> list[str]:
    """The visible lines of an element, without recursion over its inline and block children."""
    page = _Page()
    todo: list = [(iter(_laid_out(top)), top, seen, None)]
    inside = Counter([top.tag])
    counts: list[int | None] = []
    while todo:
        children, parent, seen, after = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            inside[parent.tag] -= 1
            if after:
                after()
            continue
        if isinstance(child, str):
            if seen and (parent.tag not in TABLE_PARTS | {"ul", "ol"} or child.strip()):
                page.text(child, inside["pre"] + inside["textarea"] > 0)
            continue
        if _boxless(child):
            continue
        tag, own = child.tag, _seen(child, seen)
        after = None
        if tag == "br":
            page.feed()
        elif tag == "img":
            page.text((child.attrs.get("alt") or "") if own else "", False)
        elif tag == "table" and nested < NESTED_TABLES:
            page.block(2)
            page.rows(_render_table(child, own, nested + 1))
            page.block(2)
        else:
            if tag in BLOCK:
                gap = 2 if tag in SPACED and not (tag in LISTS and inside["li"]) else 1
                page.block(gap)
                if tag in LISTS:
                    start = child.attrs.get("start") or "1"
                    counts.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)
                if tag == "li":
                    mark = "- " if not counts or counts[-1] is None else f"{counts[-1]}. "
                    if counts and counts[-1] is not None:
                        counts[-1] += 1
                    if own:
                        page._add("  " * max(0, len(counts) - 1) + mark)

                def after(tag=tag, gap=gap):
                    if tag in LISTS:
                        counts.pop()
                    page.block(gap)

            inside[tag] += 1
            todo.append((iter(_laid_out(child)), child, own, after))
    return page.done()


def html_to_text(html: str | None) -> str:
    """The visible text of a page. Null and empty pages have none; broken markup is read as a browser would close it."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\0", ""))
    builder.close()
    return "\n".join(_render(builder.root))


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html; more columns are ignored) to (page_id, url, text, n_lines), one row per row.

    A null html gives an empty text; repeated rows are rendered alike; an empty table gives no rows. Each page
    is rendered on its own, whole, whatever its length.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [html_to_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]})

    return map_pandas(pages.select("page_id", "url", "html"), of, "text string, n_lines long", "page_id", "url")
