"""HTML extraction by layout-aware rendering.

A tokenizer reads tags, comments and character data; a tree builder adds the tags that HTML implies (head, body, tbody, ends of p, li,
dt, dd, tr, td, th, option and headings) and closes what is left open. The renderer walks the tree without recursion and emits all visible
text: script, style, head, templates and the like have none, nor have elements hidden by attribute or inline style. White space collapses
except in pre and textarea; blocks stand on lines of their own, with a blank line around paragraphs, headings, lists and tables; list items
get marks, indented by depth (`INDENT` characters at most); cells of a table row are padded to the width of their column, so that columns line up, spanning
cells (colspan, rowspan) included; what stands in a table, its sections or its rows but in no cell goes before the rows. A column is `WIDTH` characters wide at most:
after a cell that is wider, the row goes on in a new line, in its columns. Columns that would begin beyond `LINE` characters are set apart by two spaces only,
and tables inside of more than `NEST` others are rendered as blocks, their cells set apart by spaces.
Every page takes time in proportion to its length, save for columns taken by rowspans of many rows at once.

Defined results: null and empty pages render as the empty text; text outside any tag is visible; unknown tags are inline; anything
that isn't well formed still renders: a tag ends at the first > that no quoted attribute holds, at the first of all where that is none, and where
no > follows, < is text. Every row, repeated ones and those with a null id as well, gets a row; an empty table gives an empty one. Columns other than
the key and the page aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidied

TOKEN = re.compile(r"<!--|<[!?]|</\s*([a-zA-Z][^\s>/]*)|<([a-zA-Z][^\s>/]*)")
QUOTED = re.compile(r"""=\s*+(?:"[^"]*"|'[^']*')""")
REST = re.compile(r"""(?:[^>"'=]|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+>""")
ATTRS = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Searched in the text itself: lower-casing can change its length.
ENDS = {t: re.compile("</" + t, re.I | re.A) for t in RAW}
GONE = frozenset("head script style template noscript title meta link base iframe object embed svg math canvas audio video map datalist dialog noembed noframes select".split())
BLOCK = frozenset("address article aside blockquote body center details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul tr caption tbody thead tfoot option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(["td", "th"])
SECTIONS = frozenset(["tbody", "thead", "tfoot", "tr"])
#: A start tag closes open elements of the second set, up to one of the third.
CLOSES = {
    **{t: (frozenset(["p"]), frozenset(["table", "td", "th", "button"])) for t in BLOCK - {"li", "dt", "dd", "tr", "tbody", "thead", "tfoot", "option", "body", "html", "caption"}},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "table"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\r\n\f]+")
INDENT, WIDTH, LINE, NEST = 80, 120, 2000, 200


class Node:
    __slots__ = ("tag", "hidden", "start", "cols", "rows", "children")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, cols: int = 1, rows: int = 1):
        self.tag, self.hidden, self.start, self.cols, self.rows, self.children = tag, hidden, start, cols, rows, []


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.push(root)

    def push(self, node: Node):
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def add(self, node: Node):
        """Opens an element in the current one."""
        self.nodes[-1].children.append(node)
        self.push(node)

    def cut(self, k: int):
        while len(self.nodes) > k:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, ends, until):
        """Closes the open elements of tags `ends`, down to the last one of tags `until`."""
        floor = max(1, self.last(until))
        first = len(self.nodes)
        for t in ends:
            places = self.places.get(t)
            if places and places[-1] > floor:
                first = min(first, places[bisect_right(places, floor)])
        self.cut(first)


class _Tags:
    """Ends of start tags; remembers from where no > follows outside quotes, so that no page is searched again and again."""

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.lost: list[tuple[int, list[int], list[int]]] = []

    def end(self, at: int) -> int:
        for begin, starts, ends in self.lost:
            k = bisect_right(starts, at) - 1
            if at >= begin and (k < 0 or at >= ends[k]):
                return self.text.find(">", at) + 1
        m = REST.match(self.text, at)
        if m:
            return m.end()
        spans = [q.span() for q in QUOTED.finditer(self.text, at)]
        self.lost.append((at, [x for x, _ in spans], [x for _, x in spans]))
        return self.text.find(">", at) + 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRS.finditer(text)}


def _number(value: str, most: int) -> int:
    return min(most, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value, re.A) else 1


def _open(tag: str, attrs: str) -> Node:
    if not attrs or attrs == "/":
        return Node(tag)
    a = _attributes(attrs)
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", ""))) or tag == "input" and a.get("type") == "hidden"
    start = a.get("start", "1") if tag == "ol" else "1"
    node = Node(tag, hidden, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1)
    if tag in CELLS:
        node.cols, node.rows = _number(a.get("colspan", "1"), 1000), _number(a.get("rowspan", "1"), 65_534)
    if tag == "img" and a.get("alt"):
        node.children.append(a["alt"])
    return node


def parse(text: str) -> Node:
    root = Node("html")
    stack = _Open(root)
    nodes = stack.nodes
    tags = _Tags(text)
    stage = "start"  # before the head, in it, after it

    def enter(tag: str) -> Node:
        nonlocal stage
        stack.cut(1)
        stage = tag
        node = Node(tag)
        stack.add(node)
        return node

    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if m and m[2] and m.start() > tags.last:
            m = None
        chars = text[at : m.start() if m else n]
        if chars and (stage == "body" or chars.strip()):
            if stage != "body":
                enter("body")
            nodes[-1].children.append(html.unescape(chars))
        if not m:
            break
        if not m[2]:
            end = text.find("-->", m.start() + 2) + 2 if m[0] == "<!--" else text.find(">", m.end())
            at = end + 1 if end > 1 else n
        if m[2]:
            at = tags.end(m.end())
            attrs = text[m.end() : at - 1]
            tag = m[2].lower()
            if tag == "html":
                continue
            if tag == "head":
                if stage == "start":
                    enter("head")
                continue
            if tag == "body":
                if stage != "body":
                    enter("body").hidden = _open(tag, attrs).hidden
                continue
            if stage != "body" and tag in IN_HEAD:
                if stage == "start":
                    enter("head")
            elif stage != "body":
                enter("body")
            closes = CLOSES.get(tag)
            if closes:
                stack.close(*closes)
                if tag in HEADINGS and nodes[-1].tag in HEADINGS:
                    stack.cut(len(nodes) - 1)
            if tag == "tr" and nodes[-1].tag == "table":
                stack.add(Node("tbody"))
            elif tag in CELLS and nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if nodes[-1].tag == "table":
                    stack.add(Node("tbody"))
                stack.add(Node("tr"))
            node = _open(tag, attrs)
            if tag in RAW:
                nodes[-1].children.append(node)
                end = ENDS[tag].search(text, at)
                end = end.start() if end else n
                inner = text[at:end]
                if tag in ("textarea", "title"):
                    node.children.append(html.unescape(inner))
                close = text.find(">", end)
                at = n if close < 0 else close + 1
            elif tag in VOID:
                nodes[-1].children.append(node)
            else:
                stack.add(node)
        elif m[1]:
            tag = m[1].lower()
            if tag == "head" and stage == "head":
                stack.cut(1)
                stage = "after"
            elif tag not in ("html", "body"):
                k = stack.last((tag,))
                inside = tag in CELLS or tag in SECTIONS or tag == "table" or stack.last(("table", "td", "th")) < k
                if k > 0 and inside and (stage != "body" or k > 1):
                    stack.cut(k)
    return root


class _Flow:
    """Lines of text; knows whether a space or a blank line is due."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str, pre: bool):
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            if first:
                self._put(first)
            for x in rest:
                self.line(always=True)
                if x:
                    self._put(x)
            return
        t = SPACE.sub(" ", s)
        if t == " ":
            self.space = self.space or bool(self.now)
            return
        if t[0] == " ":
            self.space = bool(self.now)
            t = t[1:]
        end = t[-1] == " "
        self._put(t[:-1] if end else t)
        self.space = end

    def _put(self, t: str):
        if self.blank:
            if self.lines:
                self.lines.append("")
            self.blank = False
        if not self.now:
            self.now.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(t)

    def line(self, always: bool = False):
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        elif always and self.lines and not self.blank:
            self.lines.append("")
        self.space = False

    def gap(self):
        self.line()
        self.blank = bool(self.lines)


def _holders(table: Node) -> set[int]:
    """Ids of the elements inside a table, not inside its cells, that hold rows or cells somewhere."""
    out, up, todo = set(), {}, [table]
    while todo:
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, Node) or c.hidden or c.tag in GONE or c.tag == "table":
                continue
            if c.tag in CELLS or c.tag in SECTIONS:
                k = node
                while k is not None and id(k) not in out:
                    out.add(id(k))
                    k = up.get(id(k))
            if c.tag not in CELLS:
                up[id(c)] = node
                todo.append(c)
    return out


def _parts(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """Rows of cells of a table, and divs of all else: one of what stands in the table itself, then one for each row or section.

    Elements around rows or cells, such as forms, are looked through.
    """
    holders = _holders(table)
    rows: list[list[Node]] = [[]]
    strays = [Node("div")]
    # what stands there, and the row and the div that it belongs to
    todo: list = [(c, rows[0], strays[0]) for c in reversed(table.children)]
    while todo:
        node, row, stray = todo.pop()
        if not isinstance(node, Node):
            stray.children.append(node)
        elif node.hidden:
            continue
        elif node.tag in CELLS:
            row.append(node)
        elif node.tag in SECTIONS or node.tag in ("colgroup", "col") or id(node) in holders and node.tag not in GONE and node.tag not in ("table", "caption"):
            if node.tag in SECTIONS:
                row, stray = [], Node("div")
                rows.append(row)
                strays.append(stray)
            todo += [(c, row, stray) for c in reversed(node.children)]
        else:
            stray.children.append(node)
    return [r for r in rows if r], strays


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """First column, column after the last, and node of each cell."""
    out: list[list[tuple[int, int, Node]]] = []
    busy: list[tuple[int, int, int]] = []  # columns that cells of earlier rows take, and up to which row
    for y, r in enumerate(rows):
        busy = sorted(b for b in busy if b[2] > y)
        new, line, col, k = [], [], 0, 0
        for c in r:
            while k < len(busy) and busy[k][0] < col + c.cols:
                col = max(col, busy[k][1])
                k += 1
            line.append((col, col + c.cols, c))
            if c.rows > 1:
                new.append((col, col + c.cols, min(y + c.rows, len(rows))))
            col += c.cols
        for b in new:
            if busy and busy[-1][1] == b[0] and busy[-1][2] == b[2]:
                busy[-1] = (busy[-1][0], b[1], b[2])
            else:
                busy.append(b)
        out.append(line)
    return out


def _table(table: Node, done: dict[int, list[str]]) -> list[str]:
    """Lines of a table: captions and stray content first, then rows with aligned cells."""
    found, strays = _parts(table)
    out = [x for s in strays for x in _render(s, done)]
    rows = [[(a, b, [x for x in _render(c, done) if x]) for a, b, c in r] for r in _grid(found)]
    starts = sorted({a for r in rows for a, _, _ in r})
    rows = [[(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in r] for r in rows]
    width = [0] * len(starts)
    for several in (False, True):
        for r in rows:
            for a, b, lines in r:
                if (b - a > 1) == several and lines:
                    need = max(map(len, lines)) - (sum(width[a : b - 1]) + 2 * (b - 1 - a) if several else 0)
                    width[b - 1] = max(width[b - 1], min(need, WIDTH))
    left = [0]
    for w in width:
        left.append(left[-1] + (w + 2 if w else 0))
    for r in rows:
        for i in range(max((len(lines) for _, _, lines in r), default=0)):
            line = ""
            for a, _, lines in r:
                if i >= len(lines):
                    continue
                if line and left[a] > LINE:
                    line += "  " + lines[i]
                    continue
                if line and len(line) + 2 > left[a]:
                    out.append(line)
                    line = ""
                line = line.ljust(min(left[a], LINE)) + lines[i]
            if line:
                out.append(line)
    return out


def _tables(root: Node) -> list[Node]:
    """The tables that may be seen, outer ones first."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str) or node.hidden or (node.tag in GONE and node is not root):
            continue
        if node.tag == "table":
            depth += 1
            if depth > NEST:
                continue
            out.append(node)
        todo += [(c, depth) for c in node.children]
    return out


def _render(root: Node, done: dict[int, list[str]]) -> list[str]:
    """Lines of an element. done: those of the tables inside it."""
    flow = _Flow()
    indents: list[str] = []
    # (node, entering); lists: kinds and counters of the lists around
    todo: list = [(root, True)]
    lists: list[list] = []
    pre = 0
    while todo:
        node, entering = todo.pop()
        if isinstance(node, str):
            flow.text(node, pre > 0)
            continue
        tag = node.tag
        if entering:
            if node.hidden or (tag in GONE and node is not root):
                continue
            if tag == "br":
                flow.line(always=True)
                continue
            if tag == "wbr":
                continue
            if tag == "table" and id(node) in done:
                flow.gap()
                lines = done[id(node)]
                if lines:
                    if flow.blank and flow.lines:
                        flow.lines.append("")
                    flow.blank = False
                    flow.lines += [flow.indent + x if x else x for x in lines]
                    flow.gap()
                continue
            if tag in SPACED and not (lists and tag in ("ul", "ol", "p", "menu")):
                flow.gap()
            elif tag in BLOCK:
                flow.line()
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, node.start])
            elif tag == "li":
                if not lists:
                    lists.append(["ul", 1])
                    node.start = -1
                kind = lists[-1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent = ("  " * (len(lists) - 1))[:INDENT] + " " * len(mark)
                flow.mark = mark
            elif tag == "dd":
                indents.append(flow.indent)
                flow.indent += "  " * (len(flow.indent) < INDENT)
            elif tag in ("td", "th"):
                flow.text(" ", False)
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "q":
                flow.text('"', False)
            todo.append((node, False))
            todo += [(c, True) for c in reversed(node.children)]
            continue
        if tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "q":
            flow.text('"', False)
        elif tag == "dd":
            flow.indent = indents.pop()
        elif tag == "li":
            flow.line()
            flow.mark = ""
            if node.start == -1:
                lists.pop()
            flow.indent = ("  " * len(lists))[:INDENT] if len(lists) > 1 else ""
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            if not lists:
                flow.indent = ""
        if tag in SPACED and not (lists and tag in ("ul", "ol", "p", "menu")):
            flow.gap()
        elif tag in BLOCK:
            flow.line()
    flow.line()
    while flow.lines and not flow.lines[-1]:
        flow.lines.pop()
    return flow.lines


def render(page: str | None) -> str:
    root = parse(page or "")
    done: dict[int, list[str]] = {}
    for table in reversed(_tables(root)):
        done[id(table)] = _table(table, done)
    return "\n".join(_render(root, done))


def extract(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """The key and the text of every row; no shuffle."""

    def run(batches):
        for b in batches:
            out = [render((t.as_py() or b"").decode("utf-8", "replace")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    return texts(pages, key, text=column).withColumn(key, F.col(key).cast("long")).mapInArrow(tidied(run), f"`{key}` long, text string")
