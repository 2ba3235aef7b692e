"""Layout-aware HTML rendering to text.

A tree builder with implied tags reads whole pages; a renderer then lays out
what is visible: collapsed white space in lines, blank lines between blocks
with margins, bullets and numbers of lists, indented nesting, preformatted
text as it is, and table cells padded to common columns.

Not visible: head, script, style, template, noscript, media, annotations of
formulas, elements with ``hidden`` or ``display: none``, closed dialogs, closed
details but for their summary, and what is invisible by ``visibility``, which
descendants can take back. Of styles, the style attribute counts. Of svg its text elements show, of a select the chosen option (of a
list box all), of inputs the values of buttons.

Cases: null or empty html gives an empty text. Anything is accepted: stray
ends are ignored, open elements end with their parents or the page. Elements
nest as deep as the page has them. Repeated rows and null ids stay. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object embed audio video canvas annotation annotation-xml datalist noembed noframes param source track area".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr thead tbody tfoot td th xmp".split())
#: Blocks set off by an empty line.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir fieldset xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: An opening tag ends an open one of these, if no element of the second set lies between.
ENDS_P = BLOCK - frozenset("body html dd dt li td th tr thead tbody tfoot caption legend".split())
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
} | {k: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])) for k in ("thead", "tbody", "tfoot")}
#: Elements that end an open head.
IN_HEAD = frozenset("base link meta title script style template noscript".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARATION = re.compile(r"([-\w]+)\s*:((?:\"[^\"]*\"?|'[^']*'?|[^;\"'])*)")
IMPORTANT = re.compile(r"\s*!\s*important\s*$")
#: The most columns and rows of a cell that HTML knows; what is above counts as these.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


class Stack:
    """Open elements, with the places of each tag, so that no look-up walks them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def open(self, tag: str) -> None:
        node = Node(tag)
        self.top.children.append(node)
        self.push(node)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the highest open element of the tags, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def close(self, tags, fence) -> None:
        """End the elements above ``fence`` from the lowest of ``tags`` on."""
        low, found = self.last(fence), []
        for t in tags:
            own = self.places.get(t)
            if own and own[-1] > low:
                found.append(own[bisect(own, low)])
        if found:
            self.cut(min(found))

    def end(self, tag: str, fence) -> None:
        """End the highest element of a tag, unless a fence is above it."""
        at = self.last((tag,))
        if at and at >= self.last(fence):
            self.cut(at)

    def foreign(self) -> bool:
        """Whether the open element is one of svg or math, where a tag can end itself."""
        at = self.last(("svg", "math", "foreignobject"))
        return at > 0 and self.nodes[at].tag != "foreignobject"


def parse(source: str) -> Node:
    """The page's tree under a root node."""
    root = Node("")
    stack = Stack(root)
    at, size = 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        if m is None:  # a lone "<"
            stack.top.children.append(source[at])
            at += 1
            continue
        at = m.end()
        end, tag, attrs, text = m.groups()
        if text is not None:
            if stack.top.tag == "head" and text.strip():
                stack.cut(len(stack.nodes) - 1)
            stack.top.children.append(html.unescape(text))
        elif end is not None:
            end = end.lower()
            if end == "p" and not stack.has("p"):
                stack.top.children.append(Node("p"))
            elif end == "br":
                stack.top.children.append(Node("br"))
            elif end not in ("html", "body"):
                stack.end(end, () if end in ("table", "div", "section", "article", "main", "nav", "footer", "header") else ("table",))
        elif tag is not None:
            tag = tag.lower()
            if stack.top.tag == "head" and tag not in IN_HEAD:
                stack.cut(len(stack.nodes) - 1)
            if tag in ("html", "body") and stack.has(tag):
                continue
            if tag in ENDS_P:
                stack.close(("p",), ("button", "td", "th", "table", "caption", "object"))
            if tag in IMPLIED:
                stack.close(*IMPLIED[tag])
            if tag == "tr" and stack.top.tag == "table":
                stack.open("tbody")
            if tag in ("td", "th") and stack.top.tag in ("table", "tbody", "thead", "tfoot"):
                if stack.top.tag == "table":
                    stack.open("tbody")
                stack.open("tr")
            node = Node(tag, _attributes(attrs) if attrs.strip() else None)
            stack.top.children.append(node)
            if tag in VOID or attrs.endswith("/") and (tag in ("svg", "math", "path") or stack.foreign()):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(source, at)
                body = source[at : stop.start()]
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                at = stop.end()
            elif tag == "plaintext":
                node.children.append(source[at:])
                at = size
            else:
                stack.push(node)
    return root


def styles(source: str) -> dict[str, str]:
    """Properties of a style attribute in lower case; of several the important one counts, else the last."""
    out, fixed = {}, set()
    for name, value in DECLARATION.findall(source):
        name, value = name.lower(), value.strip().lower()
        important = bool(IMPORTANT.search(value))
        if important or name not in fixed:
            out[name] = IMPORTANT.sub("", value)
            if important:
                fixed.add(name)
    return out


def visible(node: Node) -> bool:
    """Whether an element is laid out. Visibility, which its descendants can take back, is settled before."""
    if node.tag in HIDDEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not node.attrs.get("style") or styles(node.attrs["style"]).get("display") != "none"


def _settle(root: Node) -> None:
    """Take out what isn't seen though laid out: text and images of invisible elements, and all but the summary of closed details."""
    todo = [(root, True)]
    while todo:
        node, seen = todo.pop()
        if node.attrs.get("style"):
            how = styles(node.attrs["style"]).get("visibility")
            seen = seen if how in (None, "inherit", "unset") else how not in ("hidden", "collapse")
        children = node.children
        if node.tag == "details" and "open" not in node.attrs:
            children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
        if not seen:
            # Blanks stay: they keep words apart.
            children = [x for x in children if (not x.strip() if isinstance(x, str) else x.tag not in ("img", "input", "hr"))]
        node.children = children
        todo += [(x, seen) for x in children if not isinstance(x, str)]


def _button(node: Node) -> str:
    """What an input shows, if it is a button."""
    kind = node.attrs.get("type", "").strip().lower()
    return node.attrs.get("value", "") if kind in ("submit", "reset", "button") else node.attrs.get("alt", "") if kind == "image" else ""


def _chosen(node: Node) -> list[Node]:
    """The options that a select shows."""
    options, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if not isinstance(child, str) and visible(child):
            if child.tag == "option":
                options.append(child)
            else:
                todo += reversed(child.children)
    if "multiple" in node.attrs or _number(node.attrs.get("size"), 1) > 1:
        return options
    return [x for x in options if "selected" in x.attrs][-1:] or [x for x in options if "disabled" not in x.attrs][:1]


def _labels(node: Node) -> list[Node]:
    """The elements of an svg whose text is drawn."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or not visible(child) or child.tag in ("defs", "symbol", "desc", "metadata"):
            continue
        if child.tag in ("text", "foreignobject"):
            out.append(child)
        else:
            todo += reversed(child.children)
    return out


#: A line: its pieces from the last to the first, so that a margin or mark is put before it in one step; none if it is empty.
Line = list[str]


def _joined(line: Line) -> str:
    return "".join(reversed(line))


class Lines:
    """Lines of one block context: inline text flows into the last line."""

    def __init__(self):
        self.done: list[Line] = []
        self.now: list[str] = []
        self.gap = False  # an empty line is due before the next

    def text(self, s: str) -> None:
        s = BLANKS.sub(" ", s)
        if not self.now or self.now[-1].endswith((" ", "\n")):
            s = s.removeprefix(" ")
        if s:
            self.now.append(s)

    def end_line(self, force: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line or force:
            self.put([[line] if line else []])

    def put(self, lines: list[Line]) -> None:
        if self.gap and self.done:
            self.done.append([])
        self.gap = False
        if self.done:
            self.done += lines
        else:
            self.done = lines  # a nested block's lines are not copied level by level

    def block(self, lines: list[Line], spaced: bool) -> None:
        self.end_line()
        if not lines:
            return
        self.gap |= spaced
        self.put(lines)
        self.gap = spaced

    def finish(self) -> list[Line]:
        self.end_line()
        return self.done


def _flow(node: Node, out: Lines, pre: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                first, *rest = child.expandtabs(8).split("\n")
                out.now.append(first)
                for line in rest:
                    out.end_line(force=True)
                    out.now.append(line)
            else:
                out.text(child)
        elif not visible(child):
            continue
        elif child.tag == "br":
            out.end_line(force=True)
        elif child.tag == "img":
            if child.attrs.get("alt"):
                out.text(child.attrs["alt"])
        elif child.tag == "input":
            out.text(_button(child))
        elif child.tag in ("select", "svg"):
            for part in _chosen(child) if child.tag == "select" else _labels(child):
                out.text(" ")
                if part.attrs.get("label") and part.tag == "option":
                    out.text(part.attrs["label"])
                else:
                    _flow(part, out, pre)
                out.text(" ")
        elif child.tag == "hr":
            out.block([["---"]], True)
        elif child.tag == "table":
            out.block(_table(child), True)
        elif child.tag in LISTS:
            out.block(_list(child), not node.tag == "li")
        elif child.tag in BLOCK:
            out.block(_block(child), child.tag in SPACED)
        else:
            _flow(child, out, pre)


def _indented(lines: list[Line], margin: str) -> list[Line]:
    for x in lines:
        if x:
            x.append(margin)
    return lines


def _block(node: Node) -> list[Line]:
    out = Lines()
    _flow(node, out, node.tag in ("pre", "xmp"))
    lines = out.finish()
    if node.tag in ("blockquote", "dd"):
        lines = _indented(lines, "  ")
    if node.tag in ("pre", "xmp"):
        full = [k for k, x in enumerate(lines) if _joined(x).strip()]
        lines = lines[full[0] : full[-1] + 1] if full else []
    return lines


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"[+-]?[0-9]{1,9}", text.strip()) else default


def _list(node: Node) -> list[Line]:
    out = Lines()
    count = _number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif visible(child):
            if child.tag == "li":
                if node.tag == "ol":
                    count = _number(child.attrs.get("value"), count)
                    mark = f"{count}. "
                    count += 1
                else:
                    mark = "- "
                body = _block(child) or [[]]
                first = body[0]
                body[0] = []
                _indented(body, " " * len(mark))
                first.append(mark if first else mark.rstrip(" "))
                body[0] = first
                out.block(body, False)
            else:
                shell = Node(node.tag)
                shell.children = [child]
                inner = Lines()
                _flow(shell, inner, False)
                out.block(_indented(inner.finish(), "  "), False)
    return out.finish()


def _table(node: Node) -> list[Line]:
    before, grid = Lines(), []
    # The first thead is shown first and the first tfoot last, wherever they are written.
    groups: dict[str, list[Node]] = {"thead": [], "": [], "tfoot": []}
    taken: set[str] = set()
    todo = [(x, "") for x in reversed(node.children)]
    while todo:
        child, group = todo.pop()
        if isinstance(child, str):
            if child.strip():
                before.text(child)
        elif not visible(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            own = child.tag if child.tag in groups and child.tag not in taken else ""
            taken.add(child.tag)
            todo += [(x, own) for x in reversed(child.children)]
        elif child.tag == "tr":
            groups[group].append(child)
        else:
            before.block(_block(child), False)
    rows = [*groups["thead"], *groups[""], *groups["tfoot"]]
    spans: list[tuple[int, int, int]] = []  # columns from and to, and the last row, of cells that reach down
    width: dict[int, int] = {}
    for r, row in enumerate(rows):
        spans = [x for x in spans if x[2] >= r]
        cells: dict[int, list[str]] = {}
        col, k, fresh = 0, 0, []
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    before.text(cell)
                continue
            if not visible(cell):
                continue
            if cell.tag not in ("td", "th"):
                stray = Node("div")
                stray.children = [cell]
                before.block(_block(stray), False)
                continue
            while k < len(spans) and spans[k][0] <= col:
                col, k = max(col, spans[k][1]), k + 1
            wide = min(max(1, _number(cell.attrs.get("colspan"), 1)), MOST_COLUMNS)
            deep = _number(cell.attrs.get("rowspan"), 1)
            deep = len(rows) if deep == 0 else min(max(1, deep), MOST_ROWS)
            lines = [_joined(x) for x in _block(cell) if x]
            if lines:
                cells[col] = lines
                width[col] = max([width.get(col, 0), *map(_columns, lines)])
            if deep > 1:
                fresh.append((col, col + wide, r + deep - 1))
            col += wide
        spans = sorted(spans + fresh)
        if cells:
            grid.append(cells)
    used = sorted(width)
    out = before.finish()
    for cells in grid:
        for k in range(max(map(len, cells.values()))):
            line = [cells[c][k] if c in cells and k < len(cells[c]) else "" for c in used]
            shown = " | ".join(x + " " * (width[c] - _columns(x)) for c, x in zip(used, line, strict=True)).rstrip(" ") if len(used) > 1 else line[0].rstrip(" ")
            out.append([shown] if shown else [])
    return out


def _columns(text: str) -> int:
    """Columns that a text takes in a terminal: wide characters two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def to_text(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    tree = parse(source.replace("\r\n", "\n").replace("\r", "\n"))
    _settle(tree)
    depth, level = 0, [tree]
    while level:
        level = [x for n in level for x in n.children if not isinstance(x, str)]
        depth += 1
    # A level takes three calls at most; calls between Python functions take no C stack.
    if sys.getrecursionlimit() < 4 * depth + 1000:
        sys.setrecursionlimit(4 * depth + 1000)
    lines = _block(tree)
    return "\n".join(_joined(x).rstrip(" ") for x in lines).strip("\n")


def _rendered(batches):
    for batch in slices(batches, "html"):
        texts = [to_text(x) for x in column(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def render(pages: DataFrame) -> DataFrame:
    """page_id and text of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_rendered, "page_id long, text string")
