"""HTML to text by layout.

A tree builder reads tags, comments and text, implies the tags that authors leave out (html, head and
body; ends of p, li, dt, dd, option, table parts; tbody and tr) and closes what a parent's end closes.
Table parts that stand outside of a table have no meaning: cells become a blank, other parts a new line.
A renderer walks the tree: invisible elements give nothing, blocks stand on lines of their own with
blank lines between paragraphs, lists get their marks and indent, preformatted text stays as it is,
and table cells are padded so that the columns of a table line up, row and column spans included. A
table that would be wider than WIDEST has the cells of a row two blanks apart, or on lines of their own
where a cell has several lines. Pages may be nested as deep as they like: neither step recurses.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, read_table

#: Elements by their part in parsing and layout.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript title meta link base object applet audio video canvas svg math iframe noembed noframes datalist area param source track".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer nav main address li dt dd form center details summary figcaption hr tr caption thead tbody tfoot td th legend menu dir option select".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dt dd".split())
#: A start tag closes open elements of the second column, up to one of the third.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
#: End tags don't close elements beyond these; those of table parts go as far as the table.
FENCES = frozenset(("table", "td", "th", "caption", "html"))
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
#: Parts that mean nothing outside of a table.
STRAY = (TABLE_PARTS | {"col", "colgroup"}) - {"table"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag. Quotes hold text together only where a value begins; one that never ends doesn't hide the end of the tag.
_REST = re.compile(r"(?:[^>=]+|=[ \t\n\r\f]*(?:\"[^\"]*\"|'[^']*'|))*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
_POINT = re.compile(r"&#0*([0-9]+)(;?)")
#: Columns of indent that nested blocks get at most, and of a table whose cells are lined up.
MOST_INDENT, WIDEST = 64, 500


def _unescaped(raw: str) -> str:
    """raw with its character references resolved; numbers beyond the code points become the replacement character."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _POINT.sub(lambda m: m[0] if len(m[1]) <= 7 else "\ufffd", raw)
    return entities.unescape(raw)


def _number(value: str | None, default: int) -> int:
    """The integer that an attribute's value begins with; the default where it has none of up to nine digits."""
    m = _NUMBER.match(value or "")
    return int(m[1]) if m else default


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return _unescaped(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


def build(source: str) -> Node:
    """The tree of a page: an html element with a head and a body."""
    root, head, body = Node("html"), Node("head"), Node("body")
    root.children = [head, body]
    stack, in_head, at = [root, body], True, 0
    opened: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain
    in_p = [False, False]  # for each open element, whether a start tag of CLOSES_P finds a paragraph to end

    def text(raw: str) -> None:
        nonlocal in_head
        if raw:
            if in_head and raw.strip():
                in_head = False
            top = stack[-1]
            if top.tag in ("table", "thead", "tbody", "tfoot", "tr") and raw.strip():
                # text that stands in a table outside of cells comes before the table
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "table")
                stack[k - 1].children.insert(len(stack[k - 1].children) - 1, _unescaped(raw))
            else:
                top.children.append(_unescaped(raw))

    def close(upto: int) -> None:
        for node in stack[max(upto, 2) :]:
            opened[node.tag] -= 1
        del stack[max(upto, 2) :], in_p[max(upto, 2) :]

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.tag] += 1
        in_p.append(node.tag == "p" or in_p[-1] and node.tag != "button" and node.tag not in FENCES)

    while at < len(source):
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        named = _NAME.match(source, start + 1) or (_NAME.match(source, start + 2) if source.startswith("</", start) else None)
        if not named:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")):
                if source.startswith(opening, start):
                    text(source[at:start])
                    end = source.find(closing, start + len(opening))
                    if opening == "<![CDATA[":
                        text(entities.escape(source[start + len(opening) : end if end >= 0 else len(source)]))
                    at = end + len(closing) if end >= 0 else len(source)
                    break
            else:
                text(source[at : start + 1])
                at = start + 1
            continue
        text(source[at:start])
        rest = _REST.match(source, named.end())
        if not rest:
            break  # a tag that never ends is dropped, with all after it
        end = rest.end()
        tag, attributes, at = named[0].lower(), source[named.end() : end - 1], end
        if source[start + 1] == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "head":
                in_head = False
            elif tag not in ("html", "body") and (opened[tag] or tag == "p"):
                fences = ("table", "html") if tag in TABLE_PARTS else FENCES
                for k in range(len(stack) - 1, 1, -1) if opened[tag] else ():
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in fences:
                        break
                else:
                    if tag == "p":
                        stack[-1].children.append(Node("p"))
            continue
        if tag in ("html", "head", "body"):
            if tag != "head":
                target = body if tag == "body" else root
                target.attributes = target.attributes or attributes
            in_head = tag != "body" and in_head
            continue
        node = Node(tag, attributes)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            at = end.end() if end else len(source)
            node.children = [_unescaped(inner) if tag in ("textarea", "title") else inner]
            (head if in_head and tag in HEAD_ONLY else stack[-1]).children.append(node)
            continue
        if in_head and tag in HEAD_ONLY:
            head.children.append(node)
            continue
        in_head = False
        if tag in STRAY and not opened["table"]:
            stack[-1].children.append(" " if tag in ("td", "th") else Node("br"))
            continue
        if tag in CLOSES_P and in_p[-1]:
            close(next(k for k in range(len(stack) - 1, 1, -1) if stack[k].tag == "p"))
        if tag == "table" and stack[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            close(next(k for k in range(len(stack) - 1, 1, -1) if stack[k].tag == "table"))  # a table within a table, but in no cell
        if tag in IMPLIED_ENDS:
            ends, fences = IMPLIED_ENDS[tag]
            lowest = None
            for k in range(len(stack) - 1, 1, -1) if any(opened[e] for e in ends) else ():
                if stack[k].tag in fences:
                    break
                if stack[k].tag in ends:
                    lowest = k
                elif stack[k].tag in FENCES:
                    break
            if lowest is not None:
                close(lowest)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        if tag == "tr" and stack[-1].tag == "table":
            push(Node("tbody"))
        if tag in ("td", "th"):
            if stack[-1].tag == "table":
                push(Node("tbody"))
            if stack[-1].tag in ("thead", "tbody", "tfoot"):
                push(Node("tr"))
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            stack[-1].children.append(node)
        else:
            push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in INVISIBLE:
        return False
    if not node.attributes:
        return True
    if node.get("hidden") is not None or (node.get("aria-hidden") or "").lower() == "true":
        return False
    if node.tag == "input" and (node.get("type") or "").lower() == "hidden":
        return False
    return not _HIDDEN.search(node.get("style") or "")


class Lines:
    """Lines of text under way, and the containers (list items, quotations) that they stand in. Gaps between blocks collapse to the larger one."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.marks: list[str] = []
        self.indents, self.used = [0], 0  # columns of the first k containers; how many of them have shown their mark
        self.entered: list[tuple[int, int]] = []  # lines and gap before each container

    def inline(self, raw: str, keep: bool) -> None:
        if not keep:
            raw = _BLANKS.sub(" ", raw)
            if not self.parts or self.parts[-1].endswith((" ", "\n")):
                raw = raw.lstrip(" ")
        if raw:
            self.parts.append(raw)

    def line_break(self) -> None:
        line = "".join(self.parts)
        self.parts = []
        if not line.strip():
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        for x in line.rstrip("\n").split("\n"):
            if x.strip() or self.used < len(self.marks):
                mark = "".join(self.marks[self.used :])
                self.lines.append((" " * min(self.indents[self.used], MOST_INDENT) + mark + x).rstrip())
                self.used = len(self.marks)
            else:
                self.lines.append("")

    def block(self, gap: int) -> None:
        self.line_break()
        if not self.entered or len(self.lines) > self.entered[-1][0]:  # a container doesn't begin with a gap
            self.gap = max(self.gap, gap)

    def enter(self, mark: str) -> None:
        """What follows, up to leave(), is indented by the width of mark; its first line has mark itself."""
        self.line_break()
        self.entered.append((len(self.lines), self.gap))
        self.marks.append(mark)
        self.indents.append(self.indents[-1] + len(mark))

    def leave(self) -> None:
        self.line_break()
        lines, gap = self.entered.pop()
        self.gap = 0 if len(self.lines) > lines else gap  # a container doesn't end with a gap
        self.marks.pop()
        self.indents.pop()
        self.used = min(self.used, len(self.marks))

    def done(self) -> list[str]:
        self.line_break()
        return self.lines


#: A step of the layout: it yields the steps that it needs done before it goes on.
Step = Generator["Step", None, None]


def _done(step: Step) -> None:
    """Carry out a step and all steps that it asks for, with a stack of our own."""
    under_way = [step]
    while under_way:
        inner = next(under_way[-1], None)
        if inner is None:
            under_way.pop()
        else:
            under_way.append(inner)


def _table(node: Node, out: Lines) -> Step:
    """Captions and what else stands in a table outside of its rows, then the rows."""
    rows: list[list[tuple[list[str], int, int]]] = []
    loose: list[str] = []
    todo = [child for child in reversed(node.children)]
    group_ends: list[int] = []  # for each row, the number of rows up to the end of its group
    open_rows = 0
    while todo:
        child = todo.pop()
        if child is None:  # the end of a group
            group_ends += [len(rows)] * (len(rows) - open_rows)
            open_rows = len(rows)
            continue
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag in ("thead", "tbody", "tfoot"):
            todo += [None, *reversed(child.children), None]
            continue
        cells = [c for c in child.children if isinstance(c, Node) and visible(c)] if child.tag == "tr" else [child]
        row = []
        for cell in cells:
            inner = Lines()
            yield _one(cell, inner) if cell.tag not in ("td", "th", "caption") else _walk(cell, inner, False)
            if child.tag != "tr":
                loose += inner.done()
            else:
                row.append((inner.done(), min(max(_number(cell.get("colspan"), 1), 1), 1000), max(_number(cell.get("rowspan"), 1), 0)) if cell.attributes else (inner.done(), 1, 1))
        if row:
            rows.append(row)
    group_ends += [len(rows)] * (len(rows) - open_rows)
    lines = loose + (_aligned(rows, group_ends) or [x for row in rows for x in _side_by_side(row)])
    if lines:
        out.inline("\n".join(lines), True)


def _side_by_side(row: list[tuple[list[str], int, int]]) -> list[str]:
    if max(len(lines) for lines, _, _ in row) > 1:
        return [x for lines, _, _ in row for x in lines]
    return ["  ".join(lines[0] for lines, _, _ in row if lines)]


def _aligned(rows: list[list[tuple[list[str], int, int]]], group_ends: list[int]) -> list[str] | None:
    """The rows with their columns lined up, or None where they get wider than WIDEST."""
    taken: dict[int, int] = {}  # column: the row up to which a cell from above stands in it
    placed = []  # for each row (column, columns, lines) of its cells
    for r, row in enumerate(rows):
        at, cells = 0, []
        for lines, span, down in row:
            while taken.get(at, 0) > r:
                at += 1
            if 2 * at > WIDEST:
                return None
            cells.append((at, span, lines))
            if down != 1:
                for c in range(at, min(at + span, WIDEST)):
                    taken[c] = min(r + down, group_ends[r]) if down else group_ends[r]
            at += span
        placed.append(cells)
    starts = sorted({at for cells in placed for at, _, _ in cells})  # columns in which no cell begins have no width
    place = {at: k for k, at in enumerate(starts)}
    widths = [0] * len(starts)
    spanning = []
    for cells in placed:
        for at, span, lines in cells:
            first, last = place[at], bisect_left(starts, at + span) - 1
            if first == last:
                widths[first] = max(widths[first], max(map(len, lines), default=0))
            else:
                spanning.append((last - first, first, last, max(map(len, lines), default=0)))
    for n, first, last, width in sorted(spanning):
        if last < len(widths) - 1:  # what stands in the last column moves nothing
            widths[last] += max(0, width - sum(widths[first : last + 1]) - 2 * n)
    if sum(widths) + 2 * len(widths) > WIDEST:
        return None
    begin = [0]
    for w in widths:
        begin.append(begin[-1] + w + 2)
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for at, _, lines in cells:
                if k < len(lines):
                    line = line.ljust(begin[place[at]]) + lines[k]
            out.append(line.rstrip())
    return out


def _walk(node: Node, out: Lines, keep: bool) -> Step:
    """Lay out the children of a node."""
    count = _number(node.get("start"), 1) if node.tag == "ol" and node.attributes else 1
    for child in node.children:
        if isinstance(child, str):
            out.inline(child, keep)
        elif visible(child):
            if child.tag == "li":
                if node.tag == "ol" and child.attributes:
                    count = _number(child.get("value"), count)
                yield _one(child, out, keep, node.tag, f"{count}. " if node.tag == "ol" else "- ")
                count += 1
            else:
                yield _one(child, out, keep, node.tag)


def _one(node: Node, out: Lines, keep: bool = False, parent: str = "", mark: str = "- ") -> Step:
    """Lay out a visible element."""
    tag = node.tag
    gap = 1 if tag in PARAGRAPHS else 0
    if tag == "br":
        out.line_break()
    elif tag == "hr":
        out.block(0)
        out.inline("---", True)
        out.block(0)
    elif tag == "img":
        out.inline(node.get("alt") or "", False)
    elif tag == "input":
        if (node.get("type") or "text").lower() in ("submit", "button", "reset", "text", "search"):
            out.inline(node.get("value") or "", False)
    elif tag in ("table", "li", "blockquote", "dd"):
        out.block(gap)
        out.enter({"table": "", "li": mark}.get(tag, "  "))
        yield _table(node, out) if tag == "table" else _walk(node, out, keep)
        out.leave()
        out.block(gap)
    elif tag in BLOCKS:
        if tag in ("ul", "ol", "dl") and parent in ("li", "ul", "ol", "dd"):
            gap = 0  # a nested list
        out.block(gap)
        yield _walk(node, out, keep or tag == "pre")
        out.block(gap)
    else:
        yield _walk(node, out, keep or tag in ("textarea", "xmp"))


def render(source: str | None) -> str:
    """All visible text of a page, laid out."""
    if not source:
        return ""
    root, out = build(source), Lines()
    if visible(root) and visible(root.children[1]):
        _done(_walk(root, out, False))
    return "\n".join(out.done())


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_chars long, n_lines long, text string) for every row of pages.

    Null and empty pages give the empty text. Whole pages are read, however long or deep, broken ones
    too: open tags end with the page, an open comment or script takes the rest. One row for each input
    row, whatever its id, repeated ones included; other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def of(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [render(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["page_id", "n_chars", "n_lines", "text"])

    return map_arrow(pages, of, f"page_id {dict(pages.dtypes)['page_id']}, n_chars long, n_lines long, text string")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """page_id, n_chars, n_lines and text of every page."""
    return html_text(read_table(spark, sf_dir, "pages"))
