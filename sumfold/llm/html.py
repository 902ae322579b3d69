"""Layout-aware HTML rendering.

A tree builder with implied end tags makes a tree of the page; rendering walks it with
visibility rules and emits all visible text: blocks on lines of their own, a blank line
around paragraphs and headings, list items with bullets or numbers and indents, table
cells aligned in columns (cells may span columns and rows), preformatted text as it stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe object video audio canvas svg noembed noframes datalist select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd figcaption hr details summary center menu dir legend caption tr td th tbody thead tfoot optgroup option".split())
CLOSES_P = SPACED | frozenset("div section article header footer nav main aside address form hr details center menu dir li dt dd".split())
SCOPE = frozenset("table td th caption button object template html".split())
#: A start tag implies the end of the first of these open elements, looked for up to one of the others.
IMPLIED = {
    "li": (("li",), frozenset("ul ol menu dir".split()) | SCOPE), "dt": (("dt", "dd"), frozenset(["dl"]) | SCOPE), "dd": (("dt", "dd"), frozenset(["dl"]) | SCOPE),
    "tr": (("tr",), frozenset("table tbody thead tfoot".split())), "td": (("td", "th"), frozenset("tr table".split())), "th": (("td", "th"), frozenset("tr table".split())),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset(["table"])), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset(["table"])), "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset(["table"])),
    "option": (("option",), frozenset(["select", "datalist"])), "optgroup": (("optgroup",), frozenset(["select"])), "body": (("head",), frozenset(["html"])),
}
TABLE = frozenset("table tbody thead tfoot tr".split())
CROSSES = TABLE | frozenset("td th html body".split())  # end tags that reach beyond a cell
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
_name = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_attr = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_gone = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_space = re.compile(r"[ \t\n\r\f​]+")
_whole = re.compile(r"[0-9]{1,9}")
_raw_end = {tag: re.compile(f"</{tag}(?=[ \\t\\n\\r\\f/>]|$)", re.I | re.A) for tag in RAW}  # searched in the page itself: its lower case may be longer
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # bounds of colspan and rowspan in the HTML standard


def _text(s: str) -> str:
    """Character references resolved; numbers too long for an integer are cut to as many digits as still lie beyond all characters."""
    if "&#" in s:
        s = re.sub(r"&#([0-9]{9})[0-9]+", r"&#\1", re.sub(r"&#0+", "&#0", s))
    return unescape(s)


class Node:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inside = tag, attrs, []


def _tag_end(html: str, at: int) -> int:
    """Index of the '>' that ends the tag, outside of quoted values; if a quote never ends, the first one."""
    first = html.find(">", at)
    if first < 0:
        return -1
    end, quote = first, at
    while True:
        a, b = html.find('"', quote, end), html.find("'", quote, end)
        if a < 0 and b < 0:
            return end
        q = a if b < 0 or 0 <= a < b else b
        if html[q - 1] not in "= \t\n\r\f" or "=" not in html[max(at, q - 8) : q]:
            quote = q + 1  # a stray quote opens nothing
            continue
        close = html.find(html[q], q + 1)
        if close < 0:
            return first
        quote = close + 1
        if close > end:
            end = html.find(">", close)
            if end < 0:
                return first


def tokens(html: str) -> Iterator[tuple]:
    """('text', s), ('open', tag, attrs, closed) and ('close', tag); comments and declarations are skipped."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield ("text", _text(html[at:]))
            return
        if lt > at:
            yield ("text", _text(html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif html[lt + 1 : lt + 2] == "/" and (m := _name.match(html, lt + 2)):
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            yield ("close", m[0].lower())
        elif m := _name.match(html, lt + 1):
            end = _tag_end(html, m.end())
            if end < 0:
                return  # an unfinished tag is no text
            tag, inner = m[0].lower(), html[m.end() : end]
            attrs = {k.lower(): _text(v.strip("\"'")) for k, v in _attr.findall(inner)} if inner.strip(" /\n\t") else {}
            yield ("open", tag, attrs, inner.endswith("/"))
            at = end + 1
            if tag in RAW:
                stop = m.start() if (m := _raw_end[tag].search(html, at)) else n
                if tag in ("textarea", "title"):
                    yield ("text", _text(html[at:stop]))
                at = stop
        else:
            yield ("text", "<")
            at = lt + 1


def tree(html: str) -> Node:
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, so that no tag walks a deep stack

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_to(i: int) -> None:
        for node in reversed(stack[i:]):
            places[node.tag].pop()
        del stack[i:]

    def put(node: Node | str, stray: bool) -> None:
        """Content that strays between a table's cells goes before the table, which is its parent's last child while open."""
        if stray and stack[-1].tag in TABLE and (i := last(("table",))):
            above = stack[i - 1].inside
            above.insert(len(above) - 1, node)
        else:
            stack[-1].inside.append(node)

    for kind, *rest in tokens(html):
        top = stack[-1]
        if kind == "text":
            if top.tag == "head" and rest[0].strip():
                close_to(len(stack) - 1)
            put(rest[0], bool(rest[0].strip()))
        elif kind == "open":
            tag, attrs, closed = rest
            if tag == "html":
                root.attrs.update(attrs)
                continue
            if top.tag == "head" and tag not in IN_HEAD:
                close_to(len(stack) - 1)
            if tag in CLOSES_P and (i := last(("p",))) > last(SCOPE):
                close_to(i)
            if tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                if (i := last(ends)) > last(stop):
                    close_to(i)
            node = Node(tag, attrs)
            put(node, tag not in IN_TABLE)
            if tag not in VOID and not (closed and tag in ("svg", "path")):
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
        else:
            tag = rest[0]
            if tag == "br":
                put(Node("br", {}), True)
                continue
            i = last((tag,))
            if i and (tag in CROSSES or i >= last(("table", "td", "th"))):
                close_to(i)
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or (a and _gone.search(a.get("style", ""))) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


class Lines:
    """Rendered lines: inline text is collapsed and flows, blocks break it."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.want = 0  # blank lines due before the next text

    def text(self, s: str) -> None:
        s = _space.sub(" ", s)
        if not self.line or self.line[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def flush(self) -> None:
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s:
            self.put([s])

    def put(self, lines: list[str]) -> None:
        if self.want and self.out:
            self.out.append("")
        self.want = 0
        self.out += lines

    def gap(self) -> None:
        self.flush()
        self.want = 1


def _number(s: str | None, default: int) -> int:
    """A whole number of up to nine digits; anything else is the default."""
    s = (s or "").strip()
    return int(s) if _whole.fullmatch(s) else -int(s[1:]) if s[:1] == "-" and _whole.fullmatch(s[1:]) else default


def _cells(table: Node) -> list[list[tuple[Node, int, int]]]:
    """Rows of (cell, its column, columns) of the table itself, head first and foot last. A cell that spans rows stands in its first one and keeps its columns from the cells below."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    todo = [(c, "tbody", 0) for c in table.inside]
    todo.reverse()
    loose: list | None = None
    groups = 0  # a span ends with its group of rows
    while todo:
        c, part, group = todo.pop()
        if isinstance(c, str) or not visible(c):
            continue
        if c.tag in parts or c.tag in ("form", "center"):
            loose = None
            groups += 1
            todo += [(x, c.tag if c.tag in parts else part, groups) for x in reversed(c.inside)]
        elif c.tag == "tr":
            loose = None
            parts[part].append((group, [x for x in c.inside if isinstance(x, Node) and visible(x)]))
        elif c.tag in ("td", "th"):
            if loose is None:
                loose = []
                parts[part].append((group, loose))
            loose.append(c)
    out, held, now = [], {}, None  # held: rows for which a column is still taken
    for group, row in parts["thead"] + parts["tbody"] + parts["tfoot"]:
        if group != now:
            held, now = {}, group
        at, placed, fresh = 0, [], {}
        for c in row:
            while at in held:
                at += 1
            wide = min(MOST_COLUMNS, max(1, _number(c.attrs.get("colspan"), 1)))
            high = _number(c.attrs.get("rowspan"), 1)
            high = MOST_ROWS if high == 0 else min(MOST_ROWS, max(1, high))  # 0: to the end of the group
            placed.append((c, at, wide))
            if high > 1:
                fresh |= dict.fromkeys(range(at, at + wide), high - 1)
            at += wide
        held = {j: n - 1 for j, n in held.items() if n > 1} | fresh
        out.append(placed)
    return out


def _table(table: Node) -> Iterator:
    out: list[str] = []
    for c in table.inside:
        if isinstance(c, Node) and c.tag == "caption" and visible(c):
            out += yield _lines(c)
    cells = _cells(table)
    starts = sorted({at for row in cells for _, at, _ in row})  # columns in which a cell starts; the others have no width
    rows, width = [], [0] * len(starts)
    for row in cells:
        rows.append([])
        for c, at, n in row:
            lines = yield _lines(c)
            first = bisect_left(starts, at)
            rows[-1].append((lines, first, bisect_left(starts, at + n) - first))
    spans = [(n, at, max(map(len, lines), default=0)) for row in rows for lines, at, n in row]
    for n, at, need in sorted(spans, key=lambda s: s[:2]):  # a wide text in several columns widens the last of them
        width[at + n - 1] += max(0, need - sum(width[at : at + n]) - 2 * (n - 1))
    for row in rows:
        for i in range(max((len(lines) for lines, _, _ in row), default=0)):
            line, end = [], 0
            for lines, at, n in row:
                skipped = sum(width[end:at]) + 2 * (at - end)
                room = sum(width[at : at + n]) + 2 * n
                line.append(" " * skipped + (lines[i] if i < len(lines) else "").ljust(room))
                end = at + n
            out.append("".join(line).rstrip())
    return out


def _lines(top: Node) -> Iterator:
    """Lines of a node's visible text, as a step of `render`: it yields the parts that it needs and gets their lines, so no depth of nesting nests calls."""
    lines = Lines()
    todo: list = [iter(top.inside)]
    ends: list = [None]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
            end = ends.pop()
            if end is not None:
                (lines.gap if end else lines.flush)()
            continue
        if isinstance(c, str):
            lines.text(c)
        elif not visible(c):
            continue
        elif c.tag == "br":
            lines.flush()
        elif c.tag in ("td", "th", "tr"):  # outside of a table
            lines.flush()
            todo.append(iter(c.inside))
            ends.append(0)
        elif c.tag == "table":
            lines.gap()
            if got := (yield _table(c)):
                lines.put(got)
            lines.want = 1
        elif c.tag == "pre":
            lines.gap()
            got = _plain(c).strip("\n")
            if got.strip():
                lines.put([s.rstrip() for s in got.split("\n")])
            lines.want = 1
        elif c.tag in ("ul", "ol", "menu", "dir"):
            lines.gap()
            if got := (yield _list(c)):
                lines.put(got)
            lines.want = 1
        elif c.tag in BLOCK:
            spaced = c.tag in SPACED
            (lines.gap if spaced else lines.flush)()
            todo.append(iter(c.inside))
            ends.append(int(spaced))
        else:
            todo.append(iter(c.inside))
            ends.append(None)
    lines.flush()
    return lines.out


def render(top: Node) -> list[str]:
    """Lines of a node's visible text."""
    steps, got = [_lines(top)], None
    while steps:
        try:
            part = steps[-1].send(got)
        except StopIteration as end:
            steps.pop()
            got = end.value
        else:
            steps.append(part)
            got = None
    return got


def _plain(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c is node or visible(c):
            if c.tag == "br":
                out.append("\n")
            todo += reversed(c.inside)
    return "".join(out)


def _list(node: Node) -> Iterator:
    out: list[str] = []
    number = _number(node.attrs.get("start"), 1)
    for c in node.inside:
        if isinstance(c, str):
            if c.strip():
                out.append(_space.sub(" ", c).strip())
            continue
        if not visible(c):
            continue
        item = Node("div", {})
        item.inside = c.inside if c.tag == "li" else [c]
        lead = f"{number}. " if node.tag == "ol" else "- "
        got = [s for s in (yield _lines(item)) if s]
        if c.tag != "li":
            lead = "  "
        elif node.tag == "ol":
            number += 1
        if got:
            out += [lead + got[0], *(" " * len(lead) + s for s in got[1:])]
    return out


def extract(html: str | None) -> str | None:
    """Visible text of a page; null for null."""
    if html is None:
        return None
    return "\n".join(render(tree(html)))


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages plus the column `into`, which replaces one of that name. Row-local: rows and other columns are kept.

    A null page gives null, an empty page (and one without visible text) an empty text. Repeated rows
    give the same text each, an empty table an empty one; pages of any length or depth count whole.
    """
    page = F.col(f"`{html}`")

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in s], dtype="object")

    small_batches(pages.sparkSession)
    return pages.withColumn(into, of(page))
