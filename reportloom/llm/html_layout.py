"""Layout-aware rendering of HTML: a tree builder with implied tags, visibility rules and a text layout.

All visible text comes out; blocks are set off by lines, paragraphs by blank lines; list items carry bullets or numbers;
the cells of a table are padded to columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_END = re.compile(r"[\s/>]")
SPACES = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: Elements by how the HTML standard parses and shows them. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas annotation annotation-xml desc defs metadata datalist title base link meta".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address li dt dd tr td th thead tbody tfoot caption details summary dialog figcaption legend center hgroup option optgroup search".split())
ENDS_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())
#: An opening tag ends these open elements, up to the given bounds.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Closing tags look for their element no further than these.
SCOPE = frozenset("table td th caption html".split())
IN_HEAD = frozenset("head title meta link base script style template noscript html".split())
#: Elements nested deeper become siblings in this depth, and their own end tags are passed over; hidden ones still hide what they hold.
DEEPEST = 150
#: Cells of a table are aligned as far as their columns begin within so many characters of a line; two blanks set off those beyond.
ALIGNED = 150


class TagEnds:
    """Where tags end, found from all quotes and ``>`` of the page at once, so hostile pages take linear time."""

    def __init__(self, source: str) -> None:
        self.source, self.name_end = source, 0
        self.marks = [m.start() for m in re.finditer("[>\"']", source)]
        self.open = [False] * (len(self.marks) + 1)
        after: dict[str, int] = {}
        for k in range(len(self.marks) - 1, -1, -1):
            c = source[self.marks[k]]
            self.open[k] = True if c == ">" else c in after and self.open[after[c] + 1]
            after[c] = k

    def ended(self, start: int) -> bool:
        """Whether the tag that opens at ``start`` comes to its ``>``."""
        if start + 1 >= self.name_end:
            found = NAME_END.search(self.source, start + 1 + (self.source[start + 1 : start + 2] == "/"))
            self.name_end = found.start() if found else len(self.source)
        return self.open[bisect_left(self.marks, self.name_end)]


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def build(source: str) -> Node:
    """The tree of a page. Unclosed, stray and misnested tags are repaired; no input fails."""
    root = Node("#root")
    stack = [root]
    unpushed: Counter[str] = Counter()
    outside: list[Counter[str]] = []  # what was unpushed before a hidden element below the greatest depth

    def close(tags: set[str], bounds: frozenset[str] | set[str]) -> None:
        nonlocal unpushed
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                if outside and len(stack) <= DEEPEST:
                    unpushed = outside.pop()
                return
            if stack[k].tag in bounds:
                return

    def put(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and text.strip():
                close({"head"}, {"html"})
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    at, size, last, last_comment, ends, kept = 0, len(source), source.rfind(">"), source.rfind("<!--"), None, 0
    while at < size:
        start = source.find("<", max(at, kept))
        if start < 0 or start > last and start > last_comment:
            put(source[at:])
            break
        tagged = source[start + 1 : start + 2].isalpha() or source[start + 1 : start + 2] == "/"
        open_ended = start > last and not source.startswith("<!--", start)
        found = None if open_ended or tagged and ends and not ends.ended(start) else TOKEN.match(source, start)
        if found is None:
            if tagged and not ends:
                ends = TagEnds(source)
            kept = start + 1
            continue
        put(source[at:start])
        at = kept = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if unpushed[tag]:
                unpushed[tag] -= 1
                continue
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif tag in ("body", "html"):
                continue
            close({tag}, SCOPE if tag not in SCOPE else {"table"} - {tag})
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTR.findall(found[3])} if found[3] and not found[3].isspace() else {}
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag not in IN_HEAD and stack[-1].tag == "head":
            close({"head"}, {"html"})
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED_END:
            for _ in range(3):
                close(*IMPLIED_END[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack.append(_child(stack[-1], "tr", {}))
        node = _child(stack[-1], tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else size
            node.children.append(html.unescape(source[at:stop]) if tag in ("textarea", "title") else source[at:stop])
            at = min(size, (source.find(">", stop) + 1 or size)) if end else size
        elif tag not in VOID and not (found[3].rstrip().endswith("/") and tag in ("svg", "math", "path", "rect", "circle", "line", "use", "g", "text", "tspan")):
            if len(stack) < DEEPEST:
                stack.append(node)
            elif len(stack) == DEEPEST and hidden(node):
                stack.append(node)
                outside.append(unpushed)
                unpushed = Counter()
            else:
                unpushed[tag] += 1
    return root


def _child(parent: Node, tag: str, attrs: dict[str, str]) -> Node:
    node = Node(tag, attrs)
    parent.children.append(node)
    return node


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and ("hidden" in a and a["hidden"] != "until-found" or "style" in a and HIDING.search(a["style"]) is not None or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a)


class Layout:
    """Lines of text with collapsed white space, block gaps, indents and markers."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.marker, self.after_space = 0, "", "", True

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.newline()
                self._put(x)
            return
        s = SPACES.sub(" ", s)
        if self.after_space:
            s = s.removeprefix(" ")
        if s:
            self._put(s)
            self.after_space = s.endswith(" ")

    def _put(self, s: str) -> None:
        if s:
            self.line.append(s)
            self.after_space = False

    def newline(self) -> None:
        """Ends the line, even an empty one within a block."""
        self._end("".join(self.line).rstrip(" "))

    def _end(self, line: str) -> None:
        if self.lines and self.gap > 1:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        if self.marker:
            lead, self.marker = self.indent[: -len(self.marker)] + self.marker, ""
        else:
            lead = self.indent
        self.lines.append((lead + line).rstrip(" "))
        self.line, self.after_space = [], True

    def block(self, gap: int) -> None:
        """Ends the line if there is one; at least ``gap`` line ends come before the next."""
        if line := "".join(self.line).rstrip(" "):
            self._end(line)
        self.line, self.after_space = [], True
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(0)
        return self.lines


def render(node: Node, to: Layout, pre: bool = False) -> None:
    number = None
    if node.tag == "ol":
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for x in node.children:
        if isinstance(x, str):
            to.text(x, pre)
            continue
        tag = x.tag
        if x.attrs or tag in UNSEEN:
            if hidden(x):
                continue
        if tag == "br":
            to.newline()
        elif tag == "hr":
            to.block(2)
            to.text("---")
            to.block(2)
        elif tag == "table":
            to.block(2)
            for line in table_lines(x):
                to.text(line, True)
                to.newline()
            to.gap = max(to.gap, 2)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and to.indent) else 1
            to.block(gap)
            before = to.indent
            if tag == "li":
                to.marker = "- " if number is None else f"{number}. "
                to.indent += " " * len(to.marker)
                number = None if number is None else number + 1
            elif tag in ("dd", "blockquote"):
                to.indent += "    " if tag == "dd" else "> "
            render(x, to, pre or tag == "pre")
            if tag == "li" and to.marker and not to.line:
                to.marker = ""
            to.block(gap)
            to.indent = before
        else:
            if tag == "img" or tag in VOID:
                continue
            render(x, to, pre)
            if tag == "q":
                continue


def table_lines(table: Node) -> list[str]:
    """Rows of a table, cells padded to columns that begin within ``ALIGNED``. Spanned columns share the width of what they span."""
    rows: list[list[tuple[list[str], int]]] = []
    heads: list[str] = []

    def walk(node: Node) -> None:
        loose = Layout()
        for x in node.children:
            if isinstance(x, str):
                loose.text(x)
            elif hidden(x):
                continue
            elif x.tag in ("thead", "tbody", "tfoot", "colgroup"):
                walk(x)
            elif x.tag == "tr":
                cells = []
                for c in x.children:
                    if isinstance(c, str) and not c.strip() or isinstance(c, Node) and hidden(c):
                        continue
                    inner = Layout()
                    if isinstance(c, str):
                        inner.text(c)
                        cells.append((inner.done(), 1))
                    else:
                        if c.tag in ("td", "th"):
                            render(c, inner)
                        else:
                            holder = Node("#cell")
                            holder.children.append(c)
                            render(holder, inner)
                        span = c.attrs.get("colspan", "1")
                        cells.append((inner.done(), min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() and len(span) < 5 else 1))
                if cells:
                    rows.append(cells)
            else:
                holder = Node("#loose")
                holder.children.append(x)
                render(holder, loose)
        heads.extend(loose.done())

    walk(table)
    # columns are the places where some cell begins
    begins = sorted({at for cells in rows for at in accumulate((span for _, span in cells[:-1]), initial=0)})
    placed = []
    for cells in rows:
        at, row = 0, []
        for lines, span in cells:
            row.append((lines, bisect_left(begins, at), bisect_left(begins, at + span)))
            at += span
        placed.append(row)
    widths = [0] * len(begins)
    for single in (True, False):
        for row in placed:
            for lines, a, b in row:
                need = max(map(len, lines), default=0)
                if single and b == a + 1:
                    widths[a] = max(widths[a], need)
                elif not single and b > a + 1:
                    widths[b - 1] += max(0, need - sum(widths[a:b]) - 2 * (b - a - 1))
    offsets = list(accumulate((w + 2 for w in widths), initial=0))
    out = list(heads)
    for row in placed:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            parts, size = [], 0
            for lines, a, _ in row:
                gap = 0 if not a else max(2, offsets[a] - size) if offsets[a] <= ALIGNED else 2
                text = lines[k] if k < len(lines) else ""
                parts += [" " * gap, text]
                size += gap + len(text)
            out.append("".join(parts).rstrip(" "))
    return out


def visible_text(source: str | None) -> str:
    """The page's visible text; '' for null, empty and invisible pages."""
    if not source:
        return ""
    to = Layout()
    render(build(source), to)
    lines = to.done()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text in ``into`` (a column of that name is replaced). Rows and other columns stay as they are.

    Null, empty and invisible pages give ''. Repeated rows are rendered each, an empty table gives an empty result. Extra columns of
    any name stay. Long and hostile pages take time in proportion to their length; elements nested more than DEEPEST deep are laid out
    as siblings (their text stays, if it is visible), and cells of tables are aligned within ALIGNED characters of a line only, so
    a page gives no more than some twenty times its own length.
    """
    others = [c for c in pages.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(x.as_py()) for x in batch.column(batch.schema.get_field_index("__html"))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "__text"])

    rows = pages.select(*[pages[c].alias(f"__{i}") for i, c in enumerate(others)], pages[html_col].alias("__html"))
    schema = ", ".join([*(f"`__{i}` {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(others)), "__text string"])
    out = rows.mapInArrow(run, schema)
    return out.toDF(*others, into)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "html")).select("page_id", "text")
