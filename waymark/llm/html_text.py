"""HTML extraction by layout-aware rendering.

A tree builder with implied end tags reads the page; a renderer emits all text that a browser would show: hidden
elements are left out, blocks stand on lines of their own with a blank line between paragraphs, list items
carry their mark and depth, and table cells are aligned in columns.

Work is linear in the page, but for logarithms, however deep its markup nests and however far its cells span: where an
element stands among the open ones is kept by name, spans are kept as runs of columns, and tables are first measured
from the innermost outwards, then each line is placed once. Indentation and padding end at MAX_INDENT, MAX_COLUMN and
MAX_OFFSET, since a page could otherwise ask for any amount of white space; text is never cut.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import bound_batches, read_table

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset("area audio base canvas datalist dialog embed head iframe link meta noembed noframes noscript object param rp script source style svg template title track video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul table caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup"}
#: An opening tag closes these open elements, as far as its scope reaches.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: What stands directly in these and is no part of a table is shown before the table.
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
#: A part of a table, and the innermost open elements that may hold it.
HOLDERS = {"tr": frozenset("table thead tbody tfoot".split()), "col": frozenset({"table", "colgroup"})} | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), frozenset({"table"})) | dict.fromkeys(("td", "th"), frozenset("table thead tbody tfoot tr".split()))
#: Elements that stay where they are in a table.
STAYS = frozenset("script style template".split())
FOREIGN = frozenset("template svg math".split())
WALLS = frozenset("table td th caption button object template html".split())

#: Columns to which lists and quotes are indented, that a cell is padded to, and at which any cell begins, at most.
MAX_INDENT, MAX_COLUMN, MAX_OFFSET = 80, 100, 1000
#: An opening tag of these closes one element of its kind, others all they imply closed.
CLOSES_ONE = frozenset("td th li dt dd option rt rp".split())
#: End tags that reach through walls.
THROUGH = frozenset("table tr tbody thead tfoot body html template".split())

_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "layout", "name", "shown")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children, self.layout, self.shown = name, attrs, [], None, True


class Open:
    """The open elements, and by name where in them they stand."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        while len(self.nodes) > k:
            self.places[self.nodes.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost open element of these names, 0 for none."""
        best = 0
        for name in names:
            own = self.places.get(name)
            if own and own[-1] > best:
                best = own[-1]
        return best


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def parse(page: str) -> Node:
    """The tree of a page. Never fails: stray end tags are ignored and open elements end with the page."""
    root = Node("#root", {})
    stack, at, size = Open(root), 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            _add(stack, html.unescape(page[at:]))
            break
        if m.start() > at:
            _add(stack, html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            _close(stack, m[1].lower())
        elif m[2]:
            name, attrs = m[2].lower(), attributes(m[3]) if m[3].strip(" /\n\t") else {}
            _make_room(stack, name)
            node = Node(name, attrs)
            in_table = _add(stack, node)
            if name in RAW or name in RCDATA:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                body = page[at : end.start() if end else size]
                node.children.append(html.unescape(body) if name in RCDATA else body)
                at = end.end() if end else size
            elif name not in VOID and not (name == "form" and in_table):
                stack.push(node)
        elif m[0].startswith("<![CDATA["):
            _add(stack, m[0][9:].removesuffix("]]>"))
    return root


def _add(stack: Open, child: Node | str) -> bool:
    """Put the child into the open element, or before the table if it stands between a table's parts; whether it does."""
    here = stack.nodes[-1]
    if here.name in TABLE_PARTS:
        blank = not child.strip(" \t\n\f\r") if isinstance(child, str) else child.name in HOLDERS or child.name in STAYS
        table = stack.last(("table",))
        if not blank and table > stack.last(FOREIGN):
            stack.nodes[table - 1].children.insert(-1, child)
            return True
    here.children.append(child)
    return False


def _to_table(stack: Open, name: str) -> bool:
    """Close all up to the element that holds a part of a table, with a row for a cell that has none; whether there is one."""
    k = stack.last(HOLDERS[name])
    if k <= stack.last(FOREIGN):
        return False
    stack.cut(k + 1)
    if name in ("td", "th") and stack.nodes[k].name != "tr":
        row = Node("tr", {})
        stack.nodes[k].children.append(row)
        stack.push(row)
    return True


def _make_room(stack: Open, name: str) -> None:
    """Close what the opening of name implies closed."""
    if name in HOLDERS and _to_table(stack, name):
        return
    if stack.nodes[-1].name == "colgroup" and name not in STAYS:
        stack.cut(len(stack.nodes) - 1)
    if name in IMPLIED:
        ends, scope = IMPLIED[name]
        bound = max(stack.last(scope), stack.last(FOREIGN))
        while (k := stack.last(ends)) > bound:
            stack.cut(k)
            if name in CLOSES_ONE:
                break
    if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th"):
        k = stack.last(("p",))
        if k and k > stack.last(WALLS):
            stack.cut(k)
    if name == "table" and stack.nodes[-1].name in TABLE_PARTS:
        _close(stack, "table")
    if name in ("body", "main", "div", "p", "article", "section", "h1") and stack.nodes[-1].name == "head":
        stack.cut(len(stack.nodes) - 1)


def _close(stack: Open, name: str) -> None:
    k = stack.last((name,))
    if not k:
        if name in ("br", "p"):
            _add(stack, Node(name, {}))
    elif name in THROUGH or k >= stack.last(WALLS):
        stack.cut(k)


def gone(node: Node) -> bool:
    """Whether an element takes no part in the layout, with all that is in it."""
    if node.name in UNSEEN and not (node.name == "dialog" and "open" in node.attrs):
        return True
    a = node.attrs
    if not a:
        return False
    style = a.get("style", "")
    if "hidden" in a and a["hidden"] != "until-found" or a.get("type", "").lower() == "hidden" or style and _GONE.search(style):
        return True
    return bool(style) and (node.name in HOLDERS and node.name not in ("td", "th")) and _visibility(node) == "collapse"


def _visibility(node: Node) -> str:
    found = _VISIBILITY.findall(node.attrs.get("style", ""))
    return found[-1].lower() if found else ""


def prune(root: Node) -> list[Node]:
    """Drop what isn't shown, and give the tables that stay, each before those in it.

    What is invisible loses its text, but not the elements in it that are made visible again; of closed details only the summary stays.
    """
    tables, work = [], [root]
    while work:
        node = work.pop()
        if node.name == "table":
            tables.append(node)
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, str):
                if node.shown:
                    kept.append(c)
            elif not gone(c):
                told = _visibility(c) if "style" in c.attrs else ""
                c.shown = told == "visible" if told else node.shown
                kept.append(c)
        if node.name == "details" and "open" not in node.attrs:
            kept = [c for c in kept if isinstance(c, Node) and c.name == "summary"][:1]
        node.children = kept
        work.extend(c for c in kept if isinstance(c, Node))
    return tables


class Page:
    """Lines of a page or a cell under construction. An item is a line, or (first prefix, prefix, table) for all lines of a table."""

    def __init__(self) -> None:
        self.items: list = []
        self.now: list[str] = []
        self.space = False  # a white space waits for text behind it
        self.gap = False  # a blank line waits for the next line
        self.prefix = ""
        self.first = ""  # what the next line has instead of the prefix
        self.height = self.width = 0

    def text(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end_line(keep=True)
                if part:
                    self.now.append(part)
            return
        text = _SPACE.sub(" ", text)
        if not text:
            return
        if text[0] == " ":
            self.space = True
        if body := text.strip(" "):
            if self.space and self.now and not self.now[-1].endswith(" "):
                self.now.append(" ")
            self.now.append(body)
            self.space = text[-1] == " "

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now).rstrip(" ") if not keep else "".join(self.now)
        if line or keep:
            line = (self.first or self.prefix) + line
            self._put(line if keep else line.rstrip(" "))
        self.now, self.space = [], False

    def table(self, node: Node) -> None:
        self.end_line()
        self.gap = True
        if node.layout.height:
            self._put((self.first or self.prefix, self.prefix, node.layout))
        self.gap = True

    def _put(self, item) -> None:
        if self.gap and self.items:
            self.items.append("")
        self.gap, self.first = False, ""
        self.items.append(item)

    def close(self, trim: bool) -> "Page":
        """End the page and measure it; a cell has no blank lines at its ends."""
        self.end_line()
        if trim:
            a, b = 0, len(self.items)
            while a < b and self.items[a] == "":
                a += 1
            while b > a and self.items[b - 1] == "":
                b -= 1
            self.items = self.items[a:b]
        for item in self.items:
            line = isinstance(item, str)
            self.height += 1 if line else item[2].height
            self.width = max(self.width, width(item) if line else len(item[1]) + item[2].width)
        return self


def render(root: Node) -> str:
    """The visible text of a tree."""
    for table in reversed(prune(root)):
        table.layout = Layout(table)
    page = filled(root.children, False)
    return "\n".join(page.items if all(isinstance(x, str) for x in page.items) else placed(page)).strip("\n")


def filled(children: list, trim: bool) -> Page:
    """A page of these, walked with a stack of its own, so that deep nesting can't exhaust Python's. Tables are laid out already."""
    page = Page()
    work: list = [(c, False, None) for c in reversed(children)]
    while work:
        item, pre, undo = work.pop()
        if undo is not None:
            _leave(page, *undo)
            continue
        if isinstance(item, str):
            page.text(item, pre)
            continue
        name = item.name
        if name == "br":
            page.end_line(keep=not page.now)
            continue
        if name == "hr":
            page.end_line()
            page.gap = True
            continue
        if name in ("img", "input"):
            label = item.attrs.get("alt" if name == "img" else "value", "") if item.shown else ""
            if label and (name == "img" or item.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text")):
                page.text(label, False)
            continue
        if name == "table":
            page.table(item)
            continue
        if name in ("td", "th"):
            page.text(" ", False)
        if name in BLOCK or name == "tr":
            page.end_line()
            if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and page.prefix):
                page.gap = True
            before, first = page.prefix, page.first
            room = len(before) < MAX_INDENT
            if name == "li":
                mark = item.attrs.get("#mark", "- ")
                page.prefix, page.first = before + " " * len(mark) * room, before + mark
            elif name in ("blockquote", "dd") and room:
                step = "> " if name == "blockquote" else "    "
                page.prefix, page.first = before + step, first and first + step
            if name in ("ol", "ul", "menu", "dir"):
                _number(item)
            work.append((None, pre, (before, first, name)))
        inner = pre or name in ("pre", "textarea", "listing")
        work.extend((c, inner, None) for c in reversed(item.children))
    return page.close(trim)


def _leave(page: Page, before: str, first: str, name: str) -> None:
    """The end of a block."""
    page.end_line()
    page.prefix, page.first = before, "" if name == "li" else page.first and first
    if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and page.prefix):
        page.gap = True


def _number(items: Node) -> None:
    """Give the list items their marks."""
    n = items.attrs.get("start", "1")
    k = int(n) if re.fullmatch(r"-?\d{1,9}", n) else 1
    for c in items.children:
        if isinstance(c, Node) and c.name == "li":
            if items.name == "ol":
                value = c.attrs.get("value", "")
                k = int(value) if re.fullmatch(r"-?\d{1,9}", value) else k
                c.attrs = c.attrs | {"#mark": f"{k}. "}
                k += 1
            else:
                c.attrs = c.attrs | {"#mark": "- "}


def width(text: str) -> int:
    """Columns of a terminal: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Taken:
    """Columns that cells of earlier rows reach down into, as maximal runs; a span is freed at the row it ends before."""

    def __init__(self) -> None:
        self.starts, self.ends, self.due = [], [], []

    def free(self, x: int) -> int:
        """The first free column from x on."""
        k = bisect_right(self.starts, x) - 1
        return self.ends[k] if k >= 0 and self.ends[k] > x else x

    def take(self, a: int, b: int, until: int) -> None:
        """Take the free columns of a to b until a row."""
        while (a := self.free(a)) < b:
            k = bisect_left(self.starts, a)
            end = min(b, self.starts[k]) if k < len(self.starts) else b
            heappush(self.due, (until, a, end))
            left, right = k > 0 and self.ends[k - 1] == a, k < len(self.starts) and self.starts[k] == end
            if left and right:
                self.ends[k - 1] = self.ends[k]
                del self.starts[k], self.ends[k]
            elif left:
                self.ends[k - 1] = end
            elif right:
                self.starts[k] = a
            else:
                self.starts.insert(k, a)
                self.ends.insert(k, end)
            a = end

    def release(self, row: int) -> None:
        while self.due and self.due[0][0] <= row:
            _, a, b = heappop(self.due)
            k = bisect_right(self.starts, a) - 1
            start, end = self.starts[k], self.ends[k]
            parts = [(x, y) for x, y in ((start, a), (b, end)) if x < y]
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, _ in parts], [y for _, y in parts]


class Layout:
    """A table whose inner tables are laid out: what stands loose in it, its caption, then rows of cells; spans take their columns and rows."""

    def __init__(self, table: Node) -> None:
        parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
        loose, captions = [], []
        for c in table.children:
            if isinstance(c, str):
                if c.strip(" \t\n\f\r"):
                    loose.append(c)
            elif c.name == "caption":
                captions.append(c)
            elif c.name in parts:
                parts[c.name] += [r for r in c.children if isinstance(r, Node) and r.name == "tr"]
            elif c.name == "tr":
                parts["tbody"].append(c)
            elif c.name not in ("col", "colgroup"):
                loose.append(c)
        rows = parts["thead"] + parts["tbody"] + parts["tfoot"]
        #: Rows of (column, cell); captions and loose parts are rows of one cell.
        self.rows: list[list[tuple[int, Page]]] = [[(0, page)] for page in (filled(x, True) for x in ([loose] if loose else []) + [c.children for c in captions]) if page.height]
        above, taken, widths, columns = len(self.rows), Taken(), {}, set()
        for y, row in enumerate(rows):
            taken.release(y)
            x, cells = 0, []
            for cell in row.children:
                if not isinstance(cell, Node) or cell.name not in ("td", "th"):
                    continue
                x = taken.free(x)
                across, down = max(1, _span(cell, "colspan", 1000)), min(_span(cell, "rowspan", 65534) or len(rows), len(rows) - y)
                page = filled(cell.children, True)
                cells.append((x, page))
                columns.add(x)
                if across == 1:
                    widths[x] = max(widths.get(x, 0), min(page.width, MAX_COLUMN))
                if down > 1:
                    taken.take(x, x + across, y + down)
                x += across
            self.rows.append(cells)
        self.offset, left = {}, 0
        for x in sorted(columns):
            self.offset[x] = min(left, MAX_OFFSET)
            left += widths.get(x, 0) + 2 if widths.get(x, 0) else 0
        self.rows[above:] = [[(self.offset[x], page) for x, page in cells] for cells in self.rows[above:]]
        self.height = sum(max((page.height for _, page in cells), default=0) for cells in self.rows)
        self.width = max(map(self._row_width, self.rows), default=0)

    @staticmethod
    def _row_width(cells: list[tuple[int, Page]]) -> int:
        end = 0
        for at, page in cells:
            if page.width:
                end = max(at, end + 2 if end else 0) + page.width
        return end


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1


def placed(page: Page) -> list[str]:
    """The lines of a page with tables: every piece of a line gets its row and column, then rows are put together."""
    pieces: list[tuple[int, int, int, str, bool]] = []  # row, column, order, text, whether what follows stands close
    work: list = [(page, 0, 0)]
    while work:
        own, row, column = work.pop()
        inner: list = []
        if isinstance(own, Page):
            for item in own.items:
                if isinstance(item, str):
                    if item:
                        pieces.append((row, column, len(pieces), item, False))
                    row += 1
                    continue
                first, prefix, table = item
                if column < MAX_INDENT:
                    for k in range(table.height if prefix.strip() else 1):
                        if (text := prefix if k else first).strip():
                            pieces.append((row + k, column, len(pieces), text, True))
                inner.append((table, row, min(column + len(prefix), MAX_OFFSET)))
                row += table.height
        else:
            for cells in own.rows:
                inner += [(cell, row, min(column + at, MAX_OFFSET)) for at, cell in cells]
                row += max((cell.height for _, cell in cells), default=0)
        work.extend(reversed(inner))
    pieces.sort()
    lines, at = [""] * page.height, 0
    while at < len(pieces):
        row, parts, used, close = pieces[at][0], [], 0, True
        while at < len(pieces) and pieces[at][0] == row:
            _, column, _, text, glued = pieces[at]
            pad = max(column - used, 0 if close else 2)
            parts += [" " * pad, text]
            used, close = used + pad + width(text), glued
            at += 1
        lines[row] = "".join(parts).rstrip(" ") if close else "".join(parts)
    return lines


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row, without a shuffle.

    A null or empty page gives an empty text; broken markup never fails. Repeated rows and null ids stay; other
    columns are ignored.
    """
    bound_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(_texts, "page_id long, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))
