"""HTML to text as laid out: a tree with implied tags, visibility, blocks, lists and tables with aligned cells."""

import re
from collections.abc import Iterable, Iterator
from html import escape, unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_styles import Sheet

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("script style head title template noscript iframe noembed noframes object audio video canvas datalist meta link base param source track col colgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption thead tbody tfoot option optgroup select text".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir".split())
CLOSES_P = BLOCK - frozenset("body html tr caption thead tbody tfoot li dd dt option optgroup select legend text".split())
#: The most columns and rows that a cell takes.
SPANS = {"colspan": 1000, "rowspan": 65534}
#: What may stand in <head>; what is not drawn in drawings and formulas.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
UNDRAWN = {"svg": frozenset("defs desc metadata symbol clippath mask marker pattern".split()), "math": frozenset({"annotation", "annotation-xml"})}
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "thead": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), "tbody": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}),
    "tfoot": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}),
}
WALL = {"li": frozenset("ul ol menu dir table".split()), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"select"}), "optgroup": frozenset({"select"})}
IN_TABLE = frozenset({"table"})
SCOPE = frozenset("table td th caption html".split())

#: Comments and declarations; a tag, in which quotes count behind an equals sign; a tag up to the first >; a tag that never ends.
OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
TOKEN = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
PLAIN = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
BEGUN, CUT = re.compile(r"</?[a-zA-Z]"), re.compile(r"<[a-zA-Z/][^<]*\Z")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    """`gone`: not drawn, with all in it; `unseen`: without text or a mark of its own."""

    __slots__ = ("tag", "attrs", "items", "gone", "unseen")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.items, self.gone, self.unseen = tag, attrs, [], False, False


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)}


class Stack:
    """The open elements, and where those of each tag stand among them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.top().items.append(node)
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, k: int) -> None:
        for x in self.nodes[k:]:
            self.at[x.tag].pop()
        del self.nodes[k:]

    def close(self, tags: frozenset[str], wall: frozenset[str]) -> bool:
        """Ends the innermost open element of these tags, and all in it, unless a wall stands inside."""
        k = self.last(tags)
        if not k or k < self.last(wall):
            return False
        self.cut(k)
        return True


def parse(html: str) -> Node:
    """The tree: tags that others imply are closed or opened, an end tag without a start is dropped, all that is open ends with the text.

    A tag whose quotes leave it without an end makes quotes count for nothing from there on, so no text is read more than twice."""
    root = Node("#root", "")
    stack = Stack(root)
    at, end, token, last = 0, len(html), TOKEN, html.rfind(">")

    def text(s: str) -> None:
        """Text that isn't blank ends an open head."""
        while stack.top().tag == "head" and s.strip(" \t\n\r\f"):
            stack.cut(len(stack.nodes) - 1)
        stack.top().items.append(s)

    while at < end:
        begin, m = html.find("<", at), None
        while begin >= 0:
            m = token.match(html, begin) if begin <= last or html.startswith(("<!", "<?"), begin) else None
            if not m and token is TOKEN and begin <= last and BEGUN.match(html, begin):
                token = PLAIN
                continue
            if m or (m := CUT.match(html, begin)):
                break
            begin = html.find("<", begin + 1)
        if not m:
            text(html[at:])
            break
        if begin > at:
            text(html[at:begin])
        at = m.end()
        tag = m[2] if m.re.groups else None
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not stack.at.get("p"):
                stack.top().items.append(Node("p", ""))
            elif tag == "br":
                stack.top().items.append(Node("br", ""))
            else:
                stack.close(frozenset({tag}), SCOPE - {tag} if tag not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") else frozenset({"html"}) if tag != "tr" else IN_TABLE)
            continue
        while tag not in HEAD and stack.top().tag == "head":
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSED_BY:
            while stack.close(CLOSED_BY[tag], WALL.get(tag, IN_TABLE)):
                pass
        if tag in CLOSES_P:
            stack.close(frozenset({"p"}), SCOPE | {"button"})
        elif tag in ("td", "th") and stack.top().tag in ("table", "tbody", "thead", "tfoot"):
            stack.push(Node("tr", ""))
        elif tag == "body":
            stack.close(frozenset({"head"}), frozenset())
        k = stack.last(UNDRAWN)
        drawn = stack.nodes[k].tag if k else ""
        node = Node(tag, m[3] + " hidden" if drawn and tag in UNDRAWN[drawn] else m[3])
        ended = m[3].rstrip().endswith("/")
        if tag in RAW or tag in VOID or ended and (drawn or tag not in BLOCK):
            stack.top().items.append(node)
            if tag in RAW and not (drawn and ended):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if tag != "plaintext" else None
                raw = html[at : stop.start() if stop else end]
                node.items.append(escape(raw, quote=False) if tag in ("xmp", "plaintext") else raw)
                at = stop.end() if stop else end
        else:
            stack.push(node)
    return root


def hidden(node: Node) -> bool:
    return node.gone or node.tag in HIDDEN


def settle(root: Node) -> None:
    """Marks what isn't drawn: display none, hidden unless a display is declared, closed dialogs, what a closed <details> has besides its summary. Visibility is inherited: the text of
    an invisible element goes, a visible one inside stays."""
    sheets, work = [], [root]
    while work:
        x = work.pop()
        if x.tag == "style":
            sheets.append("".join(c for c in x.items if isinstance(c, str)))
        work += [c for c in reversed(x.items) if isinstance(c, Node)]
    sheet = Sheet(sheets)
    below = [(root, True)]
    while below:
        x, seen = below.pop()
        a = _attributes(x.attrs) if x.attrs and not x.attrs.isspace() else {}
        own = sheet.of(x.tag, a) if a or sheet.by else {}
        display = own["display"][0] if "display" in own else ""
        x.gone = display == "none" or not display and ("hidden" in a or x.tag == "dialog" and "open" not in a)
        if x.gone or x.tag in HIDDEN:
            continue
        shown = own["visibility"][0] if "visibility" in own else ""
        seen = shown == "visible" or shown == "initial" or seen and shown not in ("hidden", "collapse")
        if not seen:
            x.unseen, x.gone = True, x.tag in VOID and x.tag not in ("br", "hr")
            x.items = [c for c in x.items if isinstance(c, Node)]
        if x.tag == "details" and "open" not in a:
            x.items = [c for c in x.items if isinstance(c, Node) and c.tag == "summary"][:1]
        below += [(c, seen) for c in x.items if isinstance(c, Node)]


def _wide(s: str) -> int:
    """The columns that a text takes: two for wide characters, none for combining ones."""
    return len(s) if s.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines so far; `gap` counts the line ends that the next text asks for, 1 for a new line and 2 for a blank one."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.space, self.indent, self.ends = 0, False, "", 0  # line ends since the last text in <pre>

    def want(self, n: int) -> None:
        self.gap, self.space, self.ends = max(self.gap, n), False, 0

    def text(self, s: str) -> None:
        """Inline text; runs of white space are one space, none at a line's ends."""
        s = BLANK.sub(" ", unescape(s)).replace("\xa0", " ")
        if s == " ":
            self.space = self.space or bool(self.out) and not self.gap
            return
        if not s:
            return
        lead, tail = s[0] == " ", s[-1] == " "
        self.put((" " if (lead or self.space) and not self.gap and self.out else "") + s.strip(" "))
        self.space = tail

    def put(self, s: str) -> None:
        if self.gap:
            self.out.append(("\n" * self.gap if self.out else "") + self.indent)
            self.gap = 0
        self.out.append(s)
        self.space, self.ends = False, 0

    def lines(self, lines: list[str]) -> None:
        for x in lines:
            self.put(x)
            self.want(1)


def _inline(node: Node, tables: dict[int, list[str]]) -> str:
    """A cell's text on one line."""
    page = Page()
    _walk(node, page, tables)
    return BLANK.sub(" ", "".join(page.out)).strip()


def _holders(table: Node) -> set[int]:
    """Elements that hold rows or cells of this table besides its own parts, such as forms."""
    found: set[int] = set()
    work: list[tuple[Node, tuple | None]] = [(table, None)]
    while work:
        x, path = work.pop()
        for c in x.items:
            if isinstance(c, str) or c.tag == "table":
                continue
            if c.tag in ("tr", "td", "th"):
                up = path
                while up and id(up[0]) not in found:
                    found.add(id(up[0]))
                    up = up[1]
            if c.tag not in ("td", "th", "caption"):
                work.append((c, (c, path)))
    return found


def _rows(table: Node, tables: dict[int, list[str]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The table's rows, and as text what stands in it outside of cells."""
    holders = _holders(table)
    loose, cells = Node("span", ""), []

    def text() -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        if loose.items:
            yield "text", [(_inline(loose, tables), 1, 1)]
            loose.items = []

    def row() -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        if cells:
            yield "row", cells[:]
            cells.clear()

    work: list = [("one", x) for x in reversed(table.items)]
    while work:
        step, x = work.pop()
        if step == "end":
            yield from text()
            yield from row()
        elif isinstance(x, str):
            loose.items.append(x)
        elif hidden(x):
            continue
        elif x.tag in ("td", "th"):
            yield from text()
            cells.append((_inline(x, tables), *(_span(x, k) for k in ("colspan", "rowspan"))))
        elif x.tag in ("tr", "thead", "tbody", "tfoot") or id(x) in holders:
            yield from text()
            if x.tag in ("tr", "thead", "tbody", "tfoot"):
                yield from row()
                if x.tag == "tr" and id(x) not in holders:  # an empty row still counts for cells over several rows
                    yield "row", []
                work.append(("end", x))
            work += [("one", c) for c in reversed(x.items)]
        elif x.tag in BLOCK:
            yield from text()
            yield "text", [(_inline(x, tables), 1, 1)]
        else:
            loose.items.append(x)
    yield from text()
    yield from row()


def _span(cell: Node, name: str) -> int:
    """How many columns or rows a cell takes, up to the most that HTML has."""
    if name not in cell.attrs.lower():
        return 1
    v = _attributes(cell.attrs).get(name, "1").strip()
    return min(SPANS[name], max(1, int(v))) if v.isdecimal() and len(v) < 10 else 1


def _lines(node: Node, tables: dict[int, list[str]]) -> list[str]:
    """A table's lines: cells in columns as wide as their widest text, two spaces apart; a cell over several columns or rows keeps the others in place. Text outside of cells stands before its row."""
    out: list[str | list[tuple[int, str]]] = []
    width: dict[int, int] = {}
    down: dict[int, int] = {}  # of columns: rows that a cell above still takes
    for kind, cells in _rows(node, tables):
        if kind == "text":
            if cells[0][0]:
                out.append(cells[0][0])
            continue
        row, at, taken = [], 0, {}
        for text, wide, deep in cells:
            while down.get(at, 0):
                at += 1
            row.append((at, text))
            width[at] = max(width.get(at, 0), _wide(text) if wide == 1 else 0)
            if deep > 1:
                taken.update(dict.fromkeys(range(at, at + wide), deep))
            at += wide
        down = {k: v - 1 for k, v in (down | taken).items() if v > 1}
        out.append(row)
    start, x = {}, 0
    for k in sorted(width):
        start[k] = x
        x += width[k] + 2
    lines = []
    for row in out:
        if isinstance(row, str):
            lines.append(row)
            continue
        line, used = [], 0
        for k, text in row:
            if text:
                at = max(start[k], used + 2 if line else 0)
                line += [" " * (at - used), text]
                used = at + _wide(text)
        if line:
            lines.append("".join(line))
    return lines


def _number(text: str | None, other: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", text) else other


def _walk(node: Node, page: Page, tables: dict[int, list[str]], pre: bool = False) -> None:
    """Writes what is visible in a node; tables inside are known by their lines."""
    work: list[tuple] = [("items", node, pre)]
    while work:
        step, x, pre = work.pop()
        if step == "items":
            if x.tag in ("ol", "ul", "menu", "dir"):
                a = _attributes(x.attrs) if x.tag == "ol" else {}
                way = -1 if "reversed" in a else 1
                number = _number(a.get("start"), sum(isinstance(c, Node) and c.tag == "li" and not hidden(c) for c in x.items) if way < 0 else 1)
                kids = []
                for c in x.items:
                    if isinstance(c, Node) and c.tag == "li":
                        if x.tag == "ol" and "value" in c.attrs.lower():
                            number = _number(_attributes(c.attrs).get("value"), number)
                        kids.append(("item", (c, f"{number}. " if x.tag == "ol" else "- "), pre))
                        number += 0 if hidden(c) else way
                    else:
                        kids.append(("one", c, pre))
                work += reversed(kids)
            else:
                work += [("one", c, pre) for c in reversed(x.items)]
        elif step == "end":
            page.want(x)
        elif step == "indent":
            page.indent = x
        elif step == "item":
            c, mark = x
            if hidden(c):
                continue
            page.want(1)
            before, page.indent = page.indent, page.indent
            if not c.unseen:
                page.put(mark)
            page.indent = before + " " * len(mark)
            page.marked = len(page.out)
            work += [("end", 1, pre), ("indent", before, pre), ("items", c, pre)]
        elif isinstance(x, str):
            if pre:
                for k, line in enumerate(unescape(x).replace("\r\n", "\n").split("\n")):
                    if k:
                        page.ends += 1
                        page.gap = max(page.gap, page.ends)
                    if line.strip():
                        page.put(line.rstrip())
            else:
                page.text(x)
        elif not hidden(x):
            tag = x.tag
            if tag == "br":
                page.gap, page.space = page.gap + 1 if page.gap < 2 else 2, False
            elif tag == "hr":
                page.want(2)
            elif tag == "img":
                alt = _attributes(x.attrs).get("alt", "").strip()
                if alt:
                    page.text(alt)
            elif tag == "input":
                a = _attributes(x.attrs)
                if a.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "image") and a.get("value"):
                    page.text(a["value"])
            elif tag == "table":
                page.want(2)
                page.lines(tables[id(x)])
                page.want(2)
            elif tag in BLOCK or tag in ("td", "th"):
                n = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and page.indent) else 1
                if not (page.out and getattr(page, "marked", -1) == len(page.out)):
                    page.want(n)
                kids = [("end", n, pre), ("items", x, pre or tag in ("pre", "textarea"))]
                if tag in ("dd", "blockquote"):
                    kids.insert(1, ("indent", page.indent, pre))
                    page.indent += "  "
                work += kids
            else:
                work.append(("items", x, pre or tag in ("textarea", "listing", "xmp")))


def render(html: str | None) -> str:
    """A page's visible text. Null and pages without any give an empty text."""
    if not html:
        return ""
    root = parse(html)
    settle(root)
    found, work = [], [root]
    while work:
        x = work.pop()
        if x.tag == "table":
            found.append(x)
        work += [c for c in x.items if isinstance(c, Node)]
    tables: dict[int, list[str]] = {}
    for x in reversed(found):  # inner ones first
        tables[id(x)] = _lines(x, tables)
    page = Page()
    _walk(root, page, tables)
    return "".join(page.out).strip("\n").rstrip()


def render_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text for each row: what a reader sees of its whole html, in order.

    Blocks stand on lines of their own, paragraphs and the like behind a blank one; items have a dash or a number and are indented by
    depth; table cells are aligned in columns; white space is one space but in <pre>. Scripts, styles, the head, comments and elements that are hidden or invisible,
    by their own attributes or by rules of <style> for tags, classes and ids, are left out, as is the body of a closed <details>; the head ends at the first text or tag that can't stand in it. What a table holds outside of cells
    stands before it. Broken html never fails: open tags end with the page. Null gives an empty text. Repeated rows
    stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array([render(x.as_py()) for x in batch["html"]], pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string")
