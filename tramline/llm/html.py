"""Visible text of web pages, laid out by a small tree builder and renderer."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# Fixed values of the HTML standard: elements by how they nest and how they are shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe datalist object audio video canvas title defs metadata desc annotation annotation-xml rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p plaintext pre search section summary ul table caption tr xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure fieldset hr".split())
#: Starting one of these ends an open one of those, up to the nearest of the limits.
LIST, TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), LIST | TABLE), "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | TABLE), "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | TABLE),
    "td": (frozenset("td th caption".split()), TABLE | {"tr"}), "th": (frozenset("td th caption".split()), TABLE | {"tr"}), "tr": (frozenset("tr td th caption".split()), TABLE),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), TABLE), "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), TABLE), "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), TABLE),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: A block ends an open paragraph, unless one of these stands between.
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "tr", "caption"} | {"hr"}
P_LIMITS = frozenset("td th caption table button object html body".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title script style template noscript head html".split())
#: Elements that end at whatever they can't hold.
HOLDS = {"head": HEAD_ONLY, "colgroup": frozenset(["col", "template"])}

TOKEN = re.compile(r"<!--(?:(?!-->).)*(?:-->|\Z)|<(?:!|\?|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Elements that may be open at once; deeper ones become children of the deepest.
DEEPEST = 256


class Node:
    """`hidden`: not displayed, with all it holds. `shown`: visible; those inside may be otherwise. `chosen`: an option
    that is selected, or a select that shows all of its options, or details that are open."""

    __slots__ = ("children", "chosen", "down", "hidden", "ordinal", "shown", "span", "tag")

    def __init__(self, tag: str, hidden: bool = False, shown: bool = True):
        self.tag, self.hidden, self.shown, self.children, self.ordinal, self.span = tag, hidden, shown, [], None, 1
        self.down, self.chosen = 1, False


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\t\n\r\f") else {}


def number(text: str | None, least: int, most: int, default: int) -> int:
    return min(most, max(least, int(text))) if text and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def tree(html: str) -> Node:
    """Elements with their implied starts and ends; comments and declarations are dropped."""
    root = Node("html")
    stack = [root]
    beyond: list[str] = []  # open elements that aren't on the stack, which is full

    def end(tags, limits) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return end(tags, limits)
            if stack[i].tag in limits:
                return None
        return None

    def leave(tag: str) -> None:
        if tag not in HOLDS.get(stack[-1].tag, (tag,)):
            stack.pop()

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if text.strip():
                leave("")
            if stack[-1].shown:
                stack[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in beyond:
                del beyond[len(beyond) - 1 - beyond[::-1].index(tag) :]
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))  # an end tag alone is an empty paragraph
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                limits = frozenset() if tag in ("body", "html", "table") else TABLE if tag in BLOCK else TABLE | {"td", "th"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        beyond.clear()
                        break
                    if stack[i].tag in limits:
                        break
            continue
        if tag == "html":
            continue
        leave(tag)
        if tag in CLOSES_P:
            end(frozenset(["p"]), P_LIMITS)
        if tag in ENDS:
            end(*ENDS[tag])
        a = attributes(m[3])
        style = a.get("style", "")
        seen = VISIBILITY.search(style)
        shown = seen[1].lower() == "visible" if seen and seen[1].lower() in ("visible", "hidden", "collapse") else stack[-1].shown
        node = Node(tag, tag in HIDDEN or "hidden" in a or bool(GONE.search(style)) or (tag == "dialog" and "open" not in a) or (tag == "input" and a.get("type", "").lower() == "hidden"), shown)
        node.chosen = "selected" in a or "multiple" in a or "open" in a
        if tag in ("td", "th"):
            node.span, node.down = number(a.get("colspan"), 1, 100, 1), number(a.get("rowspan"), 0, 65534, 1)
        elif tag == "ol":
            node.ordinal = number(a.get("start"), -(10**6), 10**6, 1)
        elif tag == "li" and "value" in a:
            node.ordinal = number(a["value"], -(10**6), 10**6, 1)
        elif tag == "img" and a.get("alt") and shown:
            node.children.append(a["alt"])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(html, at)
            body, at = (html[at : close.start()], close.end()) if close else (html[at:], size)
            if not node.hidden and shown:
                node.children.append(body if tag == "xmp" else unescape(body))
        elif tag not in VOID and not (m[3].endswith("/") and any(x.tag in ("svg", "math") for x in stack)):
            # an element that isn't displayed is put on a full stack too, once, so that what it holds stays hidden
            if len(stack) < DEEPEST or (len(stack) == DEEPEST and node.hidden):
                stack.append(node)
            else:
                beyond.append(tag)
    return root


def width(text: str) -> int:
    """Columns of a text in a fixed-width face."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of a box: collapses white space, keeps asked-for gaps between blocks."""

    def __init__(self):
        self.lines, self.now, self.gap, self.pending = [], "", 0, False

    def text(self, t: str) -> None:
        t = SPACE.sub(" ", t)
        if t.startswith(" ") and self.now and not self.now.endswith(" "):
            self.now += " "
        t = t.lstrip(" ") if not self.now or self.now.endswith(" ") else t
        if t:
            self.start()
            self.now += t

    def start(self) -> None:
        if not self.now and self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def literal(self, t: str) -> None:
        for i, line in enumerate(t.split("\n")):
            if i:
                self.start()
                self.lines.append(self.now)
                self.now = ""
            if line:
                self.start()
                self.now += line

    def br(self) -> None:
        self.start()
        self.lines.append(self.now.rstrip(" "))
        self.now = ""

    def block(self, gap: int) -> None:
        """Ends the line; the next text stands `gap` lines below."""
        if self.now.strip(" "):
            self.lines.append(self.now.rstrip(" "))
        self.now = ""
        if self.lines:
            self.gap = max(self.gap, gap)

    def box(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self.start()
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.block(1)
        lines = self.lines
        while lines and not lines[-1].strip(" "):
            lines.pop()
        first = next((i for i, x in enumerate(lines) if x.strip(" ")), 0)
        return lines[first:]


def table(node: Node) -> list[str]:
    """Rows as lines whose cells stand in aligned columns, two spaces apart; a caption stands above.

    A cell over several rows is shown in the first one and keeps its columns free in the others of its row group.
    """
    rows, captions = [], []
    taken: dict[int, int] = {}  # column -> rows that a cell above still takes of it

    def add(cells: list[Node]) -> None:
        row, at, now = [], 0, dict(taken)
        for c in cells:
            while now.get(at, 0):
                at += 1
            row.append((at, rendered(c.children), c.span))
            for k in range(at, at + c.span):
                taken[k] = max(now.get(k, 0), c.down or 1 << 30)
            at += c.span
        for k in list(taken):
            taken[k] -= 1
            if not taken[k]:
                del taken[k]
        rows.append(row)

    def collect(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str) or c.hidden:
                if isinstance(c, str) and c.strip():
                    captions.extend(rendered([c]))  # text between cells is shown before the table
            elif c.tag == "tr":
                add([k for k in c.children if not isinstance(k, str) and not k.hidden and k.tag in ("td", "th")])
                for k in c.children:
                    if isinstance(k, str) or (k.tag not in ("td", "th") and not k.hidden):
                        captions.extend(rendered([k]))
            elif c.tag in ("thead", "tbody", "tfoot"):
                taken.clear()
                collect(c)
                taken.clear()
            elif c.tag in ("td", "th"):
                add([c])
            elif c.tag not in ("colgroup", "col"):
                captions.extend(rendered([c]))

    collect(node)
    wide: dict[int, int] = {}
    for row in rows:
        for at, lines, span in row:
            if span == 1:
                wide[at] = max(wide.get(at, 0), *map(width, lines or [""]))
    out = captions
    for row in rows:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, end = "", 0
            for at, lines, span in row:
                line += " " * sum(wide.get(k, 0) + 2 for k in range(end, at))
                room = sum(wide.get(k, 0) + 2 for k in range(at, at + span))
                cell = lines[i] if i < len(lines) else ""
                line += cell + " " * max(2, room - width(cell))
                end = at + span
            out.append(line.rstrip(" "))
    return out


def walk(node: Node):
    """The elements of a select, those of its groups too."""
    for c in node.children:
        if not isinstance(c, str) and not c.hidden:
            yield c
            if c.tag == "optgroup":
                yield from walk(c)


def rendered(children: list) -> list[str]:
    out = Lines()

    def show(nodes: list, plain: bool, state: dict) -> None:
        for x in nodes:
            if isinstance(x, str):
                if plain:
                    out.literal(x)
                else:
                    out.text(x)
            elif x.hidden:
                continue
            elif x.tag == "br":
                out.br()
            elif x.tag == "hr":
                out.box(["-" * 20], 2)
            elif x.tag == "table":
                out.box(table(x), 2)
            elif x.tag in ("ul", "ol", "menu", "dir"):
                show_list(x)
            elif x.tag == "select":
                options = [o for o in walk(x) if o.tag == "option" and not o.hidden]
                for i, o in enumerate(options if x.chosen else [o for o in options if o.chosen][-1:] or options[:1]):
                    out.text(" " * bool(i))
                    show(o.children, plain, state)
            elif x.tag == "details" and not x.chosen:
                out.block(1)
                show(next(([c] for c in x.children if not isinstance(c, str) and c.tag == "summary"), []), plain, state)
                out.block(1)
            elif x.tag in ("pre", "xmp"):
                out.block(2)
                show([x.children[0].removeprefix("\n"), *x.children[1:]] if x.children and isinstance(x.children[0], str) else x.children, True, state)
                out.block(2)
            elif x.tag == "dd":
                out.box(["    " + line for line in rendered(x.children)], 1)
            elif x.tag in BLOCK:
                gap = 2 if x.tag in SPACED else 1
                out.block(gap)
                show(x.children, plain, state)
                out.block(gap)
            elif x.tag in ("td", "th"):
                show(x.children, plain, state)
                out.text(" ")
            else:
                show(x.children, plain, state)

    def show_list(x: Node) -> None:
        lines, number_now = [], x.ordinal if x.tag == "ol" and x.ordinal is not None else 1
        for c in x.children:
            if isinstance(c, str) or c.hidden:
                lines += rendered([c]) if isinstance(c, str) else []
            elif c.tag == "li":
                number_now = c.ordinal if c.ordinal is not None else number_now
                mark = (f"{number_now}. " if x.tag == "ol" else "* ") if c.shown else ""
                number_now += 1
                inner = rendered(c.children)
                lines += [(mark if i == 0 else " " * len(mark)) + line if line else "" for i, line in enumerate(inner or [""])]
            else:
                lines += ["  " + line if line else "" for line in rendered([c])]
        out.box([line.rstrip(" ") for line in lines], 2)

    show(children, False, {})
    return out.done()


def visible_text(html: str) -> str:
    return "\n".join(rendered(tree(html).children))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Id and `text`: all visible text of each page, as a reader would see it.

    Implied tags are supplied (paragraphs, list items, cells, rows, head and body), elements that aren't shown are left
    out (head, scripts, templates, fallbacks, `hidden`, display:none, closed dialogs, the body of closed details, options
    that aren't shown), visibility is inherited and may be set again inside, aria-hidden text is shown; blocks stand on lines of
    their own with a blank line around paragraphs, headings, lists and tables, list items carry marks and cells stand in
    columns. Null and empty pages give an empty text; broken or cut-off markup is read as far as it goes, nesting beyond
    DEEPEST is flattened (hidden elements stay hidden); null and repeated ids are kept row by row; other columns aren't read. No shuffle.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(h or "") for h in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "id long, text string")
    return out.withColumnRenamed("id", id_col)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
