"""HTML as the text that a reader would see, laid out in plain lines.

A tokenizer and a tree builder with implied tags (unclosed paragraphs, items, rows
and cells, missing bodies and rows of tables, raw text elements) make a tree; what is
never shown is left out: scripts, styles, templates, comments, heads, closed details,
and elements hidden by attribute, by style or by a class that by convention hides text
from sight. Styles are those of ``style`` attributes and of ``style`` elements, as far as
their selectors are elements, classes and ids, alone or joined (``p.x#y``); rules with
other selectors, and those under conditions other than ``@media screen`` or ``all``, are
not followed. Visibility is inherited, and what lies in hidden elements may be visible.
The renderer emits all other text: inline text with white space
collapsed, blocks on lines of their own with one blank line around paragraphs,
headings and lists, items with bullets or numbers and indented by depth,
preformatted text as it is, and tables with cells padded to aligned columns.

Time and output grow with the page, whatever it holds: columns are not widened for
lines of cells wider than WIDEST, padding carries no line beyond LINE columns, tables
within more than NESTED others are laid out as blocks, and indents end at INDENT. None
of these leaves text out. Text between the rows of a table stays where it is.
Defined results: null or empty html gives empty text; malformed markup never fails,
what can't be a tag is text; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title annotation annotation-xml desc metadata defs symbol".split())
#: Classes of text for screen readers only, which repeats what is shown in another form.
UNSEEN = frozenset("katex-mathml mjx_assistive_mathml sr-only visually-hidden screen-reader-text".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article".split())
LISTS = frozenset("ul ol menu dir".split())
PREFORMATTED = frozenset({"pre", "textarea"})
#: Inline elements that stand apart from their neighbours.
APART = frozenset("option text textarea button".split())
#: A start tag on the left ends these open elements, up to the nearest of the elements on the right.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of tables and the elements in which they may lie; rows and bodies that are missing between are implied.
TABLE_PARTS = {name: ("table", "thead", "tbody", "tfoot", "tr") for name in ("td", "th")} | {"tr": ("table", "thead", "tbody", "tfoot")}
TABLE_PARTS |= {name: ("table",) for name in ("thead", "tbody", "tfoot", "caption", "colgroup")}
#: An end tag doesn't close anything outside of these.
SCOPES = frozenset({"table", "td", "th", "caption", "html"})
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: Most columns and rows of a cell.
COLSPAN, ROWSPAN = 1000, 65_534
#: More ids than a selector has: a style attribute comes before any rule.
INLINE = 1 << 30
#: Elements within which a slash ends an element.
FOREIGN = frozenset({"svg", "math"})
WIDEST, LINE, NESTED, INDENT = 100, 280, 50, 60

PLAIN_TAG = re.compile(r"([A-Za-z][^\s/>]*+)([^>\"']*+)>")
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
TAG_MARK = re.compile(r"[>\"']")
BARE_TAG = re.compile(r"([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
CSS_SKIPPED = re.compile(r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?|<!--|-->", re.S)
CSS_MARK = re.compile(r"[{};]")
SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*+)?((?:[.#][\w-]++)*+)")
SCREEN = re.compile(r"@media\s+(?:[^{]*,\s*)?(?:only\s+)?(?:screen|all)\s*(?:,.*)?", re.I | re.S)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
LONG_NUMBER = re.compile(r"&#0*[1-9][0-9]{7,};?")


@dataclass
class Node:
    name: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str


def unescaped(text: str) -> str:
    """Text with character references resolved; numbers beyond all characters become U+FFFD."""
    return entities.unescape(LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", ""), ("", name, attributes) of start tags, ("", "/name", "") of end tags; raw elements bring their text."""
    at, begin, last = 0, 0, source.rfind(">")
    dead: set[int] = set()
    while 0 <= (at := source.find("<", at)) < last:
        after = source[at + 1 : at + 2]
        found = None
        if after in "!?":
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                stop = len(source) if stop < 0 else stop + 3
            else:
                stop = source.find(">", at) + 1
        elif after == "/" and source[at + 2 : at + 3].isalpha() and source[at + 2].isascii():
            found = BARE_TAG.match(source, at + 2)
            stop = found.end()
        elif after.isascii() and after.isalpha():
            found = PLAIN_TAG.match(source, at + 1)
            if not found:
                head = TAG_NAME.match(source, at + 1)
                stop = tag_end(source, head.end(), dead)
                found = (None, head[0], source[head.end() : stop - 1]) if stop else BARE_TAG.match(source, at + 1)
            stop = found.end() if isinstance(found, re.Match) else stop
        else:
            at += 1
            continue
        if begin < at:
            yield source[begin:at], "", ""
        begin = at = stop
        if found and after == "/":
            yield "", "/" + found[1].lower(), ""
        elif found:
            name = found[1].lower()
            yield "", name, found[2]
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(source, at) if at < last else None
                body = source[at : close.start() if close else len(source)]
                if body:
                    yield body, name, ""
                begin = at = close.end() if close else len(source)
    if begin < len(source):
        yield source[begin:], "", ""


def tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where a tag ends whose attributes begin at ``at``; 0 if its quotes lead to no end.

    ``dead`` keeps the opening quotes from which no end is reached, so that no text is searched twice.
    """
    tried = []
    while found := TAG_MARK.search(source, at):
        if found[0] == ">":
            return found.end()
        if found.start() in dead:
            break
        tried.append(found.start())
        at = source.find(found[0], found.end()) + 1
        if not at:
            break
    dead.update(tried)
    return 0


def parse(source: str) -> tuple[Node, Styles]:
    """The tree of a page, whose root is ``html``, and what its style elements say."""
    root, styles = Node("html"), Styles()
    stack = Open(root)
    raw = None
    for text, name, attrs in tokens(source):
        if text and name:
            raw.children.append(unescaped(text) if name in ("title", "textarea") else text)
            if name == "style" and not stack.places["template"] and SCREEN.fullmatch(f"@media {raw.attrs.get('media', '').strip() or 'all'}"):
                styles.add(text)
        elif text:
            if stack[-1].name == "head" and text.strip():
                stack.cut(len(stack) - 1)
            stack[-1].children.append(unescaped(text))
        elif name.startswith("/"):
            closed(stack, name[1:])
        elif name == "html":
            root.attrs = attributes(attrs) | root.attrs
        elif name:
            opened(stack, name)
            node = Node(name, attributes(attrs) if attrs else {})
            stack[-1].children.append(node)
            if name in RAW:
                raw = node
            elif name not in VOID and not (attrs.endswith("/") and stack.last(FOREIGN)):
                stack.push(node)
    return root, styles


def attributes(text: str) -> dict:
    return short_attributes(text) if len(text) < 500 else found_attributes(text)


def found_attributes(text: str) -> dict:
    return {a.lower(): unescaped(x or y or z or "") for a, x, y, z in reversed(ATTR.findall(text))}


short_attributes = lru_cache(4096)(found_attributes)


class Open(list):
    """The open elements, and the places of those of each name and of all blocks."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self))
        if node.name in BLOCKS:
            self.blocks.append(len(self))
        self.append(node)

    def cut(self, k: int) -> None:
        for node in self[k:]:
            self.places[node.name].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        del self[k:]

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def first_after(self, names: Iterable[str], k: int) -> int:
        """The place of the outermost open element of these names within the one at ``k``, 0 if there is none."""
        return min((p[bisect_right(p, k)] for n in names if (p := self.places[n]) and p[-1] > k), default=0)


def opened(stack: Open, name: str) -> None:
    """Closes what a start tag implies to be at its end, and opens what it implies to have begun."""
    if stack[-1].name == "head" and name not in HEAD_ONLY:
        stack.cut(len(stack) - 1)
    if name in BLOCKS and stack.places["p"] and stack.blocks[-1] == stack.places["p"][-1]:  # a block ends an open paragraph
        stack.cut(stack.places["p"][-1])
    ends, bound = IMPLIED_ENDS.get(name, ((), ()))
    if ends and stack.last(ends) > (within := stack.last(bound)):
        stack.cut(stack.first_after(ends, within) if len(ends) > 2 else stack.last(ends))
    if name in TABLE_PARTS and (context := stack.last(TABLE_PARTS[name])) > stack.last(("td", "th")):
        stack.cut(context + 1)
        implied = ["tbody"] * (stack[-1].name == "table" and name in ("tr", "td", "th")) + ["tr"] * (stack[-1].name != "tr" and name in ("td", "th"))
        for node in map(Node, implied):
            stack[-1].children.append(node)
            stack.push(node)


def closed(stack: Open, name: str) -> None:
    k = stack.last((name,))
    if k and (name in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") or k >= stack.last(SCOPES)):
        stack.cut(k)
    elif name in ("p", "br"):
        stack[-1].children.append(Node(name))


class Styles:
    """What the rules of style sheets say of ``display`` and ``visibility``."""

    def __init__(self):
        self.rules: dict[str, dict[tuple[str, str, frozenset[str]], dict]] = defaultdict(dict)
        self.known: dict[tuple, dict] = {}
        self.order = 0

    def add(self, sheet: str) -> None:
        """Rules of a sheet; at the end of the sheet all blocks end."""
        text = CSS_SKIPPED.sub(lambda x: '""' if x[0][0] in "\"'" else " ", sheet) + "}"
        begin, blocks = 0, []  # of each open block: whether its rules hold, selectors (None of groups of rules), declarations
        for mark in CSS_MARK.finditer(text):
            before = text[begin : mark.start()].strip()
            begin = mark.end()
            if mark[0] == "{":
                holds = not blocks or blocks[-1][0] and blocks[-1][1] is None
                if before.startswith("@"):
                    blocks.append((holds and SCREEN.fullmatch(before) is not None, None, {}))
                else:
                    blocks.append((holds, before, {}))
                continue
            if blocks and blocks[-1][0]:
                for name, value, important in DECLARED.findall(before):
                    known = blocks[-1][2].get(name.lower())
                    if not known or important or not known[0]:
                        blocks[-1][2][name.lower()] = bool(important), value.lower()
            if mark[0] == "}" and blocks:
                holds, selectors, declared = blocks.pop()
                if declared and selectors is not None:
                    self.rule(selectors, declared)

    def rule(self, selectors: str, declared: dict) -> None:
        self.order += 1
        for found in map(SELECTOR.fullmatch, map(str.strip, selectors.split(","))):
            if found and found[0]:
                parts = found[2].replace("#", ".#").split(".")[1:]
                ids, classes = {x[1:] for x in parts if x[0] == "#"}, frozenset(x for x in parts if x[0] != "#")
                element = (found[1] or "*").lower()
                if len(ids) > 1:
                    continue
                own = "".join(ids)
                weight = len([x for x in parts if x[0] == "#"]), len([x for x in parts if x[0] != "#"]), element != "*", self.order
                known = self.rules["#" + own if ids else "." + min(classes) if classes else element].setdefault((element, own, classes), {})
                for what, (important, value) in declared.items():
                    known[what] = max(known.get(what, ()), (important, weight, value))

    def ruled(self, name: str, own: str, classes: str) -> dict:
        """Of each property (whether important, weight, value), as sheets say it of elements of a name, id and classes."""
        found: dict[str, tuple] = {}
        of = set(classes.split())
        for key in ["*", name, "#" + own, *("." + x for x in of)]:
            for (element, its, needed), known in self.rules.get(key, {}).items():
                if element in ("*", name) and its in ("", own) and needed <= of:
                    for what, says in known.items():
                        found[what] = max(found.get(what, ()), says)
        return found

    def of(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether an element is displayed, and whether it is visible in one that is visible or not."""
        if node.name in HIDDEN or node.name == "input" and node.attrs.get("type", "").lower() == "hidden":
            return False, False
        attrs = node.attrs
        if UNSEEN.intersection(attrs.get("class", "").lower().split()):
            return False, False
        found = {}
        if self.rules:
            key = node.name, attrs.get("id", ""), attrs.get("class", "")
            if key not in self.known:
                self.known[key] = self.ruled(*key)
            found = dict(self.known[key])
        for k, (name, value, important) in enumerate(DECLARED.findall(attrs["style"]) if "style" in attrs else ()):
            found[name.lower()] = max(found.get(name.lower(), ()), (bool(important), (INLINE, k), value.lower()))
        display = found["display"][2] if "display" in found else "none" if "hidden" in attrs or node.name == "dialog" and "open" not in attrs else ""
        visibility = found["visibility"][2] if "visibility" in found else ""
        return display != "none", visibility in ("visible", "initial") or visible and visibility not in ("hidden", "collapse")


def content(node: Node) -> list:
    """Children that are laid out: of closed details only the summary."""
    if node.name == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    return node.children


def width(text: str) -> int:
    """Columns of a terminal: wide East Asian characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines so far; blank lines between blocks are asked for and never doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space = "", False, False
        self.prefix: list[str] = []
        self.bullet = ""

    def inline(self, text: str) -> None:
        parts = SPACE.sub(" ", text)
        if parts == " ":
            self.space = True
            return
        if parts.startswith(" "):
            self.space = True
        word = parts.strip(" ")
        if word:
            self.line += (" " if self.space and self.line else "") + word
            self.space = parts.endswith(" ")

    def end_line(self) -> None:
        if self.line:
            self.put(self.line)
        self.line, self.space = "", False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.prefix[:INDENT])[:INDENT]
        if self.bullet:
            lead = lead[: max(0, len(lead) - len(self.bullet))] + self.bullet
            self.bullet = ""
        self.lines.append((lead + line).rstrip())

    def blank(self) -> None:
        self.end_line()
        self.gap = True


def render(nodes: list, styles: Styles, visible: bool = True, within: int = 0) -> str:
    """All visible text of nodes that lie in a visible element or not, and in how many tables."""
    page, pre, counters = Page(), 0, []
    work: list = [("in", node, visible) for node in reversed(nodes)]
    while work:
        what, node, visible = work.pop()
        if what == "table":
            page.blank()
            for row in node:
                page.put(row)
            page.gap = True
            continue
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                page.line += " " * (page.space and page.line != "")
                page.space = False
                *full, last = node.split("\n")
                for x in full:
                    page.put(page.line + x)
                    page.line = ""
                page.line += last
            else:
                page.inline(node)
            continue
        name = node.name
        if what == "out":
            page.space |= name in APART
            if name in BLOCKS:
                page.end_line()
                page.gap = page.gap or name in SPACED and not (name in LISTS and len(counters) > 1)
            if name in PREFORMATTED:
                pre -= 1
            if name in LISTS:
                counters.pop()
            if name == "li" or name in ("dd", "blockquote"):
                page.prefix.pop()
                page.bullet = ""
            continue
        displayed, visible = styles.of(node, visible)
        if not displayed:
            continue
        if name in ("hr", "img", "input") and not visible:
            continue
        if name == "br":
            page.put(page.line)
            page.line, page.space = "", False
            continue
        if name == "hr":
            page.blank()
            page.put("-" * 10)
            page.gap = True
            continue
        if name == "img":
            page.inline(node.attrs.get("alt", ""))
            continue
        if name == "input":
            page.inline(node.attrs.get("value", "") if node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file") else "")
            continue
        if name == "table" and within < NESTED:
            page.end_line()
            work.append(("table", table_lines(node, styles, visible, within + 1), visible))
            continue
        if name in BLOCKS:
            page.end_line()
            page.gap = page.gap or name in SPACED and not (name in LISTS and counters)
        page.space |= name in APART
        if name == "optgroup" and visible:
            page.inline(f" {node.attrs.get('label', '')} ")
        if name in PREFORMATTED:
            pre += 1
        if name in LISTS:
            start = node.attrs.get("start", "1")
            counters.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        if name == "li":
            mark = "* "
            if counters and counters[-1][0]:
                mark = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            page.prefix.append(" " * len(mark))
            page.bullet = mark if visible else ""
        elif name in ("dd", "blockquote"):
            page.prefix.append("    " if name == "dd" else "> ")
        work.append(("out", node, visible))
        work += [("in", c, visible) for c in reversed(content(node))]
    page.end_line()
    return "\n".join(page.lines).strip("\n")


#: Rows and columns that a cell takes, and its lines.
Cell = tuple[int, int, list[str]]


def spans(cell: Node) -> tuple[int, int]:
    """Rows and columns that a cell takes; what isn't a number is 1."""
    found = []
    for name, most in (("rowspan", ROWSPAN), ("colspan", COLSPAN)):
        digits = re.match(r"\s*([0-9]*)", cell.attrs.get(name, ""))[1].lstrip("0")
        found.append(max(1, min(int(digits), most)) if 0 < len(digits) < 7 else most if digits else 1)
    return found[0], found[1]


def table_lines(table: Node, styles: Styles, visible: bool, within: int) -> list[str]:
    """Rows of a table with cells padded to their columns; a cell's own lines stay one below the other, text between rows where it is."""
    rows: list[list[Cell] | str] = []
    todo = [(c, visible) for c in reversed(table.children)]
    while todo:
        node, visible = todo.pop()
        if isinstance(node, str):
            if visible and node.strip():
                rows.append(SPACE.sub(" ", node).strip())
        elif node.name in ("tr", "tbody", "thead", "tfoot"):
            displayed, visible = styles.of(node, visible)
            if not displayed:
                continue
            if node.name != "tr":
                todo += [(c, visible) for c in reversed(node.children)]
                continue
            cells: list[Cell] = []
            for c in node.children:
                if isinstance(c, Node) and c.name in ("td", "th"):
                    displayed, seen = styles.of(c, visible)
                    if displayed:
                        cells.append((*spans(c), render(c.children, styles, seen, within).split("\n")))
                elif isinstance(c, Node) or c.strip():
                    rows += [x for x in render([c], styles, visible, within).split("\n") if x]
            rows.append(cells)
        else:
            rows += [x for x in render([node], styles, visible, within).split("\n") if x]
    return aligned(rows)


def aligned(rows: list[list[Cell] | str]) -> list[str]:
    """Lines of rows of cells, and of lines between them."""
    placed: list[list[tuple[int, list[str]]] | str] = []
    busy: list[tuple[int, int, int]] = []  # columns (from, to) that cells from above take, and for how many more rows
    wide: dict[int, int] = {}
    for cells in rows:
        if isinstance(cells, str):
            placed.append(cells)
            continue
        c, mine, after, above = 0, [], [(a, b, n - 1) for a, b, n in busy if n > 1], iter(sorted(busy))
        taken = next(above, None)
        for down, across, lines in cells:
            while taken and taken[0] <= c:
                c, taken = max(c, taken[1]), next(above, None)
            mine.append((c, lines))
            wide[c] = max(wide.get(c, 0), *(w for x in lines if (w := width(x)) <= WIDEST), 0)
            if down > 1 and c < COLSPAN:
                after.append((c, c + across, down - 1))
            c += across
        placed.append(mine)
        busy = after
    columns, starts, total = sorted(wide), {}, 0
    for c in columns:
        starts[c] = total
        total += wide[c] + 2
    out = []
    for mine in placed:
        if isinstance(mine, str):
            out.append(mine)
            continue
        for k in range(max((len(lines) for _, lines in mine), default=0)):
            line, at = "", 0
            for c, lines in mine:
                if k < len(lines) and lines[k]:
                    size = width(lines[k])
                    pad = max(min(starts[c], LINE - size) - at, 2 * (line != ""))
                    line += " " * pad + lines[k]
                    at += pad + size
            out.append(line.rstrip())
    return out


def visible_text(source: str | None) -> str:
    if not source:
        return ""
    root, styles = parse(source)
    return render([root], styles)


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for every row."""
    narrow = pages.select(pages[id_col].alias("page_id"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["page_id", "text"])

    return narrow.mapInArrow(run, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, text string")


def page_report(pages: DataFrame, **columns) -> DataFrame:
    """page_id, n_chars, n_lines, text_sha256 and text."""
    found = page_texts(pages, **columns)
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"), F.sha2("text", 256).alias("text_sha256"), "text")
