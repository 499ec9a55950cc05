"""HTML to text by layout: a tree with implied tags, visibility rules, and rendering of blocks, lists and tables.

Blocks start on lines of their own, paragraphs and the like with an empty line between; white space collapses
outside <pre>; list items are marked and indented by depth; table cells are padded to columns. Invisible
are elements that are never shown (script, style, head, template ...), those with `hidden`, or hidden by their
own style or by a simple selector (tag, .class, #id) of the page's style sheets, and the closed part of details.
Rules count that hold on any screen; of those for a property the element's own style wins, then #id, .class and
tag, and for one selector the last (an important one first). What is inside of an element of hidden visibility
shows again where it is made visible.

Cells are aligned by columns, as colspan and rowspan place them. A table whose lines would be longer than LINE
has its cells two spaces apart instead, so that the text of a page grows with the page (by the padding of a line of
many empty cells up to some hundred times). Of drawings (svg) the texts are shown.

Defined cases: a null or empty page renders as the empty string. Unclosed, misnested and stray tags never
fail: an end tag without a start is left out, a `<` that starts no tag is text, as is all from a tag on that
never ends, a quotation mark without its mate is a character, elements nested deeper than DEPTH are placed at
that depth. Spans that are no numbers count as 1. Pages of any length are read in linear time. Rows that share
an id, and repeated rows, are rendered each by itself. A column named text is replaced, others pass through if
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

DEPTH = 200
LINE = 1000  # characters of a line of aligned cells at most
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER_SHOWN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist area base link meta".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())  # of a drawing (svg), which shows texts and foreign objects
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article header footer main nav aside address li dt dd form figcaption details summary tr caption thead tbody tfoot center legend optgroup option select textarea dialog".split())
#: An opening tag of the first kind closes an open element of the second, unless one of the third stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
CLOSES_P = (BLOCKS - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "optgroup", "option", "select", "textarea", "legend"}) | {"p"}
#: Elements in a table that are rendered as they are, even with cells inside.
NO_WRAPPER = frozenset("table caption details ul ol li pre blockquote dd textarea select".split())
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "html"})

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NUMBER = re.compile(r"\s*\+?0*([0-9]{1,9})(?![0-9])")
_NO_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.|\\\Z)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.|\\\Z)*(?:'|(?=\n)|\Z)|<!--|-->", re.S)  # a string without its mate ends with its line
_BRACE = re.compile(r"[{};]")
_SCREEN = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen))?\s*", re.I)
_WORD = re.compile(r"\s*([\w-]+)")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _screen(media: str) -> bool:
    return any(_SCREEN.fullmatch(m) for m in media.split(","))


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on any screen, in order."""
    css = _NO_CSS.sub(" ", css)
    blocks: list[tuple[str, str, list[str]]] = []  # open ones: kind (list, style or skip), selectors, declarations
    at = 0
    for m in _BRACE.finditer(css):
        part, at = css[at : m.start()], m.end()
        kind = blocks[-1][0] if blocks else "list"
        if m[0] == "{":
            head = part.strip()
            if kind != "list":
                inner = "skip"  # a nested rule has other selectors
            elif not head.startswith("@"):
                inner = "style"
            else:
                name, _, of = head[1:].partition(" ") if " " in head else (head[1:].partition("(")[0], "", "(" if "(" in head else "")
                inner = "list" if name.lower() == "media" and _screen(of) or name.lower() == "layer" else "skip"
            blocks.append((inner, head, []))
        else:
            if kind == "style":
                blocks[-1][2].append(part)
            if m[0] == "}" and blocks:
                kind, selectors, declarations = blocks.pop()
                if kind == "style":
                    yield selectors, ";".join(declarations)


Rules = dict[tuple[str, str], tuple[bool, bool]]  # (selector, property) to (important, hides)


def _declared(style: str) -> Iterator[tuple[str, tuple[bool, bool]]]:
    """property, (important, hides) of the declarations of display and visibility."""
    for declaration in style.split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip().lower() if len(name) < 1000 else ""
        if name in ("display", "visibility"):
            value, bang, after = value.partition("!")
            word = _WORD.match(value)
            if word and (not bang or after.strip().lower() == "important"):
                yield name, (bool(bang), word[1].lower() in (("none",) if name == "display" else ("hidden", "collapse")))


def _add_rules(css: str, rules: Rules) -> None:
    for selectors, body in _rules(css):
        simple = [x.strip().lower() for x in selectors.split(",") if re.fullmatch(r"\s*[.#]?[\w-]+\s*", x)]
        for name, now in _declared(body) if simple else ():
            for x in simple:
                if now[0] or not rules.get((x, name), now)[0]:
                    rules[x, name] = now


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The `>` that ends a tag, not one in quotation marks; -1 if none does. last: the last place of each mark."""
    while stop := _TAG_STOP.search(page, at):
        c, at = stop[0], stop.start()
        if c == ">":
            return at
        at = (page.index(c, at + 1) if at < last[c] else at) + 1
    return -1


def parse(page: str) -> tuple[Node, Rules]:
    """(root, rules of its style sheets)."""
    root, rules = Node("html", {}), {}
    stack, at = [root], 0
    last = {c: page.rfind(c) for c in "\"'"}

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s))

    def close(tags: set[str], unless) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in unless:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        end = _tag_end(page, m.end(), last) if m and m[2] else 0
        if not m or end < 0:
            text(page[at:])
            break
        text(page[at : m.start()])
        if not m[2]:
            at = m.end()
            continue
        at, tag, inside = end + 1, m[2].lower(), page[m.end() : end]
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close({tag}, SCOPE - {tag} if tag not in ("table", "body", "html") else ())
            continue
        attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(inside)} if inside else {}
        if tag == "html" or tag == "body" and any(x.tag == "body" for x in stack):
            root.attributes |= attributes
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in CLOSES:
            tags, unless = CLOSES[tag]
            if tag == "tr":
                close({"td", "th"}, {"table"})
            close(tags, unless)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            content = page[at : shut.start() if shut else len(page)]
            at = (page.find(">", shut.end()) if shut else -1) + 1 or len(page)
            if tag == "style" and _screen(attributes.get("media", "")):
                _add_rules(content, rules)
            elif tag == "textarea":
                node.children.append(unescape(content))
        elif tag not in VOID and not inside.rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            in_rows = tag == "form" and stack[-1].tag in ("table", "thead", "tbody", "tfoot", "tr")  # such a form holds nothing, as in browsers
            if len(stack) < DEPTH and not in_rows:
                stack.append(node)
    return root, rules


def _hides(node: Node, name: str, rules: Rules) -> bool | None:
    """What style says on a property of an element: whether it hides; None if nothing."""
    a = node.attributes
    for own, (_, hides) in reversed([*_declared(a["style"])] if "style" in a else []):
        if own == name:
            return hides
    if rules:
        for x in (["#" + a["id"].lower()] if "id" in a else []) + ["." + c.lower() for c in a.get("class", "").split()] + [node.tag]:
            if (x, name) in rules:
                return rules[x, name][1]
    return None


def visible(node: Node, rules: Rules) -> bool:
    """Whether anything of an element takes part in the layout."""
    a = node.attributes
    if node.tag in NEVER_SHOWN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input":
        return False
    return not _hides(node, "display", rules)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line under construction, none of them empty
        self.gap, self.indent, self.mark = 0, "", ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.end(0, force=True)
                self.add(part)
            return
        s = _SPACES.sub(" ", s)
        self.add(s[1:] if s.startswith(" ") and (not self.parts or self.parts[-1].endswith(" ")) else s)

    def end(self, gap: int, force: bool = False) -> None:
        """End the line; before the next one come at least `gap` empty lines."""
        line, self.parts = "".join(self.parts).rstrip(), []
        if line or force:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = self.indent
            if self.mark and line:
                lead, self.mark = self.indent[: -len(self.mark)] + self.mark, ""
            self.lines.append((lead + line).rstrip())
        self.gap = max(self.gap, gap)


def _holds_cells(node: Node) -> bool:
    """Whether rows or cells stand in an element that is no table and lays nothing out itself."""
    return node.tag not in NO_WRAPPER and any(isinstance(x, Node) and (x.tag in ("tr", "td", "th") or _holds_cells(x)) for x in node.children)


def _number(value: str, most: int) -> int:
    found = _NUMBER.match(value)
    return min(int(found[1]), most) if found else most if re.match(r"\s*\+?[0-9]", value) else 1


def _cells(node: Node, rules: Rules, veiled: bool, strays: list, row: list | None = None) -> list[list[tuple[Node, bool]]]:
    """Rows of (cell, whether its visibility is hidden) of a table, without those of tables inside it; what stands outside of cells goes to strays, likewise."""
    rows = []
    for x in node.children:
        if isinstance(x, str):
            strays.append((x, veiled))
            continue
        if not visible(x, rules):
            continue
        own = _veiled(x, rules, veiled)
        if x.tag == "tr":
            rows.append([])
            strays.append((" ", False))
            rows += _cells(x, rules, own, strays, rows[-1])
            strays.append((" ", False))
        elif x.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
            row.append((x, own))
        elif x.tag in ("thead", "tbody", "tfoot", "colgroup") or _holds_cells(x):
            rows += _cells(x, rules, own, strays, row)
        else:
            strays.append((x, veiled))
    return rows


def _placed(rows: list[list[tuple[Node, list[str]]]]) -> tuple[list[list[tuple[int, int]]], list[int]] | None:
    """(first column, columns) of each cell, and the width of each column; None if a line would be longer than LINE."""
    busy: list[int] = []  # by column: rows that a cell above still takes
    places, most = [], LINE // 3
    for row in rows:
        at, placed = 0, []
        for cell, _ in row:
            while at < len(busy) and busy[at]:
                at += 1
            n = max(1, _number(cell.attributes.get("colspan", ""), most))
            down = _number(cell.attributes.get("rowspan", ""), len(rows)) or len(rows)
            placed.append((at, n))
            busy += [0] * (at + n - len(busy))
            busy[at : at + n] = [down] * n
            at += n
            if len(busy) > most:
                return None
        busy = [max(0, b - 1) for b in busy]
        places.append(placed)
    widths = [0] * len(busy)
    long = [(n, at, max(map(len, lines), default=0)) for row, placed in zip(rows, places) for (_, lines), (at, n) in zip(row, placed)]
    for n, at, width in sorted(long):  # a cell over several columns widens the last of them
        widths[at + n - 1] += max(0, width - sum(widths[at : at + n]) - 2 * (n - 1))
    return (places, widths) if sum(widths) + 2 * len(widths) <= LINE else None


def _table(node: Node, flow: Flow, rules: Rules, veiled: bool) -> None:
    strays: list[tuple[Node | str, bool]] = []
    found = _cells(node, rules, veiled, strays)
    for x, own in strays:  # what stands outside of cells is shown before the table
        _render(x, flow, rules, False, own)
    flow.end(0)
    rows = [[(c, _lines(c, rules, own)) for c, own in row] for row in found]
    places, widths = _placed(rows) or ([[(k, 1) for k in range(len(row))] for row in rows], [])
    for row, placed in zip(rows, places):
        for k in range(max([len(lines) for _, lines in row], default=0)):
            line, upto = "", 0
            for (_, lines), (at, n) in zip(row, placed):
                own = lines[k] if k < len(lines) else ""
                if widths:
                    line += " " * (sum(widths[upto:at]) + 2 * (at - upto)) + own.ljust(sum(widths[at : at + n]) + 2 * n - 2) + "  "
                    upto = at + n
                else:
                    line += own + "  "
            flow.add(line)
            flow.end(0)


def _lines(node: Node, rules: Rules, veiled: bool = False) -> list[str]:
    flow = Flow()
    for x in node.children:
        _render(x, flow, rules, False, veiled)
    flow.end(0)
    return flow.lines


def _veiled(node: Node, rules: Rules, veiled: bool) -> bool:
    """Whether an element's own text is hidden, by its visibility or that of the elements around it."""
    own = _hides(node, "visibility", rules)
    return veiled if own is None else own


def _drawn(node: Node, rules: Rules, veiled: bool) -> Iterator[tuple[Node, bool]]:
    """The texts and foreign objects of a drawing that are shown, and whether their visibility is hidden."""
    for x in node.children:
        if isinstance(x, Node) and x.tag not in UNDRAWN and visible(x, rules):
            own = _veiled(x, rules, veiled)
            if x.tag in ("text", "foreignobject"):
                yield x, own
            else:
                yield from _drawn(x, rules, own)


def _render(node: Node | str, flow: Flow, rules: Rules, pre: bool, veiled: bool) -> None:
    if isinstance(node, str):
        if not veiled:
            flow.text(node, pre)
        return
    tag = node.tag
    if not visible(node, rules):
        return
    veiled = _veiled(node, rules, veiled)
    if tag == "br":
        flow.end(0, force=True)
        return
    gap = 1 if tag in SPACED else 0
    if tag in ("ul", "ol") and flow.indent:
        gap = 0  # a list within a list
    block = tag in BLOCKS
    if block:
        flow.end(gap)
    if tag == "hr":
        flow.add("" if veiled else "---")
    elif tag == "table":
        _table(node, flow, rules, veiled)
    elif tag == "svg":
        for x, own in _drawn(node, rules, veiled):
            flow.text(" ", False)
            for y in x.children:
                _render(y, flow, rules, False, own)
            flow.text(" ", False)
    elif tag in ("td", "th"):  # outside of a table
        for x in node.children:
            _render(x, flow, rules, pre, veiled)
        flow.text(" ", False)
    elif tag in ("ul", "ol"):
        start = node.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for x in node.children:
            if isinstance(x, Node) and x.tag == "li" and visible(x, rules):
                inner = _veiled(x, rules, veiled)
                mark = "" if inner else f"{number}. " if tag == "ol" else "- "
                number += 1
                outer = flow.indent
                flow.end(0)
                flow.indent, flow.mark = outer + " " * len(mark), mark
                for y in x.children:
                    _render(y, flow, rules, pre, inner)
                flow.end(0)
                flow.indent, flow.mark = outer, ""
            else:
                _render(x, flow, rules, pre, veiled)
    else:
        outer = flow.indent
        if tag in ("blockquote", "dd"):
            flow.indent += "  "
        shut = tag == "details" and "open" not in node.attributes
        for x in node.children:
            if not shut or isinstance(x, Node) and x.tag == "summary":
                _render(x, flow, rules, pre or tag in ("pre", "textarea"), veiled)
        if block:
            flow.end(gap)
        flow.indent = outer
        return
    if block:
        flow.end(gap)


def render(page: str | None) -> str:
    """The visible text of a page, laid out."""
    if not page:
        return ""
    root, rules = parse(page)
    lines = _lines(root, rules)
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, *, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (the columns `keep`, by default all but the HTML) with text."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", column)]
    pages = pages.select(F.col(column).cast("string").alias("html"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[1:]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = pa.array([render(x.as_py()) for x in part.column(0)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], [*part.schema.names[1:], "text"])

    out = in_batches(pages, run, schema)
    return out.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], "text")
