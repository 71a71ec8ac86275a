"""HTML to text by layout: a tree with implied tags, visibility, and blocks, lists and tables rendered."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of cells are broken at blanks so that they are no wider, but for longer words.
CELL_WIDTH = 80
#: Lists, quotations and tables within each other that have an indent or a grid of their own; deeper ones are plain blocks.
MOST_NESTED = 40

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |(?P<text>[^<]++|<)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Rules of style sheets, comments and at-rules apart; and the selectors that are understood.
_SHEET = re.compile(r"/\*.*?(?:\*/|\Z)|@[^;{}]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})|(?P<who>[^{}@;/]++)\{(?P<what>[^{}]*+)\}|.", re.S)
_SELECTOR = re.compile(r"(?P<tag>[a-z][a-z0-9]*|\*)?(?:\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+))?", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Within formulas and drawings: what shows no text of its own; elements of a formula whose blanks count.
_NO_FORMULA = frozenset("annotation annotation-xml mphantom".split())
_NO_LABEL = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
_LEAVES = frozenset("mi mn mo ms mtext".split())
#: Blocks; those of _SPACED stand apart by an empty line.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tr td th caption thead tbody tfoot".split())
_SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends these open elements, up to the elements that bound the search.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{s: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for s in _SECTIONS},
    "body": ({"head"}, set()),
}
_WALLS = frozenset("table td th caption button template html body".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree of a page: missing ends, rows and table parts are implied, stray ends are ignored."""
    root = Node("#root", {})
    stack = [root]
    #: Where each tag is open, so that no tag looks through all that is open.
    places: dict[str, list[int]] = {}

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def close(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        i = last(tags)
        if i and i >= last(walls):
            cut(i)

    def open_node(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:  # an unfinished tag: text
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            stack[-1].children.append(html.unescape(m["text"]))
        elif kind == "cdata":
            stack[-1].children.append(m["cdata"])
        elif kind == "end":
            tag = m["end"].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", {}))
            else:
                walls = frozenset() if tag in ("html", "body", "table") else frozenset(("table",)) if tag in ("tr", "td", "th", *_SECTIONS) else _WALLS - {tag}
                close({tag}, walls)
        elif kind in ("start", "attrs"):
            tag = m["start"].lower()
            attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m["attrs"])} if m["attrs"].strip("/ \n") else {}
            if tag in _P_ENDS:
                close({"p"}, _WALLS)
            if tag in _ENDS:
                close(*_ENDS[tag])
            if tag in _SECTIONS or tag == "tr":
                close({"td", "th"}, {"table"})
                close({"tr"}, {"table"})
            if tag in _SECTIONS:
                close(_SECTIONS, {"table"})
            if tag in ("html", "body") and places.get(tag):
                continue
            if tag in ("td", "th") and stack[-1].tag in ("table", *_SECTIONS):
                open_node("tr", {})
            if stack[-1].tag == "head" and tag in _BLOCK:
                cut(len(stack) - 1)
            if tag in _VOID or m["attrs"].endswith("/") and tag not in _BLOCK and tag not in _RAW:
                stack[-1].children.append(Node(tag, attrs))
            elif tag in _RAW and m["attrs"].endswith("/") and last({"svg", "math"}):
                stack[-1].children.append(Node(tag, attrs))
            elif tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                node = Node(tag, attrs)
                body = source[at : stop.start() if stop else n]
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                stack[-1].children.append(node)
                at = stop.end() if stop else n
            else:
                open_node(tag, attrs)
    return root


Rules = dict[tuple[str, str, str], list[tuple[int, int, str, str]]]


def style_rules(root: Node) -> Rules:
    """What the page's style sheets say of display and visibility, by (tag, class, id) of simple selectors."""
    rules: Rules = {}
    todo, order = [root], 0
    while todo:
        node = todo.pop()
        if node.tag != "style":
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
            continue
        for rule in _SHEET.finditer("".join(c for c in node.children if isinstance(c, str))):
            if rule["who"] is None:
                continue
            said = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARATION.finditer(rule["what"])]
            for who in rule["who"].split(",") if said else ():
                m = _SELECTOR.fullmatch(who.strip())
                if m and m[0]:
                    key = ("" if m["tag"] in (None, "*") else m["tag"].lower(), m["class"] or "", m["id"] or "")
                    for what, value, important in said:
                        order += 1
                        weight = 1000 * important + 100 * bool(key[2]) + 10 * bool(key[1]) + bool(key[0])
                        rules.setdefault(key, []).append((weight, order, what, value))
    return rules


def shown(node: Node, rules: Rules) -> tuple[bool, bool | None]:
    """(whether the element is there, whether its text can be seen or None if its parent says)."""
    a = node.attrs
    if node.tag in _HIDDEN or node.tag == "title":
        return False, None
    if not a and not rules:
        return True, None
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False, None
    best: dict[str, tuple[int, int, str]] = {}
    if "hidden" in a and a["hidden"].lower() != "until-found":
        best["display"] = (0, 0, "none")
    found = []
    if rules:
        classes, own = a.get("class", "").split(), a.get("id", "")
        keys = [(t, c, "") for t in ("", node.tag) for c in ("", *classes)] + [(t, "", own) for t in ("", node.tag) if own]
        found = [r for k in keys for r in rules.get(k, ())]
    found += [(1000 * bool(m[3]) + 500, 0, m[1].lower(), m[2].lower()) for m in _DECLARATION.finditer(a.get("style", ""))]
    for weight, order, what, value in found:
        if (weight, order) >= best.get(what, (0, 0, ""))[:2]:
            best[what] = (weight, order, value)
    display, visibility = best.get("display", (0, 0, ""))[2], best.get("visibility", (0, 0, ""))[2]
    return display != "none", {"hidden": False, "collapse": False, "visible": True}.get(visibility)


def visible(node: Node) -> bool:
    """Whether an element of a formula or drawing is to be seen."""
    there, seen = shown(node, {})
    return there and seen is not False


class Flow:
    """Lines of one block flow."""

    __slots__ = ("lines", "line", "gap", "space")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = True
        words = words.strip(" ")
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(words)
        self.space = s[-1] in " \t\n\r\f"

    def pre(self, s: str) -> None:
        first, *rest = s.expandtabs(8).split("\n")
        self.line.append(first)
        for x in rest:
            self.lay()
            self.line.append(x)
        self.space = False

    def lay(self, empty: bool = True) -> None:
        """End the line."""
        if self.line or empty:
            if self.line and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            if self.line:
                self.gap = 0
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def edge(self, spaced: bool) -> None:
        """A block starts or ends here; spaced ones ask for an empty line."""
        if self.line:
            self.lay()
        self.gap = max(self.gap, 2 if spaced else 1)

    def put(self, lines: list[str]) -> None:
        """Lines of a flow within this one."""
        self.edge(False)
        if lines:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.lines += lines
        self.gap = max(self.gap, 1)

    def done(self) -> list[str]:
        if self.line:
            self.lay()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a].strip():
            a += 1
        while b > a and not self.lines[b - 1].strip():
            b -= 1
        return self.lines[a:b]


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def place(rows: list[list[tuple[int, int, list[str]]]], cuts: set[int]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of cells (column, columns spanned, lines) from rows of cells (columns and rows spanned, lines).

    A cell that spans rows keeps its columns in the rows that follow, up to the next of cuts, where a
    section of the table starts or ends; 0 rows are all up to there.
    """
    out, held = [], {}
    for r, row in enumerate(rows):
        if r in cuts:
            held = {}
        own, new, column = [], {}, 0
        for span, down, lines in row:
            while column in held:
                column += 1
            own.append((column, span, lines))
            if down != 1:
                new |= dict.fromkeys(range(column, column + span), down or len(rows) + 1)
            column += span
        held = {c: n - 1 for c, n in (held | new).items() if n > 1}
        out.append(own)
    return out


def wrapped(lines: list[str]) -> list[str]:
    """Lines broken at blanks to CELL_WIDTH; a longer word has a line of its own."""
    out = []
    for line in lines:
        if width(line) <= CELL_WIDTH:
            out.append(line)
            continue
        part, size = [], 0
        for word in line.split(" "):
            w = width(word)
            if part and size + 1 + w > CELL_WIDTH:
                out.append(" ".join(part))
                part, size = [], 0
            size += w + (1 if part else 0)
            part.append(word)
        out.append(" ".join(part))
    return out


def lay_out(rows: list[list[tuple[int, int, list[str]]]], cuts: set[int]) -> list[str]:
    """Rows of cells with the cells of a column under each other; see place().

    Where long words would make blanks of many times the text, cells over CELL_WIDTH do not widen their column.
    """
    widths: dict[int, int] = {}
    placed = place([[(span, down, wrapped(lines)) for span, down, lines in row] for row in rows], cuts)
    sizes = [(column, max(map(width, lines), default=0)) for row in placed for column, span, lines in row if span == 1]
    for column, w in sizes:
        widths[column] = max(widths.get(column, 0), w)
    text = sum(len(x) for row in placed for _, _, lines in row for x in lines)
    tall = sum(max((len(lines) for _, _, lines in row), default=0) for row in placed)
    if sum(widths.values()) * tall > 16 * text + (1 << 20):
        widths = {}
        for column, w in sizes:
            widths[column] = max(widths.get(column, 0), w if w <= CELL_WIDTH else 0)
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, at = [], 0
            for column, span, lines in row:
                parts += [" " * widths.get(c, 0) for c in range(at, column)]
                s = lines[k] if k < len(lines) else ""
                room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                parts.append(s + " " * (room - width(s)))
                at = column + span
            out.append("  ".join(parts).rstrip())
    return out


def span_of(node: Node, name: str, least: int, most: int) -> int:
    span = node.attrs.get(name, "1").strip()
    return min(most, max(least, int(span))) if re.fullmatch(r"\d{1,5}", span) else 1


def formula(math: Node) -> str:
    """The text of a formula in order; a fraction has a bar, cells of a matrix a blank between them."""
    out, todo = [], [math]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in _NO_FORMULA or not visible(x):
            continue
        if x.tag in _LEAVES:
            kids = [_SPACE.sub(" ", c) if isinstance(c, str) else c for c in x.children]
            if kids and isinstance(kids[0], str):
                kids[0] = kids[0].lstrip(" ")
            if kids and isinstance(kids[-1], str):
                kids[-1] = kids[-1].rstrip(" ")
        else:
            kids = [c for c in x.children if isinstance(c, Node) or c.strip()]
        if x.tag == "mfrac" and len(kids) == 2:
            kids.insert(1, " / ")
        elif x.tag in ("mtd", "mtr", "mtable"):
            kids = [" ", *kids, " "]
        todo.extend(reversed(kids))
    return "".join(out)


def drawn(node: Node) -> bool:
    a = node.attrs
    return node.tag not in _NO_LABEL and a.get("display", "").lower() != "none" and a.get("visibility", "").lower() not in ("hidden", "collapse") and visible(node)


def labels(svg: Node) -> list[Node | str]:
    """The texts of a drawing and the pages within it, blanks between them; lines of a text stand apart as well."""
    out, todo = [], list(reversed(svg.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or not drawn(x):
            continue
        if x.tag not in ("text", "foreignobject"):
            todo.extend(reversed(x.children))
            continue
        out += [" ", x]
        inner = [x] if x.tag == "text" else []
        while inner:
            y = inner.pop()
            kids = [c for c in y.children if isinstance(c, str) or drawn(c)]
            y.children = [z for c in kids for z in ((" ", c) if isinstance(c, Node) and c.tag == "tspan" and c.attrs.keys() & {"x", "y", "dy"} else (c,))]
            inner += [c for c in kids if isinstance(c, Node)]
    return [*out, " "] if out else []


def render(root: Node) -> str:
    """All visible text; a stack of steps instead of recursion, as pages may nest deeply."""
    flows = [Flow()]
    lists: list[list] = []
    tables: list[list[list[tuple[int, int, list[str]]]]] = []
    cuts: list[set[int]] = []
    rules = style_rules(root)
    pre = 0
    #: What comes: a node, whether it starts, whether its text is seen, and whether it has a flow or grid of its own.
    steps: list = [(root, True, True, False)]
    while steps:
        node, enter, seen, own = steps.pop()
        if isinstance(node, str):
            if seen:
                flows[-1].pre(node) if pre else flows[-1].text(node)
            continue
        tag = node.tag
        flow = flows[-1]
        if enter:
            there, says = shown(node, rules)
            if not there:
                continue
            seen = seen if says is None else says
            if tag == "br":
                flow.lay()
                continue
            if tag == "img":
                if seen and node.attrs.get("alt", "").strip():
                    flow.text(node.attrs["alt"])
                continue
            if tag == "input":
                if seen and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "search") and node.attrs.get("value"):
                    flow.text(node.attrs["value"])
                continue
            if tag == "math":
                text = formula(node) if seen else ""
                if node.attrs.get("display", "").lower() == "block":
                    flow.edge(False)
                    flow.text(text)
                    flow.edge(False)
                else:
                    flow.text(text)
                continue
            if tag == "svg":
                steps.extend((x, True, seen, False) for x in reversed(labels(node)))
                continue
            if tag in _BLOCK and tag not in ("td", "th", "tr", *_SECTIONS):
                flow.edge(tag in _SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            own = len(flows) <= MOST_NESTED
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1").strip()
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li" or tag in ("dd", "blockquote"):
                if own:
                    flows.append(Flow())
            elif tag == "table":
                tables.append([] if own else None)
                cuts.append(set())
            elif tag in _SECTIONS and tables and tables[-1] is not None:
                cuts[-1].add(len(tables[-1]))
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif tag in ("td", "th"):
                own = bool(tables) and tables[-1] is not None
                if own:
                    flows.append(Flow())
                else:
                    flow.edge(False)
            elif tag == "pre":
                pre += 1
            steps.append((node, False, seen, own))
            steps.extend((c, True, seen, False) for c in reversed(node.children))
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.edge(not lists)
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if own:
                lines = flows.pop().done()
                if lines:
                    flows[-1].put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])
            else:
                flow.edge(False)
        elif tag in ("dd", "blockquote"):
            if own:
                lines = flows.pop().done()
                flows[-1].put(["  " + x if x else "" for x in lines])
            flows[-1].edge(tag == "blockquote")
        elif tag in ("td", "th") and own:
            lines = flows.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((span_of(node, "colspan", 1, 100), span_of(node, "rowspan", 0, 65534), lines))
        elif tag in _SECTIONS and tables and tables[-1] is not None:
            cuts[-1].add(len(tables[-1]))
        elif tag == "table":
            rows, edges = tables.pop(), cuts.pop()
            if rows is not None:
                flows[-1].put(lay_out(rows, edges))
            flows[-1].edge(True)
        elif tag == "pre":
            pre -= 1
            flow.edge(True)
        elif tag in _BLOCK and tag not in ("tr", "td", "th", *_SECTIONS):
            flow.edge(tag in _SPACED)
    return "\n".join(flows[0].done())


def title_of(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in ("svg", "table"))
    return None


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text) of each row of pages.

    text is all visible text: blocks on lines of their own, paragraphs, headings, lists and tables apart by
    an empty line, list items with marks and indents, cells of a column under each other and wide ones broken,
    preformatted text as it is, formulas in a line, texts of drawings apart by blanks. Scripts, styles, heads,
    templates, hidden elements and those that their style attribute or a rule of a style sheet hides (by tag,
    class or id; other selectors and media rules are not read) are left out; within what visibility hides,
    what it shows again is kept. Beyond MOST_NESTED lists and tables within each other no indents are added. A null page has a null title and text, an empty one an empty text; rows are
    rendered one by one, so repeated rows and null ids are rows like others.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                titles, texts = [], []
                for source in part.column(1):
                    source = source.as_py()
                    root = parse(source) if source is not None else None
                    titles.append(title_of(root) if root else None)
                    texts.append(render(root) if root else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["page_id", "title", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, title string, text string")
