"""Layout-aware text rendering of HTML pages.

A tree builder (implied end tags, void and raw-text elements, forgiving of missing end tags) feeds a
renderer that emits all visible text: blocks on lines of their own, paragraphs apart by a blank line,
list items with bullets or numbers and indentation, ``pre`` as it is, tables with aligned columns, in which a cell's blocks,
lists and tables keep their lines. Hidden are: the head, scripts, styles and other elements that aren't rendered, ``hidden`` elements, and
inline styles with ``display:none`` or ``visibility:hidden`` (which a descendant may lift), on cells, rows and items too.

Pages of any depth and length are read: no step recurses, and none looks at a character more than a few times. Tags that the page's end
cuts off are dropped, as browsers do. Two bounds are on white space only: indentation stops growing at ``DEEPEST`` levels, and cells
wider than ``WIDEST`` don't widen their column. ``colspan`` and ``rowspan`` have the HTML standard's bounds.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg datalist map area base link meta param source track col colgroup rp".split())
BLOCK = frozenset("html body address article aside blockquote center details dd div dl dt fieldset figcaption figure footer form header hgroup hr legend main nav section summary search option optgroup select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir table pre blockquote dl figure hr xmp listing".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a start tag of the key ends an open element of the value, unless one of the bars is in between
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html button object template".split())
DEEPEST = 40
WIDEST = 60


class Node:
    __slots__ = ("tag", "raw", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.raw):
            v = m[2] or ""
            found.setdefault(m[1].lower(), unescape(v[1:-1] if v[:1] in "\"'" else v))
        return found


def tokens(html: str):
    """(text, None, None) of text, (None, tag, raw) of start tags, (None, "/tag", "") of end tags; what follows a start tag of raw text is its text."""
    at, n = 0, len(html)
    dead: set[str] = set()  # quotes of which there are no more

    def end_of_tag(k: int) -> int:
        while (m := STOP.search(html, k)) is not None:
            k = m.end()
            if m[0] == ">":
                return k
            if m[0] not in dead and _after_equals(html, m.start()):
                closed = html.find(m[0], k)
                if closed < 0:
                    dead.add(m[0])
                else:
                    k = closed + 1
        return -1

    while at < n:
        k = html.find("<", at)
        if k < 0 or k + 1 >= n:
            yield html[at:], None, None
            return
        c = html[k + 1]
        end = c == "/"
        m = NAME.match(html, k + 1 + end)
        if m is None and c not in "!?/":
            yield html[at : k + 1], None, None
            at = k + 1
            continue
        if k > at:
            yield html[at:k], None, None
        if m is None:  # a comment, a declaration, or what looks like an end tag
            closed = html.find("-->", k + 4) if html.startswith("<!--", k) and not html.startswith("<!-->", k) else html.find(">", k)
            if closed < 0:
                return
            at = closed + (3 if html.startswith("-->", closed) else 1)
            continue
        at = end_of_tag(m.end())
        if at < 0:
            return
        tag = m[0].lower()
        if end:
            yield None, "/" + tag, ""
            continue
        yield None, tag, html[m.end() : at - 1]
        if tag in RAW:
            closed = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            yield html[at : closed.start() if closed else n], None, None
            if closed is None:
                return
            at = end_of_tag(closed.end())
            if at < 0:
                return


def _after_equals(html: str, k: int) -> bool:
    """Whether a quote at k begins a value: only white space, of a few characters, is between it and an equals sign."""
    return html[max(0, k - 8) : k].rstrip().endswith("=")


class Open:
    """The open elements, and where in their stack those of each name are."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, names) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((p[-1] for t in names if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def end(self, names, bars) -> None:
        """End open elements of these names, from the innermost on (a cell within a row within a section), up to the first bar."""
        while (at := self.last(names)) > self.last(bars - names):
            self.cut(at)


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    o = Open(root)
    raw = False
    for text, tag, attributes in tokens(html):
        if raw:  # the text of an element that has no other content
            o.stack[-1].children[-1].children.append(text)
            raw = False
        elif text is not None:
            o.stack[-1].children.append(text)
        elif tag[0] == "/":
            tag = tag[1:]
            at = o.last((tag,))
            if tag not in SCOPE and tag not in SIBLING and o.last(SCOPE) > at:
                continue
            if at:
                o.cut(at)
            elif tag in ("br", "p"):
                o.stack[-1].children.append(Node(tag))
        else:
            if tag in CLOSES_P:
                o.end(frozenset("p"), SCOPE)
            if tag in HEADINGS and o.stack[-1].tag in HEADINGS:
                o.cut(len(o.stack) - 1)
            if tag in SIBLING:
                names, bars = SIBLING[tag]
                o.end(frozenset(names), frozenset(bars))
            if tag == "body" and o.stack[-1].tag == "head":
                o.cut(len(o.stack) - 1)
            node = Node(tag, attributes)
            o.stack[-1].children.append(node)
            raw = tag in RAW
            if not raw and tag not in VOID and not attributes.endswith("/"):
                o.push(node)
    return root


def run(steps):
    """The result of a generator that yields further generators to be run, to any depth, and gets their results."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def sight(node: Node, shown: bool) -> tuple[bool, bool]:
    """(whether the element is there at all, whether its own text is visible)."""
    if node.raw and ("hidden" in (low := node.raw.lower()) or "style" in low):
        a = node.attributes()
        style = SPACES.sub("", a.get("style", "").lower())
        if "hidden" in a or "display:none" in style or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False, False
        if "visibility:hidden" in style or "visibility:collapse" in style:
            return True, False
        if "visibility:visible" in style:
            return True, True
    return True, shown


def span(node: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan within the standard's bounds."""
    if name not in node.raw.lower():
        return 1
    given = node.attributes().get(name, "1").strip()
    return min(max(int(given), 1), most) if re.fullmatch("[0-9]{1,9}", given) else most if re.fullmatch("[0-9]+", given) else 1


class Renderer:
    """Collects lines; ``gap`` is the number of line ends owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.prefix: list[str] = []
        self.first: str | None = None  # bullet of an item that has no text yet

    def text(self, s: str) -> None:
        if "&" in s:
            s = unescape(s)
        words = SPACES.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if (words[0] == " " or self.space) and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.strip(" "))

    def end_line(self) -> None:
        self.space = False
        if self.line:
            self.put("".join(self.line))
            self.line = []

    def put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.prefix[:DEEPEST])
        if self.first is not None:
            lead = lead[: -len(self.first)] + self.first if self.first else lead
            self.first = None
        self.lines.append(lead + s)

    def paragraph(self) -> None:
        self.end_line()
        self.gap = True

    def node(self, node: Node, shown: bool = True):
        tag = node.tag
        if tag in UNSEEN:
            return
        there, shown = sight(node, shown)
        if not there:
            return
        if tag == "br":
            if self.line:
                self.end_line()
            return
        if tag == "table":
            self.paragraph()
            lines, captions = yield table(node, shown)
            for line in (*captions, *lines):
                self.put(line)
            self.gap = True
            return
        if tag == "pre" or tag == "xmp" or tag == "listing":
            self.paragraph()
            s = "".join(flat(node, shown)).removeprefix("\n").rstrip("\n")
            for line in s.split("\n") if s.strip() else ():
                self.put(line)
            self.gap = True
            return
        spaced, block = tag in SPACED, tag in BLOCK
        if spaced:
            self.paragraph() if tag not in LISTS or not self.prefix else self.end_line()
        elif block or tag == "li":
            self.end_line()
        if tag in LISTS:
            yield self.items(node, shown)
        elif tag == "li":  # an item outside any list
            yield self.item(node, "- ", shown)
        else:
            indent = tag in ("dd", "blockquote")
            if indent:
                self.prefix.append("  ")
            yield self.children(node, shown)
            if indent:
                self.end_line()
                self.prefix.pop()
        if spaced:
            self.paragraph() if tag not in LISTS or not self.prefix else self.end_line()
        elif block:
            self.end_line()

    def children(self, node: Node, shown: bool):
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    self.text(c)
            else:
                yield self.node(c, shown)

    def item(self, node: Node, bullet: str, shown: bool):
        """An item's bullet goes before its first visible line, if it has one."""
        self.end_line()
        self.prefix.append(" " * len(bullet))
        outer, self.first = self.first, bullet
        begun = len(self.lines)
        yield self.children(node, shown)
        self.end_line()
        self.first = outer if len(self.lines) == begun else None
        self.prefix.pop()

    def items(self, node: Node, shown: bool):
        number = 1
        if node.tag == "ol":
            start = node.attributes().get("start", "1")
            number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    self.text(c)
            elif c.tag == "li":
                there, seen = sight(c, shown)
                if there:
                    yield self.item(c, f"{number}. " if node.tag == "ol" else "- ", seen)
                    number += 1
            else:
                yield self.node(c, shown)
        self.end_line()


LISTS = frozenset("ul ol menu dir".split())


def cell(node: Node, shown: bool):
    """The lines of a cell, without blank ones."""
    inner = Renderer()
    yield inner.children(node, shown)
    inner.end_line()
    return [line.rstrip() for line in inner.lines if line.strip()]


def table(node: Node, shown: bool):
    """(lines, caption lines): cells are in columns as wide as their widest cell of at most ``WIDEST``; a row is as high as its highest cell."""
    rows: list[list[list[str]]] = []
    captions: list[str] = []

    def said(s: str, seen: bool) -> list[str]:
        words = SPACES.sub(" ", unescape(s)).strip() if seen else ""
        return [words] if words else []

    def row_of(tr: Node, seen: bool, below: dict[int, int]):
        """A row's cells; below: column -> rows that a cell above still covers."""
        row: list[list[str]] = []
        covered, new = dict(below), {}

        def place(lines: list[str], wide: int = 1, high: int = 1) -> None:
            while covered.get(len(row)):
                row.append([])
            for k in range(wide):
                if high > 1:
                    new[len(row)] = high - 1
                row.append([] if k else lines)

        for d in tr.children:
            if isinstance(d, str):
                if said(d, seen):
                    place(said(d, seen))
            elif d.tag not in UNSEEN:
                there, own = sight(d, seen)
                if there:
                    of_row = d.tag in ("td", "th")
                    if of_row:
                        lines = yield cell(d, own)
                    else:
                        inner = Node("#cell")
                        inner.children = [d]
                        lines = yield cell(inner, seen)
                    if of_row or lines:
                        place(lines, span(d, "colspan", 1000) if of_row else 1, span(d, "rowspan", 65_534) if of_row else 1)
        for k in list(below):
            below[k] -= 1
            if not below[k]:
                del below[k]
        below.update(new)
        if any(row):
            rows.append(row)

    def walk(part: Node, seen: bool):
        below: dict[int, int] = {}
        for c in part.children:
            if isinstance(c, str):
                captions.extend(said(c, seen))
                continue
            if c.tag in UNSEEN:
                continue
            there, own = sight(c, seen)
            if not there:
                continue
            if c.tag == "tr":
                yield row_of(c, own, below)
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield walk(c, own)
            elif c.tag in ("td", "th"):
                lines = yield cell(c, own)
                if lines:
                    rows.append([lines])
            else:
                inner = Node("#cell")
                inner.children = [c]
                captions.extend((yield cell(inner, seen)))

    yield walk(node, shown)
    widths: dict[int, int] = {}
    for r in rows:
        while r and not r[-1]:
            r.pop()
        for i, lines in enumerate(r[:-1]):  # nothing follows a row's last cell
            for line in lines:
                if widths.get(i, 0) < len(line) <= WIDEST:
                    widths[i] = len(line)
    for r in rows:
        for i, lines in enumerate(r[-1:]):
            k = len(r) - 1
            if k in widths:
                for line in lines:
                    if widths[k] < len(line) <= WIDEST:
                        widths[k] = len(line)
    out = []
    for r in rows:
        for k in range(max(len(lines) for lines in r)):
            have = [lines[k] if k < len(lines) else "" for lines in r]
            while have and not have[-1]:
                have.pop()
            out.append(" | ".join(s.ljust(widths.get(i, 0)) for i, s in enumerate(have)).rstrip())
    return out, captions


def flat(node: Node, shown: bool):
    """The visible pieces of text within an element, line ends kept."""
    todo = [(c, shown, node.tag in RAW) for c in reversed(node.children)]
    while todo:
        c, seen, raw = todo.pop()
        if isinstance(c, str):
            if seen:
                yield c if raw else unescape(c)
        elif c.tag == "br":
            yield "\n"
        elif c.tag not in UNSEEN:
            there, own = sight(c, seen)
            if there:
                todo += [(x, own, c.tag in RAW) for x in reversed(c.children)]


def render(html: str | None) -> str:
    """Visible text of a whole page; null and empty pages give the empty string, plain text itself."""
    if not html:
        return ""
    r = Renderer()
    run(r.node(parse(html)))
    r.end_line()
    return "\n".join(r.lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every page, one pass without a shuffle.

    Null ids and repeated rows are kept as they are; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [render(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, n_chars long, n_lines long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"))
