"""Main content of HTML pages: title, description, headings, text and links of the content root."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as ty

SCHEMA = ty.StructType([ty.StructField(n, t) for n, t in (("title", ty.StringType()), ("meta_description", ty.StringType()), ("content", ty.StringType()), ("content_length", ty.LongType()), ("headings", ty.ArrayType(ty.StringType())), ("links", ty.ArrayType(ty.StringType())), ("word_count", ty.LongType()))])
_SKIPPED = frozenset("script style nav header footer aside iframe noscript svg canvas template".split())
_ROLES = frozenset("navigation banner contentinfo complementary".split())
_CLASS_PARTS = ("nav", "menu", "sidebar", "footer", "header", "advert", "ads", "promo", "breadcrumb", "cookie", "modal", "popup")
_ID_PARTS = ("nav", "menu", "sidebar", "footer", "header", "cookie", "popup")
_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []

    def elements(self):
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if not isinstance(c, str))

    def texts(self, skip: bool):
        stack = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                yield e
            elif not (skip and is_skipped(e)):
                stack.extend(reversed(e.children))


#: an ampersand that begins no reference with a semicolon, and characters that no text holds, one of which stands for it while HTML is read
_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")
_MARKS = "".join(map(chr, range(0xFDD0, 0xFDF0)))


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.root = _Element("#root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in _ENDS:
            self._close(_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        e = _Element(tag, {k: self._plain(v or "") for k, v in reversed(attrs)})
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def _close(self, tags, bars):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in bars:
                return

    def handle_data(self, data):
        self.stack[-1].children.append(self._plain(data))

    def _plain(self, s: str) -> str:
        return s.replace(self.mark, "&") if self.mark else s


def is_skipped(e: _Element) -> bool:
    """Navigation, decoration and hidden elements, by tag, role, attribute, style, class and id (substrings)."""
    a = e.attrs
    if e.tag in _SKIPPED or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    style, classes, name = a.get("style", "").lower(), a.get("class", "").lower(), a.get("id", "").lower()
    return any(s in style for s in _STYLES) or any(s in classes for s in _CLASS_PARTS) or any(s in name for s in _ID_PARTS)


def parse_tree(html: str, bare: bool = True) -> _Element:
    """``bare``: references without a semicolon (&amp) count where HTML lets them; else they are text."""
    mark = "" if bare else next((c for c in _MARKS if c not in html), _MARKS[0])
    b = _Builder(mark)
    b.feed(_BARE.sub(mark, html) if mark else html)
    b.close()
    return b.root


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def parse_page(html: str | None, bare: bool = True) -> tuple:
    """The fields of SCHEMA. The root is the first main, else article, else body, else the document."""
    root = parse_tree(html or "", bare)
    every = list(root.elements())
    first = lambda tag: next((e for e in every if e.tag == tag), None)
    title = first("title")
    meta = next((e for e in every if e.tag == "meta" and e.attrs.get("name") == "description"), None)
    body = next((e for e in (first("main"), first("article"), first("body")) if e is not None), root)
    inside = list(body.elements())
    headings = [h for tag in ("h1", "h2", "h3") for e in inside if e.tag == tag and (h := _squeeze(" ".join(e.texts(False))))]
    content = " ".join(t for s in body.texts(True) if (t := _squeeze(s)))
    links = [e.attrs["href"] for e in inside if e.tag == "a" and e.attrs.get("href", "").startswith("http")]
    return _squeeze("".join(title.texts(False))) if title else "", meta.attrs.get("content", "") if meta else "", content, len(content.encode()), headings[:30], links[:100], len(content.split())


# rows go to Python by the hundred, whatever the size of Arrow's batches, so that a worker holds few pages


@F.udf(SCHEMA, useArrow=False)
def parse_page_udf(html: str | None) -> tuple:
    return parse_page(html)


@F.udf(SCHEMA, useArrow=False)
def parse_page_strict_udf(html: str | None) -> tuple:
    """References without a semicolon stay text."""
    return parse_page(html, bare=False)


@F.udf(ty.ArrayType(ty.StringType()), useArrow=False)
def hrefs_udf(html: str | None) -> list[str]:
    """All hrefs of anchors, in document order."""
    return [e.attrs["href"] for e in parse_tree(html or "").elements() if e.tag == "a" and "href" in e.attrs]
