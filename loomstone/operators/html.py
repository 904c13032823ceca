"""Saved pages to ordered element lists, with a tolerant parser (implied end tags, raw script text).

No layout is known: positions and visibility are left out, so ids number all elements of content kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.net import redirect_target
from loomstone.sources.tables import spread

# Element kinds, tags that are not walked, tags that only hold others in full texts.
KINDS = {
    **{f"h{i}": "heading" for i in range(1, 7)}, "a": "link", "button": "button", "img": "image", "video": "video", "audio": "audio", "nav": "navigation", "header": "header", "footer": "footer",
    "table": "table", "ul": "list", "ol": "list", "li": "item", "section": "section", "article": "section", "main": "main", "aside": "sidebar", "details": "expandable", "summary": "summary", "pre": "code",
    "blockquote": "quote", "figure": "figure", "figcaption": "caption", "dl": "definitions", "dt": "term", "dd": "definition", "p": "text", "tr": "row", "th": "column header", "td": "cell",
}
SKIPPED = {"script", "style", "noscript", "svg", "meta", "link", "head", "input", "textarea", "select", "form", "label", "fieldset", "legend"}
NEVER_TEXT = {"script", "style", "noscript", "svg", "meta", "link", "head"}
WRAPPERS = {"thead", "tbody", "tfoot", "form", "fieldset", "label", "input", "textarea", "select", "legend"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open tag that one of these begins ends first.
CLOSED_BY = {
    "p": {"p", "div", "ul", "ol", "li", "dl", "table", "section", "article", "main", "aside", "nav", "header", "footer", "blockquote", "figure", "pre", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
INLINE = {"a", "abbr", "b", "big", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var"}
LABEL_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "a", "button", "summary", "li", "th", "td", "dt"}
MAX_DEPTH = 15


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def find(self, *tags: str) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if n.tag in tags:
                    yield n
                stack += reversed(n.children)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
            node = node.parent
        if tag in CLOSED_BY["p"]:  # an open paragraph ends, inline tags below it, too
            up = node
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ("li", "dt", "dd", "tr", "td", "th"):  # close an open sibling below inline tags
            up = self.at
            while up.parent and up.tag not in ("ul", "ol", "dl", "table", "body", "div", "section"):
                if up.tag in CLOSED_BY and tag in CLOSED_BY[up.tag]:
                    node = up.parent
                up = up.parent
        self.at = node
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _short(text: str, limit: int = 80) -> str:
    text = _clean(text)
    return f"{text[: limit - 1]}…" if len(text) > limit else text


def _label(node: Node) -> str:
    for name in ("aria-label", "alt", "title"):
        if node.attrs.get(name):
            return _short(node.attrs[name])
    if node.tag == "pre":
        classes = " ".join([node.attrs.get("class", ""), *(c.attrs.get("class", "") for c in node.find("code"))])
        m = re.search(r"(?:language-|lang-|hljs\s+)(\w+)", classes)
        n = node.text().count("\n") + 1
        return m[1] if m else f"{n} lines"
    if node.tag in LABEL_TAGS:
        return _short(node.text())
    return "[image]" if node.tag == "img" else ""


def _destination(node: Node) -> str | None:
    if node.tag == "details":
        return "collapse" if "open" in node.attrs else "expand"
    if node.tag != "a":
        return None
    href = node.attrs.get("href", "")
    for prefix, shown in (("mailto:", "email "), ("tel:", "call ")):
        if href.startswith(prefix):
            return shown + href[len(prefix) :]
    return "scroll down" if href.startswith("#") else href or None


def table_text(node: Node) -> str:
    """Rows with cells between pipes."""
    rows = [" | ".join(c for c in (_clean(x.text()) for x in row.find("th", "td")) if c) for row in node.find("tr")]
    return "\n".join(r for r in rows if r)


def full_text(node: Node) -> str:
    """Readable text of an element: headings, items and links marked, tables as rows, code as it is."""
    if node.tag == "pre":
        return node.text().strip()
    if node.tag == "table":
        return table_text(node)
    lines: list[str] = []
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            if child.strip():
                lines.append(child.strip())
        elif child.tag in NEVER_TEXT:
            continue
        elif child.tag == "table":
            lines.append(table_text(child))
        elif child.tag in ("pre", "code"):
            lines.append(child.text().strip())
        elif child.tag in WRAPPERS:
            stack += reversed(child.children)
        elif text := child.text().strip():
            if re.fullmatch(r"h[1-6]", child.tag):
                lines.append(f"## {text}")
            elif child.tag == "li":
                lines.append(f"- {text}")
            elif child.tag == "a":
                lines.append(f"[{text}]({child.attrs.get('href', '')})")
            elif child.tag == "tr":
                lines.append(" | ".join(c for c in (_clean(x.text()) for x in child.find("th", "td")) if c))
            else:
                lines.append(text)
    return "\n".join(x for x in lines if x)


def elements_of(html: str | None) -> tuple[str, list[tuple]]:
    """Title, and elements in page order: (ord, id, kind, depth, label, summary, clickable, dest, text)."""
    if not html:
        return "", []
    root, out = parse(html), []
    title = next((_clean(n.text()) for n in root.find("title")), "")

    stack = [(n, 0) for n in [*root.find("body"), root][:1]]
    while stack:
        node, depth = stack.pop()
        if node.tag in SKIPPED or depth > MAX_DEPTH:
            continue
        role, name = node.attrs.get("role", ""), node.attrs.get("id", "")
        region = node.tag == "div" and ((role and role not in ("presentation", "none")) or (name and not name[0].isdigit()))
        kind = KINDS.get(node.tag) or ("region" if region else None)
        if kind:
            click = (node.tag == "a" and bool(node.attrs.get("href"))) or node.tag in ("button", "details", "summary") or role == "button" or "tabindex" in node.attrs
            text = full_text(node)
            first = next((x for x in (_clean(t) for t in text.split("\n")) if x), "")
            out.append((len(out), f"e{len(out) + 1}", kind, depth, _label(node), "" if node.tag == "pre" else _short(first, 120), click, _destination(node) if click else None, text))
            if kind == "code":
                continue
        stack += [(child, depth + (1 if kind else 0)) for child in reversed(node.children) if isinstance(child, Node)]
    return title, out


ELEMENTS = "page_id long, title string, ord int, element_id string, kind string, depth int, label string, summary string, clickable boolean, dest string, text string"


def page_elements(pages: DataFrame) -> DataFrame:
    """One row for each element of pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for batch in batches:
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                title, found = elements_of(html)
                rows += [(page, title, *e) for e in found]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return spread(pages.selectExpr("cast(page_id as long) as page_id", "html")).mapInArrow(run, ELEMENTS)


RESULTS = "page_id long, place int, title string, url string, display_url string, snippet string"


def results_of(html: str | None) -> list[tuple[str, str, str, str]]:
    """(title, href, display URL, snippet) of the results of a saved search page, those without a title left out.

    Fixed values: the classes result, result__a, result__url and result__snippet.
    """

    def has(node: Node, name: str) -> bool:
        return name in node.attrs.get("class", "").split()

    def first(node: Node, name: str) -> Node | None:
        stack = list(reversed(node.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                if has(n, name):
                    return n
                stack += reversed(n.children)
        return None

    out, stack = [], [parse(html or "")]
    while stack:
        node = stack.pop()
        if has(node, "result") and (link := first(node, "result__a")):
            shown, snippet = first(node, "result__url"), first(node, "result__snippet")
            title = _clean(link.text())
            if title:
                out.append((title, link.attrs.get("href", ""), _clean(shown.text()) if shown else "", _clean(snippet.text()) if snippet else ""))
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def search_page_results(pages: DataFrame) -> DataFrame:
    """The result list of saved search pages(page_id, html), redirects decoded."""
    names = [c.split()[0] for c in RESULTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, place, *found) for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for place, found in enumerate(results_of(html), 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.string()] * 4), strict=True)], names=names)

    rows = pages.selectExpr("cast(page_id as long) as page_id", "html").mapInArrow(run, RESULTS)
    return rows.withColumn("url", redirect_target(F.col("url"))).select(*names)
