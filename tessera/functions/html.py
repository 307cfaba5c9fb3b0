"""Extraction from HTML with the standard library's parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element with its children; text children are strings."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> list[Node]:
        """Return this element and all below it, in document order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return out

    def text(self) -> str:
        """Return the text of the element and of all below it."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)

    def classes(self) -> set[str]:
        """Return the class names."""
        return set((self.attrs.get("class") or "").split())

    def inside(self, test) -> bool:
        """Tell whether an element above this one passes ``test``."""
        node = self.parent
        while node is not None:
            if test(node):
                return True
            node = node.parent
        return False

    def drop(self) -> None:
        """Remove the element from its parent."""
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """Return the root of a document; broken markup gives a tree all the same."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def page_text(html: str | None) -> str | None:
    """Return an encyclopedia page's text without references, tables and formulas.

    A redirect has none.
    """
    if html is None:
        return None
    root = parse(html)
    nodes = root.walk()
    if any("redirectMsg" in n.classes() for n in nodes):
        return None
    heading = next((n for n in nodes if n.tag == "span" and n.attrs.get("id") == "References"), None)
    if heading is not None and heading.parent is not None and heading.parent.parent is not None:
        above = heading.parent.parent
        at = next(i for i, c in enumerate(above.children) if c is heading.parent)
        above.children = above.children[:at] + [c for c in above.children[at + 1 :] if isinstance(c, str)]
    for node in root.walk():
        if node.tag in ("table", "math"):
            node.drop()
    return root.text()


def links(html: str | None) -> list[str] | None:
    """Return the targets of all anchors that have one."""
    return None if html is None else [n.attrs["href"] for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs]


def work_links(html: str | None) -> list[str] | None:
    """Return the plain links to works of a listing, without bookmarks and collections."""
    if html is None:
        return None

    def item(n: Node) -> bool:
        return n.tag == "li" and {"work", "blurb", "group"} <= n.classes() and n.inside(
            lambda m: m.tag == "ol" and {"work", "index", "group"} <= m.classes()
        )

    out = []
    for node in parse(html).walk():
        href = node.attrs.get("href", "")
        if node.tag == "a" and href.startswith("/works/") and "?" not in href and "#" not in href and node.inside(item):
            if not href.endswith(("bookmarks", "collections")):
                out.append(href)
    return out


def work_paragraphs(html: str | None) -> list[str] | None:
    """Return the paragraphs of a work: of the whole work, else of its first chapter."""
    if html is None:
        return None
    nodes = parse(html).walk()
    for place, kind in (("chapters", "userstuff"), ("chapter-1", "userstuff module")):
        found = [
            n.text()
            for n in nodes
            if n.tag == "p"
            and n.inside(
                lambda m, p=place, k=kind: m.tag == "div"
                and m.attrs.get("class") == k
                and m.parent is not None
                and m.parent.tag == "div"
                and m.parent.attrs.get("id") == p
            )
        ]
        if found:
            return found
    return []


def source_links(html: str | None) -> list[str] | None:
    """Return, of a result list, the links named pdf, pointed at the source archives."""
    if html is None:
        return None
    return [
        n.attrs["href"].replace("/pdf/", "/src/")
        for n in parse(html).walk()
        if n.tag == "a"
        and "href" in n.attrs
        and n.text() == "pdf"
        and n.inside(lambda m: m.tag == "li" and "arxiv-result" in m.classes())
    ]


def embedded_json(html: str | None) -> str | None:
    """Return the page data that a news page carries in a script."""
    if html is None:
        return None
    for node in parse(html).walk():
        if node.tag == "script" and node.attrs.get("id") == "__NEXT_DATA__" and node.attrs.get("type") == "application/json":
            return node.text()
    return None


_KINDS = {
    page_text: "string",
    links: "array<string>",
    work_links: "array<string>",
    work_paragraphs: "array<string>",
    source_links: "array<string>",
    embedded_json: "string",
}


def over(function: Callable, html: Column) -> Column:
    """Apply one of this module's functions to a column, in Arrow batches."""
    return F.pandas_udf(lambda s: pd.Series([function(x) for x in s], dtype=object), _KINDS[function])(html)


def links_by_pattern(c: Column) -> Column:
    """Return link targets by a pattern; for simple, well-formed anchors, without leaving the JVM."""
    return F.regexp_extract_all(c, F.lit(r"<a [^>]*?href=\"([^\"]*)\""), F.lit(1))
