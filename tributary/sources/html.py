"""Rows from HTML pages by simple selectors: one record, a list of containers, or parallel lists; and tables.

Selectors are compounds (tag, .class, #id, [name] or [name=value]) joined by spaces. Pages are parsed
where they lie, a batch at a time; Spark zips, types and filters what comes out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.sources.files import zipped

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_COMPOUND = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]")


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else f" {p.text()} " for p in self.parts if isinstance(p, str) or p.tag not in ("script", "style")).split())

    def walk(self):
        for p in self.parts:
            if not isinstance(p, str):
                yield p
                yield from p.walk()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    return tree.root


def _fits(node: Node, compound: str) -> bool:
    for kind, name, attr, value in _COMPOUND.findall(compound):
        if attr:
            if attr not in node.attrs or value and node.attrs[attr] != value:
                return False
        elif kind == "#" and node.attrs.get("id") != name or kind == "." and name not in (node.attrs.get("class") or "").split() or not kind and node.tag != name.lower():
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes under root that a selector names, in the order of the page."""
    steps = selector.split()
    if not steps:
        return []

    def above(node: Node, left: list[str]) -> bool:
        while left and node.parent is not None and node.parent is not root:
            node = node.parent
            if _fits(node, left[-1]):
                left = left[:-1]
        return not left

    return [n for n in root.walk() if _fits(n, steps[-1]) and above(n, steps[:-1])]


def container(selectors: Sequence[str]) -> str:
    """The longest common beginning of selectors, by steps; empty if they have none."""
    split = [s.split() for s in selectors]
    common = []
    for steps in zip(*split, strict=False):
        if len(set(steps)) > 1:
            break
        common.append(steps[0])
    return " ".join(common)


def _value(node: Node | None, attr: str | None) -> str | None:
    if node is None:
        return None
    return (node.attrs.get(attr) if attr else node.text()) or None


def extract(pages: DataFrame, key: str, html: str, fields: Sequence[dict], items: str | None = None) -> DataFrame:
    """(key, place, a string for each field) of every page.

    fields: name, selector, and attr for an attribute instead of the text. With `items`, a row for
    each node it selects, fields being sought inside; without, one row a page. Empty rows go.
    """
    names = [f["name"] for f in fields]

    def rows(batches):
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                root = parse(page)
                for i, box in enumerate(select(root, items) if items else [root]):
                    out.append((k, i, *[_value(next(iter(select(box, f["selector"])), None) if f["selector"] else box, f.get("attr")) for f in fields]))
            yield pd.DataFrame(out, columns=[key, "place", *names])

    kind = dict(pages.dtypes)[key]
    found = pages.select(key, html).mapInPandas(rows, f"`{key}` {kind}, place int, " + ", ".join(f"`{n}` string" for n in names))
    return found.dropna(how="all", subset=names)


def extract_lists(pages: DataFrame, key: str, html: str, fields: Sequence[dict]) -> DataFrame:
    """(key, place, fields): every field's matches as a list, the lists side by side, null where one ends."""
    names = [f["name"] for f in fields]

    def rows(batches):
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                root = parse(page)
                out.append((k, *[[_value(n, f.get("attr")) for n in select(root, f["selector"])] for f in fields]))
            yield pd.DataFrame(out, columns=[key, *names])

    kind = dict(pages.dtypes)[key]
    lists = pages.select(key, html).mapInPandas(rows, f"`{key}` {kind}, " + ", ".join(f"`{n}` array<string>" for n in names))
    return zipped(lists, names).dropna(how="all", subset=names)


def extract_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of every table row: a map by header; a cell beyond the headers is column_i."""

    def rows(batches):
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                for i, node in enumerate(select(parse(page), "table")):
                    lines = [[(c.tag, c.text()) for c in r.walk() if c.tag in ("td", "th")] for r in select(node, "tr")]
                    heads = [x for _, x in lines[0]] if lines and all(tag == "th" for tag, _ in lines[0]) else []
                    for j, line in enumerate(lines[1:] if heads else lines):
                        out.append((k, i, j, {heads[n] if n < len(heads) else f"column_{n}": x for n, (_, x) in enumerate(line)}))
            yield pd.DataFrame(out, columns=[key, "table", "row", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(rows, f"`{key}` {kind}, table int, row int, cells map<string,string>").where(F.size("cells") > 0)


def sitemap(pages: DataFrame, key: str, xml: str, pattern: str | None = None) -> DataFrame:
    """(key, url) of the places that a sitemap lists, by a pattern if given; by Spark's own functions."""
    urls = pages.select(key, F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), 1)).alias("url"))
    return urls.where(F.col("url").rlike(pattern)) if pattern else urls
