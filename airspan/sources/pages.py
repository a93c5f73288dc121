"""Readings out of stored station pages."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from airspan.functions.numbers import commas_to_dots_if_digits, commas_to_dots_if_number
from airspan.operators.sizing import spread_if_few
from airspan.schemas import RAW_COLUMNS, RAW_POLLUTANTS, name_col

# Executors need no copy of this package: the parser travels with the job.
register_pickle_by_value(sys.modules[__name__])

# Fixed value: the word in the bold label next to the station name.
STATION_LABEL = "Estación"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_ROW_COLUMNS = ["page_id", "station", "row_no", "n_cells", "blank"] + [f"c{i}" for i in range(8)]
_ROW_SCHEMA = "page_id long, station string, row_no int, n_cells int, blank boolean, " + ", ".join(
    f"c{i} string" for i in range(8))


class _Node:
    __slots__ = ("tag", "classes", "parent", "parts")

    def __init__(self, tag: str, classes: list[str], parent: "_Node | None"):
        self.tag, self.classes, self.parent, self.parts = tag, classes, parent, []

    def walk(self) -> Iterator["_Node"]:
        """The elements inside, in page order. A loop, so deep nesting is no problem."""
        waiting = [iter(self.parts)]
        while waiting:
            part = next(waiting[-1], None)
            if part is None:
                waiting.pop()
            elif isinstance(part, _Node):
                yield part
                waiting.append(iter(part.parts))

    def texts(self) -> list[str]:
        found, waiting = [], [iter(self.parts)]
        while waiting:
            part = next(waiting[-1], None)
            if part is None:
                waiting.pop()
            elif isinstance(part, _Node):
                waiting.append(iter(part.parts))
            else:
                found.append(part)
        return found

    def first(self, test) -> "_Node | None":
        return next((n for n in self.walk() if test(n)), None)


class _Tree(HTMLParser):
    """Only what the page layout needs: elements, their classes and their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", [], None)

    def handle_starttag(self, tag, attrs):
        classes = next((v or "" for k, v in attrs if k == "class"), "").split()
        node = _Node(tag, classes, self.open)
        self.open.parts.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.parts.append(data)


# A page of these parts alone - texts, and tags with plain attributes - is read by one pattern. The parser
# takes any page, but several times as long; comments, scripts and broken tags are left to it.
_ATTRIBUTE = r"""[ \t\n]+[a-zA-Z][a-zA-Z-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[a-zA-Z0-9_.-]+))?"""
_PART = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTRIBUTE})*)[ \t\n]*(/?)>|([^<]+)")
_NAME_AND_VALUE = re.compile(r"""[ \t\n]+([a-zA-Z][a-zA-Z-]*)(?:=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9_.-]+)))?""")
_RAW_TEXT = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title", "plaintext"}
_NO_CLASSES: list[str] = []


def _after_end(open_: _Node, tag: str) -> _Node:
    """The element that is open after an end tag."""
    node = open_
    while node is not None and node.tag != tag:
        node = node.parent
    return node.parent if node is not None and node.parent is not None else open_


def _read_plain(tree: _Tree, page: str) -> bool:
    """Feeds a page of plain parts to the tree; False, with nothing of use in it, for any other. The tree's own steps are
    written out here, as most of the time goes into them."""
    at, open_ = 0, tree.open
    for part in _PART.finditer(page):
        begin, end = part.span()
        if begin != at:
            return False
        at = end
        closing, tag, attributes, alone, text = part.groups()
        if text is not None:
            open_.parts.append(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if closing:
            if attributes or alone:
                return False
            open_ = open_.parent if open_.tag == tag else _after_end(open_, tag)
            continue
        if tag in _RAW_TEXT:
            return False
        classes = _NO_CLASSES if not attributes else next(
            (unescape(a or b or c) for name, a, b, c in _NAME_AND_VALUE.findall(attributes) if name.lower() == "class"), "").split()
        node = _Node(tag, classes, open_)
        open_.parts.append(node)
        if tag not in _VOID:
            open_ = node
        if alone:
            open_ = _after_end(open_, tag)
    tree.open = open_
    return at == len(page)


def _joined(node: _Node, gap: str) -> str:
    return gap.join(t.strip() for t in node.texts() if t.strip())


def _is_div(node: _Node | None, name: str) -> bool:
    return node is not None and node.tag == "div" and name in node.classes


def _station_of(root: _Node) -> str:
    """Text of the cell after the one whose bold label holds the word; else empty."""
    label = root.first(lambda n: n.tag in ("b", "strong") and STATION_LABEL in "".join(n.texts()))
    while label is not None and label.tag != "td":
        label = label.parent
    if label is None:
        return ""
    cells = [n for n in label.parent.parts if isinstance(n, _Node) and n.tag == "td"]
    after = cells[cells.index(label) + 1:]
    return _joined(after[0], "") if after else ""


def _rows_of(root: _Node, most: int | None = None) -> list[list[str]]:
    """Cell texts of the body rows, or the first of them, of the first table in the content area."""
    area = (
        root.first(lambda n: _is_div(n, "content-2") and _is_div(n.parent, "content"))
        or root.first(lambda n: _is_div(n, "content-2"))
        or root.first(lambda n: _is_div(n, "content"))
    )
    table = area.first(lambda n: n.tag == "table") if area else None
    body = table.first(lambda n: n.tag == "tbody") if table else None
    if body is None:
        return []
    rows = islice((n for n in body.walk() if n.tag == "tr"), most)
    return [[_joined(c, " ") for c in row.walk() if c.tag == "td"] for row in rows]


def _root_of(html: str) -> _Node:
    tree = _Tree()
    if not _read_plain(tree, html):
        tree = _Tree()
        tree.feed(html)
        tree.close()
    return tree.root


def _row_parser(most: int | None):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                root = _root_of(html or "")
                rows = _rows_of(root, most)
                station = _station_of(root) if rows else ""
                for i, cells in enumerate(rows):
                    padded = (cells + [""] * 8)[:8]
                    found.append((page_id, station, i, len(cells), not any(cells), *padded))
            yield pd.DataFrame(found, columns=_ROW_COLUMNS)
    return parse


def _parse_stations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names = [_station_of(_root_of(html or "")) for html in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"], "station": names})


def table_rows(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, station, row_no, n_cells, blank, c0..c7): the table rows as they stand, or the first
    ``most`` of each page.

    A page without the word of the content area or without a table has no rows, so it is not
    sent to Python at all.
    """
    likely = pages.filter(F.col("html").contains("content") & F.col("html").rlike("(?i)<table"))
    return spread_if_few(likely.select("page_id", "html")).mapInPandas(_row_parser(most), _ROW_SCHEMA)


def parse_pages(pages: DataFrame, first_only: bool = False) -> DataFrame:
    """Raw readings of the pages: cells by position, short rows padded with empty text.

    All rows but blank ones, with comma rule A; or, ``first_only``, just the newest row of each
    page, where one of fewer than two cells is no row, with comma rule B.
    """
    rows = table_rows(pages, 1 if first_only else None)
    if first_only:
        rows, fix = rows.filter("row_no = 0 and n_cells >= 2"), commas_to_dots_if_number
    else:
        rows, fix = rows.filter("not blank"), commas_to_dots_if_digits
    values = [fix(F.col(f"c{i + 2}")).alias(c) for i, c in enumerate(RAW_POLLUTANTS)]
    return rows.select(
        "page_id", "row_no", F.col("station").alias("Estacion"), F.col("c0").alias("Fecha"),
        F.col("c1").alias("Hora"), *values,
    ).select("page_id", "row_no", *[F.col(name_col(c)) for c in RAW_COLUMNS])


def station_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, station) of every page; empty text where there is no label. The text of a page
    that cannot hold the label is left behind."""
    html = F.when(F.col("html").rlike("(?i)estaci"), F.col("html")).alias("html")
    return spread_if_few(pages.select("page_id", html)).mapInPandas(
        _parse_stations, "page_id long, station string")
