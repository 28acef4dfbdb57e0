"""HTML, Markdown and CSV rows to typed blocks, by Arrow batches over a small event parser each."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as text_
from pagewright.sources import markdown

BLOCKS = "doc_id long, ordinal int, type string, text string, heading_level int, cells array<array<string>>, header_rows int"
MERGED = ", merged_cells array<struct<row:int,column:int,row_span:int,column_span:int>>"
# Elements without content of their own, elements that make blocks, elements that end a paragraph.
SKIPPED = {"script", "style", "noscript", "template", "object", "iframe", "title"}
TYPES = {"p": "PARAGRAPH", "li": "LIST", "pre": "CODE", "figcaption": "CAPTION", **{f"h{k}": "TITLE" for k in range(1, 7)}}
ENDS_P = set(TYPES) | {"div", "article", "section", "nav", "ul", "ol", "table", "footer", "header", "blockquote", "body"}


def _span(value: str | None) -> int:
    """A span that isn't a number from 1 to 10,000 is 1."""
    span = int(value) if value and value.strip().isascii() and value.strip().isdigit() and len(value) < 9 else 1
    return span if 1 <= span <= 10_000 else 1


class _Table:
    """A grid under construction; end tags of cells and rows may be missing."""

    def __init__(self, at: int) -> None:
        self.at = at  # where its block goes
        self.rows: list[list[str]] = []
        self.heads: list[bool] = []
        self.merged: list[tuple[int, int, int, int]] = []
        self.taken: dict[int, int] = {}  # column to the last row that a cell from above covers
        self.cell: list[str] | None = None
        self.in_row = self.caption = False

    def end_cell(self) -> None:
        if self.cell is not None:
            row = self.rows[-1]
            row += [""] * (self.column - len(row)) + [" ".join("".join(self.cell).split())]
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        self.in_row = False

    def begin_row(self) -> None:
        self.end_row()
        self.rows.append([])
        self.heads.append(True)
        self.in_row, self.next = True, 0

    def begin_cell(self, tag: str, attrs: dict) -> None:
        self.end_cell()
        if not self.in_row:
            self.begin_row()
        at, column = len(self.rows) - 1, self.next
        while self.taken.get(column, -1) >= at:
            column += 1
        rows, columns = _span(attrs.get("rowspan")), _span(attrs.get("colspan"))
        self.column, self.next = column, column + columns
        if rows > 1:
            self.taken.update((c, max(at + rows - 1, self.taken.get(c, -1))) for c in range(column, column + columns))
        if rows > 1 or columns > 1:
            self.merged.append((at, column, rows, columns))
        self.heads[-1] &= tag == "th"
        self.cell = []

    def block(self) -> tuple | None:
        self.end_row()
        kept = [(r, h) for r, h in zip(self.rows, self.heads, strict=True) if r]  # rows without cells are none
        if not kept:
            return None
        width = max(len(r) for r, _ in kept)
        cells = [r + [""] * (width - len(r)) for r, _ in kept]
        heads = sum(h for _, h in kept)
        return ("TABLE", "\n".join(" | ".join(r) for r in cells), None, cells, heads, self.merged)


class _Page(HTMLParser):
    """Collects blocks in document order; an open paragraph ends where a block begins.

    The head has no content of its own besides skipped elements, so it ends at the first element that makes a block. A table
    inside a cell is a block of its own after the outer table's, and isn't part of the cell's text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple | None] = []
        self.open: list[list] = []  # [tag, texts]
        self.skip = 0
        self.tables: list[_Table] = []

    def _close(self, tag: str) -> None:
        if not any(o[0] == tag for o in self.open):
            return
        while self.open:
            name, texts = self.open.pop()
            body = "".join(texts)
            body = body.strip("\n") if name == "pre" else " ".join(body.split())
            if body:
                self.out.append((TYPES[name], body, int(name[1]) if TYPES[name] == "TITLE" else None, None, None))
            if name == tag:
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if self.tables:
            self._table_tag(tag, dict(attrs))
            return
        if tag in ENDS_P and not any(o[0] == "li" for o in self.open):
            self._close("p")
        if tag == "li":
            self._close("li")
        if tag == "table":
            self._begin_table()
        elif tag == "img":
            self.out.append(("IMAGE", dict(attrs).get("alt") or "", None, None, None))
        elif tag in TYPES and not (tag == "p" and any(o[0] == "li" for o in self.open)):
            self.open.append([tag, []])
        elif tag == "br" and self.open:
            self.open[-1][1].append("\n" if self.open[-1][0] == "pre" else " ")

    def _begin_table(self) -> None:
        self.tables.append(_Table(len(self.out)))
        self.out.append(None)

    def _end_table(self) -> None:
        done = self.tables.pop()
        self.out[done.at] = done.block()

    def _table_tag(self, tag: str, attrs: dict) -> None:
        top = self.tables[-1]
        if tag == "table":
            if top.cell is None and not top.caption:
                self._end_table()  # outside of cells a new table ends the open one
            elif top.cell is not None:
                top.cell.append(" ")
            self._begin_table()
        elif tag == "caption":
            top.end_row()
            top.caption = True
        elif tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
            top.caption = False
            if tag == "tr":
                top.begin_row()
            elif tag in ("td", "th"):
                top.begin_cell(tag, attrs)
            else:
                top.end_row()

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif self.tables:
            top = self.tables[-1]
            if tag in ("td", "th"):
                top.end_cell()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                top.end_row()
            elif tag == "caption":
                top.caption = False
            elif tag == "table":
                self._end_table()
        elif tag in TYPES:
            self._close(tag)
        elif tag in ENDS_P:
            self._close("p")
            if tag in ("ul", "ol"):
                self._close("li")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        cell = next((t.cell for t in reversed(self.tables) if t.cell is not None), None)
        if cell is not None:
            cell.append(data)
        elif self.open:
            self.open[-1][1].append(data)


def html_blocks_of(html: str) -> list[tuple]:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.tables:
        page._end_table()
    while page.open:
        page._close(page.open[-1][0])
    return [b for b in page.out if b is not None]


def markdown_blocks_of(text: str) -> list[tuple]:
    """Blocks of a Markdown text by way of its HTML; raw HTML stays text."""
    return html_blocks_of(markdown.to_html(text))


def csv_blocks_of(text: str) -> list[tuple]:
    """One table with one header row; ragged rows and empty lines stay."""
    rows = list(csv.reader(io.StringIO(text or "", newline="")))
    return [("TABLE", "\n".join(" | ".join(r) for r in rows), None, rows, 1)] if rows else []


def blocks(rows: DataFrame, parse: Callable[[str], list[tuple]]) -> DataFrame:
    """``rows`` has doc_id and text; one row per block, numbered from 1; only HTML has merged cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(d, k, *b[:5], b[5] if len(b) > 5 else None) for d, t in zip(f["doc_id"], f["text"], strict=True) for k, b in enumerate(parse(t), 1)]
            out = pd.DataFrame(found, columns=["doc_id", "ordinal", "type", "text", "heading_level", "cells", "header_rows", "merged_cells"])
            yield out.astype({"heading_level": "Int32", "header_rows": "Int32"})

    return rows.select("doc_id", "text").mapInPandas(run, BLOCKS + MERGED)


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


LINK = r"""<(?i:a|img|link|video|audio|source)\s[^>]*?(?i:href|src)\s*=\s*("[^"]*"|'[^']*')"""


def link_kind(url: Column) -> Column:
    """EMPTY, DATA, EXTERNAL or LOCAL."""
    u = text_.trimmed(F.coalesce(url, F.lit("")))
    return F.when(u == "", "EMPTY").when(F.startswith(u, F.lit("data:")), "DATA").when(u.rlike("^(?i:https?:)?//"), "EXTERNAL").otherwise("LOCAL")


def leaves(url: Column) -> Column:
    """Whether a link counts as external: it leads out of the document, or runs a script."""
    return (link_kind(url) == "EXTERNAL") | text_.trimmed(F.coalesce(url, F.lit(""))).rlike("^(?i:javascript:)")


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, url: targets of a page's elements."""
    found = F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda u: F.substring(u, F.lit(2), F.length(u) - 2))
    return pages.select(key, F.explode(found).alias("url"))
