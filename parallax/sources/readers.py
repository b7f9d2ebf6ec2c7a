"""Parsers of text, HTML and Markdown for ``files.binary_spans``, a table reader, and a PDF reader where a library for it is installed.

A parser takes the bytes of a file and gives (page, box, text). Files without layout get lines of 12 points on pages of 612 by 792.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Found = tuple[int, tuple[float, float, float, float], str]
TABLE = "doc_id string, page int, table_no int, row_no int, cells array<string>, confidence double"


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _lines(text: str) -> Iterator[Found]:
    for page, part in enumerate(text.split("\f"), 1):
        for i, line in enumerate(re.split(r"\r\n|[\n\r]", part)):
            if line.strip():
                yield page, (0.0, 12.0 * i, 612.0, 12.0 * i + 10.0), line.strip()


def text_parser(content: bytes) -> list[Found]:
    """Lines of plain text; form feeds break pages."""
    return list(_lines(_decoded(content)))


class _Html(HTMLParser):
    """The text of an HTML document, block by block, and the rows of its tables."""

    BLOCKS = {"p", "div", "br", "li", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "ul", "ol", "pre", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.tables, self.hidden, self.cell = [], [], 0, None

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in self.BLOCKS:
            self.text.append("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            self.cell = []
            self.text.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.text.append("\n")
        if tag in ("td", "th") and self.cell is not None:
            if self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(re.sub(r"\s+", " ", data))
            if self.cell is not None:
                self.cell.append(data)


def _parsed(content: bytes) -> _Html:
    parser = _Html()
    parser.feed(_decoded(content))
    parser.close()
    return parser


def html_parser(content: bytes) -> list[Found]:
    """One line for each block of an HTML document with text in it; scripts and styles are left out."""
    return list(_lines("".join(_parsed(content).text)))


def pdf_parser(content: bytes) -> list[Found]:
    """Lines of a PDF by the library that is installed (PyMuPDF, else pypdf); an error where there is none."""
    import io

    try:
        import fitz
    except ImportError:
        import pypdf  # raises where neither is there

        pages = pypdf.PdfReader(io.BytesIO(content)).pages
        return [(n, box, t) for n, page in enumerate(pages, 1) for _, box, t in _lines((page.extract_text() or "").replace("\f", "\n"))]
    out: list[Found] = []
    for n, page in enumerate(fitz.open(stream=content, filetype="pdf"), 1):
        for block in page.get_text("dict")["blocks"]:
            for line in block.get("lines", []):
                out += [(n, tuple(map(float, s["bbox"])), s["text"].strip()) for s in line["spans"] if s["text"].strip()]
    return out


def tables_of(content: bytes) -> list[tuple[int, list[list[str]]]]:
    """(page, rows) of the tables of a text: those of HTML, else rows of bars (Markdown), else rows of tabs; tables of two rows and columns at least."""
    text = _decoded(content)
    if re.search(r"<\s*table\b", text, re.I):
        found = [(1, t) for t in _parsed(content).tables]
    else:
        found = []
        for mark in ("|", "\t"):
            for page, part in enumerate(text.split("\f"), 1):
                rows: list[list[str]] = []
                for line in [*part.splitlines(), ""]:
                    if mark in line:
                        cells = [c.strip() for c in (line.strip().strip("|") if mark == "|" else line).split(mark)]
                        if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                            rows.append(cells)
                    elif rows:
                        found.append((page, rows))
                        rows = []
            if found:
                break
    return [(p, [r for r in t if any(r)]) for p, t in found if len([r for r in t if any(r)]) >= 2 and max(map(len, t)) >= 2]


def binary_tables(spark: SparkSession, paths: str | list[str], *, glob: str = "*", most_pages: int | None = 20) -> DataFrame:
    """Rows of the tables of text, HTML and Markdown files; confidence is the share of rows as wide as the widest. A file that fails gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    found = tables_of(bytes(content))
                except Exception:
                    found = []
                for t, (page, rows) in enumerate((p, r) for p, r in found if most_pages is None or p <= most_pages):
                    width = max(map(len, rows))
                    sure = sum(len(r) == width for r in rows) / len(rows)
                    out += [(name, page, t, k, r, sure) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["doc_id", "page", "table_no", "row_no", "cells", "confidence"])

    return files.mapInPandas(run, TABLE)


def page_counts(spans: DataFrame) -> DataFrame:
    """(doc_id, pages): the last page of each document that has text."""
    from pyspark.sql import functions as F

    return spans.groupBy("doc_id").agg(F.max("page").alias("pages"))
