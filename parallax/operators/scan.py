"""From documents to lines: spans, line assembly, layout statistics, page routing, sections.

A page is the unit that lines and sections never cross, so windows and folds are partitioned by document and page.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions.scalars import page_structure
from parallax.functions.text import col, strip
from parallax.schemas import SPAN


def text_spans(documents: DataFrame, doc: str, text: str, *, lines_per_page: int | None = None) -> DataFrame:
    """Spans of plain text: one for each non-blank line, in order; pages of ``lines_per_page`` lines, or form feeds."""
    rows = documents.select(F.col(doc).cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f" if lines_per_page is None else "\u0000")).alias("p", "t"))
    lines = rows.select("doc_id", "p", F.posexplode(F.split("t", r"\r\n|[\n\r]")).alias("i", "line")).where(strip("line") != "")
    page = F.col("p") if lines_per_page is None else F.floor(F.col("i") / lines_per_page)
    y = F.col("i").cast("double") * 12.0
    return lines.select(
        "doc_id", (page + 1).cast("int").alias("page"), F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(612.0).alias("x1"), (y + 10.0).alias("y1")).alias("bbox"),
        strip("line").alias("text"), F.lit("").alias("source_path"), (F.col("p").cast("long") * 1_000_000 + F.col("i")).alias("ord"),
    )


def assemble_lines(spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Spans joined to lines: a line takes the spans whose middle lies within ``tolerance`` of its first span's.

    Lines are anchored, not chained, so this is a fold over one page; a page is the group.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        rows = [(float((b["y0"] + b["y1"]) / 2), float(b["x0"]), int(o), b, t) for b, o, t in zip(page["bbox"], page["ord"], page["text"], strict=True)]
        rows.sort(key=lambda r: r[:3])
        lines, anchor = [], None
        for r in rows:
            if anchor is None or abs(r[0] - anchor) > tolerance:
                lines.append([])
                anchor = r[0]
            lines[-1].append(r)
        out = []
        for n, line in enumerate(lines):
            line.sort(key=lambda r: (r[1], r[2]))
            box = {k: pick(float(r[3][k]) for r in line) for k, pick in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
            out.append((page["doc_id"].iat[0], int(page["page"].iat[0]), box, " ".join(r[4] for r in line), page["source_path"].iat[0], n))
        return pd.DataFrame(out, columns=["doc_id", "page", "bbox", "text", "source_path", "ord"])

    return spans.groupBy("doc_id", "page").applyInPandas(fold, SPAN)


def join_spans(spans: DataFrame) -> DataFrame:
    """One row for each page: all spans in reading order, joined by line ends, in the box of the page's spans."""
    order = F.struct(((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("y"), F.col("bbox.x0").alias("x"), "ord", "text")
    return spans.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "\n").alias("text"),
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"), F.min("source_path").alias("source_path"),
    )


def page_spec(pages: DataFrame, most: int | None) -> DataFrame:
    """Pages from 1 to ``most``; all if None."""
    return pages if most is None else pages.where(F.col("page") <= most)


def sample_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first two pages and the last of every document."""
    return pages.withColumn("__last", F.max("page").over(Window.partitionBy(doc))).where("page in (1, 2) or page = __last").drop("__last")


def low_coverage(pages: DataFrame, text: str = "text", least: int = 80) -> DataFrame:
    """Pages whose text, without outer blanks, is shorter than ``least``."""
    return pages.where(F.length(strip(F.coalesce(F.col(text), F.lit("")))) < least)


def image_only(pages: DataFrame, doc: str = "doc_id", text: str = "text", most: int | None = None, least: int = 80) -> DataFrame:
    """(doc, image_only): whether every page, up to ``most``, is low in text."""
    short = F.length(strip(F.coalesce(F.col(text), F.lit("")))) < least
    return page_spec(pages, most).groupBy(doc).agg(F.bool_and(short).alias("image_only"))


def layout_statistics(pages: DataFrame, keys: Sequence[str], text: str, image_share: Column | None = None, short: int = 20) -> DataFrame:
    """(keys, n_chars, n_lines, average, short_share, image_share, structure) by non-blank lines of each page."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n"), lambda s: strip(s)), lambda s: s != "")
    rows = pages.select(*keys, F.length(strip(F.coalesce(F.col(text), F.lit("")))).alias("n_chars"), lines.alias("l"), (image_share if image_share is not None else F.lit(0.0)).alias("image_share"))
    n = F.size("l")
    total = F.length(F.array_join("l", ""))
    rows = rows.select(
        *keys, "n_chars", n.alias("n_lines"), F.when(n > 0, total / n).otherwise(0.0).alias("average"),
        F.when(n > 0, F.size(F.filter("l", lambda s: F.length(s) < short)) / n).otherwise(0.0).alias("short_share"), "image_share",
    )
    return rows.withColumn("structure", page_structure(F.col("n_chars"), F.col("average"), F.col("short_share"), F.col("image_share")))


def implausible_tokens(texts: DataFrame, keys: Sequence[str], text: str, patterns=fixed.PLAUSIBLE_PATTERNS, ranges=fixed.PLAUSIBLE_RANGES) -> DataFrame:
    """(keys, token, family, value): numbers outside the plausible range of their family."""
    def bad(pattern: str, family: str, factor: float) -> Column:
        lo, hi = ranges[family]
        number = lambda t: F.regexp_replace(F.regexp_extract(t, pattern, 1), ",", "").try_cast("double") * factor
        tokens = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        read = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(family).alias("family"), number(t).alias("value")))
        return F.filter(read, lambda r: ~r["value"].between(lo, hi))

    found = [bad(*p) for p in patterns]
    return texts.select(*keys, F.explode(F.concat(*found)).alias("r")).select(*keys, "r.token", "r.family", "r.value")


def better_reading(pages: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """(keys, text): the second reading where it has strictly fewer implausible numbers, else the first."""
    count = lambda c: implausible_tokens(pages, keys, c).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"bad_{c}"))
    both = pages.join(count(first), list(keys), "left").join(count(second), list(keys), "left")
    n = lambda c: F.coalesce(f"bad_{c}", F.lit(0))
    return both.select(*keys, F.when((n(first) > 0) & F.col(second).isNotNull() & (n(second) < n(first)), F.col(second)).otherwise(F.col(first)).alias("text"))


def is_heading(text: Column | str) -> Column:
    return col(text).rlike(r"^\d+(\.\d+)*\.?\s+\S|^[a-z]\.\s+\S|^Time Current Curve\b")


def fill_sections(spans: DataFrame, keys: Sequence[str], order: Sequence[Column | str], text: str = "text", heading: Column | None = None) -> DataFrame:
    """``spans`` with section: the last heading at or above, within ``keys``; a heading carries itself."""
    head = is_heading(text) if heading is None else heading
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("section", F.last(F.when(head, F.col(text)), ignorenulls=True).over(over))
