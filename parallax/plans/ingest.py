"""From documents to records: spans, pages with little text read by an optional reader, and the three extraction lanes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.operators.extract import extract_parameters
from parallax.operators.judge import Scorer, ocr_lane, records_from_claims, text_lane, vision_lane
from parallax.operators.scan import assemble_lines, join_spans, layout_statistics, low_coverage, page_spec
from parallax.schemas import RECORD_COLUMNS


@dataclass
class Lanes:
    """Optional scorers; a lane without one gives nothing."""

    reader: Scorer | None = None
    text: Scorer | None = None
    vision: Scorer | None = None
    most_pages: int | None = None
    assemble: bool = False


def ingest(spans: DataFrame, pages: DataFrame, lanes: Lanes | None = None) -> dict[str, DataFrame]:
    """spans (with those read from pages low in text), pages (doc_id, page, text) and low_coverage.

    ``pages`` has doc_id, page, source_path for every page, also those without spans.
    """
    lanes = lanes or Lanes()
    spans, pages = page_spec(spans, lanes.most_pages), page_spec(pages, lanes.most_pages)
    if lanes.assemble:
        spans = assemble_lines(spans)
    full = pages.select("doc_id", "page", "source_path").join(join_spans(spans).select("doc_id", "page", "text"), ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    low = low_coverage(full)
    if lanes.reader is not None:
        spans = spans.unionByName(ocr_lane(full, lanes.reader))
        full = full.drop("text").join(join_spans(spans).select("doc_id", "page", "text"), ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return {"spans": spans, "pages": full, "low_coverage": low.select("doc_id", "page")}


def all_lanes(spans: DataFrame, pages: DataFrame, pair_id: str, side: str, lanes: Lanes | None = None) -> DataFrame:
    """Records of the pattern, text and vision lanes, in that order; pages are routed by their structure."""
    lanes = lanes or Lanes()
    parts = [extract_parameters(spans, pair=F.lit(pair_id), side=F.lit(side)).select(*RECORD_COLUMNS)]
    if lanes.text is not None:
        parts.append(records_from_claims(text_lane(pages, lanes.text), "llm_text").select(*RECORD_COLUMNS))
    if lanes.vision is not None:
        routed = pages.join(layout_statistics(pages, ["doc_id", "page"], "text").select("doc_id", "page", "structure"), ["doc_id", "page"])
        parts.append(records_from_claims(vision_lane(routed, lanes.vision), "vision").select(*RECORD_COLUMNS))
    out = parts[0]
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("ord", F.col("ord") + F.lit(k) * (1 << 58)))
    return out.withColumns({"pair_id": F.lit(pair_id), "side": F.lit(side)})
