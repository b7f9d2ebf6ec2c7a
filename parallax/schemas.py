"""Row types shared by the operators."""

from __future__ import annotations

BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPAN = f"doc_id string, page int, bbox {BBOX}, text string, source_path string, ord bigint"
RECORD = (
    f"record_id bigint, ord bigint, pair_id string, side string, doc_id string, page int, bbox {BBOX}, section string, span_text string, name string, raw_value string, "
    "normalized_magnitude double, normalized_unit string, source_path string, entity_tag string, provenance string, extraction_lane string"
)
RECORD_COLUMNS = [c.strip().split(" ")[0] for c in RECORD.replace(BBOX, "bbox").split(",")]
CITATION = "array<struct<clause_id: string, edition_year: int, source_name: string, summary: string>>"
CLAUSE = "clause_id string, edition_year int, source_name string, applicable_families array<string>, applicable_doc_classes array<string>, tolerance_band double, summary string"
EQUIPMENT = "doc_id string, canonical_id string, kind string, identity_anchors array<string>, weak_descriptors array<string>, parameters map<string, string>, confidence double, cluster_status string"
