"""From lines to typed parameter records by pattern tables; patterns are data, and scanning stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions.scalars import canonical_parameter, claim_id, infer_entity, row_marker, with_base_quantity
from parallax.functions.text import strip

Pattern = tuple[str, str, str | None]


def pattern_matches(text: Column, patterns: Sequence[Pattern], label_value: str | None = fixed.LABEL_VALUE) -> Column:
    """array<struct<k, n, name, raw_value>> of all matches: patterns in order, then one label with number and unit."""
    def matches(k: int, pattern: str, name: str, unit: str | None) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        raw = lambda t: t if unit is None else F.concat(t, F.lit(f" {unit}"))
        return F.transform(tokens, lambda t, i: F.struct(F.lit(k).alias("k"), i.alias("n"), F.lit(name).alias("name"), raw(t).alias("raw_value")))

    found = [matches(k, *p) for k, p in enumerate(patterns)]
    if label_value:
        part = lambda g: F.regexp_extract(text, label_value, g)
        one = F.struct(F.lit(len(patterns)).alias("k"), F.lit(0).alias("n"), strip(part(1)).alias("name"), F.concat(part(2), F.lit(" "), part(3)).alias("raw_value"))
        found.append(F.when(part(2) != "", F.array(one)).otherwise(F.slice(F.array(one), 1, 0)))
    return F.concat(*found)


def extract_parameters(spans: DataFrame, patterns: Sequence[Pattern] = fixed.PATTERNS, *, label_value: str | None = fixed.LABEL_VALUE, second_pass: bool = True, pair: Column | None = None, side: Column | None = None) -> DataFrame:
    """Records of all pattern matches, in the order of spans, patterns and positions.

    The second pass reads each page as one text and adds what only shows across line ends: (page, name, value) not
    seen in the first, once each, in the box of the page and without a row marker.
    """
    spans = spans.withColumn("section", F.col("section") if "section" in spans.columns else F.lit(None).cast("string"))
    first = spans.select("doc_id", "page", "bbox", "section", F.col("text").alias("span_text"), "source_path", "ord", row_marker("text").alias("entity_tag"), F.explode(pattern_matches(F.col("text"), patterns, label_value)).alias("m"))
    keep = ["doc_id", "page", "bbox", "section", "span_text", "source_path", "entity_tag"]
    rows = first.select(*keep, F.lit(0).alias("pass"), "ord", "m.k", "m.n", canonical_parameter(F.col("m.name")).alias("name"), "m.raw_value")
    if second_pass:
        from parallax.operators.scan import join_spans

        pages = join_spans(spans).select("doc_id", "page", "bbox", F.lit(None).cast("string").alias("section"), F.col("text").alias("span_text"), "source_path", F.lit("").alias("entity_tag"), F.explode(pattern_matches(F.col("text"), patterns, None)).alias("m"))
        more = pages.select(*keep, F.lit(1).alias("pass"), F.lit(0).cast("bigint").alias("ord"), "m.k", "m.n", canonical_parameter(F.col("m.name")).alias("name"), "m.raw_value")
        key = ["doc_id", "page", "name", "raw_value"]
        fresh = more.join(rows.select(*key).distinct(), key, "left_anti")
        one = fresh.groupBy(*key).agg(F.min_by(F.struct(*[c for c in fresh.columns if c not in key]), F.struct("k", "n")).alias("r")).select(*key, "r.*")
        rows = rows.unionByName(one)
    rows = with_base_quantity(rows, "raw_value", "q")
    return rows.select(
        F.xxhash64("doc_id", "page", "name", "raw_value", "pass", "ord", "k", "n").alias("record_id"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("pass", "page", "ord", "k", "n", "raw_value")).cast("bigint").alias("ord"),
        (pair if pair is not None else F.lit("")).alias("pair_id"), (side if side is not None else F.lit("a")).alias("side"), "doc_id", "page", "bbox", "section", "span_text", "name", "raw_value",
        F.col("q.magnitude").alias("normalized_magnitude"), F.col("q.dimension").alias("normalized_unit"), "source_path", "entity_tag", F.lit("regex").alias("provenance"), F.lit("regex").alias("extraction_lane"),
    )


def claims_from_records(records: DataFrame) -> DataFrame:
    """Records with their entity (the implicit one of the document if the line names none) and claim id."""
    rows = records.withColumn("entity", infer_entity("span_text", "doc_id")).withColumn("attribute", canonical_parameter("name"))
    return rows.withColumn("claim_id", claim_id(F.col("entity.id"), F.col("attribute"), F.col("raw_value"), F.col("doc_id"), F.col("page")))


def record_tally(records: DataFrame, by: Sequence[str] = ("name",), samples: int = 10) -> DataFrame:
    """(by, records, sample values in order, ``samples`` at most)."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.slice(F.array_sort(F.collect_set("raw_value")), 1, samples).alias("values"))
