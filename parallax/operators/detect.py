"""From pairs to flags: severity by tolerance bands, direction, confidence; gaps; de-duplication; ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions.scalars import attribute_family, authority_side, confidence, flag_id, provenance_label, relative_deviation, severity, severity_rank
from parallax.functions.text import strip
from parallax.schemas import CITATION


def band_table(spark: SparkSession, overrides: DataFrame | None = None, bands: Sequence[tuple] = fixed.BANDS) -> DataFrame:
    """(family, tolerance, major, critical); a row of ``overrides`` replaces the shipped band of its family."""
    base = spark.createDataFrame(list(bands), "family string, tolerance double, major double, critical double")
    return base if overrides is None else merge_by_key(base, overrides.select("family", "tolerance", "major", "critical"), ["family"])


def merge_by_key(base: DataFrame, override: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``override``, and those of ``base`` whose key it does not have."""
    return base.join(override.select(*keys), list(keys), "left_anti").unionByName(override)


def with_severity(df: DataFrame, family: str, deviation: str, bands: DataFrame, *, doc_class: str | None = None, class_bands: Sequence[tuple] = fixed.CLASS_BANDS, default: tuple = fixed.DEFAULT_BAND) -> DataFrame:
    """``df`` with severity: the band of the document class, else that of the family, else the default. ``bands`` has one row per family."""
    spark = df.sparkSession
    named = bands.select(F.col("family").alias("__f"), F.struct("tolerance", "major", "critical").alias("__band"))
    df = df.join(named, F.col(family) == F.col("__f"), "left").drop("__f")
    band = F.coalesce("__band", F.struct(*[F.lit(v).alias(k) for v, k in zip(default, ("tolerance", "major", "critical"), strict=True)]))
    if doc_class is not None:
        special = spark.createDataFrame(list(class_bands), "__c string, __f string, tolerance double, major double, critical double").select("__c", "__f", F.struct("tolerance", "major", "critical").alias("__special"))
        df = df.join(special, (F.col(doc_class) == F.col("__c")) & (F.col(family) == F.col("__f")), "left").drop("__c", "__f")
        band = F.coalesce("__special", band)
    out = df.withColumn("__used", band).withColumn("severity", severity(F.col(deviation), F.col("__used.tolerance"), F.col("__used.major"), F.col("__used.critical")))
    return out.drop("__band", "__special", "__used")


def detect_flags(pairs: DataFrame, bands: DataFrame, *, suppress_info: bool = True, a_class: Column | None = None, b_class: Column | None = None) -> DataFrame:
    """Flags of pairs that differ: family of a's name; both numeric by deviation, else ``major``; a is authoritative unless classes say otherwise."""
    a, b = F.col("a"), F.col("b")
    both = a["normalized_magnitude"].isNotNull() & b["normalized_magnitude"].isNotNull()
    rows = pairs.where(~F.coalesce("value_equivalent", F.lit(False)) & ~F.coalesce(both & (a["normalized_magnitude"] == b["normalized_magnitude"]), F.lit(False)))
    rows = rows.withColumn("attribute_family", attribute_family(F.col("a.name"))).withColumn("deviation_pct", F.when(both, relative_deviation(a["normalized_magnitude"], b["normalized_magnitude"])).otherwise(0.0))
    rows = with_severity(rows, "attribute_family", "deviation_pct", bands).withColumn("severity", F.when(both, F.col("severity")).otherwise("major"))
    if suppress_info:
        rows = rows.where("severity <> 'info'")
    side = F.lit("doc_a") if a_class is None or b_class is None else authority_side(a_class, b_class, F.col("attribute_family"))
    first = side == "doc_a"
    return rows.select(
        *[c for c in pairs.columns if c not in ("a", "b", "value_equivalent", "name_match_confidence", "rerank_rationale", "reranked")], F.col("a.name").alias("parameter"),
        F.when(first, a["doc_id"]).otherwise(b["doc_id"]).alias("authoritative_doc_id"), F.when(first, b["doc_id"]).otherwise(a["doc_id"]).alias("deviating_doc_id"),
        a.alias("a_record"), b.alias("b_record"), confidence(F.lit(1.0), F.col("name_match_confidence") * F.col("pairing_confidence"), F.lit(1.0)).alias("confidence"),
        F.format_string("%s: %s against %s", F.col("a.name"), a["raw_value"], b["raw_value"]).alias("rationale"),
        F.when(F.lit(a_class is None or b_class is None), "a_is_reference").otherwise("class_hierarchy").alias("authority_rule"), "severity", "deviation_pct", "attribute_family",
        provenance_label(a["provenance"], b["provenance"]).alias("provenance"),
        (F.col("rerank_rationale") if "rerank_rationale" in pairs.columns else F.lit(None).cast("string")).alias("rerank_rationale"), F.array().cast(CITATION).alias("cited_clauses"),
    )


def gap_flags(unpaired_a: DataFrame, b_records: DataFrame, keys: Sequence[str] = ("pair_id",), *, names: Sequence[str] = ("Fuse Designation",), page_scope: bool = True) -> DataFrame:
    """Flags of unpaired a records in scope whose value stands in no b record of the page (or of the document)."""
    value = F.upper(strip("raw_value"))
    on = [*keys, *(["page"] if page_scope else []), "__value"]
    there = b_records.withColumn("__value", value).select(*on).distinct()
    other = b_records.groupBy(*keys).agg(F.min("doc_id").alias("__b_doc"))
    gaps = unpaired_a.where(F.col("name").isin(*names)).withColumn("__value", value).where("__value <> ''").join(there, on, "left_anti").drop("__value").join(other, list(keys), "left")
    columns = [c for c in unpaired_a.columns]
    empty = {"doc_id": F.coalesce("__b_doc", F.lit("")), "raw_value": F.lit(""), "span_text": F.lit(""), "normalized_magnitude": F.lit(None).cast("double"), "normalized_unit": F.lit(None).cast("string"), "record_id": -F.abs("record_id") - 1, "side": F.lit("b")}
    b = F.struct(*[(empty[c] if c in empty else F.col(c)).alias(c) for c in columns])
    return gaps.select(
        *keys, F.lit(0.5).alias("pairing_confidence"), F.col("name").alias("parameter"), F.col("doc_id").alias("authoritative_doc_id"), F.coalesce("__b_doc", F.lit("")).alias("deviating_doc_id"),
        F.struct(*columns).alias("a_record"), b.alias("b_record"), F.lit(0.5).alias("confidence"),
        F.format_string("%s %s has no counterpart " + ("on this page" if page_scope else "in the other document"), F.col("name"), F.col("raw_value")).alias("rationale"), F.lit("checklist_gap").alias("authority_rule"),
        F.lit("major").alias("severity"), F.lit(0.0).alias("deviation_pct"), F.lit(None).cast("string").alias("attribute_family"), F.lit("regex").alias("provenance"), F.lit(None).cast("string").alias("rerank_rationale"),
        F.array().cast(CITATION).alias("cited_clauses"),
    )


def migrated_values(unpaired_a: DataFrame, b_records: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Unpaired a records whose value stands in b, on any page."""
    value = F.upper(strip("raw_value"))
    return unpaired_a.withColumn("__value", value).join(b_records.withColumn("__value", value).select(*keys, "__value"), [*keys, "__value"], "left_semi").drop("__value")


def one_flag_per_record(flags: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """For each b record and parameter the flag of highest confidence, then nearest page, then earliest page, then order."""
    a, b = F.col("a_record"), F.col("b_record")
    over = Window.partitionBy(*keys, b["record_id"], "parameter").orderBy(F.desc("confidence"), F.abs(a["page"] - b["page"]), a["page"], a["ord"])
    return flags.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def near_misses(flags: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """(keys, parameter, page, a, b, flags): groups of flags of one page with magnitudes alike in four significant digits, '' for none."""
    form = lambda c: F.when(c.isNull(), "").otherwise(F.format_string("%.3e", c))
    return flags.groupBy(*keys, "parameter", F.col("b_record.page").alias("page"), form(F.col("a_record.normalized_magnitude")).alias("a"), form(F.col("b_record.normalized_magnitude")).alias("b")).agg(F.count(F.lit(1)).alias("flags")).where("flags > 1")


def sort_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), F.col("a_record.ord"))


def split_by_confidence(flags: DataFrame, threshold: float, provenances: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags at or above and below ``threshold``, of the given provenances."""
    kept = flags if provenances is None else flags.where(F.col("provenance").isin(*provenances))
    return kept.where(F.col("confidence") >= threshold), kept.where(F.col("confidence") < threshold)


def severity_counts(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return flags.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("flags"))


def with_flag_id(flags: DataFrame) -> DataFrame:
    return flags.withColumn("flag_id", flag_id(F.col("parameter"), F.col("a_record"), F.col("b_record")))


def display_view(flags: DataFrame) -> DataFrame:
    """Badges for a report: provenance, weak pairing, number of clauses, whole-page citations."""
    box = F.col("a_record.bbox")
    return flags.select(
        "*", F.upper("severity").alias("severity_chip"), F.concat(F.lit("["), F.col("provenance"), F.lit("]")).alias("provenance_badge"), (F.col("pairing_confidence") < 0.75).alias("weak_pair"),
        F.when(F.size("cited_clauses") > 0, F.concat(F.lit("+"), F.size("cited_clauses").cast("string"))).otherwise("").alias("standards_badge"),
        ((box["x0"] == 0) & (box["y0"] == 0)).alias("whole_page"), F.nullif(F.col("a_record.entity_tag"), F.lit("")).alias("entity_chip"),
    )


def citation_clip(box: Column, page_width: Column, page_height: Column, pad: float = 12.0) -> Column:
    """The clip of a citation: the box padded, four times on the right, inside the page; the whole page for an empty box."""
    none = (box["x1"] <= box["x0"]) | (box["y1"] <= box["y0"])
    return F.when(none, F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), page_width.alias("x1"), page_height.alias("y1"))).otherwise(
        F.struct(F.greatest(F.lit(0.0), box["x0"] - pad).alias("x0"), F.greatest(F.lit(0.0), box["y0"] - pad).alias("y0"), F.least(page_width, box["x1"] + 4 * pad).alias("x1"), F.least(page_height, box["y1"] + pad).alias("y1"))
    )
