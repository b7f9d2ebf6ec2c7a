"""The review of document pairs: records in, flags and unpaired records out, for many pairs in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.operators.align import Embed, align_exact, align_semantic, bind_to_ranges, combine_alignments, hashed_embedding, same_entity_pairs, unpaired
from parallax.operators.dedup import drop_lane_duplicates
from parallax.operators.detect import band_table, detect_flags, gap_flags, one_flag_per_record, with_flag_id
from parallax.operators.judge import Scorer, apply_judgments, keep_all, rerank_weak
from parallax.session import checkpoint


@dataclass
class ReviewConfig:
    """All model lanes are off by default: no scorer, no judgments, names embedded by hashing."""

    embed: Embed = field(default_factory=hashed_embedding)
    threshold: float = 0.85
    same_page_only: bool = True
    suppress_info: bool = True
    pair_scorer: Scorer = keep_all
    bands: DataFrame | None = None
    entities: DataFrame | None = None
    claim_gate: bool = False
    judgments: DataFrame | None = None
    clauses: DataFrame | None = None
    #: False where the records were freed of lane duplicates before, once for each document instead of once for each pair.
    lane_duplicates: bool = True
    #: Called with the name of a stage when its plan is ready; those that checkpoint have run by then.
    on_stage: Callable[[str], None] | None = None


def bind_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Untagged records take the label of the tightest detected range around their middle, on their page."""
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    found = bind_to_ranges(records.where("entity_tag = ''"), entities, ["doc_id", "page"], value=middle)
    return records.join(found.withColumnRenamed("label", "__label"), "record_id", "left").withColumn("entity_tag", F.when(F.col("entity_tag") == "", F.coalesce("__label", F.lit(""))).otherwise(F.col("entity_tag"))).drop("__label").select(*records.columns)


def review(a: DataFrame, b: DataFrame, config: ReviewConfig | None = None) -> dict[str, DataFrame]:
    """flags, pairs, unpaired_a and unpaired_b of the records of side a and b, by pair_id.

    Lane duplicates go first, then records bind to detected entities, pair exactly and by similar names,
    weak pairs are re-scored, differences become flags, unpaired records in scope become gaps, one flag for each b record
    stays, and judgments are applied.
    """
    config = config or ReviewConfig()
    done = config.on_stage or (lambda stage: None)
    sides = [drop_lane_duplicates(x, ["pair_id", "doc_id"]) if config.lane_duplicates else x for x in (a, b)]
    if config.entities is not None:
        sides = [bind_entities(x, config.entities) for x in sides]
    a, b = (checkpoint(x) for x in sides)
    done("records")
    exact = align_exact(a, b)
    if config.claim_gate:
        from parallax.functions.scalars import infer_entity

        entity = lambda s: infer_entity(F.col(f"{s}.span_text"), F.col(f"{s}.doc_id"))["id"]
        exact = same_entity_pairs(exact, entity("a"), entity("b"))
    semantic = align_semantic(a, b, config.embed, threshold=config.threshold, same_page_only=config.same_page_only)
    pairs = checkpoint(rerank_weak(combine_alignments(exact, semantic), config.pair_scorer))
    done("pairs")
    bands = config.bands if config.bands is not None else band_table(a.sparkSession)
    found = detect_flags(pairs, bands, suppress_info=config.suppress_info)
    left_a, left_b = unpaired(a, pairs, "a"), unpaired(b, pairs, "b")
    gaps = gap_flags(left_a, b, page_scope=config.same_page_only)
    flags = with_flag_id(one_flag_per_record(found.unionByName(gaps.select(*found.columns))))
    done("flags")
    if config.judgments is not None:
        flags = apply_judgments(flags, config.judgments, config.clauses)
    return {"flags": flags, "pairs": pairs, "unpaired_a": left_a, "unpaired_b": left_b}


def compare_totals(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-3) -> DataFrame:
    """Pairs (a, b structs of one value per key) of two keyed tables: the case of one record per bucket, as a plain join."""
    from parallax.functions.scalars import relative_deviation

    rows = a.select(key, F.col(value).alias("a_value")).join(b.select(key, F.col(value).alias("b_value")), key)
    return rows.withColumn("value_equivalent", F.when(F.col("b_value") == 0, F.col("a_value") == 0).otherwise(F.abs(F.col("a_value") - F.col("b_value")) / F.abs("b_value") <= tolerance)).withColumn("deviation_pct", relative_deviation(F.col("a_value"), F.col("b_value"))).withColumn("confidence", F.lit(0.9))
