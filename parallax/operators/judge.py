"""Model answers as data: validation, guards, re-ranking, judgments and citations.

A scorer is a function from a pandas frame to a pandas frame; it runs in Arrow batches and only on rows that no
cache answers. The default scorers are fixed rules, so everything runs without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.scalars import decimal_shift, grounded, mentions_value, verbatim
from parallax.schemas import CITATION

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def parse_payload(text: Column, schema: str) -> Column:
    """JSON in a fenced block, else the outermost braces, by ``schema``; null where it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit("")), schema, {"mode": "PERMISSIVE"})


def within(value: Column, lo: float, hi: float) -> Column:
    return F.coalesce(value.between(lo, hi), F.lit(False))


def run_scorer(rows: DataFrame, scorer: Scorer, schema: str, *, key: str, cache: DataFrame | None = None) -> DataFrame:
    """Answers by ``key``; keys in ``cache`` (key, the columns of ``schema``) are not scored again."""
    todo = rows if cache is None else rows.join(cache.select(key), key, "left_anti")

    def run(batches):
        for b in batches:
            if len(b):
                yield scorer(b)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    fresh = todo.mapInPandas(run, schema)
    return fresh if cache is None else fresh.unionByName(cache.join(rows.select(key).distinct(), key, "left_semi").select(*names))


def text_lane(pages: DataFrame, scorer: Scorer, *, cache: DataFrame | None = None) -> DataFrame:
    """Claims of a text model: JSON answers to non-blank pages, exploded, kept if the span stands in the page.

    The scorer gives (key, answer); a page that gave nothing valid gives no claim.
    """
    schema = "struct<claims: array<struct<parameter_name: string, raw_value: string, entity_tag: string, span_text: string, confidence: double, reasoning: string>>>"
    keyed = pages.where(F.trim("text") != "").withColumn("key", F.sha2(F.concat_ws("|", "doc_id", F.col("page").cast("string"), "text"), 256))
    answers = run_scorer(keyed.select("key", "doc_id", "page", "text"), scorer, "key string, answer string", key="key", cache=cache)
    claims = keyed.join(answers, "key").select("doc_id", "page", F.col("text").alias("page_text"), F.explode(parse_payload(F.col("answer"), schema)["claims"]).alias("c"))
    return claims.select("doc_id", "page", "page_text", "c.*").where(within(F.col("confidence"), 0, 1) & (F.col("parameter_name") != "") & (F.col("raw_value") != "") & verbatim(F.col("span_text"), F.col("page_text"))).drop("page_text")


def vision_lane(pages: DataFrame, scorer: Scorer, *, cache: DataFrame | None = None) -> DataFrame:
    """Claims of a vision model on diagram pages, kept if the entity is grounded in the page's text; without magnitude."""
    schema = "struct<claims: array<struct<entity_kind: string, entity_id: string, parameter_name: string, raw_value: string, visual_evidence: string>>>"
    keyed = pages.where("structure = 'diagram'").withColumn("key", F.sha2(F.concat_ws("|", "doc_id", F.col("page").cast("string"), "text"), 256))
    answers = run_scorer(keyed.select("key", "doc_id", "page", "text"), scorer, "key string, answer string", key="key", cache=cache)
    claims = keyed.join(answers, "key").select("doc_id", "page", F.col("text").alias("page_text"), F.explode(parse_payload(F.col("answer"), schema)["claims"]).alias("c"))
    return claims.select("doc_id", "page", "page_text", "c.*").where((F.col("parameter_name") != "") & (F.col("raw_value") != "") & grounded(F.col("entity_id"), F.col("page_text"))).drop("page_text")


def ocr_lane(pages: DataFrame, scorer: Scorer, *, least: int = 80, cache: DataFrame | None = None) -> DataFrame:
    """Spans read from pages whose own text is shorter than ``least``: a reader gives the text of a page image, one span for each non-blank line.

    ``pages``: doc_id, page, text, source_path and what the reader needs. Spans cover the whole page (612 x 792).
    """
    from parallax.functions.text import strip

    low = pages.where(F.length(strip(F.coalesce("text", F.lit("")))) < least).withColumn("key", F.sha2(F.concat_ws("|", "doc_id", F.col("page").cast("string")), 256))
    read = run_scorer(low, scorer, "key string, answer string", key="key", cache=cache)
    lines = low.select("key", "doc_id", "page", "source_path").join(read, "key").select("doc_id", "page", "source_path", F.posexplode(F.split(F.coalesce("answer", F.lit("")), r"\r\n|[\n\r]")).alias("i", "line"))
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0))])
    return lines.where(strip("line") != "").select("doc_id", "page", box.alias("bbox"), strip("line").alias("text"), "source_path", (F.col("page").cast("bigint") * 1_000_000 + F.col("i")).alias("ord"))


def entity_lane(pages: DataFrame, scorer: Scorer, *, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, label, kind, y_top, y_bottom, ord): equipment ranges that a detector finds on pages with text; stop labels and inverted ranges go."""
    schema = "struct<entities: array<struct<label: string, kind: string, y_top: double, y_bottom: double>>>"
    keyed = pages.where(F.trim("text") != "").withColumn("key", F.sha2(F.concat_ws("|", "doc_id", F.col("page").cast("string"), "text"), 256))
    answers = run_scorer(keyed.select("key", "doc_id", "page", "text"), scorer, "key string, answer string", key="key", cache=cache)
    found = keyed.select("key", "doc_id", "page").join(answers, "key").select("doc_id", "page", F.posexplode(parse_payload(F.col("answer"), schema)["entities"]).alias("ord", "e"))
    return usable_entities(found.select("doc_id", "page", "e.*", "ord").where((F.col("y_top") >= 0) & (F.col("y_bottom") >= 0)))


def class_lane(pages: DataFrame, scorer: Scorer, *, least: float = 0.6, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_class, confidence, reasoning) from the sampled pages of each document; weak answers are ``unknown``."""
    from parallax.operators.scan import sample_pages

    schema = "struct<doc_class: string, confidence: double, reasoning: string>"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    docs = sample_pages(pages).groupBy("doc_id").agg(text.alias("text")).withColumn("key", F.sha2(F.concat_ws("|", "doc_id", "text"), 256))
    answers = docs.join(run_scorer(docs, scorer, "key string, answer string", key="key", cache=cache), "key", "left").select("doc_id", parse_payload(F.col("answer"), schema).alias("a"))
    sure = within(F.col("a.confidence"), 0, 1)
    return document_class(answers.select("doc_id", F.when(sure, F.col("a.doc_class")).otherwise("unknown").alias("doc_class"), F.when(sure, F.col("a.confidence")).otherwise(0.0).alias("confidence"), F.coalesce("a.reasoning", F.lit("")).alias("reasoning")), least)


def judge_flags(flags: DataFrame, clauses: DataFrame, scorer: Scorer, *, key: str = "flag_id", cache: DataFrame | None = None) -> DataFrame:
    """Flags with the judgments that a scorer gives; a flag without a valid judgment stays as it is.

    The scorer sees the flag and the ids of the clauses that apply to its family.
    """
    schema = "struct<severity: string, within_typical_tolerance: boolean, engineering_explanation: string, downstream_effects: array<string>, confidence: double, cited_clause_ids: array<string>>"
    open_ = clauses.select("clause_id", F.explode("applicable_families").alias("attribute_family")).groupBy("attribute_family").agg(F.sort_array(F.collect_set("clause_id")).alias("clause_ids"))
    asked = flags.select(F.col(key).alias("key"), "parameter", F.col("a_record.raw_value").alias("a_raw"), F.col("b_record.raw_value").alias("b_raw"), "severity", "deviation_pct", "attribute_family").join(open_, "attribute_family", "left")
    answers = run_scorer(asked, scorer, "key string, answer string", key="key", cache=cache)
    judged = answers.select(F.col("key").alias(key), parse_payload(F.col("answer"), schema).alias("j")).select(key, "j.*")
    valid = judged.where(within(F.col("confidence"), 0, 1) & F.col("severity").isin("critical", "major", "minor", "info"))
    return apply_judgments(flags, valid, clauses, key)


#: Labels that name no equipment.
STOP_LABELS = ("IEEE", "IEC", "NEMA", "ANSI", "UL", "NFPA", "Example", "Figure", "Note", "Table", "See")


def usable_entities(entities: DataFrame) -> DataFrame:
    """Detected labels outside the stop list (case matters) whose range is not inverted."""
    return entities.where(~F.col("label").isin(*STOP_LABELS) & (F.col("y_top") <= F.col("y_bottom")))


def document_class(classes: DataFrame, least: float = 0.6) -> DataFrame:
    """``unknown`` for answers below ``least``, with a note in the reasoning."""
    weak = F.col("confidence") < least
    return classes.withColumn("reasoning", F.when(weak, F.concat(F.col("reasoning"), F.lit(" (below the confidence floor)"))).otherwise(F.col("reasoning"))).withColumn("doc_class", F.when(weak, "unknown").otherwise(F.col("doc_class")))


def records_from_claims(claims: DataFrame, lane: str) -> DataFrame:
    """Records of model claims: no box, provenance llm, the tag given by the model; magnitudes by text lanes only."""
    from parallax.functions.scalars import canonical_parameter, with_base_quantity

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
    rows = with_base_quantity(claims, "raw_value", "q")
    tag = F.col("entity_id") if lane == "vision" else F.coalesce("entity_tag", F.lit(""))
    number = (lambda c: F.lit(None).cast(c[1])) if lane == "vision" else (lambda c: F.col(c[0]))
    return rows.select(
        F.xxhash64("doc_id", "page", "parameter_name", "raw_value", tag, F.lit(lane)).alias("record_id"), F.col("page").cast("bigint").alias("ord"), F.lit("").alias("pair_id"), F.lit("a").alias("side"), "doc_id", "page", zero.alias("bbox"), F.lit(None).cast("string").alias("section"),
        (F.col("visual_evidence") if lane == "vision" else F.col("span_text")).alias("span_text"), canonical_parameter("parameter_name").alias("name"), "raw_value",
        number(("q.magnitude", "double")).alias("normalized_magnitude"), number(("q.dimension", "string")).alias("normalized_unit"), F.lit("").alias("source_path"), tag.alias("entity_tag"), F.lit("llm").alias("provenance"), F.lit(lane).alias("extraction_lane"),
    )


def keep_all(batch: pd.DataFrame) -> pd.DataFrame:
    """The default pair scorer: no verdict, so pairs stay as they are."""
    return pd.DataFrame({"pair_key": batch["pair_key"], "score": pd.Series([None] * len(batch), dtype="float64"), "rationale": None, "decline": None})


def rerank_weak(pairs: DataFrame, scorer: Scorer = keep_all, *, weak: float = 0.75) -> DataFrame:
    """Pairs with weak ones re-scored: a verdict replaces the confidence; a declined pair goes, unless its values differ by a decimal shift.

    A rationale that names neither value is ignored, and so is a missing verdict.
    """
    keyed = pairs.withColumn("pair_key", F.concat_ws(":", F.col("a.record_id").cast("string"), F.col("b.record_id").cast("string")))
    low = keyed.where(F.col("pairing_confidence") <= weak)
    asked = low.select("pair_key", F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), F.col("a.raw_value").alias("a_raw"), F.col("b.raw_value").alias("b_raw"))
    verdicts = run_scorer(asked, scorer, "pair_key string, score double, rationale string, decline boolean", key="pair_key").where(within(F.col("score"), 0, 1)).dropDuplicates(["pair_key"])
    joined = low.join(verdicts, "pair_key", "left")
    said = F.col("score").isNotNull() & mentions_value(F.col("rationale"), F.col("a.raw_value"), F.col("b.raw_value"))
    shift = decimal_shift(F.col("a.normalized_magnitude"), F.col("b.normalized_magnitude"))
    declined = said & F.coalesce("decline", F.lit(False))
    done = joined.where(~declined | shift).withColumns({
        "pairing_confidence": F.when(said & ~declined, F.col("score")).otherwise(F.col("pairing_confidence")), "reranked": said,
        "rerank_rationale": F.when(declined, F.concat(F.lit("kept in spite of the verdict, values differ by a decimal shift: "), F.col("rationale"))).when(said, F.col("rationale")),
    }).drop("pair_key", "score", "rationale", "decline")
    strong = keyed.where((F.col("pairing_confidence") > weak) | F.col("pairing_confidence").isNull()).drop("pair_key").withColumns({"reranked": F.lit(False), "rerank_rationale": F.lit(None).cast("string")})
    return strong.unionByName(done.select(*strong.columns))


def clauses_for(clauses: DataFrame, family: Column, doc_class: Column | None = None) -> Column:
    """Whether a clause applies: its families hold the family, and its classes are empty or hold the class, if one is given."""
    fits = F.array_contains("applicable_families", family)
    if doc_class is None:
        return fits
    return fits & (doc_class.isNull() | (F.size("applicable_doc_classes") == 0) | F.array_contains("applicable_doc_classes", doc_class))


def resolve_citations(rows: DataFrame, clauses: DataFrame, *, key: str, ids: str) -> DataFrame:
    """(key, cited_clauses): cited ids as citations in their order; unknown ids are dropped."""
    open_ = rows.select(F.col(key), F.posexplode(ids).alias("i", "clause_id"))
    found = open_.join(clauses.dropDuplicates(["clause_id"]).select("clause_id", "edition_year", "source_name", "summary"), "clause_id")
    ordered = F.array_sort(F.collect_list(F.struct("i", F.struct("clause_id", "edition_year", "source_name", "summary").alias("c"))))
    return found.groupBy(key).agg(F.transform(ordered, lambda s: s["c"]).cast(CITATION).alias("cited_clauses"))


def apply_judgments(flags: DataFrame, judgments: DataFrame, clauses: DataFrame, key: str = "flag_id") -> DataFrame:
    """Flags with their judgment: severity replaced, confidence multiplied, rationale extended, citations resolved."""
    cited = resolve_citations(judgments, clauses, key=key, ids="cited_clause_ids").withColumnRenamed("cited_clauses", "__cited")
    j = judgments.where(within(F.col("confidence"), 0, 1)).select(key, F.col("severity").alias("__s"), F.col("confidence").alias("__c"), F.col("engineering_explanation").alias("__e"))
    return flags.join(j, key, "left").join(cited, key, "left").withColumns({
        "severity": F.coalesce("__s", "severity"), "confidence": F.col("confidence") * F.coalesce("__c", F.lit(1.0)),
        "rationale": F.when(F.col("__e").isNotNull(), F.concat_ws(" ", "rationale", "__e")).otherwise(F.col("rationale")), "cited_clauses": F.coalesce("__cited", "cited_clauses"),
    }).drop("__s", "__c", "__e", "__cited")


def coupled_claims(families: DataFrame, claims: DataFrame, coupled: dict[str, Sequence[str]], *, key: str = "key", family: str = "family", attribute: str = "attribute", most: int = 8) -> DataFrame:
    """(key, coupled_family, claim columns): claims stored under the first ``most`` families that depend on a family."""
    table = F.create_map(*[x for k, v in coupled.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    open_ = families.select(F.col(key), F.explode(F.slice(F.try_element_at(table, F.col(family)), 1, most)).alias("coupled_family"))
    return open_.join(claims, open_["coupled_family"] == claims[attribute])


def prompt_text(template: str, **parts: Column) -> Column:
    """A prompt with ``{name}`` replaced by columns; what a scorer is given, never run here."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def clauses_to_citations(clauses: DataFrame) -> DataFrame:
    return clauses.select("clause_id", "edition_year", "source_name", "summary")
