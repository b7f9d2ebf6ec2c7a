"""Queries of the problems on text and model output (p2, p3, p4, p6, p8, p9, p10) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions.text import clean, fold, is_blank
from parallax.functions.units import with_quantity
from parallax.llm.leaks import leaked_items
from parallax.llm.matching import match_mentions
from parallax.llm.quality import document_kinds, statistics_sql, text_statistics
from parallax.llm.survivor import surviving_records
from parallax.llm.tokens import encode_corpus
from parallax.llm.truncation import cut_values, truncation_report
from parallax.llm.vocabulary import map_values, name_tokens
from parallax.queries.problems import quantity_sql
from parallax.session import table

#: Folder of the public tokenizers; a parameter, nothing is copied.
TOKENIZERS = os.environ.get("PARALLAX_TOKENIZERS", "/opt/tokenizers")


def p8_ids(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), tokenizer=f"{tokenizers}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _cut_fields() -> dict:
    return {"key": "extraction_id", "source": clean("lane"), "fields": ["span_text", "reasoning"], "anchor": "raw_value"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_values(table(spark, d, "extracted_claim"), **_cut_fields()).select("extraction_id", F.col("field").alias("field_name")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation_report(table(spark, d, "extracted_claim"), **_cut_fields()).withColumnsRenamed({"source": "lane", "field": "field_name"})


def p6_names(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct free-entered name with its entry; 0 is the report of unmatched values."""
    claim, extracted = table(spark, d, "claim"), table(spark, d, "extracted_claim")
    names = claim.select(F.col("attribute").alias("name")).unionByName(extracted.select(F.col("parameter_name").alias("name")))
    entries = map_values(names, table(spark, d, "parameter_ref").select(F.col("param_id").alias("entry"), "name", "aliases"))
    return entries.select("name", F.col("entry").alias("param_id"), F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    claim, extracted = table(spark, d, "claim"), table(spark, d, "extracted_claim")
    rows = claim.select(F.lit("claim").alias("child_table"), F.col("id").alias("row_id"), F.col("attribute").alias("name")).unionByName(
        extracted.select(F.lit("extracted_claim").alias("child_table"), F.col("extraction_id").cast("string").alias("row_id"), F.col("parameter_name").alias("name"))
    )
    exact = table(spark, d, "parameter_ref").select("name").distinct()
    return rows.join(exact, "name", "left_anti").join(p6_names(spark, d), "name").select("child_table", "row_id", "param_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_kinds(table(spark, d, "documents")).where("kind <> 'prose'")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents"))


#: What extractors write where they found nothing.
PLACEHOLDERS = ("n/a", "-", "see above")


def _filled(c: str):
    return ~is_blank(c) & ~clean(c).isin(*PLACEHOLDERS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    trust = table(spark, d, "extractor").groupBy(clean("extraction_version").alias("version")).agg(F.max("trust").alias("trust"))
    claims = table(spark, d, "claim").select(
        "id", clean("entity_id").alias("entity_id"), "doc_id", "page", fold("attribute").alias("attribute"), "raw_value", "span_text", "section", clean("extraction_version").alias("version"), "created_at"
    )
    rows = with_quantity(claims, "q", "raw_value").where("q is not null").join(trust, "version", "left").withColumn("magnitude", F.col("q.magnitude")).withColumn("common", F.col("q.common"))
    return surviving_records(
        rows, ["entity_id", "doc_id", "page", "attribute", "common"], id="id", value="magnitude", trust=F.col("trust"), time=F.col("created_at"),
        fields={"raw_value": F.lit(True), "span_text": _filled("span_text"), "section": _filled("section")},
    )


def _document(c: str):
    """A document id in one spelling: cleaned, without the ending of a file."""
    return F.regexp_replace(clean(c), r"\.pdf$", "")


def _equipment(spark: SparkSession, d: str) -> DataFrame:
    pair, claim, entity, extracted = (table(spark, d, t) for t in ("fixture_pair", "claim", "entity", "extracted_claim"))
    sides = [pair.select(_document(c).alias("doc"), clean("project_id").alias("scope")) for c in ("doc_id_a", "doc_id_b")]
    scopes = sides[0].unionByName(sides[1]).where("doc is not null and scope is not null").groupBy("doc").agg(F.min("scope").alias("scope"))
    fact = F.xxhash64("doc", "page", fold("raw_value"))
    stored = claim.select(clean("entity_id").alias("key"), _document("doc_id").alias("doc"), "page", "raw_value")
    known = entity.where("type <> 'implicit'").withColumn("key", clean("id"))
    # The scope of an entry without one: where most of its claims were made.
    homes = stored.join(known.where("project_id is null").select("key"), "key", "left_semi").join(scopes, "doc").groupBy("key", "scope").count().groupBy("key").agg(F.max_by("scope", F.struct("count", "scope")).alias("home"))
    entries = known.join(homes, "key", "left").select(F.col("id").alias("entry"), F.coalesce(clean("project_id"), "home").alias("scope"), F.col("type").alias("kind"), "label")
    facts = stored.select("key", fact.alias("fact")).join(known.select("key", F.col("id").alias("entry")), "key").select("entry", "fact")
    read = extracted.select("extraction_id", _document("doc_id").alias("doc"), "page", "raw_value", "entity_tag", "span_text")
    mentions = read.join(scopes, "doc", "left").select(F.col("extraction_id").alias("id"), "scope", F.col("entity_tag").alias("tag"), F.col("span_text").alias("span"), fact.alias("fact"))
    reference = table(spark, d, "parameter_ref").select(F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).select(F.explode(name_tokens(F.col("n"), ())).alias("w")).distinct()
    return match_mentions(mentions, entries, facts, parameter_words=[r.w for r in reference.collect()])


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate that is not all but impossible, with its confidence."""
    return _equipment(spark, d).where("posterior >= 0.0001").select(F.col("id").alias("extraction_id"), F.col("entry").alias("entity_id"), F.round("posterior", 4).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = _equipment(spark, d).groupBy("id").agg(F.max_by("entry", F.struct("posterior", "entry")).alias("entity_id"), F.max("posterior").alias("p"))
    return best.where("p > 0.5").select(F.col("id").alias("extraction_id"), "entity_id")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p4_found": p4_found, "p10_found": p10_found, "p10_statistics": p10_statistics, "p6_found": p6_found, "p6_names": p6_names, "p3_found": p3_found, "p3_report": p3_report, "p8_ids": p8_ids, "p9_found": p9_found}

_FULL = "coalesce(lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))), '') not in ('', 'n/a', '-', 'see above')"
_BEST = "coalesce(arg_max(id, (coalesce(trust, -1), created_at)) filter ({0}), '') as {1}_from"
SQL: dict[str, str] = {
    "p10_statistics": statistics_sql(),
    "p4_found": quantity_sql("id, entity_id, doc_id, page, attribute, section, span_text, extraction_version, created_at", raw_only=True) + f""",
r as (
  select id, lower(trim(entity_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))) as e, doc_id, page, lower(trim(regexp_replace(attribute, '\\s+', ' ', 'g'))) as a, common, stated, trust, created_at,
    {_FULL.format('span_text')} as span_ok, {_FULL.format('section')} as section_ok
  from quantity left join (select lower(extraction_version) as ver, max(trust) as trust from extractor group by 1) x on ver = lower(trim(extraction_version))),
s as (select *, case when abs(stated) <= lag(abs(stated)) over w * 1.001 then 0 else 1 end as opens from r window w as (partition by e, doc_id, page, a, common, sign(stated) order by abs(stated), id)),
g as (select *, sum(opens) over (partition by e, doc_id, page, a, common, sign(stated) order by abs(stated), id) as k from s)
select min(id) as group_id, {_BEST.format('true', 'raw_value')}, {_BEST.format('span_ok', 'span_text')}, {_BEST.format('section_ok', 'section')}
from g group by e, doc_id, page, a, common, sign(stated), k having count(distinct id) > 1""",
}
