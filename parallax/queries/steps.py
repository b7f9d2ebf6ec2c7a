"""Queries of the single steps of a review, over records made from whole order lines and over whole model output, with their SQL.

Two records meet where one order line comes before another of its order; scorers are fixed rules, so SQL can say what they answer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions import scalars as S
from parallax.functions.text import clean
from parallax.operators import align, detect, equipment, evaluate, extract, judge, scan
from parallax.session import shared_folder, table
from parallax.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- records of order lines, and pairs of them

NAMES = ("Transformer Impedance", "System Voltage", "Fault Current", "Load Loss")
_LINE = """with li as (select l_orderkey as ok, l_linenumber as ln, min(l_extendedprice) as x, max(l_quantity) as q, min(l_partkey) as pk, min(l_returnflag) as f, min(l_linestatus) as s from lineitem group by 1, 2),
r as (select ok * 16 + ln as rid, cast(ln as bigint) as ord, 'o' || (ok % 50) as pair_id, ok, 'd' || ln as doc, 1 + ln % 3 as page, q as x0, q + 1 as y0, ['Transformer Impedance', 'System Voltage', 'Fault Current', 'Load Loss'][1 + pk % 4] as name,
  cast(cast(floor(x) as bigint) as varchar) || ' A' as raw, case when f <> 'N' then x end as m, 'T' || (pk % 3) as tag, case when s = 'O' then 'regex' else 'llm' end as prov from li),
pr as (select a.pair_id, a.name, a.rid as a_id, b.rid as b_id, a.ord as a_ord, a.doc as a_doc, b.doc as b_doc, a.page as a_page, b.page as b_page, a.x0, a.y0, a.raw as a_raw, b.raw as b_raw, a.m as am, b.m as bm, a.tag as a_tag, b.tag as b_tag, a.prov as a_prov, b.prov as b_prov,
  a.raw = b.raw as same, [0.4, 0.75, 0.9, 1.0][1 + a.ord % 4] as pc from r a join r b on a.ok = b.ok and a.ord < b.ord) """
_FLAG = _LINE + """, bands(fam, t, mj, cr) as (values ('impedance_pct', 7.5, 20.0, 50.0), ('voltage_kv', 0.5, 5.0, 50.0), ('fault_current_a', 5.0, 20.0, 50.0), (null, 1.0, 10.0, 50.0)),
fl0 as (select *, am is not null and bm is not null as both_m, case name when 'Transformer Impedance' then 'impedance_pct' when 'System Voltage' then 'voltage_kv' when 'Fault Current' then 'fault_current_a' end as fam from pr where not same and not coalesce(am = bm, false)),
fl1 as (select *, case when both_m then case when greatest(abs(am), abs(bm)) = 0 then 0.0 else abs(am - bm) / greatest(abs(am), abs(bm)) * 100 end else 0.0 end as dev from fl0),
fl2 as (select fl1.*, case when not both_m then 'major' when dev >= cr then 'critical' when dev >= mj then 'major' when dev >= t then 'minor' else 'info' end as severity from fl1 left join bands on bands.fam is not distinct from fl1.fam),
fl as (select *, name || '|' || a_doc || '|p' || a_page || '|y' || cast(trunc(y0) as bigint) || '|' || a_raw || '|vs|' || b_doc || '|p' || b_page || '|' || b_raw as flag_id, pc as confidence,
  case when a_prov = 'regex' and b_prov = 'regex' then 'regex' when a_prov = 'llm' and b_prov = 'llm' then 'llm' else 'mixed' end as prov from fl2 where severity <> 'info'),
best as (select * from (select *, row_number() over (partition by pair_id, b_id, name order by confidence desc, abs(a_page - b_page), a_page, a_ord) as n from fl) where n = 1) """


def _line_records(spark: SparkSession, d: str, side: str = "a") -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln")).agg(
        F.min("l_extendedprice").alias("x"), F.max("l_quantity").alias("q"), F.min("l_partkey").alias("pk"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    )
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("pk") % 4)
    box = F.struct(F.col("q").alias("x0"), (F.col("q") + 1).alias("y0"), (F.col("q") + 10).alias("x1"), (F.col("q") + 20).alias("y1"))
    raw = F.concat(F.floor("x").cast("bigint").cast("string"), F.lit(" A"))
    return li.select(
        (F.col("ok") * 16 + F.col("ln")).alias("record_id"), F.col("ln").cast("bigint").alias("ord"), F.concat(F.lit("o"), (F.col("ok") % 50).cast("string")).alias("pair_id"), F.lit(side).alias("side"), F.concat(F.lit("d"), "ln").alias("doc_id"),
        (1 + F.col("ln") % 3).alias("page"), box.alias("bbox"), F.lit(None).cast("string").alias("section"), F.concat(name, F.lit(": "), raw).alias("span_text"), name.alias("name"), raw.alias("raw_value"), F.when(F.col("f") != "N", F.col("x")).alias("normalized_magnitude"),
        F.lit("ampere").alias("normalized_unit"), F.lit("").alias("source_path"), F.concat(F.lit("T"), (F.col("pk") % 3).cast("string")).alias("entity_tag"), F.when(F.col("s") == "O", "regex").otherwise("llm").alias("provenance"), F.lit("regex").alias("extraction_lane"), "ok",
    )


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _line_records(spark, d)
    side = lambda s: rows.select(F.col("ok"), F.col("ord").alias(f"{s}_ord"), F.struct(*[c for c in rows.columns if c != "ok"]).alias(s))
    met = side("a").join(side("b"), "ok").where("a_ord < b_ord")
    sure = F.get(F.array(*map(F.lit, (0.4, 0.75, 0.9, 1.0))), (F.col("a_ord") % 4).cast("int"))
    return met.select("a.pair_id", "a", "b", F.lit(1.0).alias("name_match_confidence"), (F.col("a.raw_value") == F.col("b.raw_value")).alias("value_equivalent"), sure.alias("pairing_confidence"))


def _line_flags(spark: SparkSession, d: str) -> DataFrame:
    return detect.with_flag_id(detect.detect_flags(_line_pairs(spark, d), detect.band_table(spark)))


@query(_FLAG + "select pair_id, a_id, b_id, flag_id, name as parameter, a_doc as authoritative_doc_id, b_doc as deviating_doc_id, confidence, severity, dev as deviation_pct, fam as attribute_family, prov as provenance, name || ': ' || a_raw || ' against ' || b_raw as rationale from fl")
def pair_flags(spark, d):
    return _line_flags(spark, d).select("pair_id", F.col("a_record.record_id").alias("a_id"), F.col("b_record.record_id").alias("b_id"), "flag_id", "parameter", "authoritative_doc_id", "deviating_doc_id", "confidence", "severity", "deviation_pct", "attribute_family", "provenance", "rationale")


@query(_FLAG + "select pair_id, b_id, name as parameter, a_id, confidence from best")
def best_flags(spark, d):
    return detect.one_flag_per_record(_line_flags(spark, d)).select("pair_id", F.col("b_record.record_id").alias("b_id"), "parameter", F.col("a_record.record_id").alias("a_id"), "confidence")


def _four_digits(c: str) -> str:
    """A price in four significant digits, halves upwards, in SQL."""
    whole = f"cast(round({c} * 100) as bigint)"
    size = f"length(cast({whole} as varchar))"
    kept = f"(({whole} + 5 * cast(pow(10, {size} - 5) as bigint)) // cast(pow(10, {size} - 4) as bigint))"
    digits, power = f"cast(case when {kept} >= 10000 then {kept} // 10 else {kept} end as varchar)", f"({size} - 3 + case when {kept} >= 10000 then 1 else 0 end)"
    return f"coalesce(substr({digits}, 1, 1) || '.' || substr({digits}, 2, 3) || 'e+' || lpad(cast({power} as varchar), 2, '0'), '')"


@query(_FLAG + f"select pair_id, name as parameter, b_page as page, {_four_digits('am')} as a, {_four_digits('bm')} as b, count(*) as flags from fl group by all having count(*) > 1")
def near_miss_flags(spark, d):
    return detect.near_misses(_line_flags(spark, d))


@query(_FLAG + "select case when confidence >= 0.75 then 'sure' else 'weak' end as part, severity, count(*) as flags from fl where prov in ('regex', 'mixed') group by all")
def flags_by_confidence(spark, d):
    sure, weak = detect.split_by_confidence(_line_flags(spark, d), 0.75, ["regex", "mixed"])
    return detect.severity_counts(sure.withColumn("part", F.lit("sure")).unionByName(weak.withColumn("part", F.lit("weak"))), ["part"])


@query(_FLAG + "select a_id, b_id, upper(severity) as severity_chip, '[' || prov || ']' as provenance_badge, pc < 0.75 as weak_pair, '' as standards_badge, x0 = 0 and y0 = 0 as whole_page, a_tag as entity_chip from fl")
def flag_view(spark, d):
    view = detect.display_view(detect.sort_flags(_line_flags(spark, d)))
    return view.select(F.col("a_record.record_id").alias("a_id"), F.col("b_record.record_id").alias("b_id"), "severity_chip", "provenance_badge", "weak_pair", "standards_badge", "whole_page", "entity_chip")


@query(_LINE + "select rid as record_id from r where rid not in (select a_id from pr where not same) union all select rid + 1000000000000 from r where rid not in (select b_id from pr where not same)")
def unpaired_records(spark, d):
    rows, pairs = _line_records(spark, d), _line_pairs(spark, d).where("not value_equivalent")
    return align.unpaired(rows, pairs, "a").select("record_id").unionByName(align.unpaired(rows, pairs, "b").select((F.col("record_id") + 1_000_000_000_000).alias("record_id")))


@query(_LINE + "select a_id, b_id from (select *, case when a_tag = 'T0' then 'implicit_' || a_doc else a_tag end as ea, case when b_tag = 'T0' then 'implicit_' || b_doc else b_tag end as eb from pr) where (starts_with(ea, 'implicit_') and starts_with(eb, 'implicit_')) or (not starts_with(ea, 'implicit_') and ea = eb)")
def same_entity(spark, d):
    entity = lambda s: F.when(F.col(f"{s}.entity_tag") == "T0", F.concat(F.lit("implicit_"), F.col(f"{s}.doc_id"))).otherwise(F.col(f"{s}.entity_tag"))
    return align.same_entity_pairs(_line_pairs(spark, d), entity("a"), entity("b")).select(F.col("a.record_id").alias("a_id"), F.col("b.record_id").alias("b_id"))


def length_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A fixed rule in place of a model: by the last digit of the first value a score, a refusal, or a rationale that names nothing."""
    last = batch["a_raw"].str[-3].astype(int)
    text = pd.Series(["because of " + a if k != 3 else "because" for a, k in zip(batch["a_raw"], last, strict=True)], dtype=object)
    return pd.DataFrame({"pair_key": batch["pair_key"].to_numpy(object), "score": (last / 8).to_numpy(float), "rationale": text.to_numpy(object), "decline": (last == 1).to_numpy(bool)})


@query(_LINE + """, k as (select *, cast(a_raw[-3:-3] as int) as last, coalesce(am is not null and bm is not null and least(am, bm) <> 0 and greatest(am, bm) / least(am, bm) > 3, false) as shift from pr),
v as (select *, pc <= 0.75 and last / 8 <= 1 and (last <> 3 or contains('because', a_raw)) as said from k)
select a_id, b_id, case when said and last <> 1 then last / 8 else pc end as pairing_confidence, said as reranked,
  case when said and last = 1 then 'kept in spite of the verdict, values differ by a decimal shift: because of ' || a_raw when said then 'because of ' || a_raw end as rerank_rationale from v where not (said and last = 1) or shift""")
def reranked_pairs(spark, d):
    pairs = judge.rerank_weak(_line_pairs(spark, d), length_scorer)
    return pairs.select(F.col("a.record_id").alias("a_id"), F.col("b.record_id").alias("b_id"), "pairing_confidence", "reranked", "rerank_rationale")


def family_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """A fixed rule in place of a model: flags of critical severity become major and cite; minor ones get no valid answer."""
    out = []
    for r in batch.itertuples():
        cites = [*(r.clause_ids if r.clause_ids is not None else []), "unknown"]
        answer = {"severity": "major", "within_typical_tolerance": False, "engineering_explanation": "judged", "downstream_effects": [], "confidence": 0.5, "cited_clause_ids": cites}
        out.append((r.key, "```json\n" + json.dumps(answer) + "\n```" if r.severity == "critical" else "no answer" if r.severity == "minor" else '{"confidence": 7, "severity": "info"}'))
    return pd.DataFrame(out, columns=["key", "answer"])


@query(_FLAG + """, one as (select * from best where flag_id in (select flag_id from best group by 1 having count(*) = 1))
select flag_id, case when severity = 'critical' then 'major' else severity end as severity, case when severity = 'critical' then confidence * 0.5 else confidence end as confidence,
  name || ': ' || a_raw || ' against ' || b_raw || case when severity = 'critical' then ' judged' else '' end as rationale,
  case when severity <> 'critical' then '' when fam = 'impedance_pct' then 'c1,c2' when fam = 'voltage_kv' then 'c2' else '' end as cited from one""")
def judged_flags(spark, d):
    flags = detect.one_flag_per_record(_line_flags(spark, d))
    single = flags.groupBy("flag_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("flag_id")
    clauses = spark.createDataFrame([("c1", 2015, "s", ["impedance_pct"], [], None, "t"), ("c2", 2016, "s", ["impedance_pct", "voltage_kv"], [], None, "t")], "clause_id string, edition_year int, source_name string, applicable_families array<string>, applicable_doc_classes array<string>, tolerance_band double, summary string")
    judged = judge.judge_flags(flags.join(single, "flag_id"), clauses, family_judge)
    return judged.select("flag_id", "severity", "confidence", "rationale", F.array_join(F.transform("cited_clauses", lambda c: c["clause_id"]), ",").alias("cited"))


_GOLD = """, gold as (select 'o' || (s_suppkey % 50) as pair_id, 'g' || s_suppkey as gold_id, case when s_nationkey % 2 = 0 then 'surfaced' else 'suppressed' end as expected, ['VOLTAGE', 'fault', ''][1 + s_suppkey % 3] as p, cast(s_suppkey % 1000 as varchar) as a, '' as b from supplier),
hit as (select distinct gold_id from gold join fl using (pair_id) where fl.confidence >= 0.6 and contains(lower(name), lower(p)) and contains(a_raw, a)),
sc as (select pair_id, gold_id, expected, case when expected = 'surfaced' and hit.gold_id is not null then 'tp' when expected = 'surfaced' then 'fn' when hit.gold_id is not null then 'fp' else 'tn' end as outcome from gold left join hit using (gold_id)) """


def _gold(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("o"), (F.col("s_suppkey") % 50).cast("string")).alias("pair_id"), F.concat(F.lit("g"), "s_suppkey").alias("gold_id"), F.when(F.col("s_nationkey") % 2 == 0, "surfaced").otherwise("suppressed").alias("expected"),
                    F.get(F.array(*map(F.lit, ("VOLTAGE", "fault", ""))), (F.col("s_suppkey") % 3).cast("int")).alias("parameter_substr"), (F.col("s_suppkey") % 1000).cast("string").alias("a_value_substr"), F.lit("").alias("b_value_substr"))


@query(_FLAG + _GOLD + "select * from sc")
def gold_outcomes(spark, d):
    return evaluate.score_gold(_line_flags(spark, d), _gold(spark, d))


@query(_FLAG + _GOLD + "select coalesce(count(*) filter (outcome = 'tp') / nullif(count(*) filter (expected = 'surfaced'), 0), 0) as recall, coalesce(count(*) filter (outcome = 'fp') / nullif(count(*) filter (expected <> 'surfaced'), 0), 0) as trap_rate from sc")
def gold_recall(spark, d):
    return evaluate.recall_and_traps(evaluate.score_gold(_line_flags(spark, d), _gold(spark, d)))


@query(_FLAG + ", g as (select 'o' || (s_suppkey % 50) as pair_id, 1 + cast(s_suppkey % 3 as int) as page, 'g' || s_suppkey as gold_id, s_suppkey % 1000 || 'A' as ga, 'x' as gb from supplier) select a_id, b_id, gold_id from fl join g on g.pair_id = fl.pair_id and g.page = fl.a_page where contains(lower(replace(name || ': ' || a_raw, ' ', '')), lower(ga)) or contains(lower(replace(a_raw, ' ', '')), lower(ga)) or contains(lower(replace(fl.b_raw, ' ', '')), gb) or contains(lower(replace((select any_value(r.name) from r where r.rid = b_id) || ':' || fl.b_raw, ' ', '')), gb)")
def span_gold(spark, d):
    s = table(spark, d, "supplier")
    gold = s.select(F.concat(F.lit("o"), (F.col("s_suppkey") % 50).cast("string")).alias("pair_id"), (1 + F.col("s_suppkey") % 3).cast("int").alias("page"), F.concat(F.lit("g"), "s_suppkey").alias("gold_id"), F.concat((F.col("s_suppkey") % 1000).cast("string"), F.lit(" a")).alias("gold_a"), F.lit("X").alias("gold_b"))
    flags = _line_flags(spark, d)
    ids = flags.select("flag_id", "pair_id", F.col("a_record.record_id").alias("a_id"), F.col("b_record.record_id").alias("b_id"))
    keyed = flags.withColumn("flag_id", F.concat_ws("/", F.col("a_record.record_id").cast("string"), F.col("b_record.record_id").cast("string")))
    return evaluate.matches_span_gold(keyed, gold).select(F.split("flag_id", "/")[0].cast("bigint").alias("a_id"), F.split("flag_id", "/")[1].cast("bigint").alias("b_id"), "gold_id")


@query(_LINE + "select name, count(*) as records, list_transform(list_sort(list({'page': page, 'v': raw})), lambda s: s.v) as \"values\" from r where rid not in (select a_id from pr) group by 1")
def unpaired_names(spark, d):
    return evaluate.unpaired_tally(align.unpaired(_line_records(spark, d), _line_pairs(spark, d), "a"))


@query("with e as (select distinct extraction_id, lane, confidence from extracted_claim) select coalesce(count(*) filter (confidence >= 0.5 and lane = 'manual') / nullif(count(*) filter (lane = 'manual'), 0), 1.0) as precision from e")
def lane_precision(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "lane", "confidence").distinct()
    return evaluate.class_precision(e.withColumn("truth", F.when(F.col("confidence") >= 0.5, F.col("lane"))), "truth", "lane", "manual")


@query("select 'impedance_pct' as family, 1.0 as tolerance, 2.0 as major, 3.0 as critical union all select * from (values ('rated_power_kva', 5.0, 10.0, 50.0), ('voltage_kv', 0.5, 5.0, 50.0), ('fault_current_a', 5.0, 20.0, 50.0), ('own', 1.0, 2.0, 3.0))")
def bands_with_overrides(spark, d):
    own = spark.createDataFrame([("impedance_pct", 1.0, 2.0, 3.0), ("own", 1.0, 2.0, 3.0)], "family string, tolerance double, major double, critical double")
    return detect.band_table(spark, own)


# ---- lanes of model output, answered by fixed rules

_PAGES = "with pg as (select distinct cast(extraction_id as varchar) as doc_id, page, span_text as text, length(span_text) as n, string_split(span_text, ' ') as w from extracted_claim where trim(span_text) <> '') "


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_claim").select(F.col("extraction_id").cast("string").alias("doc_id"), "page", F.col("span_text").alias("text")).distinct()


def _answers(rule):
    """A scorer that answers each text by ``rule``; None stands for no JSON."""
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        answers = [rule(t) for t in batch["text"]]
        return pd.DataFrame({"key": batch["key"].to_numpy(object), "answer": pd.Series(["none" if a is None else json.dumps(a) for a in answers], dtype=object)})

    return score


def _text_rule(t: str):
    w = t.split(" ")
    return None if len(t) % 5 == 0 else {"claims": [{"parameter_name": w[0], "raw_value": w[-1], "entity_tag": "", "span_text": t if len(t) % 3 else t + "x", "confidence": 1.5 if len(t) % 7 == 0 else 0.5, "reasoning": ""}]}


@query(_PAGES + "select doc_id, page, w[1] as parameter_name, w[-1] as raw_value, text as span_text, 0.5 as confidence from pg where n % 5 <> 0 and n % 7 <> 0 and n % 3 <> 0 and w[1] <> '' and w[-1] <> ''")
def text_lane_claims(spark, d):
    return judge.text_lane(_pages(spark, d), _answers(_text_rule)).select("doc_id", "page", "parameter_name", "raw_value", "span_text", "confidence")


def _vision_rule(t: str):
    w = t.split(" ")
    return {"claims": [{"entity_kind": "k", "entity_id": (w[0] if len(t) % 2 else "zzq" + w[0]), "parameter_name": "p", "raw_value": w[-1], "visual_evidence": "v"}]}


@query(_PAGES + "select doc_id, page, w[1] as entity_id, w[-1] as raw_value from pg where cast(doc_id as bigint) % 2 = 0 and n % 2 = 1 and w[-1] <> '' and trim(w[1]) <> ''")
def vision_lane_claims(spark, d):
    pages = _pages(spark, d).withColumn("structure", F.when(F.col("doc_id").cast("bigint") % 2 == 0, "diagram").otherwise("prose"))
    return judge.vision_lane(pages, _answers(_vision_rule)).select("doc_id", "page", "entity_id", "raw_value")


def _entity_rule(t: str):
    return None if len(t) % 5 == 0 else {"entities": [{"label": "Note" if len(t) % 4 == 0 else t.split(" ")[0], "kind": "k", "y_top": len(t) % 13, "y_bottom": len(t) % 17}, {"label": "second", "kind": "k", "y_top": 1, "y_bottom": 2}]}


@query(_PAGES + "select doc_id, page, w[1] as label, cast(n % 13 as double) as y_top, cast(n % 17 as double) as y_bottom, 0 as ord from pg where n % 5 <> 0 and n % 4 <> 0 and w[1] not in ('IEEE', 'IEC', 'NEMA', 'ANSI', 'UL', 'NFPA', 'Example', 'Figure', 'Note', 'Table', 'See') and n % 13 <= n % 17 union all select doc_id, page, 'second', 1.0, 2.0, 1 from pg where n % 5 <> 0")
def entity_lane_ranges(spark, d):
    return judge.entity_lane(_pages(spark, d), _answers(_entity_rule)).select("doc_id", "page", "label", "y_top", "y_bottom", "ord")


def _class_rule(t: str):
    return None if len(t) % 11 == 0 else {"doc_class": ["equipment_spec", "coordination_study", "other"][len(t) % 3], "confidence": (len(t) % 10) / 10, "reasoning": ""}


@query("""with p as (select doc_id, page, min(span_text) as text from extracted_claim group by all), s as (select * from (select *, max(page) over (partition by doc_id) as m from p) where page in (1, 2) or page = m),
t as (select doc_id, length(string_agg(text, chr(10) order by page)) as n from s group by 1)
select doc_id, case when n % 11 = 0 or n % 10 < 6 then 'unknown' else ['equipment_spec', 'coordination_study', 'other'][1 + n % 3] end as doc_class, case when n % 11 = 0 then 0.0 else (n % 10) / 10 end as confidence from t""")
def class_lane_answers(spark, d):
    pages = table(spark, d, "extracted_claim").groupBy("doc_id", "page").agg(F.min("span_text").alias("text"))
    return judge.class_lane(pages, _answers(_class_rule)).select("doc_id", "doc_class", "confidence")


@query(_PAGES + ", o as (select doc_id, page, unnest(generate_series(0, len(string_split(text, '; ')) - 1)) as i, unnest(string_split(text, '; ')) as line from pg where length(text) < 80) select doc_id, page, trim(line) as text, cast(page as bigint) * 1000000 + i as ord from o where trim(line) <> ''")
def ocr_lane_lines(spark, d):
    def read(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"].to_numpy(object), "answer": batch["text"].str.replace("; ", "\n", regex=False).to_numpy(object)})

    pages = _pages(spark, d).where(F.trim("text") != "").withColumn("source_path", F.lit(""))
    return judge.ocr_lane(pages, read).select("doc_id", "page", "text", "ord")


@query("with e as (select distinct extraction_id, doc_id, page, parameter_name, raw_value, coalesce(entity_tag, '') as entity_tag, span_text from extracted_claim) select doc_id, page, raw_value, entity_tag, span_text, 'llm' as provenance, 'llm_text' as extraction_lane from e")
def claim_records(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "doc_id", "page", "parameter_name", "raw_value", "entity_tag", "span_text").distinct()
    return judge.records_from_claims(e, "llm_text").select("doc_id", "page", "raw_value", "entity_tag", "span_text", "provenance", "extraction_lane")


@query("select p_partkey, 'Part ' || p_name || ' of ' || p_brand || ' costs {what}' as prompt from part")
def prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", judge.prompt_text("Part {name} of {brand} costs {what}", name=F.col("p_name"), brand=F.col("p_brand")).alias("prompt"))


# ---- scanning: markers, patterns, plausible numbers, lines of spans

@query("with e as (select distinct extraction_id, span_text from extracted_claim), m as (select extraction_id, regexp_extract(span_text, '^[ \\t\\n\\r\\f\\x0b|]*([①-⑳]|[㉑-㉟]|\\d{1,3}[.)]?|[A-Z]-?\\d{1,3})[ \\t\\n\\r\\f\\x0b]+', 1) as t from e) "
       "select extraction_id, case when t = '' then '' when unicode(t) between 9312 and 9331 then cast(unicode(t) - 9311 as varchar) when unicode(t) between 12881 and 12895 then cast(unicode(t) - 12860 as varchar) else upper(regexp_replace(t, '[.)]+$', '')) end as tag from m")
def circled_markers(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "span_text").distinct()
    return e.select("extraction_id", S.row_marker("span_text").alias("tag"))


#: One text for each shipped pattern, with the number of a part in it.
FORMS = ("Unit {} %Z of core", "Fault level {} A RMS Sym", "a {} KVA XFMR", "a {} MVA XFMR", "IFLA = {} A x", "{} kV bus", "uses LPN-RK-{}SP fuse", "uses LPS-RK-{}SP fuse", "uses KRP-C-{}SP fuse", "Breaker rating: {} A", "plain {}")
_FORMS = "list_value(" + ", ".join(f"'{f}'" for f in FORMS) + ")"


def _form(number: Column, pick: Column) -> Column:
    texts = F.array(*[F.concat(F.lit(f.split("{}")[0]), number, F.lit(f.split("{}")[1])) for f in FORMS])
    return F.get(texts, pick)


@query(f"""with t as (select p_partkey as k, cast(p_partkey % 11 as int) as f, cast(p_size * 7 as varchar) as n from part)
select k, case f when 0 then '%Z' when 1 then 'Fault Current' when 2 then 'Transformer Rating' when 3 then 'Transformer Rating' when 4 then 'IFLA' when 5 then 'System Voltage' when 9 then 'Breaker rating' else 'Fuse Designation' end as name,
  case f when 0 then n || ' %' when 1 then n || ' A' when 2 then n || ' kVA' when 3 then n || ' MVA' when 4 then n || ' A' when 5 then n || ' kV' when 6 then 'LPN-RK-' || n || 'SP' when 7 then 'LPS-RK-' || n || 'SP' when 8 then 'KRP-C-' || n || 'SP' else n || ' A' end as raw_value from t where f <> 10""")
def shipped_patterns(spark, d):
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), _form((F.col("p_size") * 7).cast("string"), (F.col("p_partkey") % 11).cast("int")).alias("text"))
    return texts.select("k", F.explode(extract.pattern_matches(F.col("text"), fixed.PATTERNS)).alias("m")).select("k", "m.name", "m.raw_value")


@query("""with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice / 10) as bigint) as n, cast(l_orderkey % 6 as int) as f from lineitem), v as (select *, case f when 0 then n || ' %Z' when 1 then n || ' MVA' when 2 then n || ' KVA' when 3 then n || ' kV' when 4 then 'Fault at ' || n || ' A RMS' else 'IFLA = ' || n || ' A' end as token from t)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, token, ['impedance_pct', 'rated_power_kva', 'rated_power_kva', 'voltage_kv', 'fault_current_a', 'ifla_a'][1 + f] as family, cast(case f when 1 then n * 1000.0 else n end as double) as value from v
where case f when 0 then n not between 1.5 and 25 when 1 then n * 1000 not between 1 and 1000000 when 2 then n not between 1 and 1000000 when 3 then n not between 0.1 and 1500 when 4 then n not between 50 and 200000 else n not between 0.1 and 100000 end""")
def implausible_families(spark, d):
    n, f = F.floor(F.col("l_extendedprice") / 10).cast("bigint").cast("string"), (F.col("l_orderkey") % 6).cast("int")
    forms = F.array(F.concat(n, F.lit(" %Z")), F.concat(n, F.lit(" MVA")), F.concat(n, F.lit(" KVA")), F.concat(n, F.lit(" kV")), F.concat(F.lit("Fault at "), n, F.lit(" A RMS")), F.concat(F.lit("IFLA = "), n, F.lit(" A")))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return scan.implausible_tokens(table(spark, d, "lineitem").select(*keys, F.get(forms, f).alias("t")), keys, "t")


@query("with t as (select p_partkey, p_size * 3 || ' %Z' as a, p_size % 7 || ' %Z' as b from part) select p_partkey, case when p_size * 3 not between 1.5 and 25 and p_size % 7 between 1.5 and 25 then b else a end as text from t join part using (p_partkey)")
def better_readings(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat((F.col("p_size") * 3).cast("string"), F.lit(" %Z")).alias("a"), F.concat((F.col("p_size") % 7).cast("string"), F.lit(" %Z")).alias("b"))
    return scan.better_reading(p, "a", "b", ["p_partkey"])


def _line_spans(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("x"))
    box = F.struct(F.col("x").alias("x0"), F.col("q").alias("y0"), (F.col("x") + 5).alias("x1"), (F.col("q") + 2).alias("y1"))
    li = li.withColumn("page", F.floor(F.col("l_orderkey") / 16).cast("int"))
    return li.select(F.concat(F.lit("d"), (F.col("page") % 100).cast("string")).alias("doc_id"), "page", box.alias("bbox"), F.concat(F.lit("t"), "l_linenumber").alias("text"), F.lit("").alias("source_path"), F.col("l_linenumber").cast("bigint").alias("ord"))


_SPANS = "with sp as (select 'd' || (l_orderkey // 16 % 100) as doc_id, cast(l_orderkey // 16 as int) as page, max(l_quantity) as q, max(l_extendedprice) as x, 't' || l_linenumber as text, l_linenumber as ord from lineitem group by l_orderkey, l_linenumber) "


@query("with recursive" + _SPANS[4:] + """, s as (select doc_id, page, list({'y': q + 1, 'x': x, 'o': ord, 't': text} order by q, x, ord) as l from sp group by all),
w as (select doc_id, page, l, 1 as i, cast(null as double) as anchor, -1 as line, cast([] as int[]) as g from s
  union all select doc_id, page, l, i + 1, case when anchor is null or abs(l[i].y - anchor) > 2 then l[i].y else anchor end, case when anchor is null or abs(l[i].y - anchor) > 2 then line + 1 else line end, list_append(g, case when anchor is null or abs(l[i].y - anchor) > 2 then line + 1 else line end) from w where i <= len(l)),
e as (select doc_id, page, unnest(l) as v, unnest(g) as line from w where i > len(l))
select doc_id, page, line as ord, string_agg(v.t, ' ' order by v.x, v.o) as text, min(v.x) as x0, max(v.x) + 5 as x1, min(v.y) - 1 as y0, max(v.y) + 1 as y1 from e group by doc_id, page, line""")
def assembled_lines(spark, d):
    return scan.assemble_lines(_line_spans(spark, d)).select("doc_id", "page", "ord", "text", "bbox.x0", "bbox.x1", "bbox.y0", "bbox.y1")


@query(_SPANS + "select doc_id, page, string_agg(text, chr(10) order by q, x, ord) as text, min(x) as x0, min(q) as y0, max(x) + 5 as x1, max(q) + 2 as y1 from sp group by all")
def joined_pages(spark, d):
    return scan.join_spans(_line_spans(spark, d)).select("doc_id", "page", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query("select doc_id, page, count(*) as n from claim where page <= 3 group by all")
def first_pages(spark, d):
    return scan.page_spec(table(spark, d, "claim"), 3).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


# ---- names, tags and identities

def _tag_sql(text: str) -> str:
    kinds = []
    for k, (pattern, kind, prefix, label) in enumerate(fixed.TAG_PATTERNS):
        groups = label.count("{")
        part = [f"regexp_extract({text}, '{pattern}', {g + 1})" for g in range(groups)]
        shown = " || ".join([f"'{label.split('{')[0]}'"] + [f"{p} || '{label.split('{' + str(g) + '}')[1].split('{')[0]}'" for g, p in enumerate(part)])
        name = "lower(" + " || '_' || ".join([f"'{prefix}'"] * bool(prefix) + part) + ")"
        kinds.append(f"case when regexp_matches({text}, '{pattern}') then {{'at': strpos({text}, regexp_extract({text}, '{pattern}', 0)), 'k': {k}, 'id': {name}, 'type': '{kind}', 'label': {shown}}} end")
    return "list_sort(list_filter([" + ", ".join(kinds) + "], lambda x: x is not null))[1]"


@query(f"with e as (select id, label as shown, {_tag_sql('label')} as b, regexp_replace(regexp_replace(id, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as doc from entity) select id, coalesce(b.id, 'implicit_' || lower(doc)) as entity_id, coalesce(b.type, 'implicit') as type, coalesce(b.label, '(unnamed equipment in ' || id || ')') as label from e")
def entities_of_labels(spark, d):
    e = table(spark, d, "entity").select("id", "label")
    return e.select("id", S.infer_entity("label", "id").alias("x")).select("id", F.col("x.id").alias("entity_id"), F.col("x.type").alias("type"), F.col("x.label").alias("label"))


@query("""with e as (select distinct extraction_id, lower(trim(regexp_replace(entity_tag, '\\s+', ' ', 'g'), ' ' || chr(160))) as e, lower(trim(regexp_replace(span_text, '\\s+', ' ', 'g'), ' ' || chr(160))) as p from extracted_claim), t as (select *, regexp_extract_all(e, '[0-9A-Za-z_][0-9A-Za-z_./\\\\-]*') as w from e)
select extraction_id, coalesce(e <> '' and (contains(p, e) or (len(w) > 0 and len(list_filter(w, lambda x: not contains(p, x))) = 0)), false) as grounded from t""")
def grounded_guard(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "entity_tag", "span_text").distinct()
    return e.select("extraction_id", S.grounded(F.col("entity_tag"), F.col("span_text")).alias("grounded"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ANCHOR = "case when not regexp_matches(coalesce(s, ''), " + _quoted(S.VALUE_IN_NAME) + ") then trim(coalesce(" + ", ".join(f"nullif(regexp_extract(s, {_quoted(p)}, 0), '')" for p in fixed.ANCHORS) + ")) end"
_KIND = "case " + " ".join("when " + " or ".join(f"contains(j, {_quoted(w)})" for w in words) + f" then '{k}'" for k, words in fixed.KIND_WORDS) + " else 'other' end"


@query(f"""with c as (select distinct id, trim(span_text) as s, raw_value, attribute, normalized_magnitude as m, page, bbox_x0, bbox_y0, bbox_x1, bbox_y1 from claim), a as (select *, {_ANCHOR} as anchor, array_to_string(list_filter([lower(attribute), lower(s)], lambda t: t is not null and t <> ''), ' ') as j from c)
select id, anchor, coalesce(regexp_matches(anchor, {_quoted(S.PART_NUMBER)}), false) as part, {_KIND} as kind,
  case when bbox_x0 is null or bbox_y0 is null or bbox_x1 is null or bbox_y1 is null then 'p' || page || '_loc_centroid' else 'p' || page || '_loc_' || cast(round_even((bbox_x0 + bbox_x1) / 2, 0) as bigint) || '_' || cast(round_even((bbox_y0 + bbox_y1) / 2, 0) as bigint) end as place from a""")
def identity_of_claims(spark, d):
    c = table(spark, d, "claim").dropDuplicates(["id"])
    rows = c.withColumn("anchor", S.identity_anchor("span_text"))
    box = [F.col(f"bbox_{k}") for k in ("x0", "y0", "x1", "y1")]
    return rows.select("id", "anchor", S.is_part_number(F.col("anchor")).alias("part"), S.equipment_kind(F.col("attribute"), F.trim("span_text")).alias("kind"), S.centroid_label(*box, F.col("page")).alias("place"))


@query("with c as (select distinct id, raw_value from claim) select id, replace(regexp_extract(coalesce(raw_value, ''), '(\\d[\\d,]*\\.?\\d*)', 1), ',', '') as k from c where regexp_matches(raw_value, '\\d')")
def coincidence_keys(spark, d):
    c = table(spark, d, "claim").dropDuplicates(["id"]).where(F.col("raw_value").rlike(r"\d"))
    return c.select("id", S.coincidence_key("raw_value", "normalized_magnitude").alias("k"))


@query("select n_nationkey, 'nation:' || sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') as key from nation")
def cache_keys(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.cache_key("nation", "n_regionkey", "n_name").alias("key"))


@query("select a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 9) as similarity, (a.vec_id + b.label) / 2 as middle from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def next_vectors(spark, d):
    e = table(spark, d, "embeddings")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"), F.col("label").alias("l")), "vec_id")
    return both.select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("v")), 9).alias("similarity"), S.middle(F.col("vec_id"), F.col("l")).alias("middle"))


@query("with c as (select distinct id, span_text as s, trim(raw_value) as r from claim where coalesce(trim(raw_value), '') <> '' and span_text is not null and contains(lower(span_text), lower(trim(raw_value)))) select id, case when strpos(s, r) > 0 then strpos(s, r) else strpos(lower(s), lower(r)) end as place from c")
def value_places(spark, d):
    c = table(spark, d, "claim").dropDuplicates(["id"]).withColumn("r", F.trim("raw_value")).where("r <> '' and contains(lower(span_text), lower(r))")
    return c.select("id", S.value_excerpt(F.col("span_text"), F.col("r"))[0].alias("place"))


# ---- inventories

def _inventories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two inventories of parts with parameters, and their matches, all by arithmetic over the part table."""
    p = table(spark, d, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 7).cast("string")).alias("pair_id"), "p_partkey", "p_size", "p_brand", "p_type")
    side = lambda s, size: p.select("pair_id", F.concat(F.lit(f"{s}"), "p_partkey").alias("canonical_id"), F.map_from_entries(F.filter(F.array(F.struct(F.lit("size").alias("k"), size.cast("string").alias("v")), F.when(F.col("p_partkey") % 3 != (0 if s == "a" else 1), F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")))), lambda x: x.isNotNull())).alias("parameters"))
    status = F.get(F.array(*map(F.lit, ("matched", "ambiguous", "conflict", "unmatched_a", "unmatched_b", "matched"))), (F.col("p_partkey") % 6).cast("int"))
    m = p.select("pair_id", F.when(F.col("p_partkey") % 6 != 4, F.concat(F.lit("a"), "p_partkey")).alias("a_id"), F.when(F.col("p_partkey") % 6 != 3, F.concat(F.lit("b"), "p_partkey")).alias("b_id"), status.alias("status"))
    return side("a", F.col("p_size")), side("b", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), m


@query("""with p as (select 'b' || (p_partkey % 7) as pair_id, p_partkey as k, p_size as s, p_brand as brand from part), m as (select * from p where k % 6 in (0, 5))
select pair_id, 'a' || k as a_id, 'b' || k as b_id, 'size' as parameter, cast(s as varchar) as a_value, cast(s + 1 as varchar) as b_value, 'value_change' as change from m where k % 5 = 0
union all select pair_id, 'a' || k, 'b' || k, 'brand', case when k % 3 <> 0 then brand end, case when k % 3 <> 1 then brand end, case when k % 3 = 0 then 'parameter_added' else 'parameter_removed' end from m where k % 3 <> 2
union all select pair_id, case when k % 6 <> 4 then 'a' || k end, case when k % 6 <> 3 then 'b' || k end, null, null, null, ['', 'ambiguous_match', 'equipment_conflict', 'equipment_removed', 'equipment_added'][1 + k % 6] from p where k % 6 between 1 and 4""")
def inventory_changes(spark, d):
    return equipment.equipment_mutations(*_inventories(spark, d))


@query("with p as (select p_partkey as k, case when p_partkey % 3 = 0 then 'breaker:20 A' else 'fuse:x' || p_partkey end as canonical_id, case when p_partkey % 5 = 0 then p_brand else 'z' end as anchor, case when p_partkey % 7 = 0 then 1.5 else 0.9 end as c from part) select k, case when k % 3 = 0 then 'value_in_id' when k % 5 = 0 then 'anchor_is_value' when k % 7 = 0 then 'confidence' end as reason from p where k % 3 = 0 or k % 5 = 0 or k % 7 = 0")
def invalid_inventory(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, "breaker:20 A").otherwise(F.concat(F.lit("fuse:x"), "p_partkey")).alias("canonical_id"), F.array(F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise("z")).alias("identity_anchors"),
                    F.create_map(F.lit("brand"), "p_brand").alias("parameters"), F.when(F.col("p_partkey") % 7 == 0, 1.5).otherwise(0.9).alias("confidence"))
    return equipment.invalid_equipment(rows).select("k", "reason")


# ---- stores, written to the shared folder and read back

def _place(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/parallax-{name}-{uuid.uuid4().hex}"


@query("select 2 * count(*) as n, 1 as lo, 2 * count(*) as hi, 2 * count(*) as ids from customer")
def numbered_appends(spark, d):
    """The customers appended twice to a log, numbered on; how many, and that numbers are consecutive."""
    log = store.Table(spark, _place(spark, "log"), "c_custkey bigint, n bigint")
    rows = table(spark, d, "customer").select("c_custkey")
    for _ in range(2):
        log.append(rows, "n")
    return log.read().agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("ids"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'new' else s_name end as s_name, s_acctbal, cast(null as varchar) as note from supplier")
def merged_table(spark, d):
    """A stored table, merged by key and read with a wider schema."""
    path, s = _place(spark, "table"), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    first = store.Table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")
    first.overwrite(s)
    first.merge(s.where("s_suppkey % 2 = 0").withColumn("s_name", F.lit("new")), ["s_suppkey"], ["s_name"])
    first.vacuum()
    return store.Table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double, note string").read()


@query("select cast(s_suppkey as varchar) as key, upper(s_name) as value from supplier where s_suppkey % 3 <> 0")
def cached_answers(spark, d):
    """Answers computed in two goes; failures are stored as '' and not asked again, then left out."""
    cache = store.Cache(spark, _place(spark, "cache"), failed="")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), "s_name", "s_suppkey")
    answer = lambda rows: rows.select("key", F.when(F.col("s_suppkey") % 3 != 0, F.upper("s_name")).alias("value"))
    cache.get_or_compute("names", s.where("s_suppkey % 2 = 0"), answer)
    return cache.get_or_compute("names", s, answer).where("value <> ''")


@query("select p_partkey, p_name, p_size from part")
def exported_json(spark, d):
    path = _place(spark, "export")
    store.export_json(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_size int").json(path)


@query("select distinct id, verdict, created_at from decision where lower(trim(fixture_pair_id)) = (select min(lower(trim(fixture_pair_id))) from decision where lower(trim(fixture_pair_id)) <> '')")
def decisions_for_pair(spark, d):
    rows = table(spark, d, "decision").withColumn("pair", clean("fixture_pair_id"))
    first = rows.where("pair <> ''").agg(F.min("pair").alias("p")).first()["p"]
    return store.history(rows.distinct(), pair=first).select("id", "verdict", "created_at")
