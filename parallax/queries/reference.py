"""Queries of the review's operators over whole driver tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions import scalars as S
from parallax.functions.text import clean, strip
from parallax.functions.units import NUMBER, folded_table, unit_table
from parallax.operators import align, dedup, detect, equipment, evaluate, extract, judge, scan
from parallax.plans.review import ReviewConfig, compare_totals, review
from parallax.session import checkpoint, table
from parallax.sources import store
from parallax.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- orders against their lines: the review of two keyed tables

_TOTALS = """with b as (select l_orderkey as k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as b_value from lineitem group by 1),
pairs as (select o_orderkey as k, o_orderpriority, o_custkey, o_totalprice as a_value, b_value,
  case when b_value = 0 then o_totalprice = 0 else abs(o_totalprice - b_value) / abs(b_value) <= 0.001 end as same,
  case when greatest(abs(o_totalprice), abs(b_value)) = 0 then 0.0 else abs(o_totalprice - b_value) / greatest(abs(o_totalprice), abs(b_value)) * 100 end as dev from orders join b on k = o_orderkey),
flags as (select *, case when dev >= 50 then 'critical' when dev >= 10 then 'major' when dev >= 1 then 'minor' else 'info' end as severity from pairs) """


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderpriority", "o_custkey")
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return a, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(line), 2).alias("v"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    rows = compare_totals(a, b, "k", "v").join(a.select("k", "o_orderpriority", "o_custkey"), "k").withColumn("family", F.lit(None).cast("string"))
    return detect.with_severity(rows, "family", "deviation_pct", detect.band_table(spark))


@query(_TOTALS + "select k, a_value, b_value, dev as deviation_pct, severity, 0.9 as confidence from flags where not same and severity <> 'info'")
def review_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).where("not value_equivalent and severity <> 'info'")
    return rows.select("k", "a_value", "b_value", "deviation_pct", "severity", "confidence")


@query(_TOTALS + "select k, a_value, b_value, dev as deviation_pct, severity, same as value_equivalent from flags")
def review_totals_all(spark, d):
    return _judged(spark, d).select("k", "a_value", "b_value", "deviation_pct", "severity", "value_equivalent")


@query("select o_orderkey as k, 'a' as side from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'b' from lineitem where l_orderkey not in (select o_orderkey from orders)")
def unpaired_orders(spark, d):
    a, b = (x.withColumnRenamed("k", "record_id") for x in _sides(spark, d))
    pairs = a.join(b.select("record_id"), "record_id").select(F.struct("record_id").alias("a"), F.struct("record_id").alias("b"))
    side = lambda x, s: align.unpaired(x, pairs, s).select(F.col("record_id").alias("k"), F.lit(s).alias("side"))
    return side(a, "a").unionByName(side(b, "b"))


@query(_TOTALS + "select severity, count(*) as flags from flags where not same group by 1")
def severity_counts(spark, d):
    return detect.severity_counts(_judged(spark, d).where("not value_equivalent"))


@query(_TOTALS + "select o_orderpriority, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'major') as major, count(*) filter (severity = 'minor') as minor, count(*) filter (severity = 'info') as info from flags group by 1")
def severity_by_priority(spark, d):
    return _judged(spark, d).groupBy("o_orderpriority").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor", "info")])


@query(_TOTALS + "select k, least(a_value, b_value) <> 0 and greatest(a_value, b_value) / least(a_value, b_value) > 3 as shift from flags")
def decimal_shift(spark, d):
    a, b = _sides(spark, d)
    return compare_totals(a, b, "k", "v").select("k", S.decimal_shift(F.col("a_value"), F.col("b_value")).alias("shift"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, greatest(0.0::double, least(1.0::double, l_quantity / 25 * l_tax * l_discount * 1000)) as confidence from lineitem")
def confidence_clamp(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", S.confidence(F.col("l_quantity") / 25 * F.col("l_tax"), F.col("l_discount"), F.lit(1000)).alias("confidence"))


@query(_TOTALS + """, bands(family, c, t, m, x) as (values ('impedance_pct', 'equipment_spec', 5.0, 15.0, 40.0), ('impedance_pct', null, 7.5, 20.0, 50.0), ('fault_current_a', null, 5.0, 20.0, 50.0)),
rows as (select k, dev, case when c_mktsegment = 'MACHINERY' then 'equipment_spec' else 'unknown' end as cls, case when c_mktsegment = 'BUILDING' then 'other' when k % 2 = 0 then 'impedance_pct' else 'fault_current_a' end as family from flags join customer on c_custkey = o_custkey),
banded as (select r.*, coalesce(s.t, b.t, 1.0) as t, coalesce(s.m, b.m, 10.0) as m, coalesce(s.x, b.x, 50.0) as x from rows r left join bands s on s.family = r.family and s.c = r.cls left join bands b on b.family = r.family and b.c is null)
select k, family, case when dev >= x then 'critical' when dev >= m then 'major' when dev >= t then 'minor' else 'info' end as severity from banded""")
def severity_by_class(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = _judged(spark, d).drop("severity", "family").join(c, "o_custkey")
    rows = rows.withColumn("cls", F.when(F.col("c_mktsegment") == "MACHINERY", "equipment_spec").otherwise("unknown")).withColumn(
        "family", F.when(F.col("c_mktsegment") == "BUILDING", "other").when(F.col("k") % 2 == 0, "impedance_pct").otherwise("fault_current_a")
    )
    return detect.with_severity(rows, "family", "deviation_pct", detect.band_table(spark), doc_class="cls").select("k", "family", "severity")


@query("""with o as (select o_orderkey, ['coordination_study', 'relay_setting_sheet', 'equipment_spec', 'unknown', 'other'][1 + (o_orderkey % 5)] as a, ['coordination_study', 'relay_setting_sheet', 'equipment_spec', 'unknown', 'other'][1 + (o_custkey % 5)] as b,
  case when o_orderkey % 3 = 0 then 'transformer_params' when o_orderkey % 3 = 1 then 'relay_settings' else 'none' end as f from orders),
h as (select *, case f when 'transformer_params' then ['coordination_study', 'relay_setting_sheet', 'equipment_spec'] when 'relay_settings' then ['coordination_study', 'equipment_spec', 'relay_setting_sheet'] end as l from o)
select o_orderkey, case when l is not null and a <> 'unknown' and b <> 'unknown' and coalesce(list_position(l, b), 0) > coalesce(list_position(l, a), 0) then 'doc_b' else 'doc_a' end as side from h""")
def authority_hierarchy(spark, d):
    classes = F.array(*map(F.lit, ["coordination_study", "relay_setting_sheet", "equipment_spec", "unknown", "other"]))
    family = F.when(F.col("o_orderkey") % 3 == 0, "transformer_params").when(F.col("o_orderkey") % 3 == 1, "relay_settings").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", S.authority_side(F.get(classes, F.col("o_orderkey") % 5), F.get(classes, F.col("o_custkey") % 5), family).alias("side"))


@query("""select l_returnflag, l_linestatus, a, b, case when a is null or b is null then 'unknown' when a = 'regex' and b = 'regex' then 'regex' when a = 'llm' and b = 'llm' then 'llm' else 'mixed' end as label, count(*) as n
from (select l_returnflag, l_linestatus, case l_returnflag when 'A' then 'regex' when 'R' then 'llm' end as a, case l_linestatus when 'O' then 'regex' else 'llm' end as b from lineitem) group by all""")
def provenance_label(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_returnflag") == "A", "regex").when(F.col("l_returnflag") == "R", "llm").alias("a"), F.when(F.col("l_linestatus") == "O", "regex").otherwise("llm").alias("b"))
    return rows.withColumn("label", S.provenance_label(F.col("a"), F.col("b"))).groupBy("l_returnflag", "l_linestatus", "a", "b", "label").agg(F.count(F.lit(1)).alias("n"))


@query("select l_partkey, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_discount desc, abs(l_linenumber - 3), l_linenumber, l_orderkey, l_extendedprice, l_suppkey) as n from lineitem) where n = 1")
def top1_per_part(spark, d):
    order = [F.desc("l_discount"), F.abs(F.col("l_linenumber") - 3), F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_suppkey")]
    return dedup.keep_best(table(spark, d, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


def _values(mapping: dict) -> str:
    return ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in mapping.items())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- claims of documents under review

_CLAIM = "with c as (select distinct * from claim), p as (select distinct * from fixture_pair) "


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim").dropDuplicates(["id"])


def _document_records(spark: SparkSession, d: str) -> DataFrame:
    """Claims as records of their document, read once however many pairs the document is in; record_id and pair_id are those of no pair."""
    rows = S.with_base_quantity(_claims(spark, d).withColumn("doc_key", clean("doc_id")), "raw_value", "q")
    box = F.struct(*[F.col(f"bbox_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    lane = F.when(clean("extraction_version").startswith("regex"), "regex").when(clean("extraction_version").startswith("vision"), "vision").otherwise("llm_text")
    return rows.select(
        F.xxhash64("id").alias("record_id"), F.col("id").alias("claim"), "doc_key", F.unix_micros(F.col("created_at").cast("timestamp")).alias("ord"), "doc_id", "page", box.alias("bbox"), "section", F.coalesce("span_text", F.lit("")).alias("span_text"),
        S.canonical_parameter("attribute").alias("name"), "raw_value", F.col("q.magnitude").alias("normalized_magnitude"), F.col("q.dimension").alias("normalized_unit"), "source_path", S.row_marker("span_text").alias("entity_tag"),
        F.when(lane == "regex", "regex").otherwise("llm").alias("provenance"), lane.alias("extraction_lane"),
    )


def _on_side(spark: SparkSession, d: str, records: DataFrame, side: str) -> DataFrame:
    """Records of documents as records of one side of the document pairs under review."""
    pair = table(spark, d, "fixture_pair").select(F.col("fixture_pair_id").alias("pair_id"), clean(f"doc_id_{side}").alias("doc_key"))
    return records.join(pair, "doc_key").withColumn("side", F.lit(side)).withColumn("record_id", F.xxhash64("claim", "pair_id")).drop("doc_key")


def _records(spark: SparkSession, d: str, side: str) -> DataFrame:
    return _on_side(spark, d, _document_records(spark, d), side)


@query()
def review_documents(spark, d):
    """The whole review over all pairs of documents; flags."""
    # Lane duplicates are a matter of one document, so they go before documents meet in pairs.
    once = checkpoint(dedup.drop_lane_duplicates(_document_records(spark, d), ["doc_id"]))
    a, b = (_on_side(spark, d, once, s).drop("claim") for s in ("a", "b"))
    flags = review(a, b, ReviewConfig(lane_duplicates=False))["flags"]
    return flags.select("pair_id", "flag_id", "parameter", "severity", F.round("deviation_pct", 4).alias("deviation_pct"), F.round("confidence", 6).alias("confidence"), "authority_rule", "provenance")


_SPELLED = ", ".join(f"({_quoted(u)}, {_quoted('watt' if v.common == 'volt_ampere' else v.common)}, {v.factor!r}::double, {v.offset!r}::double)" for u, v in unit_table().items())
_FOLDED = ", ".join(f"({_quoted(u)}, {_quoted('watt' if v.common == 'volt_ampere' else v.common)}, {v.factor!r}::double, {v.offset!r}::double)" for u, v in (unit_table() | folded_table()).items())
_OUTER = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8239) || chr(8201)"
#: Claims as records of both sides of the document pairs: what pairing and lane duplicates look at.
_RECORDS = f"""with recursive exact(s, d, f, o) as (values {_SPELLED}), folded(s, d, f, o) as (values {_FOLDED}), nm(k, v) as (values {_values(fixed.NAME_ALIASES)}),
c as (select distinct * from claim), pairs as (select fixture_pair_id as pair_id, lower(trim(doc_id_a)) as doc, 'a' as side from fixture_pair union all select fixture_pair_id, lower(trim(doc_id_b)), 'b' from fixture_pair),
raw as (select *, regexp_replace(trim(raw_value, {_OUTER}), ',', '', 'g') as s0, lower(trim(extraction_version, {_OUTER})) as ver,
  regexp_extract(coalesce(span_text, ''), '^[ \\t\\n\\r\\f\\x0b|]*([①-⑳]|[㉑-㉟]|\\d{{1,3}}[.)]?|[A-Z]-?\\d{{1,3}})[ \\t\\n\\r\\f\\x0b]+', 1) as mk from c),
num as (select *, regexp_extract(s0, {_quoted('^(' + NUMBER.replace("(?!" + chr(92) + "d)", "") + ')')}, 1) as nt from raw),
unit as (select *, try_cast(nullif(nt, '') as double) as n, regexp_replace(trim(substr(s0, length(nt) + 1), {_OUTER}), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g') as ut from num),
q as (select unit.*, case when n is not null then case when ut = '' then n when coalesce(e.d, f.d) is not null then n * coalesce(e.f, f.f) + coalesce(e.o, f.o) end end as m, case when n is not null then case when ut = '' then 'dimensionless' else coalesce(e.d, f.d) end end as d
  from unit left join exact e on e.s = ut left join folded f on f.s = lower(ut)),
rec as (select c.id || '/' || p.pair_id || p.side as rid, epoch_us(created_at) as ord, p.pair_id, p.side, c.doc_id, page, coalesce(nm.v, attribute) as name, raw_value, m, case when m is not null then d end as d, (bbox_y0 + bbox_y1) / 2 as y,
  case when mk = '' then '' when unicode(mk) between 9312 and 9331 then cast(unicode(mk) - 9311 as varchar) when unicode(mk) between 12881 and 12895 then cast(unicode(mk) - 12860 as varchar) else upper(regexp_replace(mk, '[.)]+$', '')) end as tag,
  case when starts_with(ver, 'regex') then 'regex' when starts_with(ver, 'vision') then 'vision' else 'llm_text' end as lane,
  coalesce(nullif(regexp_extract(trim(raw_value), '^([A-Z][A-Z-]*?)-?[0-9]', 1), ''), nullif(regexp_extract(trim(raw_value), '^([A-Z][A-Z-]*)(?:[ -]+)?[0-9]', 1), ''), nullif(regexp_extract(trim(raw_value), '^([A-Z][A-Z-]*)', 1), '')) as family
  from q c join pairs p on p.doc = lower(trim(c.doc_id, {_OUTER})) left join nm on nm.k = lower(trim(attribute, {_OUTER})))"""


def _text_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record_id", F.concat(F.col("claim"), F.lit("/"), F.col("pair_id"), F.col("side"))).drop("claim")


_SAME = "lower(trim({a}.raw)) = lower(trim({b}.raw)) or coalesce({a}.d = {b}.d and case when {b}.m = 0 then {a}.m = 0 else abs({a}.m - {b}.m) / abs({b}.m) <= 0.001 end, false)"


@query(_RECORDS + """, bucket as (select pair_id, page, lower(trim(name)) as nm, list({'id': rid, 'tag': tag, 'y': y, 'm': m, 'd': d, 'f': family, 'raw': raw_value} order by ord, rid) filter (side = 'a') as a,
  list({'id': rid, 'tag': tag, 'y': y, 'm': m, 'd': d, 'f': family, 'raw': raw_value} order by ord, rid) filter (side = 'b') as b from rec group by all having count(*) filter (side = 'a') > 0 and count(*) filter (side = 'b') > 0),
st as (select pair_id, a, b, 0 as i, cast([] as varchar[]) as used, cast(null as varchar) as a_id, cast(null as varchar) as b_id, cast(null as double) as sure, cast(null as boolean) as same from bucket
  union all
  select pair_id, a, b, i + 1, case when best is null then used else list_append(used, best.id) end, r.id, best.id,
    case when (uneven or level) and not anchored then case when r.tag = best.tag then case when r.tag <> '' then 1.0 else 0.5 end else 0.4 end when r.tag <> '' and r.tag = best.tag then 1.0 when r.tag <> best.tag then 0.55 when len(a) <= 1 and len(b) <= 1 then 0.9 else 0.75 end,
    """ + _SAME.format(a="r", b="best") + """ from (
      select *, case when (uneven or level) and not anchored then list_filter(free, lambda x: """ + _SAME.format(a="r", b="x") + """)[1]
        else list_filter(list_filter(free, lambda x: abs(r.y - x.y) = list_min(list_transform(free, lambda z: abs(r.y - z.y)))), lambda x: abs(r.y - x.y) <= 1000)[1] end as best from (
        select *, list_filter(pool, lambda x: not list_contains(used, x.id)) as free, r.tag <> '' and len(strict) = 1 as anchored, len(a) <> len(b) and greatest(len(a), len(b)) > 1 as uneven, len(pool) > 1 and len(list_distinct(list_transform(pool, lambda x: x.y))) = 1 as level from (
          select *, case when len(strict) > 0 then strict else fits end as pool from (
            select *, list_filter(fits, lambda x: x.tag = r.tag) as strict from (
              select *, list_filter(b, lambda x: r.m is not null or r.f is null or x.f is null or r.f = x.f) as fits from (select *, a[i + 1] as r from st where i < len(a))))))))
select pair_id, a_id, b_id, sure as pairing_confidence, same as value_equivalent from st where b_id is not null""")
def align_greedy(spark, d):
    pairs = align.align_exact(_text_ids(_records(spark, d, "a")), _text_ids(_records(spark, d, "b")))
    return pairs.select("pair_id", F.col("a.record_id").alias("a_id"), F.col("b.record_id").alias("b_id"), "pairing_confidence", "value_equivalent")


@query("""with l as (select l_orderkey, l_linenumber, min(l_quantity) as q, max(l_extendedprice) as x from lineitem group by 1, 2)
select l_orderkey as pair_id, l_linenumber as page, 0.9 as pairing_confidence, case when round(x / 1000) = 0 then q = 0 else abs(q - round(x / 1000)) / abs(round(x / 1000)) <= 0.001 end as value_equivalent from l""")
def align_single(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.max("l_extendedprice").alias("x"))

    def side(value: Column, s: str) -> DataFrame:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
        return l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"), F.lit(0).cast("bigint").alias("ord"), F.col("l_orderkey").alias("pair_id"), F.lit(s).alias("side"), F.lit(s).alias("doc_id"), F.col("l_linenumber").alias("page"), zero.alias("bbox"), F.lit("Quantity").alias("name"), F.concat(value.cast("string"), F.lit(" A")).alias("raw_value"), value.alias("normalized_magnitude"), F.lit("").alias("entity_tag"))

    return align.align_exact(side(F.col("q"), "a"), side(F.round(F.col("x") / 1000), "b")).select("pair_id", F.col("a.page").alias("page"), "pairing_confidence", "value_equivalent")


@query()
def align_by_name(spark, d):
    pairs = align.align_semantic(_records(spark, d, "a").drop("claim"), _records(spark, d, "b").drop("claim"), align.hashed_embedding())
    return pairs.select("pair_id", F.col("a.record_id").alias("a_id"), F.col("b.record_id").alias("b_id"), F.round("name_match_confidence", 6).alias("similarity"), "value_equivalent")


_NEAR = "abs({0} - {1}) <= 0.001 * greatest(abs({0}), abs({1}))"
_ALIKE = "case when k.m is not null and v.m is not null then (coalesce(k.u, '') = '' or coalesce(v.u, '') = '' or k.u = v.u) and " + _NEAR.format("k.m", "v.m") + " else (k.form = v.form and k.form <> '') or coalesce(" + _NEAR.format("k.n", "v.n") + ", false) end"


@query(_RECORDS + """, g as (select pair_id, doc_id, page, name, list({'id': rid, 'lane': lane, 'm': m, 'u': d, 'form': regexp_replace(replace(lower(raw_value), ',', ''), '[^a-z0-9.%]', '', 'g'), 'n': try_cast(replace(nullif(regexp_extract(raw_value, '(-?[0-9][0-9,]*\\.?[0-9]*)', 1), ''), ',', '') as double)}
  order by case when lane = 'vision' then 0 when lane = 'llm_text' or regexp_matches(tag, '^[0-9]+$') then 1 else 2 end, ord, rid) as l from rec where side = 'a' group by all having min(lane) <> max(lane)),
w as (select l, 1 as i, list_slice(l, 1, 0) as kept, cast([] as varchar[]) as gone from g
  union all select l, i + 1, case when rep then kept else list_append(kept, v) end, case when rep then list_append(gone, v.id) else gone end from (select *, len(list_filter(kept, lambda k: k.lane <> v.lane and """ + _ALIKE + """)) > 0 as rep from (select *, l[i] as v from w where i <= len(l)))),
drops as (select unnest(gone) as rid from w where i > len(l))
select pair_id, rid as record_id, lane as extraction_lane from rec where side = 'a' and rid not in (select rid from drops)""")
def lane_duplicates(spark, d):
    return dedup.drop_lane_duplicates(_text_ids(_records(spark, d, "a")), ["pair_id", "doc_id"]).select("pair_id", "record_id", "extraction_lane")


_PARTS = """, r as (select distinct fixture_pair_id, upper(trim(raw_value)) as v, page, s, c.doc_id as doc from (select fixture_pair_id, doc_id_a as doc, 'a' as s from p union all select fixture_pair_id, doc_id_b, 'b' from p) x
  join c on lower(c.doc_id) = lower(x.doc) where regexp_matches(raw_value, '^[A-Z]+-[A-Z]-[0-9]+[A-Z]*$')) """


def _designations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = [_records(spark, d, s).where(F.col("raw_value").rlike(r"^[A-Z]+-[A-Z]-[0-9]+[A-Z]*$")).withColumn("name", F.lit("Fuse Designation")) for s in ("a", "b")]
    return rows[0], rows[1]


def _gap(spark, d, page_scope: bool) -> DataFrame:
    a, b = _designations(spark, d)
    gaps = detect.gap_flags(a, b, page_scope=page_scope)
    return gaps.select(F.col("pair_id").alias("fixture_pair_id"), F.upper(strip("a_record.raw_value")).alias("v"), F.col("a_record.page").alias("page"), "deviating_doc_id", "parameter", "severity", "confidence", "authority_rule", "provenance").distinct()


@query(_CLAIM + _PARTS + "select distinct fixture_pair_id, v, page, coalesce((select min(doc) from r b where b.s = 'b' and b.fixture_pair_id = a.fixture_pair_id), '') as deviating_doc_id, 'Fuse Designation' as parameter, 'major' as severity, 0.5 as confidence, 'checklist_gap' as authority_rule, 'regex' as provenance from r a where s = 'a' and not exists (from r b where b.s = 'b' and b.fixture_pair_id = a.fixture_pair_id and b.v = a.v and b.page = a.page)")
def gap_same_page(spark, d):
    return _gap(spark, d, True)


@query(_CLAIM + _PARTS + "select distinct fixture_pair_id, v, page, coalesce((select min(doc) from r b where b.s = 'b' and b.fixture_pair_id = a.fixture_pair_id), '') as deviating_doc_id, 'Fuse Designation' as parameter, 'major' as severity, 0.5 as confidence, 'checklist_gap' as authority_rule, 'regex' as provenance from r a where s = 'a' and not exists (from r b where b.s = 'b' and b.fixture_pair_id = a.fixture_pair_id and b.v = a.v)")
def gap_anywhere(spark, d):
    return _gap(spark, d, False)


@query("with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as f, l_suppkey % 100 as v, l_orderkey % 500 as pair_id from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey from r a where f = 'R' and exists (from r b where b.f = 'A' and b.pair_id = a.pair_id and b.v = a.v)")
def migrated_values(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.concat(F.lit("v"), (F.col("l_suppkey") % 100).cast("string")).alias("raw_value"), (F.col("l_orderkey") % 500).alias("pair_id"))
    return detect.migrated_values(r.where("l_returnflag = 'R'"), r.where("l_returnflag = 'A'")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("with c as (select distinct * from claim) select id, sha256(concat_ws('|', entity_id, attribute, raw_value, doc_id, cast(page as varchar))) as claim_id from c")
def claim_ids(spark, d):
    return _claims(spark, d).select("id", S.claim_id(F.col("entity_id"), F.col("attribute"), F.col("raw_value"), F.col("doc_id"), F.col("page")).alias("claim_id"))


@query("""with c as (select distinct id, trim(raw_value) as s from claim) select id, coalesce(nullif(regexp_extract(s, '^([A-Z][A-Z\\-]*?)-?\\d', 1), ''), nullif(regexp_extract(s, '^([A-Z][A-Z\\-]*)(?:[\\s\\-]+)?\\d', 1), ''), nullif(regexp_extract(s, '^([A-Z][A-Z\\-]*)', 1), '')) as family from c""")
def designation_families(spark, d):
    return _claims(spark, d).select("id", S.designation_family("raw_value").alias("family"))


@query(f"with m(k, v) as (values {_values(fixed.NAME_ALIASES)}), f(k, v) as (values {_values(fixed.PHRASES)}), g(k, v) as (values {_values(fixed.FAMILIES)}), e as (select distinct extraction_id, parameter_name from extracted_claim) "
       "select extraction_id, coalesce(m.v, parameter_name) as canonical, coalesce(f1.v, f2.v, parameter_name) as phrase, g.v as family from e left join m on m.k = lower(trim(parameter_name)) left join f f1 on f1.k = parameter_name left join f f2 on f2.k = trim(parameter_name) left join g on g.k = coalesce(f1.v, f2.v, parameter_name)")
def canonical_names(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "parameter_name").distinct()
    return e.select("extraction_id", S.canonical_parameter("parameter_name").alias("canonical"), S.canonical_phrase("parameter_name").alias("phrase"), S.attribute_family("parameter_name").alias("family"))


@query("with c as (select distinct id, span_text, raw_value from claim) select id, coalesce(trim(raw_value) <> '' and contains(trim(regexp_replace(span_text, '\\s+', ' ', 'g')), trim(regexp_replace(raw_value, '\\s+', ' ', 'g'))), false) as verbatim from c")
def verbatim_guard(spark, d):
    return _claims(spark, d).select("id", S.verbatim(F.col("raw_value"), F.col("span_text")).alias("verbatim"))


@query("with e as (select distinct extraction_id, reasoning, raw_value, parameter_name from extracted_claim) select extraction_id, coalesce(contains(reasoning, raw_value), false) or coalesce(contains(reasoning, parameter_name), false) as mentioned from e")
def rationale_guard(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "reasoning", "raw_value", "parameter_name").distinct()
    return e.select("extraction_id", S.mentions_value(F.col("reasoning"), F.col("raw_value"), F.col("parameter_name")).alias("mentioned"))


@query("with c as (select distinct id, raw_value from claim) select id, try_cast(replace(nullif(regexp_extract(raw_value, '(-?\\d[\\d,]*\\.?\\d*)', 1), ''), ',', '') as double) as n, regexp_replace(replace(lower(raw_value), ',', ''), '[^a-z0-9.%]', '', 'g') as form from c")
def value_forms(spark, d):
    return _claims(spark, d).select("id", S.first_number("raw_value").alias("n"), S.value_form("raw_value").alias("form"))


@query("""with c as (select distinct id, bbox_x0 as x0, bbox_y0 as y0, bbox_x1 as x1, bbox_y1 as y1 from claim), e as (select *, x1 <= x0 or y1 <= y0 as none from c)
select id, case when none then 0.0 else greatest(0.0, x0 - 12) end as x0, case when none then 0.0 else greatest(0.0, y0 - 12) end as y0, case when none then 612.0 else least(612.0, x1 + 48) end as x1, case when none then 792.0 else least(792.0, y1 + 12) end as y1 from e""")
def citation_clips(spark, d):
    box = F.struct(*[F.col(f"bbox_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    return _claims(spark, d).select("id", detect.citation_clip(box, F.lit(612.0), F.lit(792.0)).alias("c")).select("id", "c.*")


@query("""with c as (select distinct id, doc_id, section, page, entity_id from claim where coalesce(section, '') <> ''), s as (select *, regexp_replace(lower(trim(section)), '[^a-z0-9]+', '', 'g') as slug from c)
select doc_id, section as raw_title, any_value(case when slug = '' then lower(section) else slug end) as canonical_id, any_value(case when regexp_matches(slug, 'diagram|oneline|singleline') then 'diagram_label' when regexp_matches(slug, 'schedule') then 'schedule' when regexp_matches(slug, 'tcc|curve|plot|table') then 'table_row' else 'prose' end) as kind,
  count(distinct nullif(entity_id, '')) as row_count, list_sort(list(distinct nullif(page, 0))) as pages from s group by doc_id, section""")
def contexts(spark, d):
    rows = _claims(spark, d).withColumn("context_id", F.col("section")).withColumn("row_id", F.col("entity_id"))
    return equipment.extract_contexts(rows)


@query("""with c as (select distinct id, doc_id, section, page, entity_id from claim where coalesce(section, '') <> ''), x as (select doc_id, section, regexp_replace(lower(trim(section)), '[^a-z0-9]+', '', 'g') as canonical_id, count(distinct nullif(entity_id, '')) as row_count from c group by all)
select doc_id, section as raw_title, min(canonical_id) over (partition by row_count) as aligned_id from x""")
def contexts_aligned(spark, d):
    return equipment.align_contexts(contexts(spark, d), ["row_count"]).select("doc_id", "raw_title", "aligned_id")


def _equipment_records(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(*[F.col(f"bbox_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])
    c = _claims(spark, d)
    lane = F.when(clean("extraction_version").startswith("regex"), "regex").when(clean("extraction_version").startswith("vision"), "vision").otherwise("llm_text")
    return c.select(F.xxhash64("id").alias("record_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("ord"), "doc_id", "page", F.col("attribute").alias("name"), "raw_value", "normalized_magnitude", F.col("entity_id").alias("entity_tag"), F.col("section").alias("context_id"), F.when(F.col("section").isNotNull(), F.col("entity_id")).alias("row_id"), lane.alias("source_lane"), box.alias("bbox"))


@query()
def equipment_inventory(spark, d):
    return equipment.build_inventory(_equipment_records(spark, d))


_VALUES = "with c as (select lower(trim(entity_id)) as e, attribute, extraction_version, raw_value, created_at, id from (select distinct * from claim)), s as (select e, attribute, lower(trim(extraction_version)) as v, arg_max(raw_value, (created_at, id)) as x from c group by all) "


@query(_VALUES + """select e as entity, coalesce(a.attribute, b.attribute) as parameter, a.x as a_value, b.x as b_value, case when a.x is null then 'parameter_added' when b.x is null then 'parameter_removed' else 'value_change' end as change
from (select * from s where v = 'llm-v1') a full join (select * from s where v = 'llm-v2') b using (e, attribute) where a.x is null or b.x is null or a.x <> b.x""")
def parameter_changes(spark, d):
    c = _claims(spark, d).withColumn("entity", clean("entity_id")).withColumn("v", clean("extraction_version"))
    last = c.groupBy("entity", "attribute", "v").agg(F.max_by("raw_value", F.struct("created_at", "id")).alias("x")).where("x is not null")
    maps = last.groupBy("entity", "v").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "x"))).alias("parameters"))
    return equipment.parameter_changes(maps.where("v = 'llm-v1'"), maps.where("v = 'llm-v2'"), ["entity"])


@query("with e as (select distinct extraction_id, lane, confidence, reasoning from extracted_claim), s as (select least(9, floor(greatest(0, least(1, confidence)) * 10)) as bin, greatest(0, least(1, confidence)) as c, case when coalesce(reasoning, '') <> '' then 1.0 else 0.0 end as t from e where confidence is not null) "
       "select cast(r.bin as int) as bin, r.bin / 10 as lo, (r.bin + 1) / 10 as hi, count(c) as n, round(coalesce(avg(c), 0), 8) as mean_score, round(coalesce(avg(t), 0), 8) as hit_rate from range(10) r(bin) left join s on s.bin = r.bin group by r.bin")
def calibration(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "confidence", "reasoning").distinct().withColumn("truth", F.coalesce(F.col("reasoning") != "", F.lit(False)))
    return evaluate.calibration_bins(e, "confidence", "truth").withColumns({c: F.round(c, 8) for c in ("mean_score", "hit_rate")})


@query("with e as (select distinct extraction_id, confidence, reasoning from extracted_claim) select count(confidence) as n, round(coalesce(avg((confidence - case when coalesce(reasoning, '') <> '' then 1.0 else 0.0 end) ** 2), 0), 8) as brier from e where confidence is not null")
def brier_score(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", "confidence", "reasoning").distinct().where("confidence is not null").withColumn("truth", F.coalesce(F.col("reasoning") != "", F.lit(False)))
    return evaluate.brier(e, "confidence", "truth").withColumn("brier", F.round("brier", 8))


@query("""with x as (select source, n_chars > 2000 as guess, coalesce(lang, '') = 'en' as truth from documents), s as (select source, count(*) filter (guess and truth) as tp, count(*) filter (guess and not truth) as fp, count(*) filter (not coalesce(guess, false) and truth) as fn from x group by 1),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from s) select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from r""")
def precision_recall(spark, d):
    x = table(spark, d, "documents").select("source", F.coalesce(F.col("n_chars") > 2000, F.lit(False)).alias("g"), (F.coalesce("lang", F.lit("")) == "en").alias("t"))
    return evaluate.precision_recall(x, F.col("g") & F.col("t"), F.col("g") & ~F.col("t"), ~F.col("g") & F.col("t"), ["source"])


@query("""with x as (select distinct f.flag_id, f.severity, f.provenance, d.verdict from surfaced_flag f join (select distinct * from decision) d on lower(trim(d.flag_id)) = lower(f.flag_id)), y as (select *, case when severity in ('critical', 'major') then 'accepted' else 'dismissed' end as guess from x)
select severity, provenance, count(*) as n, avg(case when verdict = guess then 1 else 0 end) as accuracy from y group by grouping sets ((), (severity), (provenance))""")
def decision_accuracy(spark, d):
    f = table(spark, d, "surfaced_flag").select("flag_id", F.lower("flag_id").alias("k"), "severity", "provenance")
    x = f.join(table(spark, d, "decision").distinct().select(clean("flag_id").alias("k"), "verdict"), "k").select("flag_id", "severity", "provenance", "verdict").distinct()
    x = x.withColumn("guess", F.when(F.col("severity").isin("critical", "major"), "accepted").otherwise("dismissed"))
    return evaluate.accuracy(x, "verdict", "guess", ["severity", "provenance"])


# ---- documents: lines, sections, layout

_LINES = """with pg as (select doc_id, unnest(generate_series(1, len(string_split(text, chr(12))))) as page, unnest(string_split(text, chr(12))) as text from documents where text is not null),
l as (select doc_id, page, unnest(generate_series(0, len(string_split_regex(text, '\\r\\n|[\\n\\r]')) - 1)) as i, unnest(string_split_regex(text, '\\r\\n|[\\n\\r]')) as line from pg),
s as (select doc_id, page, i, trim(line, ' ' || chr(9) || chr(160) || chr(65279) || chr(12) || chr(11)) as t from l), n as (select * from s where t <> '') """


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return scan.text_spans(table(spark, d, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(_LINES + "select doc_id, count(*) as lines, max(page) as pages, min(i) as first, max(i) as last, sum(length(t)) as chars from n group by 1")
def line_spans(spark, d):
    i = F.floor(F.col("bbox.y0") / 12)
    return _spans(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("page").alias("pages"), F.min(i).alias("first"), F.max(i).alias("last"), F.sum(F.length("text")).alias("chars"))


_HEAD = "regexp_matches(t, '^[0-9]+(\\.[0-9]+)*\\.?\\s+\\S|^[a-z]\\.\\s+\\S|^Time Current Curve\\b')"


@query(_LINES + f", f as (select doc_id, i, last_value(case when {_HEAD} then t end ignore nulls) over (partition by doc_id, page order by i rows between unbounded preceding and current row) as section from n) select doc_id, count(*) as lines, count(section) as in_section, count(distinct section) as sections from f group by 1")
def sections(spark, d):
    s = scan.fill_sections(_spans(spark, d), ["doc_id", "page"], ["bbox.y0", "ord"])
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count("section").alias("in_section"), F.count_distinct("section").alias("sections"))


@query(_LINES + ", m as (select doc_id, i, unnest(regexp_extract_all(t, 'under number ([0-9]+)', 1)) as token from n) select doc_id, i, token || ' A' as raw_value, count(*) as n from m group by all")
def pattern_scan(spark, d):
    m = extract.pattern_matches(F.col("text"), [(r"under number ([0-9]+)", "Register Number", "A")], None)
    rows = _spans(spark, d).select("doc_id", F.floor(F.col("bbox.y0") / 12).alias("i"), F.explode(m).alias("m"))
    return rows.groupBy("doc_id", "i", F.col("m.raw_value").alias("raw_value")).agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select distinct id, attribute || ': ' || raw_value as t from claim where attribute is not null and raw_value is not null), m as (select id, t, '^([A-Z][A-Za-z][A-Za-z ]{0,40}?)[ \\t\\n\\r\\f\\x0b]*:[ \\t\\n\\r\\f\\x0b]*(\\d[\\d,]*\\.?\\d*)[ \\t\\n\\r\\f\\x0b]*(kVA|MVA|kV|MV|kA|VA|kHz|MHz|Hz|°C|°F|Ω|μF|%|V|A)(?:[ \\t\\n\\r\\f\\x0b]|$|[^A-Za-z0-9])' as p from c) "
       "select id, trim(regexp_extract(t, p, 1)) as name, regexp_extract(t, p, 2) || ' ' || regexp_extract(t, p, 3) as raw_value from m where regexp_extract(t, p, 2) <> ''")
def label_values(spark, d):
    c = _claims(spark, d).select("id", F.concat("attribute", F.lit(": "), "raw_value").alias("t")).where("t is not null")
    return c.select("id", F.explode(extract.pattern_matches(F.col("t"), [])).alias("m")).select("id", "m.name", "m.raw_value")


@query(_LINES + ", m as (select doc_id, page, i, regexp_extract(t, '^[ \\t\\n\\r\\f\\x0b|]*([①-⑳]|[㉑-㉟]|\\d{1,3}[.)]?|[A-Z]-?\\d{1,3})[ \\t\\n\\r\\f\\x0b]+', 1) as t from n where t <> '') "
       "select doc_id, page, i, case when unicode(t) between 9312 and 9331 then cast(unicode(t) - 9311 as varchar) when unicode(t) between 12881 and 12895 then cast(unicode(t) - 12860 as varchar) else upper(regexp_replace(t, '[.)]+$', '')) end as tag from m where t <> ''")
def row_markers(spark, d):
    return _spans(spark, d).select("doc_id", "page", F.floor(F.col("bbox.y0") / 12).alias("i"), S.row_marker("text").alias("tag")).where("tag <> ''")


_LAYOUT = """with x as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, length(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(11) || chr(12) || chr(65279))) as n_chars,
  list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(11) || chr(12) || chr(65279))), lambda s: s <> '') as l from x),
s as (select doc_id, n_chars, len(l) as n_lines, case when len(l) > 0 then list_sum(list_transform(l, lambda s: length(s))) / len(l) else 0.0 end as average, case when len(l) > 0 then len(list_filter(l, lambda s: length(s) < 20)) / len(l) else 0.0 end as short_share from w) """


@query(_LAYOUT + "select doc_id, n_chars, n_lines, average, short_share, case when short_share > 0.6 and average < 25 then 'diagram' when n_chars < 200 then 'mixed' when short_share < 0.3 and average > 40 then 'prose' else 'mixed' end as structure from s")
def page_structure(spark, d):
    return scan.layout_statistics(table(spark, d, "documents"), ["doc_id"], "text").drop("image_share")


@query(_LAYOUT + "select doc_id from s where n_chars < 80")
def low_coverage(spark, d):
    return scan.low_coverage(table(spark, d, "documents")).select("doc_id")


@query("select source, bool_and(length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(65279))) < 80) as image_only from documents group by 1")
def image_only(spark, d):
    return scan.image_only(table(spark, d, "documents"), doc="source")


@query("select doc_id, source, version_no as page from (select *, max(version_no) over (partition by source) as m from documents) where version_no in (1, 2) or version_no = m")
def sampled_pages(spark, d):
    return scan.sample_pages(table(spark, d, "documents").withColumn("page", F.col("version_no")), "source").select("doc_id", "source", "page")


@query("select l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice * 20 as bigint) as varchar) || ' kVA' as token, cast(cast(l_extendedprice * 20 as bigint) as double) as value from lineitem where not cast(l_extendedprice * 20 as bigint) between 1 and 1000000")
def implausible_values(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.bround(F.col("l_extendedprice") * 20, 0).cast("bigint").cast("string"), F.lit(" kVA")).alias("t"))
    return scan.implausible_tokens(rows, ["l_orderkey", "l_linenumber", "l_partkey"], "t").where("family = 'rated_power_kva'").drop("family")


@query("select case_no, doc_id from (select *, row_number() over (partition by case_no order by case when source like 'registry%' then 0 when source like 'reporter%' then 1 else 2 end, version_no desc, doc_id) as n from documents) where n = 1")
def best_version(spark, d):
    lane = F.when(F.col("source").startswith("registry"), 0).when(F.col("source").startswith("reporter"), 1).otherwise(2)
    return dedup.keep_best(table(spark, d, "documents"), ["case_no"], [lane, F.desc("version_no"), F.col("doc_id")]).select("case_no", "doc_id")


# ---- vectors, ranges, joins

@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 12) as s from v a join v b on a.label = b.label and a.vec_id <> b.vec_id)
select a as a_key, arg_max(b, (s, -b)) as b_key from s group by 1""")
def nearest_vector(spark, d):
    e = table(spark, d, "embeddings")
    return align.similarity_top1(e, e, key="vec_id", vector="embedding", group=["label"]).select("a_key", "b_key")


@query("select event_id, arg_min(p_partkey, (hi - lo, p_partkey)) as label from events e join (select p_partkey, p_retailprice - 900 as lo, p_retailprice - 900 + p_size / 10 as hi from part) p on e.value between lo and hi group by 1")
def range_bind(spark, d):
    ranges = table(spark, d, "part").select(F.col("p_partkey").alias("label"), (F.col("p_retailprice") - 900).alias("y_top"), (F.col("p_retailprice") - 900 + F.col("p_size") / 10).alias("y_bottom"), F.col("p_partkey").alias("ord"))
    return align.bind_to_ranges(table(spark, d, "events"), ranges, [], value=F.col("value"), record_id="event_id", width=1.0).select(F.col("record_id").alias("event_id"), "label")


@query("select o_orderkey, 'exact' as origin from orders where o_orderpriority = '1-URGENT' union all select min(o_orderkey), 'semantic' from orders o where o_totalprice > 1000 and o_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT') group by o_custkey")
def combined_alignments(spark, d):
    o = table(spark, d, "orders")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    a = F.struct(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), box.alias("bbox"), F.lit("n").alias("name"), F.col("o_orderkey").alias("ord"))
    side = lambda df, s: df.select(F.lit("").alias("pair_id"), a.alias("a"), "o_orderkey", F.lit(s).alias("origin"))
    both = align.combine_alignments(side(o.where("o_orderpriority = '1-URGENT'"), "exact"), side(o.where("o_totalprice > 1000"), "semantic"))
    return both.select("o_orderkey", "origin")


@query("select n_name as family, unnest(case n_regionkey when 0 then ['x', 'y'] when 1 then ['z'] end) as coupled, s_suppkey from nation join supplier on s_nationkey = n_nationkey where n_regionkey in (0, 1)")
def coupled_lookup(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.struct("s_suppkey", "n_name").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("family"))
    stored = spark.createDataFrame([("x",), ("y",), ("z",)], "attribute string")
    found = judge.coupled_claims(rows, stored, {"r0": ["x", "y"], "r1": ["z"]})
    return found.select(F.col("key.n_name").alias("family"), F.col("coupled_family").alias("coupled"), F.col("key.s_suppkey").alias("s_suppkey"))


@query("select p_partkey, ['c' || (p_size % 3), 'c2', 'none'] as ids, list_filter([case when p_size % 3 < 2 then 'c' || (p_size % 3) end, null, null], lambda x: x is not null) as cited from part where p_size % 3 < 2")
def resolved_citations(spark, d):
    p = table(spark, d, "part").withColumn("ids", F.array(F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")), F.lit("c2"), F.lit("none")))
    clauses = spark.createDataFrame([("c0", 2015, "s", "t"), ("c1", 2016, "s", "t")], "clause_id string, edition_year int, source_name string, summary string")
    cited = judge.resolve_citations(p, clauses, key="p_partkey", ids="ids")
    return p.join(cited, "p_partkey").select("p_partkey", "ids", F.transform("cited_clauses", lambda c: c["clause_id"]).alias("cited"))


@query("""with c(id, fams, classes) as (values ('a', ['BUILDING', 'MACHINERY'], []::varchar[]), ('b', ['BUILDING'], ['1']), ('c', ['HOUSEHOLD'], ['2', '3']))
select c_custkey, id from customer join c on list_contains(fams, c_mktsegment) and (len(classes) = 0 or list_contains(classes, cast(c_nationkey % 5 as varchar)))""")
def clause_filter(spark, d):
    c = spark.createDataFrame([("a", ["BUILDING", "MACHINERY"], []), ("b", ["BUILDING"], ["1"]), ("c", ["HOUSEHOLD"], ["2", "3"])], "id string, applicable_families array<string>, applicable_doc_classes array<string>")
    cust = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string").alias("cls"))
    open_ = c.withColumn("c_mktsegment", F.explode("applicable_families"))
    return cust.join(F.broadcast(open_), "c_mktsegment").where(judge.clauses_for(open_, F.col("c_mktsegment"), F.col("cls"))).select("c_custkey", "id").distinct()


@query("select event_id, try_cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as bigint) as k from events where try_cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as bigint) between 0 and 1000")
def payload_fields(spark, d):
    e = table(spark, d, "events").select("event_id", judge.parse_payload(F.col("props"), "struct<k: bigint>").alias("p"))
    return e.where(judge.within(F.col("p.k"), 0, 1000)).select("event_id", "p.k")


@query("select nation, label, y_top, y_bottom from (select n_name as nation, s_name as label, s_acctbal as y_top, s_acctbal * 2 as y_bottom from supplier join nation on n_nationkey = s_nationkey) where y_top <= y_bottom and label not in ('Note', 'IEEE')")
def usable_entities(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("nation"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("y_top"), (F.col("s_acctbal") * 2).alias("y_bottom"))
    return judge.usable_entities(rows)


@query("with e as (select distinct extraction_id, lane, confidence from extracted_claim) select extraction_id, case when confidence < 0.6 then 'unknown' else lane end as doc_class from e")
def class_fallback(spark, d):
    e = table(spark, d, "extracted_claim").select("extraction_id", F.col("lane").alias("doc_class"), "confidence", F.lit("").alias("reasoning")).distinct()
    return judge.document_class(e).select("extraction_id", "doc_class")


# ---- stores, ledger, sets

@query("select coalesce(n.c_custkey, c.c_custkey) as c_custkey, coalesce(n.c_name, c.c_name) as c_name, coalesce(n.bal, c.c_acctbal) as c_acctbal, coalesce(c.c_mktsegment, n.c_mktsegment) as c_mktsegment from (select * from customer where c_custkey % 3 <> 0) c full join (select c_custkey, 'new ' || c_name as c_name, c_acctbal + 1 as bal, c_mktsegment from customer where c_custkey % 2 = 0) n on n.c_custkey = c.c_custkey")
def upsert_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name")).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return store.upsert(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"], ["c_name", "c_acctbal"])


@query("select s_suppkey, case when s_suppkey % 4 = 0 then 'override' else s_name end as s_name from supplier")
def override_merge(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return detect.merge_by_key(s, s.where("s_suppkey % 4 = 0").withColumn("s_name", F.lit("override")), ["s_suppkey"])


_COST = "with e as (select distinct on (id, ts, est_cost_usd) * from cost_event) "


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cost_event").withColumn("usd", F.col("est_cost_usd").cast("decimal(18,6)")).withColumn("namespace", clean("namespace"))


@query("select cast(coalesce(sum(cast(est_cost_usd as decimal(18, 6))), 0) as double) as total from cost_event where provider = 'orrin' and lower(trim(namespace)) = 'vision-lane'")
def cost_total(spark, d):
    return store.total_cost(_ledger(spark, d), "usd", provider="orrin", namespace="vision-lane").select(F.col("total").cast("double").alias("total"))


@query("select provider, namespace, count(*) as events, cast(coalesce(sum(usd), 0) as double) as total from (select provider, lower(trim(namespace)) as namespace, cast(est_cost_usd as decimal(18, 6)) as usd from cost_event) group by grouping sets ((), (provider), (namespace))")
def cost_summary(spark, d):
    return store.cost_summary(_ledger(spark, d), amount="usd").select("provider", "namespace", "events", F.col("total").cast("double").alias("total"))


@query("select provider, count(*) as events, cast(coalesce(sum(cast(est_cost_usd as decimal(18, 6))), 0) as double) as total from cost_event where ts >= timestamp '2025-06-01' group by 1")
def cost_since(spark, d):
    rows = store.cost_summary(_ledger(spark, d), amount="usd", groups=["provider"], where=F.col("ts") >= F.lit("2025-06-01").cast("timestamp_ntz"))
    return rows.where("provider is not null").select("provider", "events", F.col("total").cast("double").alias("total"))


@query("select id, (coalesce(input_tokens, 0) * 3.0 + coalesce(output_tokens, 0) * 15.0 + coalesce(cache_read_tokens, 0) * 3.0 * 0.1 + coalesce(cache_creation_tokens, 0) * 3.0 * 1.25) / 1e6 as est_cost_usd from cost_event where model = 'orrin-large-2' union all select id, 0.0 from cost_event where model is distinct from 'orrin-large-2'")
def priced_events(spark, d):
    prices = spark.createDataFrame([("orrin-large-2", 3.0, 15.0)], "model string, in_rate double, out_rate double")
    return store.price_events(table(spark, d, "cost_event").drop("est_cost_usd"), prices).select("id", "est_cost_usd")


@query("select l_suppkey, l_partkey from lineitem where l_returnflag = 'R' union all select l_suppkey, l_partkey from lineitem where l_linestatus = 'O'")
def union_lanes(spark, d):
    l = table(spark, d, "lineitem")
    return l.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").unionByName(l.where("l_linestatus = 'O'").select("l_suppkey", "l_partkey"))


@query("select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def except_rows(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("select l_partkey, len(list_intersect(list(distinct l_suppkey) filter (l_returnflag = 'R'), list(distinct l_suppkey) filter (l_returnflag = 'A'))) as shared from lineitem group by 1 having shared > 0")
def intersect_values(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_partkey").agg(*[F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey"))).alias(f) for f in ("R", "A")])
    return l.select("l_partkey", F.size(F.array_intersect("R", "A")).cast("bigint").alias("shared")).where("shared > 0")


@query("select user_id, list_slice(list(distinct event_type order by event_type), 1, 3) as types, count(*) as events from events group by 1")
def sample_values(spark, d):
    e = table(spark, d, "events").withColumn("raw_value", F.col("event_type"))
    return extract.record_tally(e, ["user_id"], samples=3).select("user_id", F.col("values").alias("types"), F.col("records").alias("events"))


@query("select 'claim' as \"table\", count(*) as \"rows\" from claim union all select 'entity', count(*) from entity union all select 'decision', count(*) from decision")
def table_counts(spark, d):
    return evaluate.diagnostics(**{t: table(spark, d, t) for t in ("claim", "entity", "decision")})


@query("with c as (select distinct * from claim) select c.id, e.type, e.label from c join entity e on e.id = c.entity_id where c.attribute = 'Fault Current'")
def claims_of_attribute(spark, d):
    c, e = _claims(spark, d), table(spark, d, "entity")
    return c.where("attribute = 'Fault Current'").join(e.select(F.col("id").alias("entity_id"), S.entity_type("type").alias("type"), "label"), "entity_id").select("id", "type", "label")


# ---- events as a stream, in batch form

@query("select user_id, time_bucket(interval '1 hour', ts) as \"from\", time_bucket(interval '1 hour', ts) + interval '1 hour' as \"to\", count(*) as events, cast(sum(cast(value as decimal(18, 2))) as double) as total from events group by all")
def hourly_spend(spark, d):
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = live.windowed_spend(e, "ts", F.col("value"), ["user_id"])
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("from", "to")], "events", F.col("total").cast("double").alias("total"))


@query("""with g as (select user_id, ts, case when ts < lag(ts) over w + interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as "from", max(ts) + interval '30 minutes' as "to", count(*) as events from s group by user_id, k""")
def user_sessions(spark, d):
    rows = live.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"])
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("from", "to")], "events")
