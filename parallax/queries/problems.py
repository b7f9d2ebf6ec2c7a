"""Queries of the general data problems (p1, p5, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions.text import clean
from parallax.operators.orphans import Link, orphan_references, orphan_report
from parallax.functions.units import _GROUPED, NUMBER, folded_table, unit_pattern, unit_table
from parallax.operators.quantities import unify_quantities
from parallax.operators.trailing import trailing_totals
from parallax.session import table


def _spend(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(table(spark, d, "cost_event"), clean("namespace"), "ts", "est_cost_usd", key="id", version="loaded_at")


def p1_trailing(spark: SparkSession, d: str) -> DataFrame:
    return _spend(spark, d).select(
        F.col("entity").alias("namespace"), F.date_format("day", "yyyy-MM-dd").alias("event_day"),
        "total_7", "total_30", "mean_day_7", "mean_day_30", "mean_event_7", "mean_event_30", "events_7", "events_30",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _spend(spark, d).where("total_7 = 0 and total_30 > 0").select(F.col("entity").alias("namespace"), F.date_format("day", "yyyy-MM-dd").alias("event_day"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    claim, decision = table(spark, d, "claim"), table(spark, d, "decision")
    stood = {"parent_created": "created_at", "parent_deleted": "deleted_at", "child_ts": "created_at", "row_id": "id"}
    return orphan_references([
        Link("claim", "entity_id", child=claim, child_key="entity_id", parent=table(spark, d, "entity"), parent_key="id", **stood),
        Link("decision", "flag_id", child=decision, child_key="flag_id", parent=table(spark, d, "surfaced_flag"), parent_key="flag_id", **stood),
        Link("decision", "fixture_pair_id", child=decision, child_key="fixture_pair_id", parent=table(spark, d, "fixture_pair"), parent_key="fixture_pair_id", **stood),
    ])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).withColumnRenamed("period", "year_month")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d)).withColumnRenamed("period", "year_month")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return unify_quantities(table(spark, d, "claim"), sources=(clean("extraction_version"),))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where("state <> 'same'").select(F.col("id").alias("claim_id"), "common_unit").distinct()


def p7_units(spark: SparkSession, d: str) -> DataFrame:
    """Every stated quantity in its common unit; changes of unit and lone deviations together, as SQL has no search for changes."""
    state = F.when(F.col("state").isin("unit_change", "deviation"), "shifted").otherwise(F.col("state"))
    return _units(spark, d).select(F.col("id").alias("claim_id"), "common_unit", "magnitude", "stored", state.alias("state")).distinct()


def p7_shifts(spark: SparkSession, d: str) -> DataFrame:
    """How often each source is off by a unit, by the factor to reverse, as a change over a run of its history or as a lone value."""
    version = table(spark, d, "claim").select("id", clean("extraction_version").alias("extraction_version")).distinct()
    moved = _units(spark, d).where("state in ('unit_change', 'deviation')").distinct().join(version, "id")
    return moved.groupBy("extraction_version", "common_unit", "state", "factor").agg(F.count(F.lit(1)).alias("claims"))


QUERIES = {"p7_found": p7_found, "p7_units": p7_units, "p7_shifts": p7_shifts, "p1_found": p1_found, "p1_trailing": p1_trailing, "p5_found": p5_found, "p5_report": p5_report}

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(160)"
_SPEND = f"""
with one as (
  select lower(trim(namespace, {_BLANKS})) as ns, cast(ts as date) as d, cast(coalesce(est_cost_usd, 0) as decimal(28, 9)) as usd
  from cost_event qualify row_number() over (partition by id order by loaded_at desc, ts desc, usd desc) = 1),
daily as (select ns, d, sum(usd) as usd, count(*) as n from one where ns is not null and d is not null group by 1, 2),
days as (select ns, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from daily group by 1),
totals as (
  select a.ns, a.d, cast(coalesce(sum(usd) filter (b.d > a.d - 7), 0) as double) as t7, cast(coalesce(sum(usd), 0) as double) as t30, coalesce(sum(n) filter (b.d > a.d - 7), 0) as n7, coalesce(sum(n), 0) as n30
  from days a left join daily b on a.ns = b.ns and b.d between a.d - 29 and a.d group by 1, 2)
"""


def _orphan_sql() -> str:
    parts = []
    for child, field, parent, key in (("claim", "entity_id", "entity", "id"), ("decision", "flag_id", "surfaced_flag", "flag_id"), ("decision", "fixture_pair_id", "fixture_pair", "fixture_pair_id")):
        parts.append(f"""
  select '{child}' as child_table, '{field}' as field_name, cast(c.id as varchar) as row_id, strftime(c.created_at, '%Y-%m') as year_month,
    case when p.k is null then 'missing' when p.deleted_at <= c.created_at then 'deleted' when p.created_at > c.created_at then 'late' end as reason
  from (select distinct id, lower(trim({field}, {_BLANKS})) as k, created_at from {child}) c
  left join (select lower(trim({key}, {_BLANKS})) as k, created_at, deleted_at from {parent}) p on p.k = c.k
  where c.k <> ''""")
    return "with o as (" + " union all ".join(parts) + ") "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quantity_sql(columns: str, raw_only: bool = False) -> str:
    """CTEs up to ``quantity``: distinct ``columns`` of claim with the quantity read (common, stated), by the same patterns freed of look-around."""
    number, unit = NUMBER.replace(r"(?!\d)", ""), unit_pattern().replace("(?iu:", "(?i:")
    gap, end = r"[ \t\x{a0}\x{202f}\x{2009}]*", r"(?:$|[\s\x{a0}\x{202f}\x{2009}(),;:/\]|]|\.(?:\s|$))"
    lead = r"^(?:approx\.?|≈|~|[ \t\x{a0}])*"
    rows = lambda t: ", ".join(f"({_quoted(s)}, {_quoted(u.common)}, {u.factor!r}::double, {u.offset!r}::double)" for s, u in t.items())
    own = f"nullif(regexp_extract(raw_value, {_quoted(f'{lead}{number}{gap}({unit}){end}')}, 1), '')"
    around = f"""nullif(regexp_extract(case when contains(span_text, trim(raw_value)) then list_last(string_split(span_text, trim(raw_value))) end, {_quoted(f"^{gap}({unit}){end}")}, 1), ''),
      nullif(regexp_extract(attribute, {_quoted(f"[(\\[]\\s*({unit})\\s*[)\\]]\\s*$")}, 1), '')"""
    return f"""
with exact(s, common, factor, off) as (values {rows(unit_table())}),
folded(s, common, factor, off) as (values {rows(unit_table() | folded_table())}),
read as (
  select distinct {columns}, regexp_extract(raw_value, {_quoted(f"{lead}({number}){gap}(?:{unit}{end}|$|\\(|max|min|nominal)")}, 1) as num, {own if raw_only else f"coalesce({own}, {around})"} as un from claim),
clean as (select *, regexp_replace(num, {_quoted("[\\s\\x{a0}\\x{202f}\\x{2009}'’]")}, '', 'g') as plain from read),
value as (select *, try_cast(case when regexp_matches(num, {_quoted("^[+-]?" + _GROUPED.replace("(?!\\d)", "") + "(?:[eE]|$)")}) then replace(plain, ',', '') else replace(plain, ',', '.') end as double) as v from clean where num <> ''),
quantity as (
  select value.*, coalesce(e.common, f.common) as common, v * coalesce(e.factor, f.factor) + coalesce(e.off, f.off) as stated
  from value left join exact e on e.s = un left join folded f on f.s = lower(un) where coalesce(e.common, f.common) is not null and v is not null)
"""


def _units_sql() -> str:
    return quantity_sql(f"id, normalized_magnitude as m, trim(normalized_unit, {_BLANKS}) as nu") + """,
both_read as (
  select q.*, coalesce(e2.common, f2.common) as common2, m * coalesce(e2.factor, f2.factor) + coalesce(e2.off, f2.off) as stored0
  from quantity q left join exact e2 on e2.s = nu left join folded f2 on f2.s = lower(nu)),
state as (
  select id as claim_id, common as common_unit, stated as magnitude, case when m is null or coalesce(nu, '') = '' then null else stored0 end as stored,
    case when m is null or coalesce(nu, '') = '' then 'missing' when common2 is null or common2 <> common then 'dimension'
      when abs(stored0 - stated) > 0.001 * greatest(abs(stored0), abs(stated)) then 'shifted' else 'same' end as state
  from both_read)
"""


SQL = {
    "p7_found": _units_sql() + "select distinct claim_id, common_unit from state where state <> 'same'",
    "p7_units": _units_sql() + "select distinct claim_id, common_unit, magnitude, stored, state from state",
    "p1_found": _SPEND + "select ns as namespace, strftime(d, '%Y-%m-%d') as event_day from totals where t7 = 0 and t30 > 0",
    "p1_trailing": _SPEND + """select ns as namespace, strftime(d, '%Y-%m-%d') as event_day, t7 as total_7, t30 as total_30, t7 / 7 as mean_day_7, t30 / 30 as mean_day_30,
  case when n7 > 0 then t7 / n7 end as mean_event_7, case when n30 > 0 then t30 / n30 end as mean_event_30, cast(n7 as bigint) as events_7, cast(n30 as bigint) as events_30 from totals""",
    "p5_found": _orphan_sql() + "select distinct child_table, field_name, row_id, reason, year_month from o where reason is not null",
    "p5_report": _orphan_sql() + "select child_table, field_name, year_month, reason, count(*) as orphans from (select distinct * from o where reason is not null) group by all",
}
