"""Totals and averages over trailing periods, idle days included.

An entity-calendar is range-joined to daily totals. Both sides carry a coarse date bucket as
wide as the longest period, so the range condition becomes an equi-join on (entity, bucket)
with a residual date test, and a daily total is copied to at most two buckets. The aggregate
groups by (entity, bucket, day), which the partitioning of the join already satisfies.

Events are reduced to one row per entity and day before anything is joined, so a hot entity
costs the join no more than its number of days. The daily totals are checkpointed: the calendar and
the join both read them, and events are read and freed of repeated deliveries only once.

Defined cases: a null or non-finite amount counts as zero; rows without an entity or a time are
left out; an empty input gives an empty result; extra columns are ignored; repeated rows of one
``key`` count once, the one with the greatest ``version`` (ties: the greatest time, then amount).
Amounts are summed as decimals with nine places, so totals are exact and independent of the order
of rows; amounts of 1e18 and more, which no such decimal holds, are summed beside them as floating
numbers. An average over a period divides by its length in days; ``mean_event_N`` divides by the
number of events and is null for a period without any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.text import col
from parallax.session import checkpoint


def latest_by_key(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. Rows whose key is null are all kept."""
    window = Window.partitionBy("__key", F.when(F.col("__key").isNull(), F.monotonically_increasing_id())).orderBy(*order)
    return df.withColumn("__key", key).withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__key", "__rank")


#: The largest amount that is summed as a decimal.
EXACT = 1e18


def daily_totals(events: DataFrame, entity: Column | str, ts: Column | str, amount: Column | str, key: Column | str | None = None, version: Column | str | None = None) -> DataFrame:
    """(entity, day, exact, large, events): one row for each entity and day with an event, day in days since 1970.

    ``exact`` is the sum of amounts below EXACT as a decimal, ``large`` that of the others, usually null.
    """
    value = col(amount).cast("double")
    usable = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value).otherwise(0.0)
    picked = [col(entity).alias("entity"), F.unix_date(F.to_date(col(ts))).alias("day"), col(ts).alias("__ts"), usable.alias("amount")]
    if key is not None:
        picked += [col(key).alias("__id"), (col(version) if version is not None else F.lit(0)).alias("__version")]
    rows = events.select(*picked)
    if key is not None:
        rows = latest_by_key(rows, F.col("__id"), [F.desc("__version"), F.desc("__ts"), F.desc("amount"), F.asc("entity")])
    small = F.abs("amount") < EXACT
    return rows.where("entity is not null and day is not null").groupBy("entity", "day").agg(
        F.coalesce(F.sum(F.when(small, F.col("amount")).cast("decimal(28,9)")), F.lit(0).cast("decimal(38,9)")).alias("exact"),
        F.sum(F.when(~small, F.col("amount"))).alias("large"), F.count(F.lit(1)).alias("events"),
    )


def trailing_totals(
    events: DataFrame,
    entity: Column | str,
    ts: Column | str,
    amount: Column | str,
    *,
    key: Column | str | None = None,
    version: Column | str | None = None,
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """(entity, day date, total_N, mean_day_N, mean_event_N, events_N for each period of N days ending that day)."""
    longest = max(periods)
    daily = checkpoint(daily_totals(events, entity, ts, amount, key, version))
    calendar = (
        daily.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
        .select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
        .withColumn("bucket", F.floor(F.col("day") / longest))
    )
    first, last = F.floor(F.col("day") / longest), F.floor((F.col("day") + longest - 1) / longest)
    facts = daily.select(F.col("entity").alias("f_entity"), F.col("day").alias("f_day"), "exact", "large", "events", F.explode(F.array_distinct(F.array(first, last))).alias("f_bucket"))
    within = (F.col("entity") == F.col("f_entity")) & (F.col("bucket") == F.col("f_bucket")) & F.col("f_day").between(F.col("day") - (longest - 1), F.col("day"))
    sums = []
    for n in periods:
        recent = F.col("f_day") > F.col("day") - n
        sums += [F.sum(F.when(recent, F.col(c))).alias(f"{c}_{n}") for c in ("exact", "large", "events")]
    joined = calendar.join(facts, within, "left").groupBy("entity", "bucket", "day").agg(*sums)
    out = [F.col("entity"), F.date_from_unix_date("day").alias("day")]
    for n in periods:
        total = F.coalesce(F.col(f"exact_{n}").cast("double"), F.lit(0.0)) + F.coalesce(f"large_{n}", F.lit(0.0))
        count = F.coalesce(f"events_{n}", F.lit(0))
        out += [total.alias(f"total_{n}"), (total / n).alias(f"mean_day_{n}"), F.when(count > 0, total / count).alias(f"mean_event_{n}"), count.alias(f"events_{n}")]
    return joined.select(*out)
