"""The review's logs as streams: late and repeated deliveries, windowed spend, idempotent upserts. An extension; batch operators do the same on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.sources.store import Table


def first_deliveries(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once, if its repeats come within ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_spend(stream: DataFrame, ts: str, amount: str, by: Sequence[Column | str], width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(from, to, by, events, total) of tumbling or sliding windows; rows later than ``late`` are dropped, as is usual for windows that must close."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))
    return rows.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), *[c for c in rows.columns if c not in ("w", "events", "total")], "events", "total")


def sessions(stream: DataFrame, ts: str, by: Sequence[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(by, from, to, events) of activity without a pause of ``gap``."""
    rows = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(*by, F.col("s.start").alias("from"), F.col("s.end").alias("to"), "events")


def upsert_stream(stream: DataFrame, table: Table, keys: Sequence[str], checkpoint: str, update: Sequence[str] | None = None):
    """A query that merges every micro-batch into ``table``; a batch that runs again leaves the table as it was."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.merge(batch, keys, update)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
