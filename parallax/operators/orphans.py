"""References to records that do not exist: missing, deleted or arriving later.

The keys of each link (a child column and its parent table) are spread over key ranges by hash.
One co-grouped pass per range encodes the keys of both sides as integers (a dictionary local to
the range), builds one compressed bitmap of references for every period and one of the parents
that stand through the whole period, computes references AND-NOT parents and decodes the
surviving bits to keys. Survivors, with the life of their parents, are joined back to the child
rows, where the instants are compared; a parent made or removed inside the period is settled
there.

Scale: references are reduced to distinct (key, period) before the shuffle, so a key that a third
of all rows uses costs one bit. The number of ranges follows the row counts, so a group stays
bounded. The join back is an ordinary equi-join that adaptive execution may split.

Defined cases: null and blank references are no cases; null child times fall in the period null
and are only ever ``missing``; a parent without a creation time has always existed; several
parents with one key count as one that stands when any of them does; repeated child rows count
once; empty inputs give an empty result. Columns are picked by name and renamed, so clashing
extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.text import clean

ARRAY_LIMIT = 4096  # a container of more than this is cheaper as 8 KiB of bits


class Bitmap:
    """A set of integers in containers of 2**16: sorted 16-bit arrays where sparse, bits where dense."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self.containers = containers

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_LIMIT:
            return low.astype(np.uint16)
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _unpack(container: np.ndarray) -> np.ndarray:
        return container if container.dtype == np.uint16 else np.flatnonzero(np.unpackbits(container)).astype(np.uint16)

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(np.asarray(codes, np.int64))
        high = codes >> 16
        return cls({int(h): cls._pack((codes[high == h] & 0xFFFF)) for h in np.unique(high)})

    def and_not(self, other: Bitmap) -> Bitmap:
        left = {}
        for h, own in self.containers.items():
            theirs = other.containers.get(h)
            if theirs is None:
                left[h] = own
            elif own.dtype != np.uint16 and theirs.dtype != np.uint16:
                rest = self._unpack(own & ~theirs)
                if len(rest):
                    left[h] = self._pack(rest)
            else:
                rest = np.setdiff1d(self._unpack(own), self._unpack(theirs), assume_unique=True)
                if len(rest):
                    left[h] = self._pack(rest)
        return Bitmap(left)

    def codes(self) -> np.ndarray:
        parts = [(h << 16) + self._unpack(c).astype(np.int64) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


@dataclass(frozen=True)
class Link:
    """``child_table.field_name`` refers to ``parent_key`` of the parent table."""

    child_table: str
    field_name: str
    child: DataFrame
    row_id: str
    child_key: str
    child_ts: str
    parent: DataFrame
    parent_key: str
    parent_created: str | None = None
    parent_deleted: str | None = None


NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _micros(c: str) -> Column:
    """Microseconds of a time, with or without a zone, by one rule for both sides."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _survivors(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    columns = ["link", "key", "period", "lives"]
    if not len(refs):
        return pd.DataFrame({c: [] for c in columns})
    words, code = np.unique(np.concatenate([refs["key"].to_numpy(object), parents["key"].to_numpy(object)]), return_inverse=True)
    ref_code, parent_code = code[: len(refs)], code[len(refs) :]
    created = parents["created"].to_numpy(np.int64) if len(parents) else np.empty(0, np.int64)
    deleted = parents["deleted"].to_numpy(np.int64) if len(parents) else np.empty(0, np.int64)
    order = np.argsort(parent_code, kind="stable")
    sorted_code = parent_code[order]
    out = []
    for period, own in refs.groupby("period", sort=False, dropna=False).indices.items():
        lo, hi = (int(refs[c].iat[own[0]]) for c in ("lo", "hi"))
        standing = Bitmap.of(parent_code[(created <= lo) & (deleted > hi)])
        for c in Bitmap.of(ref_code[own]).and_not(standing).codes():
            at = order[np.searchsorted(sorted_code, c) : np.searchsorted(sorted_code, c, "right")]
            out.append((refs["link"].iat[0], words[c], period, [{"created": int(created[i]), "deleted": int(deleted[i])} for i in at]))
    return pd.DataFrame(out, columns=columns)


def _sides(links: Sequence[Link], unit: str) -> tuple[DataFrame, DataFrame]:
    """Child rows (link, row_id, key, at, period, lo, hi) and parent lives (link, key, created, deleted) of all links."""
    step = {"day": "interval 1 day", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    label = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    children, parents = [], []
    for k, x in enumerate(links):
        own = x.child.select(F.lit(k).alias("link"), F.col(x.row_id).cast("string").alias("row_id"), clean(x.child_key).alias("key"), F.col(x.child_ts).cast("timestamp_ntz").alias("__ts"))
        own = own.withColumn("__from", F.date_trunc(unit, "__ts").cast("timestamp_ntz")).withColumn("__to", F.col("__from") + F.expr(step))
        children.append(own.where("key is not null and key <> ''").select(
            "link", "row_id", "key", _micros("__ts").alias("at"), F.coalesce(F.date_format("__ts", label), F.lit("")).alias("period"),
            F.coalesce(_micros("__from"), F.lit(ALWAYS)).alias("lo"), F.coalesce(_micros("__to"), F.lit(ALWAYS)).alias("hi"),
        ))
        made = F.coalesce(_micros(x.parent_created), F.lit(ALWAYS)) if x.parent_created else F.lit(ALWAYS)
        gone = F.coalesce(_micros(x.parent_deleted), F.lit(NEVER)) if x.parent_deleted else F.lit(NEVER)
        parents.append(x.parent.select(F.lit(k).alias("link"), clean(x.parent_key).alias("key"), made.alias("created"), gone.alias("deleted")).where("key is not null and key <> ''"))
    return reduce(DataFrame.unionByName, children), reduce(DataFrame.unionByName, parents)


def orphan_references(links: Sequence[Link], *, unit: str = "month", keys_per_range: int = 1 << 16) -> DataFrame:
    """(child_table, field_name, row_id, reason, period): reason is missing, deleted or late.

    ``period`` is the day, month or year of the child row, null where it has no time.
    """
    children, parents = _sides(links, unit)
    rows = sum(x.child.count() + x.parent.count() for x in links)
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // keys_per_range))))
    refs = children.select("link", "key", "period", "lo", "hi").distinct().withColumn("shard", shard)
    lives = parents.distinct().withColumn("shard", shard)
    left = (
        refs.groupBy("link", "shard").cogroup(lives.groupBy("link", "shard"))
        .applyInPandas(_survivors, "link int, key string, period string, lives array<struct<created: bigint, deleted: bigint>>")
    )
    found = children.select("link", "row_id", "key", "at", "period").join(left, ["link", "key", "period"])
    stands = F.exists("lives", lambda p: (p.created <= F.col("at")) & (p.deleted > F.col("at")))
    reason = (
        F.when(F.size("lives") == 0, "missing").when(F.col("at").isNull() | stands, F.lit(None))
        .when(F.forall("lives", lambda p: p.created > F.col("at")) & F.exists("lives", lambda p: p.deleted > F.col("at")), "late").otherwise("deleted")
    )
    names = F.array(*[F.struct(F.lit(x.child_table).alias("t"), F.lit(x.field_name).alias("f")) for x in links])
    return (
        found.withColumn("reason", reason).where("reason is not null").withColumn("n", names[F.col("link")])
        .select(F.col("n.t").alias("child_table"), F.col("n.f").alias("field_name"), "row_id", "reason", F.nullif("period", F.lit("")).alias("period")).distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(child_table, field_name, period, reason, orphans): how many references lead nowhere per table and period."""
    return orphans.groupBy("child_table", "field_name", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))
