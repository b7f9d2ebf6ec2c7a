"""Best representative of each duplicate group, chosen field by field by dominance.

Claims are duplicates when their keys agree and their values, in common units, agree within a tolerance.
Each row is a point: which of its fields are usable (one dimension per field), trust and recency. The
skyline of a group is the rows that no other row equals or beats on all of these; the dominance
layers follow by peeling. A field takes its value from the first layer that has a usable one, and there
from the row of highest trust, then latest, then smallest id. As usability is judged per field, this
is the best usable row of the whole group: a row that beats it is usable too.

Scale: keys travel as two 64-bit hashes. Before any group is gathered, rows are reduced map-side to one for each (key, bin of the value, usable fields, trust):
among those the latest dominates the rest, so no layer that is read loses a row. Bins are narrower than the tolerance. What is left of a
key, however hot, is at most 2**fields times the number of trust levels for each of its bins; it is put in order of value, chained where
neighbours are within the tolerance, and reduced again, all on one partitioning.

Defined cases: rows without a quantity in the value form no groups; null parts of a key count as blank;
an unknown extractor has the least trust; repeated rows of one id count once; groups of one id are
left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bin(value: Column, tolerance: float = 1e-3) -> tuple[Column, Column]:
    """Sign and logarithmic bin of half the tolerance; zero has bin 0 of sign 0."""
    return F.signum(value).cast("int"), F.when(value == 0, 0).otherwise(F.floor(F.log(F.abs(value)) / (math.log1p(tolerance) / 2)))


def skyline_layers(points: Sequence[tuple]) -> list[int]:
    """For each point the number of its dominance layer, 0 for the undominated; larger is better on every dimension."""
    layer, left, k = [-1] * len(points), set(range(len(points))), 0
    while left:
        top = [i for i in left if not any(j != i and points[j] != points[i] and all(b >= a for a, b in zip(points[i], points[j], strict=True)) for j in left)]
        for i in top:
            layer[i] = k
        left -= set(top)
        k += 1
    return layer


def pick_survivors(rows: Sequence[dict], fields: int) -> list[str]:
    """For each field the id of the surviving row, '' if none; rows have usable (a bit per field), trust, at, id."""
    flags = [[r["usable"] >> k & 1 for k in range(fields)] for r in rows]
    layers = skyline_layers([(*f, r["trust"], r["at"]) for f, r in zip(flags, rows, strict=True)])
    out = []
    for k in range(fields):
        usable = [(layers[i], -r["trust"], -r["at"], r["id"]) for i, r in enumerate(rows) if flags[i][k]]
        out.append(min(usable)[-1] if usable else "")
    return out


def surviving_records(rows: DataFrame, keys: Sequence[str], *, id: str, value: str, fields: Mapping[str, Column], trust: Column, time: Column, tolerance: float = 1e-3) -> DataFrame:
    """(group_id, F_from for each field): of every group of two ids or more, the id whose value of the field survives, '' if none.

    ``fields`` says for each field whether a row's value is usable.
    """
    sign, bin_ = value_bin(F.col(value), tolerance)
    usable = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(fields.values())), F.lit(0))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    points = rows.where(F.col(value).isNotNull()).select(
        F.xxhash64(F.lit(0), *parts).alias("h0"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.col(id).cast("string").alias("id"), F.abs(value).alias("v"), sign.alias("sign"), bin_.alias("bin"),
        usable.alias("usable"), F.coalesce(trust.cast("int"), F.lit(-1)).alias("trust"), F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(-(1 << 62))).alias("at"),
    ).where("id is not null").withColumn("ident", F.xxhash64("id"))
    # The latest row, of those the smallest id; whether there are two ids shows in their hashes.
    latest = F.min(F.struct(F.negative("at").alias("age"), "id")).alias("first")
    reduced = points.groupBy("h0", "h1", "sign", "bin", "usable", "trust").agg(latest, F.min("id").alias("lowest"), F.min("ident").alias("i0"), F.max("ident").alias("i1"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    key = ["h0", "h1", "sign"]
    by = Window.partitionBy(*key).orderBy("lo", "hi", "usable", "trust")
    opens = F.coalesce(F.col("lo") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)) * (1 + tolerance), F.lit(True))
    chained = reduced.withColumn("opens", opens.cast("int")).withColumn("chain", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.groupBy(*key, "chain", "usable", "trust").agg(F.min("first").alias("first"), F.min("lowest").alias("lowest"), F.min("i0").alias("i0"), F.max("i1").alias("i1"))
    groups = (
        merged.groupBy(*key, "chain").agg(F.collect_list(F.struct("usable", "trust", F.negative("first.age").alias("at"), "first.id")).alias("rows"), F.min("lowest").alias("lowest"), F.min("i0").alias("i0"), F.max("i1").alias("i1"))
        .where("i0 <> i1").select("lowest", "rows")
    )

    out = [f"{f}_from" for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = [pick_survivors(rows, len(out)) for rows in b.column(1).to_pylist()]
            columns = [pa.array([p[k] for p in picked], b.column(0).type) for k in range(len(out))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["group_id", *out])

    return groups.mapInArrow(run, "group_id string, " + ", ".join(f"{f}_from string" for f in fields))
