"""Duplicates of one fact across extraction lanes of one document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.scalars import first_number, value_form


def lane_priority() -> Column:
    """Vision, then model text, then patterns; a pattern record with a bare number as its tag ranks with model text."""
    marker = F.coalesce(F.col("entity_tag"), F.lit("")).rlike(r"^\d+$")
    return F.when(F.col("extraction_lane") == "vision", 0).when((F.col("extraction_lane") == "llm_text") | marker, 1).otherwise(2)


def _alike(a: dict, b: dict, tolerance: float) -> bool:
    near = lambda x, y: abs(x - y) <= tolerance * max(abs(x), abs(y))
    if a["m"] is not None and b["m"] is not None:
        return (not a["u"] or not b["u"] or a["u"] == b["u"]) and near(a["m"], b["m"])
    return (a["form"] == b["form"] and a["form"] != "") or (a["first"] is not None and b["first"] is not None and near(a["first"], b["first"]))


def _repeats(rows: list[dict], tolerance: float) -> list:
    """Ids of rows that repeat a kept one of another lane."""
    kept, dropped = [], []
    for r in sorted(rows, key=lambda r: (r["rank"], r["ord"], r["id"])):
        if any(k["lane"] != r["lane"] and _alike(k, r, tolerance) for k in kept):
            dropped.append(r["id"])
        else:
            kept.append(r)
    return dropped


def drop_lane_duplicates(records: DataFrame, keys: Sequence[str] = ("doc_id",), tolerance: float = 1e-3) -> DataFrame:
    """``records`` without those that repeat a kept record of another lane on the same page under the same name.

    Records are taken by lane priority; one is compared only with those kept, so likeness does not chain. Only
    groups with several lanes are gathered; a group is one name on one page of one document.
    """
    group = [*keys, "page", "name"]
    row = F.struct(
        F.col("record_id").alias("id"), "ord", F.col("extraction_lane").alias("lane"), lane_priority().alias("rank"), F.col("normalized_magnitude").alias("m"), F.coalesce("normalized_unit", F.lit("")).alias("u"),
        value_form("raw_value").alias("form"), first_number("raw_value").alias("first"),
    )
    mixed = records.groupBy(*group).agg(F.min("extraction_lane").alias("lo"), F.max("extraction_lane").alias("hi"), F.collect_list(row).alias("rows")).where("lo <> hi").select("rows")
    kind = records.schema["record_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [i for rows in b.column(0).to_pylist() for i in _repeats(rows, tolerance)]
            yield pa.RecordBatch.from_arrays([pa.array(gone, b.column(0).type.value_type.field("id").type)], names=["record_id"])

    gone = mixed.mapInArrow(run, f"record_id {kind.simpleString()}")
    return records.join(gone, "record_id", "left_anti")


def keep_best(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The exact case: one row for each key, the first in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
