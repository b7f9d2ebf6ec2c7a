"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parallax.queries import problems, reference, steps

QUERIES = {**reference.QUERIES, **steps.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **steps.SQL, **problems.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: orders reviewed against the totals of their lines."""
    return QUERIES["review_totals"](spark, sf_dir)
