"""Text expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a blank at the ends of a key or a name.
BLANKS = " \t\n\r\f\x0b\x85\xa0               　﻿"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Outer blanks of any kind removed (Spark's own trim knows only the space)."""
    return F.btrim(col(c), F.lit(BLANKS))


def clean(c: Column | str) -> Column:
    """Lower case with outer blanks removed; null stays null."""
    return F.lower(strip(c))


def squash(c: Column | str) -> Column:
    """Outer blanks removed, inner runs of blanks made one space."""
    return strip(F.regexp_replace(col(c), r"[\s  -   　]+", " "))


def fold(c: Column | str) -> Column:
    """Compared without case and surplus blanks."""
    return F.lower(squash(c))


def is_blank(c: Column | str) -> Column:
    """Null, empty or made of blanks only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def settle(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with the values computed once per row, as columns that no filter reaches through.

    A filter on an ordinary column is pushed below it with its whole expression, which is then evaluated again for
    every reference; a generator in between stops that. Meant for expensive text expressions.
    """
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    rows = df.select(*[c for c in df.columns if c not in values], F.explode(F.array(one)).alias("__settled"))
    return rows.select(*[c for c in df.columns if c not in values], *[F.col(f"__settled.{k}").alias(k) for k in values])
