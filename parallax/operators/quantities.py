"""Quantities recorded in different units: common units, and unit changes in the history of a source.

Every claim is read from its text into the common unit of its dimension. Where the source also
stored a magnitude and a unit, the logarithm of stored over stated value is a series in time, one for each
source and dimension. Each series is segmented by an exact penalised changepoint search: its levels are zero and the
logarithms of the known ratios of two units that occur; a row costs its squared distance from the level in noise widths,
at most that of an outlier; every change of level costs a penalty of 2 log n (a place and a level, as in the Bayesian
criterion, n of the longest series) and one outlier, so that no change rests on one row. A row on a segment's level other than zero belongs to a unit change, whose factor is reversed; a row off
the level of its segment is a lone deviation. So a run of a few rows in another unit is a change, and a single wrong value is none.

Scale: series are cut into slices of time, so that a slice of the longest has ``block`` rows on the average, and slices
are spread by hash. Cuts are not forced changes: of every slice the least costs from each level before it to each
level at its end are composed along the series (one small matrix a slice), and the slice is searched with what comes
before and after it. Equal neighbours are merged first. Results do not depend on ``block``.

Defined cases: null text or no number with a unit gives no quantity; a stored magnitude or unit
that is null or blank is ``missing``; an unreadable stored unit or one of another dimension is
``dimension``; a pair without a ratio (zero or unlike signs) is compared directly; rows without a time come first in
their series; empty input gives an empty result; rows keep their extra columns out of the result; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.functions.text import col, is_blank
from parallax.functions.units import to_common, unit_table, with_quantity, with_stored_unit
from parallax.session import checkpoint

#: The cost of an outlier: the tolerance is this many noise widths, squared.
OUTLIER = 9.0


def row_costs(values: np.ndarray, levels: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Run of every value, and the cost of each run at each level; values are read on a grid of a quarter noise width."""
    width = math.log1p(tolerance) / math.sqrt(OUTLIER)
    grid = np.round(values / (width / 4))
    run = np.cumsum(np.concatenate([[0], grid[1:] != grid[:-1]])).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], grid[1:] != grid[:-1]]))
    off = ((grid[start] * (width / 4))[:, None] - levels[None, :]) / width
    return run, np.minimum(off * off, OUTLIER) * np.bincount(run)[:, None]


def passage_costs(costs: np.ndarray, penalty: float) -> np.ndarray:
    """Least cost from each level before the rows to each level at their end."""
    k = costs.shape[1]
    total = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    for c in costs:
        total = np.minimum(total, total.min(axis=1, keepdims=True) + penalty) + c
    return total


def best_levels(costs: np.ndarray, penalty: float, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The level of each run on the cheapest path, given the cost of each level before and after; exact (Viterbi)."""
    n, k = costs.shape
    back = np.empty((n, k), np.int16)
    own, total = np.arange(k), before
    for t in range(n):
        j = int(np.argmin(total))
        change = total > total[j] + penalty
        back[t] = np.where(change, j, own)
        total = np.where(change, total[j] + penalty, total) + costs[t]
    path = np.empty(n, np.int64)
    at = int(np.argmin(total + after))
    for t in range(n - 1, -1, -1):
        path[t] = at
        at = int(back[t, at])
    return path


def slice_borders(passages: Sequence[np.ndarray], penalty: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each slice of a series in time order the cost of each level before it and after it; a series starts without a shift."""
    k = passages[0].shape[0]
    before = [np.where(np.arange(k) == 0, 0.0, penalty)]
    for p in passages[:-1]:
        v = (before[-1][:, None] + p).min(axis=0)
        before.append(v - v.min())
    after = [np.zeros(k)]
    for p in reversed(passages[1:]):
        v = (p + after[-1][None, :]).min(axis=1)
        after.append(v - v.min())
    return list(zip(before, reversed(after), strict=True))


@cache
def unit_factors() -> dict[str, np.ndarray]:
    """The logarithms of all ratios between two units of one dimension."""
    factors: dict[str, set[float]] = {}
    for u in unit_table().values():
        factors.setdefault(u.common, set()).add(float(f"{u.factor:.12g}"))
    return {c: np.unique([float(f"{math.log(a / b):.9g}") for a in f for b in f if a != b]) for c, f in factors.items()}


def nearest_factor(common: str, values: np.ndarray, tolerance: float) -> np.ndarray:
    """For each value the logarithm of the known ratio that it equals, else not-a-number."""
    known = unit_factors().get(common, np.empty(0))
    if not len(known):
        return np.full(len(values), np.nan)
    i = np.clip(np.searchsorted(known, values), 1, max(1, len(known) - 1))
    near = known[np.minimum(i, len(known) - 1)]
    near = np.where(np.abs(known[i - 1] - values) < np.abs(near - values), known[i - 1], near)
    return np.where(np.abs(near - values) <= math.log1p(tolerance), near, np.nan)


def _occurring(rows: DataFrame, tolerance: float) -> dict[str, np.ndarray]:
    """Zero and the known ratios that occur, for each dimension; their number is bounded by the unit table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for common, own in b.groupby("common"):
                hit = nearest_factor(common, own["log_ratio"].to_numpy(float), tolerance)
                hit = np.unique(hit[~np.isnan(hit)])
                yield pd.DataFrame({"common": pd.Series([common] * len(hit), dtype=object), "level": hit})

    found = rows.where(F.abs("log_ratio") > math.log1p(tolerance)).select("common", "log_ratio").mapInPandas(run, "common string, level double").distinct().collect()
    levels: dict[str, list[float]] = {}
    for r in found:
        levels.setdefault(r.common, []).append(r.level)
    return {c: np.array([0.0, *sorted(v)]) for c, v in levels.items()}


def segmented(rows: DataFrame, history: Sequence[str], *, tolerance: float, penalty: float | None, block: int) -> DataFrame:
    """``rows`` (history, at, key, log_ratio, stored, stated, ...) with level and factor: the logarithm and the ratio of the segment's shift."""
    micros = F.coalesce(F.unix_micros("at"), F.lit(None).cast("bigint"))
    size = rows.groupBy(*history).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    ends = rows.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    slices = max(1, -(-size // block))
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // slices + 1)
    cost = OUTLIER + 2 * math.log(max(size, 2)) if penalty is None else penalty
    levels = _occurring(rows, tolerance)
    cut = rows.withColumn("slice", F.coalesce(F.floor((micros - F.lit(ends["lo"] or 0)) / F.lit(width)), F.lit(0)).cast("bigint"))

    def costs_of(own: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        own = own.astype({c: object for c in own.columns if own[c].dtype.name in ("str", "string")})  # in one piece, whatever batches it came in
        own = own.sort_values(["at", "key"], na_position="first", kind="stable")
        ladder = levels.get(own["common"].iloc[0], np.zeros(1))
        return own, ladder, *row_costs(own["log_ratio"].to_numpy(float), ladder, tolerance)

    def search(own: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in [*own.columns, "level", "shift"]})
        own, ladder, run, costs = costs_of(own)
        before, after = (borders["before"].iloc[0], borders["after"].iloc[0]) if len(borders) else (np.where(np.arange(len(ladder)) == 0, 0.0, cost), np.zeros(len(ladder)))
        level = ladder[best_levels(costs, cost, np.asarray(before, float), np.asarray(after, float))[run]]
        near = nearest_factor(own["common"].iloc[0], own["log_ratio"].to_numpy(float), tolerance)
        return own.assign(level=level, shift=np.where(np.isnan(near), np.nan, [float(f"{math.exp(x):.7g}") if x == x else math.nan for x in near]))

    def passage(own: pd.DataFrame) -> pd.DataFrame:
        own, _, _, costs = costs_of(own)
        return own[[*history, "slice"]].iloc[:1].assign(cost=[passage_costs(costs, cost).ravel().tolist()])

    def compose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.astype({h: object for h in history}).sort_values("slice")
        k = math.isqrt(len(own["cost"].iloc[0]))
        borders = slice_borders([np.asarray(c, float).reshape(k, k) for c in own["cost"]], cost)
        return own[[*history, "slice"]].assign(before=[b.tolist() for b, _ in borders], after=[a.tolist() for _, a in borders])

    keys = ", ".join(f"`{h}` string" for h in history) + ", slice bigint"
    group = [*history, "slice"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", level double, shift double"
    if slices == 1:  # every series is one slice: nothing comes before or after
        return cut.groupBy(*group).applyInPandas(lambda own: search(own, pd.DataFrame()), out)
    borders = cut.select(*group, "at", "key", "log_ratio").groupBy(*group).applyInPandas(passage, keys + ", cost array<double>").groupBy(*history).applyInPandas(compose, keys + ", before array<double>, after array<double>")
    return cut.groupBy(*group).cogroup(borders.groupBy(*group)).applyInPandas(search, out)


def unify_quantities(
    claims: DataFrame,
    key: str = "id",
    *,
    raw: str = "raw_value",
    span: str | None = "span_text",
    name: str | None = "attribute",
    magnitude: str = "normalized_magnitude",
    unit: str = "normalized_unit",
    sources: Sequence[str] = ("extraction_version",),
    time: str = "created_at",
    tolerance: float = 1e-3,
    penalty: float | None = None,
    block: int = 500_000,
) -> DataFrame:
    """(key, common_unit, magnitude, stored, state, level, factor, repaired): one row for each claim that states a quantity.

    ``state`` is same, missing, dimension, unit_change (on the level of a segment that a known ratio shifts) or
    deviation (off the level of its segment, or without a ratio); ``level`` is the logarithm of the segment's shift, ``factor`` the known unit ratio that the row
    is off by, if any; ``repaired`` is the stored value with the factor reversed; ``magnitude`` is the stated value in common units.
    """
    named = {"raw": raw, "span": span, "name": name}
    rows = claims.select(
        col(key).alias("key"), *[col(c).alias(f"__{k}") for k, c in named.items() if c], col(magnitude).cast("double").alias("m"), col(unit).alias("unit"),
        *[col(c).cast("string").alias(f"s{i}") for i, c in enumerate(sources)], col(time).cast("timestamp").alias("at"),
    )
    rows = with_quantity(rows, "q", "__raw", "__span" if span else None, "__name" if name else None).where("q is not null")
    rows = with_stored_unit(rows, "u", "unit").withColumn("absent", F.col("m").isNull() | F.isnan("m") | is_blank("unit"))
    rows = rows.select("key", "at", *[f"s{i}" for i in range(len(sources))], F.col("q.common").alias("common"), F.col("q.magnitude").alias("stated"),
                       F.when(~F.col("absent"), to_common(F.col("m"), F.col("u"))).alias("stored"),
                       F.when(F.col("absent"), "missing").when(F.col("u").isNull() | (F.col("u.common") != F.col("q.common")), "dimension").alias("state"))
    ratio = F.when(F.col("state").isNull() & (F.col("stated") * F.col("stored") > 0), F.log(F.col("stored") / F.col("stated")))
    rows = checkpoint(rows.withColumn("log_ratio", ratio))  # read below for sizes and levels, the segments and the rest
    history = ["common", *[f"s{i}" for i in range(len(sources))]]
    wide = math.log1p(tolerance)
    differs = F.abs(F.col("stored") - F.col("stated")) > tolerance * F.greatest(F.abs("stated"), F.abs("stored"))
    levelled = segmented(rows.where("log_ratio is not null").drop("state"), history, tolerance=tolerance, penalty=penalty, block=block).drop("slice")
    changed = (F.col("level") != 0) & (F.abs(F.col("log_ratio") - F.col("level")) <= wide)
    moved = levelled.withColumn("state", F.when(changed & differs, "unit_change").when(differs, "deviation").otherwise("same")).withColumn("shift", F.when(differs & ~F.isnan("shift"), F.col("shift")))
    rest = rows.where("log_ratio is null").withColumn("level", F.lit(None).cast("double")).withColumn("shift", F.lit(None).cast("double"))
    rest = rest.withColumn("state", F.coalesce("state", F.when(differs, "deviation").otherwise("same")))
    return moved.unionByName(rest).select(
        F.col("key").alias(key), F.col("common").alias("common_unit"), F.col("stated").alias("magnitude"), "stored", "state", "level", F.col("shift").alias("factor"), (F.col("stored") / F.coalesce("shift", F.lit(1.0))).alias("repaired")
    )
