import datetime as dt
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from parallax.operators.orphans import Bitmap, Link, orphan_references, orphan_report
from parallax.operators.quantities import best_levels, passage_costs, slice_borders, unify_quantities
from parallax.operators.trailing import trailing_totals

EVENT = "id bigint, ts timestamp_ntz, est_cost_usd double, namespace string, loaded_at timestamp_ntz, entity string, day string"


def at(day, hour=1):
    return dt.datetime(2025, 3, 1, hour) + dt.timedelta(days=day)


def totals(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], EVENT)
    return {(r.entity, r.day): r for r in trailing_totals(df, F.lower(F.trim("namespace")), "ts", "est_cost_usd", key="id", version="loaded_at", **more).collect()}


def test_trailing_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, at(rnd.randint(0, 90)), rnd.choice([None, 0.0, 0.25, 1.5]), rnd.choice(["a", "A ", "b"]), at(100)) for k in range(120)]
    got = totals(spark, rows)
    for name in "ab":
        own = [(r[1].date(), r[2] or 0.0) for r in rows if r[3].strip().lower() == name]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own)
        days = [lo + dt.timedelta(days=k) for k in range((hi - lo).days + 1)]
        assert {d for n, d in got if n == name} == set(days)
        for d in days:
            for n in (7, 30):
                inside = [v for e, v in own if d - dt.timedelta(days=n - 1) <= e <= d]
                r = got[name, d]
                assert abs(r[f"total_{n}"] - sum(inside)) < 1e-9 and r[f"events_{n}"] == len(inside)
                assert (r[f"mean_event_{n}"] is None) == (not inside)


def test_trailing_defined_cases(spark):
    rows = [(1, at(0), 1.0, "a", at(0)), (1, at(0), 3.0, "a", at(5)), (1, at(0), 3.0, "a", at(5)), (2, None, 9.0, "a", at(0)), (3, at(2), 5.0, None, at(0)), (4, at(3), float("nan"), "a", at(0)), (None, at(1), 2.0, "a", at(0)), (None, at(1), 2.0, "a", at(0))]
    got = totals(spark, rows)
    assert {k[0] for k in got} == {"a"} and len(got) == 4
    assert got["a", at(3).date()].total_7 == 7.0  # the restated 3, and both rows without an id
    assert totals(spark, []) == {}


def test_trailing_large_amounts(spark):
    """No amount is too large to count; those beyond decimals are summed as floating numbers, infinite ones count as zero."""
    got = totals(spark, [(1, at(0), 1e10, "a", at(0)), (2, at(0), 0.1, "a", at(0)), (3, at(1), 1e300, "a", at(0)), (4, at(2), float("inf"), "a", at(0)), (5, at(40), -2e10, "a", at(0))])
    assert got["a", at(0).date()].total_7 == 1e10 + 0.1 and got["a", at(1).date()].total_7 == 1e300 and got["a", at(2).date()].total_7 == 1e300
    assert got["a", at(40).date()].total_30 == -2e10


def test_trailing_hot_entity_plan(spark):
    df = spark.range(50_000).select(F.col("id"), (F.lit(at(0)) + F.expr("make_dt_interval(cast(id % 300 as int))")).alias("ts"), F.lit(1.0).alias("est_cost_usd"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 50)).alias("namespace"), F.lit(at(0)).alias("loaded_at"))
    out = trailing_totals(df, F.col("namespace"), "ts", "est_cost_usd", key="id", version="loaded_at")
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    assert out.where("entity = 'hot'").count() == 298


def test_bitmap():
    rnd = np.random.default_rng(1)
    for size in (0, 10, 5000, 60_000):
        a, b = (np.unique(rnd.integers(0, 200_000, size)) for _ in range(2))
        assert Bitmap.of(a).and_not(Bitmap.of(b)).codes().tolist() == np.setdiff1d(a, b).tolist()


def link(spark, children, parents, keys_per_range=1 << 16):
    c = spark.createDataFrame(children, "id bigint, ref string, created_at timestamp_ntz, deleted_at timestamp_ntz, key string")
    p = spark.createDataFrame(parents, "pid string, created_at timestamp_ntz, deleted_at timestamp_ntz, key string")
    x = Link("child", "ref", child=c, row_id="id", child_key="ref", child_ts="created_at", parent=p, parent_key="pid", parent_created="created_at", parent_deleted="deleted_at")
    return orphan_references([x], keys_per_range=keys_per_range)


def test_orphans(spark):
    children = [(1, " A ", at(10), None, "k"), (2, "gone", at(40), None, "k"), (3, "late", at(10), None, "k"), (4, "none", at(10), None, "k"), (4, "none", at(10), None, "k"), (5, None, at(1), None, "k"), (6, "  ", at(1), None, "k"), (7, "gone", at(2), None, "k"), (8, "none", None, None, "k"), (9, "a", None, None, "k"), (10, "twice", at(10), None, "k")]
    parents = [("a", at(0), None, "z"), ("gone", at(0), at(40), "z"), ("late", at(12), None, "z"), ("twice", at(50), None, "z"), ("TWICE", at(1), None, "z"), (None, at(0), None, "z")]
    for size in (1 << 16, 2):
        got = {(r.row_id, r.reason, r.period) for r in link(spark, children, parents, size).collect()}
        assert got == {("2", "deleted", "2025-04"), ("3", "late", "2025-03"), ("4", "missing", "2025-03"), ("8", "missing", None)}
    assert link(spark, [], parents).count() == 0 and link(spark, children, []).count() == 8
    assert {(r.reason, r.orphans) for r in orphan_report(link(spark, children, parents)).collect()} == {("deleted", 1), ("late", 1), ("missing", 1)}


def test_orphans_hot_key(spark):
    children = [(k, "hot" if k % 3 == 0 else f"k{k % 7}", at(k % 60), None, "k") for k in range(600)]
    got = link(spark, children, [(f"k{j}", at(0, 0), None, "z") for j in range(7)], 16).collect()
    assert len(got) == 200 and {r.reason for r in got} == {"missing"}


def test_levels_exact():
    """The search finds a path of least cost, however the rows are cut into slices."""
    rnd = np.random.default_rng(5)
    for _ in range(40):
        k, n, penalty = 3, 6, float(rnd.choice([0.3, 2.0, 5.0]))
        costs = np.minimum(rnd.random((n, k)) * 12, 9.0)
        start = np.where(np.arange(k) == 0, 0.0, penalty)
        price = lambda path: start[path[0]] * 1.0 + sum(costs[t, l] for t, l in enumerate(path)) + penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        want = min(price(p) for p in itertools.product(range(k), repeat=n))
        assert abs(price(best_levels(costs, penalty, start, np.zeros(k))) - want) < 1e-9
        cuts = [0, *sorted(rnd.choice(np.arange(1, n), 2, replace=False)), n]
        parts = [costs[a:b] for a, b in zip(cuts, cuts[1:])]
        borders = slice_borders([passage_costs(p, penalty) for p in parts], penalty)
        path = np.concatenate([best_levels(p, penalty, *b) for p, b in zip(parts, borders, strict=True)])
        assert abs(price(path) - want) < 1e-9


def test_unit_change_in_history(spark):
    """A run in another unit is a change of unit, a lone wrong value is a deviation, whatever the size of slices; without the search no change is found."""
    rnd = random.Random(4)
    rows = []
    for k in range(120):
        value = rnd.uniform(5, 50)
        factor = 1e-3 if 40 <= k < 70 and k != 55 else 1e3 if k in (10, 90) else 1.37 if k == 100 else 1.0
        rows.append(("Current", f"{value:.6f} A", value * factor * (1 + rnd.uniform(-3e-4, 3e-4)), "ampere", None))
    got = unified(spark, rows)
    change = {int(k[1:]) for k, r in got.items() if r.state == "unit_change"}
    assert change == set(range(40, 70)) - {55} and {int(k[1:]) for k, r in got.items() if r.state == "deviation"} == {10, 90, 100}
    assert got["c55"].state == "same" and got["c55"].level < 0 and got["c100"].factor is None and abs(got["c10"].factor - 1e3) < 1e-6
    assert all(abs(r.repaired / r.magnitude - 1) < 1e-3 for k, r in got.items() if k != "c100")
    for block in (7, 40):
        assert {k: (r.state, r.level, r.factor) for k, r in unified(spark, rows, block=block).items()} == {k: (r.state, r.level, r.factor) for k, r in got.items()}
    assert not any(r.state == "unit_change" for r in unified(spark, rows, penalty=1e9).values())


CLAIM = "id string, attribute string, raw_value string, normalized_magnitude double, normalized_unit string, span_text string, extraction_version string, created_at timestamp_ntz, q string, key string"


def unified(spark, rows, **more):
    df = spark.createDataFrame([(f"c{k}", *r, "v", at(k), "clash", "clash") for k, r in enumerate(rows)], CLAIM)
    return {r.id: r for r in unify_quantities(df, **more).collect()}


def test_quantities(spark):
    rows = [
        ("Fault Current", "20,000 A", 20000.0, "ampere", None), ("Fault Current", "≈ 1 160 000 mA (nameplate)", 1160.0, "ampere", ""), ("Fault Current", "2.5 kA", 2.5, "ampere", None),
        ("Temp", "64.4 degF", 291.15, "kelvin", None), ("Temp", "64.4 degF", 64.4, "deg F", None), ("Z", "72 percent", 72.0, "%", None), ("Rating", "0.15 mva", 150000.0, "VA", None),
        ("Length (cm)", "250", 2.5, "meter", None), ("Volt", "39", 39.0, "volt", "X | Volt | 39 kV"), ("Volt", "39", None, "volt", "X | Volt | 39 kV"), ("Volt", "5 kV", 5000.0, "ampere", None), ("Volt", "5 kV", 5000.0, " ", None),
        ("Volt", "39", 39.0, "volt", None), ("Fuse", "QFN-T-15A", None, None, None), ("Volt", None, 5.0, "volt", None), ("Zero", "0 V", 0.0, "volt", None), ("Zero", "0 V", 4.0, "volt", None), ("Comma", "0,0158KA", 15.8, "A", None),
        ("Volt", "5 kV", 5000.0, "furlong", "x" * 100_000), ("Volt", "", 1.0, "volt", None),
    ]
    got = unified(spark, rows)
    state = {int(k[1:]): (r.state, r.common_unit) for k, r in got.items()}
    assert [state[k][0] for k in range(12)] == ["same", "same", "deviation", "same", "same", "same", "same", "same", "deviation", "missing", "dimension", "missing"]
    assert not {12, 13, 14, 19} & set(state)
    assert state[15][0] == "same" and state[16][0] == "deviation" and state[17][0] == "same" and state[18][0] == "dimension"
    assert abs(got["c2"].factor - 0.001) < 1e-9 and got["c1"].magnitude == 1160.0
    assert {k: r.state for k, r in unified(spark, rows, block=3).items()} == {k: r.state for k, r in got.items()}
    assert unified(spark, []) == {}
