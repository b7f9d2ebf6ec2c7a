import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from parallax.llm.matching import Mention, Mixture, match_mentions, mention_of, read_mention
from parallax.llm.survivor import pick_survivors, skyline_layers, surviving_records
from parallax.llm.truncation import cut_values, length_limits, long_values, truncation_report
from parallax.llm.vocabulary import map_values, near_pairs, repair_tokens


def test_skyline_layers():
    rnd = random.Random(1)
    for _ in range(50):
        pts = [tuple(rnd.randint(0, 2) for _ in range(3)) for _ in range(8)]
        layers = skyline_layers(pts)
        for p, k in zip(pts, layers):
            above = [j for q, j in zip(pts, layers) if q != p and all(b >= a for a, b in zip(p, q))]
            assert (k == 0) == (not above) and all(j < k for j in above)


def survivors(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, k string, v double, ok boolean, trust int, at timestamp_ntz, usable string")
    out = surviving_records(df, ["k"], id="id", value="v", fields={"raw": F.lit(True), "span": F.col("ok")}, trust=F.col("trust"), time=F.col("at"))
    return sorted(map(tuple, out.collect()))


def t(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def test_survivors(spark):
    rows = [("b", "x", 100.0, True, 1, t(5)), ("a", "x", 100.05, None, 3, t(1)), ("c", "x", 100.0, True, 1, t(6)), ("c", "x", 100.0, True, 1, t(6)), ("d", "x", 100.5, True, 9, t(9)), ("e", None, 1.0, False, None, None), ("f", None, 1.0, False, None, None), ("g", "y", None, True, 1, t(1)), ("h", "z", 5.0, True, 1, t(1)), ("h", "z", 5.0, True, 1, t(1)), ("m", "w", -2.0, True, 1, t(1)), ("n", "w", 2.0, True, 1, t(1)), ("o", "q", 0.0, True, 1, t(1)), ("p", "q", 0.0, True, 2, t(1))]
    assert survivors(spark, rows) == [("a", "a", "c"), ("e", "e", ""), ("o", "p", "p")]
    assert survivors(spark, []) == []


def test_survivors_brute_force(spark):
    rnd = random.Random(2)
    rows = [(f"i{k:03}", rnd.choice("xy"), rnd.choice([1.0, 1.0005, 7.0]), rnd.random() < 0.5, rnd.randint(1, 3), t(rnd.randint(0, 400) + k * 1000)) for k in range(60)]
    want = []
    for key in "xy":
        for lo, hi in ((0, 2), (2, 9)):
            g = [r for r in rows if r[1] == key and lo < r[2] < hi]
            best = lambda own: max(((r[4], r[5], r[0]) for r in own), default=(0, 0, ""))[2]
            want.append((min(r[0] for r in g), best(g), best([r for r in g if r[3]])))
    assert survivors(spark, rows) == sorted(want)
    assert pick_survivors([{"usable": 0, "trust": 1, "at": 1, "id": "a"}], 1) == [""]


def test_hot_group_is_reduced(spark):
    df = spark.range(30_000).select(F.format_string("%06d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(4.0).alias("v"), (F.col("id") % 5).cast("int").alias("trust"), (F.lit(t(0)) + F.expr("make_dt_interval(cast(id as int))")).alias("at"))
    got = surviving_records(df, ["k"], id="id", value="v", fields={"raw": F.lit(True)}, trust=F.col("trust"), time=F.col("at")).collect()
    assert [tuple(r) for r in got] == [("000000", "029994")]  # the last row of trust 4 that three divides


def cut_frame(spark, extra=()):
    rnd = random.Random(4)
    words = ["the", "court", "orders", "payment", "before", "winter", "confidence", "because", "documents", "were", "lost", "again"]
    rows = []
    for k in range(400):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(4, 30))) + "."
        rows.append((k, "capped" if k % 2 else "free", text[:100] if k % 2 else text, "12 kV"))
    return rows, spark.createDataFrame([*rows, *extra], "id bigint, lane string, text string, anchor string")


def test_limits_and_cuts(spark):
    rows, df = cut_frame(spark, [(1000, "free", "the court orders pay", None), (1001, "free", "payment before win…", None), (1002, "free", "Rated at 12 kV", "12 kV"), (1003, "free", "the court Rated at 12 k", "12 kV"), (1004, "free", "short note", None), (1005, "free", None, None), (1006, "free", " ", None), (1007, "free", "the court orders payment", None), (1000, "free", "the court orders pay", None)])
    limits = length_limits(long_values(df, "id", F.col("lane"), ["text"])).where("not stripped").collect()
    assert {(r.source, r.unit, r.limit) for r in limits} == {("capped", "characters", 100), ("capped", "bytes", 100)}
    got = {r.id: r.reason for r in cut_values(df, "id", F.col("lane"), ["text"], anchor="anchor").collect()}
    want = {k: "limit" for k, lane, s, _ in rows if lane == "capped" and len(s) in (99, 100) and not s.endswith(".")}
    assert {k: v for k, v in got.items() if k < 1000 and v == "limit"}.keys() >= {k for k, v in want.items() if len(rows[k][2]) == 100}
    assert not any(s.endswith(".") and k in got for k, _, s, _ in rows)
    assert {k: got.get(k) for k in range(1000, 1008)} == {1000: "word", 1001: "mark", 1002: None, 1003: "word", 1004: None, 1005: None, 1006: None, 1007: None}
    report = {r.source: (r["values"], r.cut) for r in truncation_report(df, "id", F.col("lane"), ["text"], anchor="anchor").collect()}
    assert report["free"] == (206, 3) and report["capped"][0] == 200
    empty = df.where("false")
    assert cut_values(empty, "id", F.col("lane"), ["text"], anchor="anchor").count() == 0 and truncation_report(empty, "id", F.col("lane"), ["text"]).count() == 0


def test_cuts_of_very_long_words(spark):
    """A word of thousands of letters, met often, costs no more than the lengths of open ends; ends in numbers are whole."""
    long = "x" * 5000
    rows, df = cut_frame(spark, [(2000 + k, "free", f"the court orders {long} again", None) for k in range(5)] + [(2010, "free", f"the court orders {long[:700]}", None), (2011, "free", "the court orders 12", None)])
    got = {r.id: r.reason for r in cut_values(df, "id", F.col("lane"), ["text"], anchor="anchor").collect()}
    assert got.get(2010) == "word" and 2011 not in got


REF = [(1, "Transformer Impedance", ["%Z", "Xfmr Z"]), (2, "Transformer Rating", ["Xfmr Rtg"]), (7, "No-Load Loss", []), (8, "Load Loss", ["Copper Loss"]), (9, "Fault Current", ["Isc"]), (20, "Ambient Temperature", None), (24, "Pickup Current", ["Pick-up Setting"])]


def test_vocabulary(spark):
    ref = spark.createDataFrame(REF, "entry int, name string, aliases array<string>")
    want = {"fault  current": 9, "Faut Current": 9, "CURRENT, FAULT": 9, "Fau1t Curr.": 9, "FaultCurrent *": 9, "faultcurrent": 9, "isc": 9, "Pickup_Current [1]": 24, "Pick-up Settnig": 24, "N0-Load Loss": 7, "load loss (kW)": 8, "LOSS, COPPER": 8, "Xfmr Rating": 2, "Xfmr Impedance": 1, "Ambient Temp. @ site": 20, "Abmient Tempreature": 20, "misc": 0, "tbd": 0, "??": 0, "Shipping Weight": 0, "Nameplate Language": 0, "x" * 5000: 0}
    names = spark.createDataFrame([(n, "c") for n in [*want, None, "", "  ", "tbd"]], "name string, entry string")
    got = {r.name: r.entry for r in map_values(names, ref).collect()}
    assert got == want
    assert map_values(names.where("false"), ref).count() == 0
    assert {r.entry for r in map_values(names, ref.where("false")).collect()} == {0}


def test_read_mentions():
    assert read_mention("Transformer No. 9") == Mention("transformer", 9, "")
    assert read_mention("#45 feeder line").number == 45 and read_mention("M.O.V.-9").kind == "motor_operated_valve" and read_mention("CB-l9").number == 19 and read_mention("P-9O").number == 90
    assert read_mention("XFMR-76, Pragraiprarn filter house").place == "pragraiprarn filter house"
    assert mention_of("59", "For busbar Besaizer north bay the sheet states X") == Mention("bus", 59, "besaizer north bay")
    assert mention_of("⑰", "protective relay R-128 is listed with X").number == 128
    assert mention_of("n/a", "The unit on this page is listed with trip delay of 1 s") == Mention(None, None, "")
    assert mention_of(None, "Fault Current | 3 A", frozenset({"fault", "current"})) == Mention(None, None, "")
    assert mention_of(None, None) == Mention(None, None, "")


def test_mixture_constraints():
    x = np.array([[1.0, 1.0, 0.9, 0], [1.0, 1.0, 0.95, 1], [0.0, 1.0, 0.9, 0], [np.nan, np.nan, np.nan, 0]])
    p = Mixture(3).posteriors(x, np.array([0, 0, 0, 1]))
    assert p[:3].sum() <= 1 and p[1] > p[0] > p[2] and p[3] < 0.5
    assert len(Mixture(3).posteriors(np.empty((0, 4)), np.empty(0, int))) == 0


def test_mixture_learns_without_labels():
    """From a start that knows nothing of the rates, the classes are told apart, support and noisy numbers included."""
    rnd = np.random.default_rng(4)
    n = 4000
    true = rnd.random(n) < 0.4
    x = np.column_stack([np.where(rnd.random(n) < np.where(true, 0.95, 0.3), 1.0, 0.5), np.where(true, 1.0, (rnd.random(n) < 0.2) * 1.0), np.clip(np.where(true, 0.95, 0.3) + rnd.normal(0, 0.1, n), 0, 1), (rnd.random(n) < np.where(true, 0.3, 0.01)) * 1.0])
    x[rnd.random(n) < 0.3, 2] = np.nan
    model, owner = Mixture(3), np.arange(n)
    for _ in range(8):
        w = model.posteriors(x, owner)
        model = model.updated(np.array([Mixture.sums(x, w), Mixture.sums(x, 1 - w)]))
    assert ((model.posteriors(x, owner) > 0.5) == true).mean() > 0.95
    assert abs(model.support[0] - 0.3) < 0.05 and model.support[1] < 0.05 and abs(model.weight[0] / model.weight.sum() - 0.4) < 0.05


def test_one_entry_one_place(spark):
    """Mentions of one entry are one thing: a place that few of them claim does not match an entry that says none."""
    entries = [("e1", "p", "pump", "P-7"), *[(f"e{k}", "p", "pump", f"P-{k} Kasoth wharf") for k in range(20, 40)]]
    mentions = [(k, "p", "P-7 Dogrem yard", None) for k in range(6)] + [(10, "p", "P-7 Zekil mill", None), (11, "p", "P-7", None), (12, "p", "P-7 Dogrm yard", None)]
    mentions += [(100 + k, "p", f"P-{20 + k % 20} Kasoth wharf", None) for k in range(60)] + [(300 + k, "p", f"motor {20 + k % 20}", None) for k in range(40)]
    got = dict(matched(spark, mentions, entries))
    assert {k for k, e in got.items() if e == "e1"} == {*range(6), 11, 12} and not any(k >= 300 for k in got) and all(got[100 + k] == f"e{20 + k % 20}" for k in range(60))


def matched(spark, mentions, entries):
    m = spark.createDataFrame([(*x, 1, "c") for x in mentions], "id bigint, scope string, tag string, span string, fact bigint, entry string")
    e = spark.createDataFrame([(*x, "c") for x in entries], "entry string, scope string, kind string, label string, id string")
    f = spark.createDataFrame([], "entry string, fact bigint")
    best = match_mentions(m, e, f).where("posterior > 0.5").collect()
    return {(r.id, r.entry) for r in best}


def test_matching(spark):
    rnd = random.Random(6)
    kinds = {"transformer": "XFMR-", "pump": "P-", "breaker": "CB-"}
    names = ["kasoth tie", "preliv yard", "dogrem wharf", "futal basement", "zekil rooftop", "mobrax standby"]
    entries, mentions, want = [], [], set()
    for s in range(12):
        for k, (kind, prefix) in enumerate(kinds.items()):
            entries.append((f"e{s}_{k}", f"p{s}", kind, f"{prefix}{10 * k + s}, {names[(s + k) % 6].title()}"))
    for i in range(300):
        s, k = rnd.randrange(12), rnd.randrange(3)
        kind, prefix = list(kinds.items())[k]
        form = rnd.randrange(4)
        place = names[(s + k) % 6]
        tag = [f"{prefix.lower()}{10 * k + s}", None, f"{kind} no. {10 * k + s}", place][form]
        span = [f"The {kind} is listed with X", f"{kind} {place.title()}: X", "row", f"The {kind} carries X"][form]
        mentions.append((i, f"p{s}", tag, span))
        want.add((i, f"e{s}_{k}"))
    mentions += [(900, "p0", "XFMR-99", "transformer: X"), (901, "p0", None, "The unit on this page is listed with X"), (902, None, "XFMR-0", "x"), (903, "p1", "⑤", None), (0, *mentions[0][1:])]
    got = matched(spark, mentions, [*entries, ("gone", None, "pump", "P-500 Lonely mill"), ("null", "p0", None, None)])
    assert got >= want - set() and not {g for g in got if g[0] >= 900}
    assert matched(spark, [], entries) == set() and matched(spark, mentions, []) == set()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_pairs_are_complete(spark):
    """Brute force: every pair within the edits allowed is found, three substitutions too."""
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 12))) for _ in range(60)} | {"abcdefghi"})
    tokens = {"abcxyzghi", "z" * 5000}
    for w in words:
        for _ in range(6):
            t = list(w)
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(t))
                rnd.choice([lambda: t.insert(k, "x"), lambda: t.pop(k) if len(t) > 4 else None, lambda: t.__setitem__(k, "y")])()  # noqa: B023
            tokens.add("".join(t))
    a, b = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string"), spark.createDataFrame([(w,) for w in words], "word string")
    for most in (2, 3):
        got = {(r.token, r.word) for r in near_pairs(a, b, "token", "word", lambda n, most=most: F.lit(most), most).collect()}
        assert {(t, w) for t in tokens for w in words if abs(len(t) - len(w)) <= most and edits(t, w) <= most} <= got
    repaired = {(r.token, r.word): r.sim for r in repair_tokens(a, b).collect()}
    assert ("abcxyzghi", "abcdefghi") in repaired and not any(t == "z" * 5000 for t, _ in repaired)
    assert all(edits(t, w) <= 3 or s >= 0.85 for (t, w), s in repaired.items())
