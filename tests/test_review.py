"""Golden pairs, brute force and metamorphic checks of the review."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parallax.operators import align, dedup, detect, equipment, judge, scan
from parallax.operators.extract import claims_from_records, extract_parameters
from parallax.plans.review import ReviewConfig, review
from parallax.schemas import RECORD, RECORD_COLUMNS, SPAN


def spans(spark, doc, lines):
    rows = [(doc, page, {"x0": 10.0, "y0": float(y), "x1": 90.0, "y1": y + 10.0}, text, "", k) for k, (page, y, text) in enumerate(lines)]
    return spark.createDataFrame(rows, SPAN)


A = [(3, 100, "5.75%Z, liquid"), (2, 50, "Fault X1 20,000A RMS Sym"), (7, 60, "1000KVA XFMR"), (7, 160, "150 KVA XFMR"), (7, 300, "LPN-RK-500SP"), (3, 10, "1. General notes"), (4, 20, "1000KVA"), (4, 34, "XFMR")]
B = [(3, 100, "0.575%Z, liquid"), (2, 50, "Fault X1 200,000A RMS Sym"), (7, 60, "100KVA XFMR"), (7, 160, "0.15 MVA XFMR"), (3, 10, "1. General remarks"), (4, 20, "1000KVA"), (4, 34, "XFMR")]


def records(spark, doc, lines, side):
    return extract_parameters(spans(spark, doc, lines), pair=F.lit("p"), side=F.lit(side))


def test_extraction(spark):
    lines = [(1, 10, "5.75%Z, liquid"), (1, 30, "Fault X1 20,000A RMS Sym"), (1, 50, "0.15 MVA XFMR"), (1, 70, "IFLA = 42 A"), (1, 90, "13.8KV"), (1, 110, "⑥ LPN-RK-500SP"), (1, 130, "Rated Power: 1100 kVA"), (2, 10, "1000KVA"), (2, 24, "XFMR"), (2, 40, None)]
    got = {(r.name, r.raw_value): r for r in records(spark, "d", lines[:-1], "a").collect()}
    assert set(got) == {("Transformer Impedance", "5.75 %"), ("Fault Current", "20,000 A"), ("Transformer Rating", "0.15 MVA"), ("Full Load Amperes", "42 A"), ("System Voltage", "13.8 kV"), ("Fuse Designation", "LPN-RK-500SP"), ("Transformer Rating", "1100 kVA"), ("Transformer Rating", "1000 kVA")}
    assert abs(got["Transformer Impedance", "5.75 %"].normalized_magnitude - 0.0575) < 1e-12 and got["Fuse Designation", "LPN-RK-500SP"].normalized_magnitude is None
    assert got["Transformer Rating", "1000 kVA"].entity_tag == "" and got["Fuse Designation", "LPN-RK-500SP"].entity_tag == "6"
    assert claims_from_records(records(spark, "d", lines[:-1], "a")).where("entity.id = 'implicit_d'").count() > 0


def test_golden_pair(spark):
    out = review(records(spark, "A", A, "a"), records(spark, "B", B, "b"))
    flags = {(r.parameter, r.a_record.raw_value, r.b_record.raw_value): r for r in out["flags"].collect()}
    assert flags["Transformer Impedance", "5.75 %", "0.575 %"].severity == "critical" and abs(flags["Transformer Impedance", "5.75 %", "0.575 %"].deviation_pct - 90) < 1e-9
    assert flags["Fault Current", "20,000 A", "200,000 A"].severity == "critical"
    assert ("Transformer Rating", "1000 kVA", "100 kVA") in flags
    assert not any("150 kVA" in k for k in flags)
    gap = flags["Fuse Designation", "LPN-RK-500SP", ""]
    assert gap.authority_rule == "checklist_gap" and gap.confidence == 0.5 and gap.severity == "major"


def test_metamorphic(spark):
    same = review(records(spark, "A", A, "a"), records(spark, "A", A, "b"))
    assert same["flags"].count() == 0 and same["unpaired_a"].count() == 0
    other = review(records(spark, "A", [(1, 10, "5.75%Z")], "a"), records(spark, "B", [(9, 10, "13.8KV")], "b"))
    assert other["flags"].count() == 0 and other["unpaired_b"].count() == 1
    one = [sorted(map(str, review(records(spark, "A", A, "a"), records(spark, "B", B, "b"))["flags"].select("flag_id", "confidence").collect())) for _ in range(2)]
    assert one[0] == one[1]
    empty = spark.createDataFrame([], RECORD)
    assert review(empty, empty)["flags"].count() == 0


def ladder(spark, a, b):
    def side(rows, s):
        full = [(k + (100 if s == "b" else 0), k, "p", s, s, 1, {"x0": 0.0, "y0": float(y), "x1": 1.0, "y1": float(y)}, None, "", "N", raw, m, "ampere" if m is not None else None, "", tag, "regex", "regex") for k, (y, raw, m, tag) in enumerate(rows)]
        return spark.createDataFrame(full, RECORD)

    got = align.align_exact(side(a, "a"), side(b, "b")).select(F.col("a.record_id").alias("x"), (F.col("b.record_id") - 100).alias("y"), "pairing_confidence", "value_equivalent")
    return sorted(map(tuple, got.collect()))


def test_confidence_ladder(spark):
    assert ladder(spark, [(10, "1 A", 1.0, "6")], [(10, "2 A", 2.0, "6")]) == [(0, 0, 1.0, False)]
    assert ladder(spark, [(10, "1 A", 1.0, "")], [(10, "1 A", 1.0, "")]) == [(0, 0, 0.9, True)]
    assert ladder(spark, [(10, "1 A", 1.0, ""), (50, "2 A", 2.0, "")], [(12, "1 A", 1.0, ""), (51, "3 A", 3.0, "")]) == [(0, 0, 0.75, True), (1, 1, 0.75, False)]
    assert ladder(spark, [(10, "1 A", 1.0, "")], [(10, "9 A", 9.0, ""), (50, "1000 mA", 1.0, "")]) == [(0, 1, 0.5, True)]
    assert ladder(spark, [(10, "1 A", 1.0, "6")], [(10, "1 A", 1.0, "7")]) == [(0, 0, 0.55, True)]
    assert ladder(spark, [(10, "LPN-RK-5SP", None, "")], [(10, "JCN 80E", None, "")]) == []
    assert ladder(spark, [(10, "1 A", 1.0, "")], [(5000, "1 A", 1.0, "")]) == []


def test_greedy_uses_each_record_once(spark):
    rnd = random.Random(4)
    for _ in range(4):
        rows = [[(rnd.choice([10, 20, 30]), f"{v} A", float(v), rnd.choice(["", "6", "7"])) for v in rnd.choices([1, 2, 3], k=rnd.randint(1, 5))] for _ in range(2)]
        got = ladder(spark, *rows)
        assert len({g[0] for g in got}) == len(got) == len({g[1] for g in got})


def test_line_assembly_and_sections(spark):
    rows = [("d", 1, {"x0": 50.0, "y0": 10.0, "x1": 60.0, "y1": 20.0}, "b", "", 0), ("d", 1, {"x0": 1.0, "y0": 11.5, "x1": 9.0, "y1": 21.5}, "a", "", 1), ("d", 1, {"x0": 1.0, "y0": 13.0, "x1": 9.0, "y1": 23.0}, "c", "", 2)]
    assert [r.text for r in scan.assemble_lines(spark.createDataFrame(rows, SPAN)).orderBy("ord").collect()] == ["a b", "c"]
    s = spans(spark, "d", [(1, 1, "intro"), (1, 20, "1.2 Ratings"), (1, 40, "x"), (2, 1, "y")])
    assert [r.section for r in scan.fill_sections(s, ["doc_id", "page"], ["bbox.y0", "ord"]).orderBy("ord").collect()] == [None, "1.2 Ratings", "1.2 Ratings", None]
    pages = spark.createDataFrame([("d", 1, "0.575%Z", "5.75%Z"), ("d", 2, "5.75%Z", "0.5%Z"), ("d", 3, "9999 kV", None)], "doc_id string, page int, one string, two string")
    assert [r.text for r in scan.better_reading(pages, "one", "two", ["doc_id", "page"]).orderBy("page").collect()] == ["5.75%Z", "5.75%Z", "9999 kV"]


def test_lane_duplicates_do_not_chain(spark):
    rows = [(k, k, "p", "a", "d", 1, None, None, "", "N", f"{m} A", m, "ampere", "", "", "llm", lane) for k, (m, lane) in enumerate([(100.0, "vision"), (100.08, "llm_text"), (100.16, "regex"), (100.0, "vision")])]
    kept = dedup.drop_lane_duplicates(spark.createDataFrame(rows, RECORD), ["doc_id"])
    assert sorted(r.record_id for r in kept.collect()) == [0, 2, 3]


def test_range_and_gold(spark):
    recs = spark.createDataFrame([(1, 1, 5.0), (2, 1, 50.0), (3, 2, 5.0)], "record_id int, page int, y double")
    ranges = spark.createDataFrame([(1, "wide", 0.0, 100.0, 0), (1, "tight", 0.0, 10.0, 1), (1, "tie", 0.0, 10.0, 2), (2, "bad", 9.0, 1.0, 3)], "page int, label string, y_top double, y_bottom double, ord int")
    for width in (None, 7.0):
        got = align.bind_to_ranges(recs, ranges, ["page"], value=F.col("y"), width=width)
        assert sorted(map(tuple, got.collect())) == [(1, "tight"), (2, "wide")]


def test_equipment(spark):
    row = "record_id bigint, ord bigint, doc_id string, page int, name string, raw_value string, normalized_magnitude double, entity_tag string, context_id string, row_id string, source_lane string, bbox struct<x0: double, y0: double, x1: double, y1: double>"

    def build(rows):
        return {tuple(r.identity_anchors): r for r in equipment.build_inventory(spark.createDataFrame([(k, k, "d", 1, *r, None) for k, r in enumerate(rows)], row)).collect()}

    three = build([("Transformer Rating", "1000 kVA", None, "", f"TCC{k}", "1", "regex") for k in (1, 2, 3)])
    assert len(three) == 3 and all(r.cluster_status == "confident_cluster" for r in three.values())
    fuses = build([("Fuse Designation", f"LPN-RK-{k}00SP", None, "", "TCC1", str(k), "regex") for k in (1, 2, 3)])
    assert len(fuses) == 3 and all(r.parameters == {} for r in fuses.values())
    across = build([("Transformer Rating", "1000 kVA", None, "", c, None, "regex") for c in ("TCC1", "One-line", "Transformer Schedule")])
    assert [r.cluster_status for r in across.values()] == ["ambiguous_cluster"]
    lanes = build([("Fuse Designation", v, None, "", "TCC1", "1", lane) for v, lane in (("LPN-RK-500SP", "regex"), ("LPN-RK-500SP", "llm_text"), ("LPS-RK-500SP", "vision"))])
    assert [(r.cluster_status, r.mentions) for r in lanes.values()] == [("lane_conflict", 3)]
    inv = equipment.build_inventory(spark.createDataFrame([(1, 1, "d", 1, "Rating", "1000 kVA XFMR", None, "", None, None, "regex", None)], row))
    assert equipment.invalid_equipment(inv).count() == 0 and inv.first().canonical_id == "transformer:p1"


def test_matching_and_mutations(spark):
    schema = "pair_id string, canonical_id string, kind string, identity_anchors array<string>, weak_descriptors array<string>, parameters map<string,string>"
    a = spark.createDataFrame([("p", "f1", "fuse", ["LPN-RK-500SP", "tcc1", "row_1"], [], {"x": "1", "y": "2"}), ("p", "f2", "fuse", ["LPN-RK-100SP", "tcc2", "row_9"], [], {}), ("p", "t", "relay", ["r1"], [], {})], schema)
    b = spark.createDataFrame([("p", "g1", "fuse", ["LPN-RK-500SP", "tcc1", "row_1"], [], {"x": "3", "z": "4"}), ("p", "g2", "fuse", ["KRP-C-100SP", "tcc2", "row_9"], [], {}), ("p", "n", "cable", ["c"], [], {})], schema)
    m = equipment.match_equipment(a, b)
    assert {(r.a_id, r.b_id, r.status) for r in m.collect()} == {("f1", "g1", "matched"), ("f2", "g2", "conflict"), ("t", None, "unmatched_a"), (None, "n", "unmatched_b")}
    got = {(r.a_id, r.b_id, r.parameter, r.change) for r in equipment.equipment_mutations(a, b, m).collect()}
    assert got == {("f1", "g1", "x", "value_change"), ("f1", "g1", "y", "parameter_removed"), ("f1", "g1", "z", "parameter_added"), ("f2", "g2", None, "equipment_conflict"), ("t", None, None, "equipment_removed"), (None, "n", None, "equipment_added")}


def test_rerank_and_judgment(spark):
    a = records(spark, "A", [(1, 10, "5.75%Z"), (2, 10, "13.8KV")], "a")
    b = records(spark, "B", [(1, 10, "0.575%Z"), (2, 10, "12.47KV")], "b")
    pairs = align.align_exact(a, b).withColumn("pairing_confidence", F.lit(0.5))

    def decline(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair_key": batch["pair_key"], "score": 0.1, "rationale": "not " + batch["a_raw"], "decline": True})

    assert [r.a.name for r in judge.rerank_weak(pairs, decline).collect()] == ["Transformer Impedance"]  # kept: a decimal shift
    assert judge.rerank_weak(pairs).where("reranked").count() == 0 and judge.rerank_weak(pairs).count() == 2
    flags = detect.with_flag_id(detect.detect_flags(pairs, detect.band_table(spark)))
    clauses = spark.createDataFrame([("c1", 2015, "S", "t")], "clause_id string, edition_year int, source_name string, summary string")
    verdicts = flags.select("flag_id").withColumns({"severity": F.lit("minor"), "confidence": F.lit(0.5), "engineering_explanation": F.lit("why"), "cited_clause_ids": F.array(F.lit("none"), F.lit("c1"))})
    done = judge.apply_judgments(flags, verdicts, clauses).collect()
    assert {r.severity for r in done} == {"minor"} and {c.clause_id for r in done for c in r.cited_clauses} == {"c1"} and all(r.confidence == 0.25 for r in done)


def test_text_lane(spark):
    pages = spark.createDataFrame([("d", 1, "Rated  5 kV here"), ("d", 2, " "), ("d", 3, "nothing")], "doc_id string, page int, text string")

    def scorer(b: pd.DataFrame) -> pd.DataFrame:
        good = '```json\n{"claims": [{"parameter_name": "Voltage", "raw_value": "5 kV", "entity_tag": "", "span_text": "Rated 5 kV", "confidence": 0.9, "reasoning": ""}, {"parameter_name": "Made up", "raw_value": "9", "entity_tag": "", "span_text": "not there", "confidence": 0.9, "reasoning": ""}]}\n```'
        return pd.DataFrame({"key": b["key"], "answer": [good if "kV" in t else "no json" for t in b["text"]]})

    claims = judge.text_lane(pages, scorer)
    assert [r.parameter_name for r in claims.collect()] == ["Voltage"]
    rec = judge.records_from_claims(claims, "llm_text").select(*RECORD_COLUMNS).first()
    assert rec.name == "System Voltage" and rec.normalized_magnitude == 5000.0


@pytest.mark.parametrize("page_only", [True, False])
def test_semantic(spark, page_only):
    a = records(spark, "A", [(1, 10, "Rated Power: 1100 kVA")], "a")
    b = records(spark, "B", [(2 if not page_only else 1, 10, "1000KVA XFMR")], "b")
    got = align.align_semantic(a, b, align.hashed_embedding(), same_page_only=page_only).collect()
    assert len(got) == 1 and not got[0].value_equivalent and got[0].name_match_confidence > 0.99
    flags = review(a, b, ReviewConfig(same_page_only=page_only))["flags"].collect()
    assert [(r.severity, round(r.deviation_pct, 2)) for r in flags] == [("minor", 9.09)]


def test_page_lanes(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 100, ""), ("d", 2, "", ""), ("d", 3, "y" * 100, ""), ("d", 4, "z" * 100, "")], "doc_id string, page int, text string, source_path string")
    answer = lambda value: lambda b: pd.DataFrame({"key": b["key"], "answer": [value] * len(b)})
    assert [(r.page, r.text, r.bbox.x1) for r in judge.ocr_lane(pages, answer("one\n\n two")).orderBy("ord").collect()] == [(2, "one", 612.0), (2, "two", 612.0)]
    found = judge.entity_lane(pages, answer('{"entities": [{"label": "XFMR-1", "kind": "t", "y_top": 1, "y_bottom": 9}, {"label": "Note", "kind": "", "y_top": 1, "y_bottom": 9}, {"label": "X", "kind": "", "y_top": 9, "y_bottom": 1}]}'))
    assert {(r.page, r.label) for r in found.collect()} == {(1, "XFMR-1"), (3, "XFMR-1"), (4, "XFMR-1")}
    seen = []

    def classify(b):
        seen.extend(b["text"])
        return pd.DataFrame({"key": b["key"], "answer": ['{"doc_class": "equipment_spec", "confidence": 0.5, "reasoning": "r"}'] * len(b)})

    assert [(r.doc_class, r.reasoning[:2]) for r in judge.class_lane(pages, classify).collect()] == [("unknown", "r ")]
    assert [r.doc_class for r in judge.class_lane(pages, answer("nothing")).collect()] == ["unknown"]
    flags = detect.with_flag_id(detect.detect_flags(align.align_exact(records(spark, "A", A, "a"), records(spark, "B", B, "b")), detect.band_table(spark)))
    clauses = spark.createDataFrame([("c1", 2015, "S", ["impedance_pct"], "t")], "clause_id string, edition_year int, source_name string, applicable_families array<string>, summary string")
    verdict = '{"severity": "minor", "engineering_explanation": "because", "confidence": 0.5, "cited_clause_ids": ["c1", "c9"]}'
    done = judge.judge_flags(flags, clauses, answer(verdict)).collect()
    assert {r.severity for r in done} == {"minor"} and all([c.clause_id for c in r.cited_clauses] == ["c1"] for r in done)
    assert {r.severity for r in judge.judge_flags(flags, clauses, answer("no")).collect()} == {r.severity for r in flags.collect()}


def test_gold_and_counts(spark):
    from parallax.operators import evaluate

    flags = detect.with_flag_id(detect.detect_flags(align.align_exact(records(spark, "A", A, "a"), records(spark, "B", B, "b")), detect.band_table(spark)))
    gold = spark.createDataFrame([("p", "TP-1", "surfaced", "impedance", "5.75", "0.575"), ("p", "TP-2", "surfaced", "fault", "20,000", "200,000"), ("p", "FN", "surfaced", "nothing", "", ""), ("p", "FP-1", "suppressed", "rating", "150 kva", "0.15 mva")], "pair_id string, gold_id string, expected string, parameter_substr string, a_value_substr string, b_value_substr string")
    scored = evaluate.score_gold(flags, gold)
    assert {(r.gold_id, r.outcome) for r in scored.collect()} == {("TP-1", "tp"), ("TP-2", "tp"), ("FN", "fn"), ("FP-1", "tn")}
    r = evaluate.recall_and_traps(scored).first()
    assert abs(r.recall - 2 / 3) < 1e-9 and r.trap_rate == 0
    spots = spark.createDataFrame([("p", 3, "x", "5.75%z,liquid", "")], "pair_id string, page int, gold_id string, gold_a string, gold_b string")
    assert evaluate.matches_span_gold(flags, spots).count() == 1
    assert evaluate.recall_and_traps(scored.where("false")).first().recall == 0
    high, low = detect.split_by_confidence(flags, 0.8, ["regex"])
    assert high.count() + low.count() == flags.count() and detect.near_misses(flags).count() == 0
    assert detect.display_view(flags).where("severity_chip = 'CRITICAL'").count() >= 2
    assert [r.severity for r in detect.sort_flags(flags).collect()][0] == "critical"
    assert evaluate.unpaired_tally(records(spark, "A", A, "a")).first().records >= 1


def test_ingest_and_lanes(spark):
    from parallax.plans.ingest import Lanes, all_lanes, ingest

    s = spans(spark, "d", [(1, 10, "5.75%Z and so on " + "word " * 20), (3, 10, "XFMR-1"), (3, 20, "CB-2"), (3, 30, "Bus")])
    pages = spark.createDataFrame([("d", p, "") for p in (1, 2, 3)], "doc_id string, page int, source_path string")
    answer = lambda value: lambda b: pd.DataFrame({"key": b["key"], "answer": [value] * len(b)})
    out = ingest(s, pages)
    assert {r.page for r in out["low_coverage"].collect()} == {2, 3} and out["spans"].count() == 4
    lanes = Lanes(reader=answer("13.8KV\nread"), vision=answer('{"claims": [{"entity_kind": "t", "entity_id": "XFMR-1", "parameter_name": "Rating", "raw_value": "5 kVA", "visual_evidence": "v"}, {"entity_kind": "t", "entity_id": "XFMR-77", "parameter_name": "Rating", "raw_value": "9 kVA", "visual_evidence": "v"}]}'))
    out = ingest(s, pages, lanes)
    assert out["spans"].where("page = 2").count() == 2
    got = {(r.extraction_lane, r.name, r.raw_value, r.entity_tag) for r in all_lanes(out["spans"], out["pages"], "p", "a", lanes).collect()}
    assert ("regex", "Transformer Impedance", "5.75 %", "") in got and ("regex", "System Voltage", "13.8 kV", "") in got
    assert {g[1:] for g in got if g[0] == "vision"} == {("Rating", "5 kVA", "XFMR-1")}
    assert ingest(s, pages, Lanes(most_pages=1))["spans"].count() == 1


def test_entity_gate_and_keys(spark):
    from parallax.functions import scalars as S

    pairs = spark.createDataFrame([("implicit_a", "implicit_b"), ("xfmr_1", "xfmr_1"), ("xfmr_1", "xfmr_2"), ("implicit_a", "xfmr_1")], "x string, y string")
    assert sorted(map(tuple, align.same_entity_pairs(pairs, F.col("x"), F.col("y")).collect())) == [("implicit_a", "implicit_b"), ("xfmr_1", "xfmr_1")]
    gated = review(records(spark, "A", [(1, 10, "XFMR-1 5.75%Z")], "a"), records(spark, "B", [(1, 10, "XFMR-2 0.575%Z")], "b"), ReviewConfig(claim_gate=True, threshold=2.0))
    assert gated["flags"].count() == 0 and gated["unpaired_a"].count() == 1
    keys = spark.createDataFrame([(1, "a"), (1, "b")], "n int, s string").select(S.cache_key("ns", "s", "n").alias("k"), S.cache_key("ns", "n", "s").alias("j")).collect()
    assert all(r.k == r.j and r.k.startswith("ns:") for r in keys) and keys[0].k != keys[1].k
    row = spark.range(1).select(judge.prompt_text("{a} against {b}", a=F.lit("1"), b=F.lit(None).cast("string")).alias("p"), S.families_agree(F.lit("x"), F.lit(None).cast("string")).alias("f")).first()
    assert row.p == "1 against " and row.f


def test_bound_entities(spark):
    from parallax.plans.review import bind_entities

    r = records(spark, "A", [(1, 10, "5.75%Z"), (1, 200, "13.8KV")], "a")
    ranges = spark.createDataFrame([("A", 1, "XFMR-1", 0.0, 50.0, 0), ("A", 1, "page", 0.0, 100.0, 1)], "doc_id string, page int, label string, y_top double, y_bottom double, ord int")
    assert {(x.name, x.entity_tag) for x in bind_entities(r, ranges).collect()} == {("Transformer Impedance", "XFMR-1"), ("System Voltage", "")}
