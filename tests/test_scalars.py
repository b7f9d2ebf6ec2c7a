"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from parallax.functions import scalars as S


@pytest.fixture
def ask(spark):
    def run(expr, **values):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]

    return run


def test_equivalent(spark):
    rows = [("132 kV", "132000 V", True), ("132 kV", "0.132 MV", True), ("1000 kVA", "1 MVA", True), ("5.75 %", "0.0575", True), ("100 %", "1", True), ("1 kA", "1000 A", True), ("132 kV", "133 kV", False), ("132 kV", "132 kA", False), ("spam", "eggs", False), (" Spam", "spam ", True), ("0 A", "0 kA", True), ("1 A", "0 A", False), ("1000 kVA", "1000 kW", True)]
    df = S.with_base_quantity(S.with_base_quantity(spark.createDataFrame(rows, "a string, b string, want boolean"), "a", "qa"), "b", "qb")
    for r in df.select("a", "b", "want", S.equivalent(F.col("a"), F.col("qa"), F.col("b"), F.col("qb")).alias("got")).collect():
        assert r.got == r.want, r


def test_confidence_and_deviation(ask):
    assert ask(S.confidence(F.lit(0.5), F.lit(0.5), F.lit(0.5))) == 0.125
    assert ask(S.confidence(F.lit(-1.0), F.lit(1.0), F.lit(1.0))) == 0 and ask(S.confidence(F.lit(2.0), F.lit(1.0), F.lit(1.0))) == 1
    assert abs(ask(S.relative_deviation(F.lit(5.75), F.lit(0.575))) - 90) < 1e-9 and ask(S.relative_deviation(F.lit(0.0), F.lit(0.0))) == 0
    assert ask(S.severity(F.lit(50.0), F.lit(1.0), F.lit(10.0), F.lit(50.0))) == "critical" and ask(S.severity(F.lit(0.99), F.lit(1.0), F.lit(10.0), F.lit(50.0))) == "info"


@pytest.mark.parametrize(("text", "tag"), [("⑥ KRP-C", "6"), ("6 KRP-C", "6"), ("6. KRP-C", "6"), ("6) KRP-C", "6"), ("T-200 x", "T-200"), ("㉑ x", "21"), ("Note x", "")])
def test_row_marker(ask, text, tag):
    assert ask(S.row_marker("t"), t=text) == tag


@pytest.mark.parametrize(("raw", "family"), [("KRP-C-1600SP", "KRP-C"), ("LPN-RK-200SP", "LPN-RK"), ("JCN 80E", "JCN"), ("20,000A", None), ("NONE", "NONE"), ("", None)])
def test_designation(ask, raw, family):
    assert ask(S.designation_family("r"), r=raw) == family


@pytest.mark.parametrize(("title", "handle"), [("Coordination Curve 3", "tcc3"), ("TCC12", "tcc12"), ("One-Line Diagram", "one_line"), ("Fuse schedule", "fuse_schedule"), ("Some title", "sometitle"), ("  ", "")])
def test_context(ask, title, handle):
    assert ask(S.context_handle("t"), t=title) == handle


def test_entities_and_anchors(ask):
    assert ask(S.infer_entity("t", F.lit("Doc 1"))["id"], t="see P-4 and MOV-7") == "p_4"
    assert ask(S.infer_entity("t", F.lit("Doc 1"))["label"], t="Bus B-3 feeds") == "Bus B-3"
    assert ask(S.infer_entity("t", F.lit("Doc 1"))["id"], t="nothing") == "implicit_doc_1"
    assert ask(S.identity_anchor("t"), t="1000 kVA XFMR-1") is None and ask(S.identity_anchor("t"), t="LPN-RK-500SP") == "LPN-RK-500SP"
    assert ask(S.coincidence_key("t", F.lit(None).cast("double")), t="1,000 kVA") == "1000"


def test_guards(ask):
    assert ask(S.verbatim(F.lit("a  b"), F.lit("x a b y"))) and not ask(S.verbatim(F.lit(""), F.lit("x")))
    assert ask(S.grounded(F.lit("XFMR-1 north"), F.lit("the north side of xfmr-1"))) and not ask(S.grounded(F.lit("XFMR-9"), F.lit("xfmr-1")))
    assert ask(S.mentions_value(F.lit("5 kV differs"), F.lit("5 kV"), F.lit("6 kV")))
    assert ask(S.decimal_shift(F.lit(5.75), F.lit(0.575))) and not ask(S.decimal_shift(F.lit(1.0), F.lit(0.0)))
    assert ask(S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0


def test_excerpt(ask):
    at, cut = S.value_excerpt(F.lit("x" * 300 + " 1,000 KVA " + "y" * 300), F.lit("1,000 kva"))
    assert ask(at) == 302 and "1,000 KVA" in ask(cut) and ask(cut).startswith("…") and ask(cut).endswith("…")
    assert ask(S.value_excerpt(F.lit("short"), F.lit("zz"))[1]) == "short"


def test_cost(ask):
    n = F.lit(1_000_000)
    assert ask(S.model_cost(n, n, n, n, F.lit(3.0), F.lit(15.0), F.lit(False))) == 3 + 15 + 0.3 + 3.75
    assert ask(S.model_cost(n, n, n, n, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True))) == 0
