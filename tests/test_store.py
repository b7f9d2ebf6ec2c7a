import datetime as dt

import pytest
from pyspark.sql import functions as F

from parallax.sources import files, store
from parallax.streaming import live


def test_table(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), "id string, a int, b int")
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], t.schema), ["id"])
    t.merge(spark.createDataFrame([("x", 9, 9), ("z", 3, 3), ("z", 3, 3)], t.schema), ["id"], update=["a"])
    want = [("x", 9, 1), ("y", 2, 2), ("z", 3, 3)]
    assert sorted(map(tuple, t.read().collect())) == want
    t.merge(spark.createDataFrame([("x", 9, 9)], t.schema), ["id"], update=["a"])  # again: no change
    assert sorted(map(tuple, t.read().collect())) == want and t.vacuum() == 2 and sorted(map(tuple, t.read().collect())) == want
    wider = store.Table(spark, str(tmp_path / "t"), "id string, a int, b int, provenance string")
    assert wider.read().where("provenance is null").count() == 3


def test_append_numbers(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "log"), "id bigint, v string")
    for _ in range(2):
        t.append(spark.range(50).select(F.col("id").cast("string").alias("v")).repartition(5), id="id")
    assert sorted(r.id for r in t.read().collect()) == list(range(1, 101))


def test_cache(spark, tmp_path):
    c = store.Cache(spark, str(tmp_path / "c"))
    asked = []

    def compute(df):
        asked.append(df.count())
        return df.select("key", F.when(F.col("key") != "bad", F.upper("key")).alias("value"))

    keys = spark.createDataFrame([("a",), ("b",), ("bad",), ("a",)], "key string")
    for _ in range(2):
        assert sorted(map(tuple, c.get_or_compute("n", keys, compute).collect())) == [("a", "A"), ("b", "B")]
    assert asked == [3, 1] and c.stats() == {"hits": 2, "misses": 4} and c.clear("n") == 2 and c.clear("n") == 0


def test_registry(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("clauses:\n- {clause_id: a, edition_year: 2015, source_name: s, applicable_families: [f], summary: t}\n- {clause_id: b, edition_year: 1, source_name: s, applicable_families: [f], summary: t}\n- {clause_id: c}\n")
    assert [r.clause_id for r in files.load_clauses(spark, tmp_path / "c.yaml").collect()] == ["a"]
    assert files.load_clauses(spark, tmp_path / "none.yaml").count() == 0 and files.load_gold(spark, tmp_path / "none.yaml") is None
    (tmp_path / "generic.md").write_text("g")
    assert files.prompt_for("x", tmp_path) == "g" and files.prompt_for("x", tmp_path / "no") == ""


def test_binary_source(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"a\n\nb")
    (tmp_path / "two.bin").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError
        return [(1, (0, 0, 1, 1), line) for line in content.decode().split("\n")]

    assert [r.text for r in files.binary_spans(spark, str(tmp_path), parse, glob="*.bin").orderBy("ord").collect()] == ["a", "b"]
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, files.first_non_empty([a, b], "k").collect())) == [(1, "x"), (2, "z")]


@pytest.mark.parametrize("twice", [1, 2])
def test_stream_upsert(spark, tmp_path, twice):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, dt.datetime(2025, 1, 1), 2.0), (1, dt.datetime(2025, 1, 1), 2.0), (2, dt.datetime(2025, 1, 2), 3.0)], "id int, ts timestamp, v double").write.parquet(src)
    t = store.Table(spark, str(tmp_path / "t"), "id int, ts timestamp, v double")
    for _ in range(twice):
        stream = live.first_deliveries(spark.readStream.schema(t.schema).parquet(src), ["id"], "ts")
        live.upsert_stream(stream, t, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, 2.0), (2, 3.0)]


def test_markdown(spark):
    assert store.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 |  |"
