import numpy as np
import pytest

from parallax.operators.equipment import connected, match_equipment
from parallax.session import checkpoint
from parallax.sources import files, readers


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\n\r\n two \ftable\tx\n1\t2\n".encode())
    (tmp_path / "b.html").write_text("<html><style>p{}</style><h1>Head &amp; tail</h1><p>first<br>second</p><table><tr><th>k</th><th>v</th></tr><tr><td>Z</td><td>5 %</td></tr></table>", encoding="utf-8")
    (tmp_path / "c.md").write_text("text\n\n| k | v |\n|---|:-:|\n| a | 1 |\n| b |\n", encoding="utf-8")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe caf\xe9")
    (tmp_path / "e.txt").write_bytes(b"")
    got = {(r.doc_id, r.page, r.text) for r in files.binary_spans(spark, str(tmp_path), readers.text_parser, glob="*.txt").collect()}
    assert {("a", 1, "one"), ("a", 1, "two"), ("a", 2, "1\t2")} <= got and any(d == "d" for d, _, _ in got) and not any(d == "e" for d, _, _ in got)
    html = [r.text for r in files.binary_spans(spark, str(tmp_path), readers.html_parser, glob="*.html").orderBy("ord").collect()]
    assert html == ["Head & tail", "first", "second", "k v", "Z 5 %"]
    rows = {(r.doc_id, r.table_no, r.row_no): (r.cells, r.confidence) for r in readers.binary_tables(spark, str(tmp_path)).collect()}
    assert rows["b", 0, 1] == (["Z", "5 %"], 1.0) and rows["c", 0, 1][0] == ["a", "1"] and abs(rows["c", 0, 0][1] - 2 / 3) < 1e-9 and rows["a", 0, 0][0] == ["table", "x"]
    counts = readers.page_counts(files.binary_spans(spark, str(tmp_path), readers.text_parser, glob="a.txt")).collect()
    assert [(r.doc_id, r.pages) for r in counts] == [("a", 2)]
    with pytest.raises(ImportError):
        readers.pdf_parser(b"%PDF-1.4")


def test_connected_candidates():
    edges = np.array([[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0], [0, 0, 0, 0]], bool)
    parts = sorted((r.tolist(), c.tolist()) for r, c in connected(edges))
    assert parts == [([0], [0]), ([1, 2], [1, 2])] and connected(np.zeros((2, 2), bool)) == []


def test_match_scores(spark):
    schema = "pair_id string, canonical_id string, kind string, identity_anchors array<string>, weak_descriptors array<string>, page int"
    a = spark.createDataFrame([("p", "x1", "fuse", ["tcc1", "row_3"], ["w"], 2), ("p", "x2", "fuse", ["tcc2", "row_3"], [], 2), ("p", "x3", "relay", ["one_line"], [], 1)], schema)
    b = spark.createDataFrame([("p", "y1", "fuse", ["tcc1", "row_3"], ["w"], 2), ("p", "y3", "relay", ["one_line"], [], 4)], schema)
    got = {(r.a_id, r.b_id): (r.status, round(r.score, 4)) for r in match_equipment(a, b).collect()}
    # a row of a common context is identity (0.5 + 0.2 + 0.1 + 0.05); a context alone is not enough; a row mark alone is neither
    assert got["x1", "y1"] == ("matched", 0.85) and got["x3", "y3"] == ("ambiguous", round(0.2 + 0.05 / 4, 4)) and got["x2", None][0] == "unmatched_a"


def test_checkpoint_folder_is_required_on_clusters(monkeypatch):
    from parallax.session import shared_folder

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_folder(Session())
    assert checkpoint is not None


def test_cache_remembers_failures_and_trims(spark, tmp_path):
    from pyspark.sql import functions as F

    from parallax.sources import store

    c = store.Cache(spark, str(tmp_path / "c"), failed="")
    asked = []

    def compute(df):
        asked.append(sorted(r.key for r in df.collect()))
        return df.select("key", F.when(F.col("key") != "bad", F.upper("key")).alias("value"))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    c.get_or_compute("n", keys("a", "bad"), compute)
    got = {r.key: r.value for r in c.get_or_compute("n", keys("a", "bad", "b"), compute).collect()}
    assert asked == [["a", "bad"], ["b"]] and got == {"a": "A", "bad": "", "b": "B"} and c.stats() == {"hits": 2, "misses": 3}
    assert c.trim("n", 10) == 0 and c.trim("n", 1) == 2 and {r.key for r in c.get_or_compute("n", keys("b"), compute).collect()} == {"b"} and asked[-1] == ["b"]
    assert c.trim("none", 0) == 0
