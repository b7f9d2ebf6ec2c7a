import itertools
import os
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parallax.llm.leaks import WuManber, leaked_items, letters_of, worded
from parallax.llm.quality import COMMON, DRAWN, FEATURES, document_kinds, draw_below, induce_rules, labelled_sample, rules_sql, text_statistics, weak_label
from parallax.llm.queries import QUERIES, SQL, TOKENIZERS
from parallax.llm.tokens import compiled, encode_corpus
from tests.compare import DATA, same

MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_files = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    same(spark, name, QUERIES, SQL) if name in SQL else QUERIES[name](spark, DATA).count()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def own(text):
    with open(MODEL, "rb") as f:
        return np.frombuffer(compiled(f.read()).encode(text), np.int32).tolist()


@needs_files
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aab \n.,0_-é█", max_size=60)))
def test_encoding_matches(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(MODEL)
        _T.encode_special_tokens = True
    assert own(text) == _T.encode(text, add_special_tokens=False).ids


@needs_files
def test_encoding_defined_cases(spark, reference):
    long = "word " * 20_000 + "x" * 50_000
    rows = [(1, "", "c"), (2, None, "c"), (3, "<|endoftext|> it's", "c"), (4, long, "c"), (5, "a\n\n  b", "c"), (5, "a\n\n  b", "c")]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), tokenizer=MODEL).collect()}
    assert got[1] == [] and got[2] == [] and all(got[k] == reference(t) for k, t, _ in rows[2:])
    with open(MODEL, "rb") as f:
        automaton = compiled(f.read()).words.automaton
    assert automaton.decode(got[4]).decode() == long
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer=MODEL).count() == 0


ITEM = "When the old lantern fell on the cart of Tagrik, the well-known driver claimed 251 florins from the council of the northern harbour before the judgment was read."


def test_words():
    words, must, may = worded("The \ufb01rst well-\nknown judg-\r\n  ment, No. 7!")
    assert words == ["the", "first", "wellknown", "judgment", "no", "7"] and may == {12, 21} and must == {0, 3, 8, 17, 25, 27, 28}
    assert worded(None)[0] == [] and worded("a\u200bb \uff21\uff22\u00b2")[0] == ["ab", "ab2"] and letters_of("A\u200bb-\n\uff21_7!") == "aba7" and letters_of(None) == ""


def leaks(spark, docs, items=((1, ITEM),), **more):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, doc_id string")
    return sorted(map(tuple, leaked_items(d, i, **more).collect()))


def test_leaks(spark):
    w = ITEM.split()
    docs = [(1, "x " + ITEM.upper() + " y"), (2, " ".join(w[3:18]).replace("the", "the,\n")), (3, " ".join(w[3:16])), (4, None), (5, ""), (6, " ".join(w[:9] + ["extra"] + w[9:17])), (7, "z " * 200_000 + ITEM), (8, unicodedata.normalize("NFKD", ITEM).replace("judgment", "judg-\nment").replace("fell", "ﬁll")), (1, "x " + ITEM.upper() + " y")]
    want = [(1, 1), (2, 1), (7, 1), (8, 1)]
    assert leaks(spark, docs) == want and leaks(spark, docs, block_letters=100) == want
    assert leaks(spark, docs, [(1, ITEM), (2, ITEM), (3, None), (4, "too short")])[:2] == [(1, 1), (1, 2)]
    assert leaks(spark, []) == [] and leaks(spark, docs, []) == []


def test_breaks_are_read_both_ways(spark):
    """A broken word counts joined and as two, whatever the other tests hold and however tests are split into passes."""
    item = "they would sign the lease again after the long winter of that year in town once more"
    docs = [(1, "x " + item.replace("long", "be-\nlong")), (2, item.replace("winter", "win-\n  ter").replace("again", "a\u00ad\ngain")), (3, item.replace("after the", "after-\nthe"))]
    joined = item.replace("long", "belong")
    other = "nobody would belong to the board of a small harbour that had never once paid its men on time"
    for more in ({}, {"block_letters": 60}):
        assert leaks(spark, docs, [(1, item)], **more) == [(2, 1), (3, 1)]
        assert leaks(spark, docs, [(1, joined), (2, other)], **more) == [(1, 1)]
        assert leaks(spark, docs, [(1, item.replace("long", "be long")), (2, other)], **more) == [(1, 1)]


def test_search_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        items = [(i, [rnd.choice(["a", "b", "ab", "ba"]) for _ in range(rnd.randint(3, 12))]) for i in range(3)]
        words, gaps = [rnd.choice(["a", "b", "ab", "d"]) for _ in range(40)], [rnd.choice([" ", " ", ", ", "-\n"]) for _ in range(39)]
        breaks = [k for k, g in enumerate(gaps) if g == "-\n"][:6]
        gaps = [g if k in breaks or g != "-\n" else "; " for k, g in enumerate(gaps)]
        windows = set()
        for joins in itertools.product([False, True], repeat=len(breaks)):
            glued = {k for k, j in zip(breaks, joins, strict=True) if j}
            read = "".join(w + ("" if k in glued else " ") for k, w in enumerate(words)).split()
            windows |= {tuple(read[k : k + 5]) for k in range(len(read) - 4)}
        want = {i for i, w in items if any(tuple(w[k : k + 5]) in windows for k in range(len(w) - 4))}
        text = "".join(w + g for w, g in zip(words, [*gaps, ""], strict=True))
        assert WuManber([(i, " ".join(w)) for i, w in items], 5).search(text) == want


PROSE = "The court finds that the appeal must be dismissed because the record does not support it. The parties shall bear their own costs, and the order of the court below is affirmed.\n"


def labelled():
    rnd = random.Random(5)
    name = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "sun"]) for _ in range(3)).capitalize()
    out = []
    for _ in range(60):
        out.append(("prose", "".join(PROSE for _ in range(rnd.randint(1, 6))) + name()))
        out.append(("list", "\n".join(f"{rnd.choice('-•')} {name()} v. {name()}" for _ in range(rnd.randint(5, 30)))))
        out.append(("table", "A | B | C\n" + "\n".join(f"{name()} | {rnd.randint(1, 99)} | {rnd.random() * 9:.2f}" for _ in range(rnd.randint(5, 30)))))
        out.append(("junk", "\n".join("".join(rnd.choice("~^|_0Oo{}<>/") for _ in range(40)) for _ in range(rnd.randint(3, 20)))))
    return out


def test_weak_labels():
    assert all(weak_label(t) == kind for kind, t in labelled())
    assert weak_label(None) is None and weak_label(" \n") is None and weak_label("page " * 50) == "junk"


def test_kinds_on_held_out(spark):
    rows = [(k, t, "en", kind, "clash") for k, (kind, t) in enumerate(labelled())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind string, words string")
    train, held = df.where("doc_id % 3 > 0"), df.where("doc_id % 3 = 0")
    sample = labelled_sample(train)
    rules = induce_rules(sample, sample["label"].to_numpy(object))
    assert rules_sql(rules).startswith("case when") and rules_sql([]) == "'prose'"
    got = {r.doc_id: r.kind for r in document_kinds(held, rules=rules).collect()}
    truth = {r.doc_id: r.kind for r in held.select("doc_id", "kind").collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 0.95 * len(truth)


def test_statistics(spark):
    rows = [(1, "The cat.\nA dog ran;\n", "en"), (2, "", "en"), (3, None, None), (4, "a|1|2\n b|3|4", None), (5, "x" * 100_000, "en"), (6, "Das ist der Hund.", None)]
    got = {r.doc_id: r for r in text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[1].n_words == 5 and got[1].n_lines == 2 and got[1].line_end_share == 1.0 and got[1].common_share == 0.2
    assert got[2].n_words == 0 and not got[2].readable and not got[3].readable and got[3].common_share == 0
    assert got[4].cells_per_line == 2 and got[5].mean_word_length == 100_000 and got[6].common_share == 0.75
    assert {r.doc_id for r in document_kinds(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rules=[]).collect()} == {1, 4, 5, 6}
    assert all(len(set(w)) >= 40 for w in COMMON.values())


def test_sample_bound_at_any_size():
    """The share of the hash range that is drawn is never zero, and near the sample for tables of any size."""
    assert draw_below(10, 12_000) == DRAWN and draw_below(12_001, 12_000) < DRAWN
    for total in (3 * 10**10, 10**12, 10**15):
        assert abs(draw_below(total, 12_000) / DRAWN * total - 12_000) < 1
    assert draw_below(10**25, 12_000) == 1


def test_rules_may_use_all_statistics():
    rnd = np.random.default_rng(3)
    x = pd.DataFrame({f: rnd.random(400) for f in FEATURES})
    for name in ("n_words", "mean_word_length", "symbol_share", "bullet_share", "line_end_share", "common_share"):
        labels = np.where(x[name] > 0.8, "junk", "prose").astype(object)
        assert {c[0] for _, rule in induce_rules(x, labels) for c in rule} == {name}
