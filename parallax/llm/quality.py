"""Per-document statistics of text, and an ordered rule list that tells prose from lists, tables and junk.

The statistics are built-in expressions. A rule list is induced from a bounded labelled sample by
incremental reduced-error pruning: for one class after the other, the rarer first, a rule grows
on two thirds of the rows by information gain until it holds no other class, is pruned on the last
third, its rows are taken out, and the next is learnt until a rule errs too often. The learnt thresholds
are exported as one SQL CASE expression, which runs over all documents natively.

Labels for the sample come from a labelling function over the lines of the whole text (``weak_label``); it
abstains where the signs disagree, and rows without a label are not learnt from.

Scale: one map over the documents; only the sample of about ``sample`` rows reaches the driver.

Defined cases: null, empty and blank texts have statistics of zero and no kind; ``lang`` null or unknown
takes the language whose common words are most frequent; repeated documents are judged alike; a small table without labels gives
prose only; a sample of 1000 readable documents or more of which none can be labelled is an error, as no rule could be learnt.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.text import col, settle

#: Common words of each language (function words of two letters and more).
COMMON = {
    "en": "the of and to in is was that for on with as by at from this which be are were had not it an or no has have been his her their its who but upon under than then there these those will shall would may any all if so such when".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch kann nicht trägt".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au aux est pas plus ne se ce il elle son sa ses avec été sont ou mais cette ont leur dont donc à".split(),
    "es": "el la los las de del en que un una por con para su se no al lo como más es sus le ha sin sobre este entre cuando ser son dos también fue había era muy hasta desde está si".split(),
}

FEATURES = (
    "n_words", "mean_word_length", "letter_share", "digit_share", "symbol_share", "common_share", "n_lines", "words_per_line", "line_end_share", "bullet_share",
    "cells_per_line", "numeric_cell_share", "distinct_share", "chars_per_word",
)
KINDS = ("table", "list", "junk")


#: Blanks of the class used below, the same in every engine of regular expressions.
_BLANK = r" \t\n\r\f\x0b"
#: Patterns over the skeleton, in which every run of two letters or more is ``xx``.
LINE = rf"[^{_BLANK}\x{{a0}}][^\r\n]*"
LINE_END = rf"[.!?;:,…][\"')\]»”’]*[ \t\x{{a0}}]*(?:[\r\n]|\z)"
BULLET = rf"(?:^|[\r\n])[ \t]*(?:[-–—•*·▪◦o]|\(?[0-9]{{1,4}}[.)]|\(?[a-zA-Z][.)])[ \t]+[^{_BLANK}]"
GAP, DEAD_GAP = r"[ \x{a0}]{2,}", r"[ \x{a0}]{2,}(?:[\t\r\n\f\x0b]|\z)"
DEAD_SEMICOLON = rf";(?:[{_BLANK}]|\z)"
NUMERIC_CELL = r"(?:[|¦\t;]|[ \x{a0}]{2,})[ ]?[0-9-]"
UNSEEN = rf"[a-zA-Z\p{{L}}{_BLANK}\x{{a0}}\x{{feff}}]+"
SEEN = rf"[^{_BLANK}\x{{a0}}\x{{feff}}]"
PLAIN_MARKS = r"""[\p{N}.,;:'"()?!/§–—“”„‘’«»-]+"""


def text_statistics(documents: DataFrame, key: str = "doc_id", text: Column | str = "text", lang: Column | str = "lang") -> DataFrame:
    """(key, one column for each of FEATURES, readable): one pass of plain expressions over the whole text.

    Words are runs of letters; a line counts if it is not blank; symbols are visible characters other than
    letters, digits and usual punctuation; a cell mark is a bar, a tab, a semicolon without a blank after
    it or a gap of two blanks; a numeric cell is a mark followed by a digit (looked for in texts with a mark to a
    line or more); a bullet is a dash, dot, number or letter that opens a line.

    The text is gone through twice, for its words and for its skeleton, which is much shorter; all marks are counted there.
    """
    rows = documents.select(F.col(key).alias("__key"), F.coalesce(col(text), F.lit("")).alias("t"), col(lang).alias("g"))
    rows = rows.select("__key", "g", F.col("t").rlike(SEEN).alias("readable"), F.length("t").alias("size"), F.split(F.lower("t"), r"[^a-z\p{L}]+").alias("words"), F.regexp_replace("t", r"[a-zA-Z\p{L}]{2,}", "xx").alias("s"))
    within = lambda g: F.size(F.filter("words", lambda w: w.isin(COMMON[g])))
    common = F.when(F.col("g") == "en", within("en")).when(F.col("g") == "de", within("de")).when(F.col("g") == "fr", within("fr")).when(F.col("g") == "es", within("es"))
    count = lambda pattern: F.regexp_count("s", F.lit(pattern))
    without = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    marks = F.col("s")
    for mark in "|¦\t":
        marks = F.replace(marks, F.lit(mark), F.lit(""))
    edges = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    rows = rows.select(
        "__key", "readable", "s", "size", (F.size("words") - edges).alias("n_words"), F.length(F.array_join("words", "")).alias("letters"), F.size(F.array_distinct("words")).alias("distinct"),
        F.coalesce(common, F.greatest(*[within(g) for g in COMMON])).alias("common"), F.regexp_replace("s", UNSEEN, "").alias("v"), count(LINE).alias("n_lines"), count(LINE_END).alias("ends"), count(BULLET).alias("bullets"),
        (F.length("s") - F.length(marks) + F.length("s") - F.length(F.replace("s", F.lit(";"), F.lit(""))) - count(DEAD_SEMICOLON) + count(GAP) - count(DEAD_GAP)).alias("cells"),
    )
    rows = rows.withColumn("numeric", F.when((F.col("cells") > 0) & (F.col("cells") >= F.col("n_lines")), count(NUMERIC_CELL)).otherwise(0))
    rows = rows.withColumn("seen", F.col("letters") + F.length("v")).withColumn("digits", F.length("v") - without("v", "[0-9]+")).withColumn("symbols", without("v", PLAIN_MARKS))
    return rows.select(
        F.col("__key").alias(key), "n_words", share("letters", "n_words").alias("mean_word_length"), share("letters", "seen").alias("letter_share"), share("digits", "seen").alias("digit_share"),
        share("symbols", "seen").alias("symbol_share"), share("common", "n_words").alias("common_share"), "n_lines", share("n_words", "n_lines").alias("words_per_line"),
        share("ends", "n_lines").alias("line_end_share"), share("bullets", "n_lines").alias("bullet_share"), share("cells", "n_lines").alias("cells_per_line"),
        share("numeric", "cells").alias("numeric_cell_share"), F.least(F.lit(1.0), share("distinct", "n_words")).alias("distinct_share"), share("size", "n_words").alias("chars_per_word"), "readable",
    )


def statistics_sql(table: str = "documents") -> str:
    """The same statistics in plain SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda pattern, c="s": f"len(regexp_extract_all({c}, {quoted(pattern)}))"
    within = lambda g: "len(list_filter(words, lambda x: x in (" + ", ".join(map(quoted, COMMON[g])) + ")))"
    share = lambda a, b, name: f"case when {b} > 0 then {a} / {b} else 0 end as {name}"
    return f"""
with d as (
  select doc_id, lang as g, regexp_matches(coalesce(text, ''), {quoted(SEEN)}) as readable, length(coalesce(text, '')) as size, string_split_regex(lower(coalesce(text, '')), '[^a-z\\p{{L}}]+') as words,
    regexp_replace(coalesce(text, ''), '[a-zA-Z\\p{{L}}]{{2,}}', 'xx', 'g') as s from {table}),
c as (
  select doc_id, readable, s, size, len(words) - cast(words[1] = '' as int) - cast(len(words) > 1 and words[-1] = '' as int) as n_words, length(array_to_string(words, '')) as letters, len(list_distinct(words)) as dist,
    coalesce(case {' '.join(f"when g = '{g}' then {within(g)}" for g in COMMON)} end, greatest({', '.join(within(g) for g in COMMON)})) as common,
    regexp_replace(s, {quoted(UNSEEN)}, '', 'g') as v, {count(LINE)} as n_lines, {count(LINE_END)} as ends, {count(BULLET)} as bullets,
    {count("[|¦" + chr(9) + "]")} + {count(";")} - {count(DEAD_SEMICOLON)} + {count(GAP)} - {count(DEAD_GAP)} as cells from d),
e as (
  select *, case when cells > 0 and cells >= n_lines then {count(NUMERIC_CELL)} else 0 end as numbers, letters + length(v) as seen, {count('[0-9]', 'v')} as digits,
    length(regexp_replace(v, {quoted(PLAIN_MARKS)}, '', 'g')) as symbols from c)
select doc_id, n_words, {share('letters', 'n_words', 'mean_word_length')}, {share('letters', 'seen', 'letter_share')}, {share('digits', 'seen', 'digit_share')}, {share('symbols', 'seen', 'symbol_share')},
  {share('common', 'n_words', 'common_share')}, n_lines, {share('n_words', 'n_lines', 'words_per_line')}, {share('ends', 'n_lines', 'line_end_share')}, {share('bullets', 'n_lines', 'bullet_share')},
  {share('cells', 'n_lines', 'cells_per_line')}, {share('numbers', 'cells', 'numeric_cell_share')}, least(1.0, case when n_words > 0 then dist / n_words else 0 end) as distinct_share, {share('size', 'n_words', 'chars_per_word')}, readable
from e"""


_ANY_COMMON = frozenset().union(*COMMON.values())
_SENTENCE = re.compile(r"[^\W\d_][^.!?]{25,}[.!?]")
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪◦o]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+")
_CITATION = re.compile(r"^\(?\d{4}\)?\s+\d+\s+[A-Z]{2,}\s+\d+")
_PARTIES = re.compile(r"\S\s+(?:v\.?|vs\.?|against|contre|gegen|contra)\s+\S", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SHAPE = re.compile(r"(?=.*[aeiouyäöüàâéèêëîïôûùáíóúœ])(?!.*[^aeiouyäöüàâéèêëîïôûùáíóúœ]{6})(?:[a-zà-ÿ]+|[A-ZÀ-Þ][a-zà-ÿß]+|[A-ZÀ-Þ]+)$", re.I)


@lru_cache(200_000)
def _shaped(word: str) -> bool:
    """Whether a run of letters looks like a word: one case pattern, a vowel, no heap of consonants."""
    if word in {"a", "o", "v", "y", "e"}:
        return True
    return 1 < len(word) < 20 and (word.islower() or word.istitle() or word.isupper()) and bool(_SHAPE.match(word))


def weak_label(text: str | None) -> str | None:
    """prose, list, table or junk where the lines of a text show signs of just one; else None."""
    lines = [x for x in re.split(r"[\r\n]+", text or "") if x.strip()]
    if not lines:
        return None
    flat = " ".join(x.strip() for x in lines)
    sentences = sum(len(m[0]) for m in _SENTENCE.finditer(flat) if sum(map(_ANY_COMMON.__contains__, m[0].lower().split())) >= 3)
    words = _WORD.findall(flat)
    shaped = sum(len(w) for w in words if _shaped(w))
    readable = shaped / max(1, len(re.sub(r"\s", "", flat)))
    if len(words) >= 12 and len({w.lower() for w in words}) <= 3 and not re.search(r"\d", flat):
        return "junk"  # one thing over and over
    signs = set()
    tabular = False
    for mark in (r"\s*\|\s*", r"\s*¦\s*", r"\t+", r";(?=\S)", r" {2,}"):
        cells = [re.split(mark, x.strip()) for x in lines]
        sizes = [len(c) for c in cells]
        k = max(set(sizes), key=sizes.count)
        if k >= 3 and sizes.count(k) >= 0.8 * len(lines):
            body = [c for row in cells if len(row) == k for c in row]
            if sum(bool(re.fullmatch(r"[-+]?[\d.,:/%-]+", c.strip())) for c in body) >= 0.2 * len(body):
                tabular = True
    if tabular:
        signs.add("table")
    entries = [e for x in lines for e in (re.split(r";\s+", x) if _BULLET.match(x) else [x])]
    entry = sum(bool((_CITATION.match(_BULLET.sub("", e)) or _PARTIES.search(e) or _BULLET.match(e)) and len(e.split()) <= 14) for e in entries)
    if entry >= 0.75 * len(entries) and len(entries) >= 2 and sentences < 0.2 * len(flat) and not tabular:
        signs.add("list")
    if sentences >= 0.3 * len(flat) and readable > 0.5:
        signs.add("prose")
    if readable < 0.45 and sentences < 0.05 * len(flat) and not tabular and entry < 0.2 * len(entries):
        signs.add("junk")
    return signs.pop() if len(signs) == 1 else None


Rule = tuple[str, list[tuple[str, str, float]]]


def _covers(x: pd.DataFrame, conditions: list[tuple[str, str, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, at in conditions:
        v = x[name].to_numpy(float)
        hit &= (v <= at) if op == "<=" else (v > at)
    return hit


def _grow(x: pd.DataFrame, y: np.ndarray, features: Sequence[str]) -> list[tuple[str, str, float]]:
    """Conditions by greatest information gain until no other class is covered."""
    rule: list[tuple[str, str, float]] = []
    hit = np.ones(len(y), bool)
    while (hit & ~y).any() and len(rule) < 8:
        p0, n0 = (hit & y).sum(), (hit & ~y).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name in features:
            v, own = x[name].to_numpy(float)[hit], y[hit]
            order = np.argsort(v, kind="stable")
            v, own = v[order], own[order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            p, n = np.cumsum(own)[edge].astype(float), np.cumsum(~own)[edge].astype(float)
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1e-9)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= _covers(x, rule[-1:])
    return rule


def induce_rules(x: pd.DataFrame, labels: np.ndarray, *, order: Sequence[str] = KINDS, features: Sequence[str] = FEATURES, most_errors: float = 0.25, seed: int = 7) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; rows that no rule covers are prose."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(labels), bool)
    for kind in order:
        while (left & (labels == kind)).sum() >= 3:
            rows = np.flatnonzero(left)
            y = labels[rows] == kind
            part = np.zeros(len(rows), bool)  # a third of each side is kept for pruning
            for side in (np.flatnonzero(y), np.flatnonzero(~y)):
                part[rng.permutation(side)[: len(side) // 3]] = True
            rule = _grow(x.iloc[rows[~part]], y[~part], features)
            worth = []
            for k in range(1, len(rule) + 1):
                hit = _covers(x.iloc[rows[part]], rule[:k])
                p, n = (hit & y[part]).sum(), (hit & ~y[part]).sum()
                worth.append(((p - n) / max(1, p + n), p))
            if not rule:
                break
            rule = rule[: max(range(len(rule)), key=lambda k: (worth[k][0], worth[k][1], k)) + 1]
            hit = _covers(x.iloc[rows], rule)
            if not (hit & y).any() or (hit & ~y).sum() > most_errors * hit.sum():
                break
            rules.append((kind, rule))
            left[rows[hit]] = False
    return rules


def rules_sql(rules: Sequence[Rule]) -> str:
    """The rule list as one SQL CASE expression over the statistics."""
    when = [f"when {' and '.join(f'{name} {op} {at!r}D' for name, op, at in rule)} then '{kind}'" for kind, rule in rules]
    return f"case {' '.join(when)} else 'prose' end" if when else "'prose'"


def labelled_sample(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, sample: int = 12_000) -> pd.DataFrame:
    """The statistics and labels of about ``sample`` documents, drawn by a hash of their key; all of a smaller table."""
    total = max(1, documents.count())
    drawn = documents.where(F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(DRAWN)) < F.lit(draw_below(total, sample)))
    label = F.pandas_udf(lambda t: t.map(weak_label, na_action="ignore"), "string")
    # The sample is small; spread it, as its texts may come from few files. Its labels ride along with the statistics; nothing is filtered here, as a filter would be moved below the exchange and label twice.
    drawn = drawn.select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang")).repartition(documents.sparkSession.sparkContext.defaultParallelism, "__id")
    rows = text_statistics(drawn.withColumn("__key", F.struct("__id", label("__text").alias("label"))), "__key", "__text", "__lang").select("__key.*", *FEATURES, "readable").toPandas()
    kept = rows[rows["readable"] & rows["label"].notna()]
    if rows["readable"].sum() >= 1000 and not len(kept):
        raise ValueError("no document of the sample could be labelled, so no rules can be learnt")
    return kept.drop_duplicates("__id").drop(columns=["__id", "readable"]).reset_index(drop=True)


#: Range of the hash that draws the sample.
DRAWN = 1 << 62


def draw_below(total: int, sample: int) -> int:
    """The bound of the hash under which about ``sample`` of ``total`` rows lie, exact for any total."""
    return DRAWN if total <= sample else max(1, DRAWN * sample // total)


def document_kinds(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, sample: int = 12_000, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(key, kind): prose, list, table or junk for every document with visible text."""
    if rules is None:
        rows = labelled_sample(documents, key, text, lang, sample=sample)
        rules = induce_rules(rows, rows["label"].to_numpy(object))
    rows = text_statistics(documents, key, text, lang).where("readable")
    return settle(rows, kind=F.expr(rules_sql(rules))).select(key, "kind")
