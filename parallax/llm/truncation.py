"""Texts cut off by a field limit or in transfer, and how often each source cuts.

Field limits: for each source and field the histograms of length in characters and in bytes are tested
for a spike at their upper end. A length is a limit when hardly any value is longer and far more
values have it than the mean of the lengths just below; the length one less counts too where it
spikes as well, as a blank at the cut is often stripped. A value at a limit without terminal
punctuation is cut.

Transfer: a value of any length that ends in a cut mark, or in the middle of a word, is cut. The ends of
words are learnt from the corpus: after the word before it, the last piece is a proper prefix
of a word that often follows there, and that piece itself never closes a sentence there.

Scale: what the judgement needs of a value (sizes, last words, signs of an end) is taken out of its text once and
checkpointed, so texts are not shuffled again; word pairs are aggregated map-side. Prefixes are made only in
the lengths that open ends after the same word have, of words that repeat, and meet the ends by equi-joins; no value meets a list.
Pairs with digits, which name nothing that repeats, are left out; a value that ends in a number is judged by field
limits, marks and its anchor only.

Defined cases: null and blank values are whole; a value that ends in its ``anchor`` (the value
quoted by the text) is whole; one that ends inside it is cut; repeated rows of a key count once; an
empty table gives no limits and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.text import is_blank, strip
from parallax.session import checkpoint

#: What closes a sentence, what may stand behind it, and what marks a cut.
TERMINAL = list(".!?;:。！？")
QUOTES = "'\")]»”’"
MARKS = ("…", "\ufffd", "...", "[...]", "[…]")
#: What is left off the end of a word.
PUNCTUATION = ".,;:!?"


def _ends_in(c: Column, ends: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.endswith(c, F.lit(e)) for e in ends])


def long_values(df: DataFrame, key: str, source: Column, fields: Sequence[str], anchor: str | None = None) -> DataFrame:
    """(key, source, field, value, characters, bytes, anchor): the usable values, one for each key and field; sizes are those before outer blanks go."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.col(key).alias("key"), source.alias("source"), (F.col(anchor) if anchor else F.lit(None).cast("string")).alias("anchor"), F.explode(parts).alias("v"))
    rows = rows.select("key", "source", "anchor", "v.field", strip("v.value").alias("value"), F.length("v.value").alias("characters"), F.octet_length("v.value").alias("bytes")).where("value <> ''")
    return rows.distinct()


def length_limits(values: DataFrame, *, least: int = 5, factor: float = 5.0, beyond: float = 0.005, span: int = 10) -> DataFrame:
    """(source, field, unit, limit, values, at_limit): the lengths at which a field of a source is cut off."""
    measures = F.array(F.struct(F.lit("characters").alias("unit"), F.col("characters").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))
    histogram = values.select("source", "field", F.explode(measures).alias("m")).groupBy("source", "field", "m.unit", "m.n").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("source", "field", "unit")
    by = group.orderBy("n")
    marked = (
        histogram.withColumn("total", F.sum("c").over(group))
        .withColumn("longer", F.coalesce(F.sum("c").over(by.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)))
        .withColumn("below", F.coalesce(F.sum("c").over(by.rangeBetween(-span, -1)), F.lit(0)) / span)
        .withColumn("below2", F.coalesce(F.sum("c").over(by.rangeBetween(-span - 1, -2)), F.lit(0)) / span)
        .withColumn("next", F.lead("n").over(by)).withColumn("next_c", F.lead("c").over(by)).withColumn("next_longer", F.lead("longer").over(by))
    )
    spike = (F.col("c") >= least) & (F.col("c") >= factor * F.greatest("below", F.lit(0.5))) & (F.col("longer") <= beyond * F.col("total")) & (F.col("n") >= 2 * span)
    # One less than a limit: a spike in its own right over the lengths below it, while the limit itself is above.
    stripped = (F.col("next") == F.col("n") + 1) & (F.col("next_longer") <= beyond * F.col("total")) & (F.col("next_c") >= least) & (F.col("next_c") >= factor * F.greatest("below", F.lit(0.5))) & (F.col("c") >= 3) & (F.col("c") >= 3 * F.greatest("below", F.lit(0.5)))
    return marked.where(spike | stripped).select("source", "field", "unit", F.col("n").alias("limit"), F.col("total").alias("values"), F.col("c").alias("at_limit"), (~spike).alias("stripped"))


def _bare(word: Column) -> Column:
    """A word without punctuation at its end; # for all words with a digit."""
    return F.when(word.rlike("[0-9]"), "#").otherwise(F.rtrim(word, F.lit(PUNCTUATION)))


def value_facts(values: DataFrame) -> DataFrame:
    """(key, source, field, characters, bytes, before, piece, ended, marked, quoted, inside): what the judgement needs of each value, without its text.

    ``piece`` is the last piece, ``before`` the word before it ('' in a value of one word); ``quoted`` a value that ends in its anchor, ``inside`` one that ends within it.
    """
    marked, backwards = _ends_in(F.col("value"), MARKS), F.reverse("value")
    word = lambda k: F.reverse(F.regexp_extract(backwards, r"^(\S+)(?:\s+(\S+))?", k))
    ended = F.substring(F.rtrim(F.col("value"), F.lit(QUOTES)), -1, 1).isin(TERMINAL) & ~marked
    quoted = F.coalesce(F.endswith("value", strip("anchor")) & ~is_blank("anchor"), F.lit(False))
    anchor = strip("anchor")
    begun = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(anchor) - 1)), lambda i: F.endswith("value", F.concat(F.lit(" "), F.substring(anchor, F.lit(1), i))))
    inside = F.coalesce(F.when(~is_blank("anchor") & ~F.contains("value", anchor), begun), F.lit(False))
    return values.select("key", "source", "field", "characters", "bytes", _bare(word(2)).alias("before"), word(1).alias("piece"), ended.alias("ended"), marked.alias("marked"), quoted.alias("quoted"), F.when(ended, False).otherwise(inside).alias("inside"))


def word_pairs(values: DataFrame) -> DataFrame:
    """(p, t, n, ends): how often word t follows word p inside a text, and how often it closes a sentence there. The last word counts where it closes one."""
    words = F.split("value", r"\s+")
    last = F.element_at("w", -1)
    shut = lambda w: F.substring(w, -1, 1).isin(".", ";", "!", "?") & ~_ends_in(w, MARKS)
    rows = values.select(words.alias("w")).select(F.when(shut(last), F.col("w")).otherwise(F.slice("w", F.lit(1), F.size("w") - 1)).alias("w"))
    pairs = F.arrays_zip(F.slice(F.concat(F.array(F.lit("")), F.col("w")), F.lit(1), F.size("w")).alias("p"), F.col("w").alias("t"))
    rows = rows.select(F.explode(pairs).alias("x")).select("x.p", "x.t").where("not t rlike '[0-9]'").select(_bare(F.col("p")).alias("p"), F.rtrim(F.col("t"), F.lit(PUNCTUATION)).alias("t"), shut(F.col("t")).cast("long").alias("e"))
    return rows.where("t <> ''").groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("ends"))


def _going_on(words: DataFrame, ends: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """(keys, piece, out): of the pieces in ``ends`` that begin a longer word t of ``words`` under the same keys, the greatest n of one."""
    sizes = ends.groupBy(*keys).agg(F.collect_set(F.length("piece")).alias("sizes"))
    cut = words.join(sizes, list(keys)).select(*keys, "t", "n", F.explode(F.filter("sizes", lambda k: k < F.length("t"))).alias("k")).select(*keys, F.expr("substring(t, 1, k)").alias("piece"), "n")
    return cut.groupBy(*keys, "piece").agg(F.max("n").alias(out))


def judged_values(df: DataFrame, key: str, source: Column, fields: Sequence[str], *, anchor: str | None = None, support: int = 3, closing: float = 0.02) -> DataFrame:
    """(key, source, field, reason): every usable value; reason is limit, mark or word where it does not hold its whole text, else null."""
    values = long_values(df, key, source, fields, anchor)
    facts = checkpoint(value_facts(values))
    sizes = length_limits(facts).groupBy("source", "field").agg(*[
        F.collect_set(F.when((F.col("unit") == u) & (F.col("stripped") == s), F.col("limit"))).alias(f"{u}_{int(s)}") for u in ("characters", "bytes") for s in (False, True)
    ])
    at_limit = lambda k: F.coalesce(F.array_contains(f"characters_{k}", F.col("characters")) | F.array_contains(f"bytes_{k}", F.col("bytes")), F.lit(False))
    rows = facts.join(sizes, ["source", "field"], "left").withColumn("exact", at_limit(0)).withColumn("near", at_limit(1)).drop("characters_0", "characters_1", "bytes_0", "bytes_1", "characters", "bytes")
    stats = checkpoint(word_pairs(values))  # a vocabulary of pairs, used in several places below
    ends = rows.where("not (ended or quoted or exact or marked) and not piece rlike '[0-9]'").groupBy("before", "piece").agg(F.count(F.lit(1)).alias("here")).withColumn("initial", F.substring("piece", 1, 1))
    frequent = stats.where(F.col("n") >= support)
    own = stats.select(F.col("p").alias("before"), F.col("t").alias("piece"), "n", "ends")
    goes_on = _going_on(frequent.select(F.col("p").alias("before"), "t", "n"), ends, ["before"], "goes_on")
    known = frequent.groupBy(F.col("p").alias("before")).agg(F.lit(True).alias("known"))
    single = stats.groupBy("t").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends1"))
    anywhere = _going_on(single.where(F.col("n") >= support).withColumn("initial", F.substring("t", 1, 1)), ends, ["initial"], "anywhere").drop("initial")
    closes = F.coalesce(F.col("ends") >= F.greatest(F.lit(1.0), closing * F.col("n")), F.lit(False))
    alone = F.col("known").isNull() & F.col("anywhere").isNotNull() & (F.coalesce("ends1", F.lit(0)) == 0) & (F.col("here") < F.col("anywhere"))
    broken = (
        ends.join(own, ["before", "piece"], "left").join(goes_on, ["before", "piece"], "left").join(known, "before", "left").join(anywhere, "piece", "left")
        .join(single.select(F.col("t").alias("piece"), "ends1"), "piece", "left")
        .where((~closes & F.col("goes_on").isNotNull() & (F.col("here") < F.col("goes_on"))) | alone).select("before", "piece", F.lit(True).alias("broken"))
    )
    shut = stats.where(F.col("ends") >= F.greatest(F.lit(1.0), closing * F.col("n"))).select(F.col("p").alias("before"), F.col("t").alias("piece"), F.lit(True).alias("shut"))
    reason = F.when(F.col("ended"), F.lit(None)).when(F.col("marked"), F.when(F.col("exact"), "limit").otherwise("mark")).when(F.col("quoted"), F.lit(None))
    reason = reason.when(F.col("exact") | (F.col("near") & F.col("shut").isNull()), "limit").when(F.col("broken") | F.col("inside"), "word")
    return rows.join(broken, ["before", "piece"], "left").join(shut, ["before", "piece"], "left").select(F.col("key").alias(key), "source", "field", reason.alias("reason"))


def cut_values(df: DataFrame, key: str, source: Column, fields: Sequence[str], *, anchor: str | None = None, support: int = 3, closing: float = 0.02) -> DataFrame:
    """(key, source, field, reason): the values that do not hold their whole text; reason is limit, mark or word."""
    return judged_values(df, key, source, fields, anchor=anchor, support=support, closing=closing).where("reason is not null")


def truncation_report(df: DataFrame, key: str, source: Column, fields: Sequence[str], *, anchor: str | None = None) -> DataFrame:
    """(source, field, values, cut, share): how often each source cuts each field."""
    one = judged_values(df, key, source, fields, anchor=anchor).groupBy(key, "source", "field").agg(F.max(F.col("reason").isNotNull().cast("long")).alias("cut"))
    return one.groupBy("source", "field").agg(F.count(F.lit(1)).alias("values"), F.sum("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("values"))
