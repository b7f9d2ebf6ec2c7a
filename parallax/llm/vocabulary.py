"""Free-entered values mapped to a canonical list: token repair, then soft TF-IDF over whole entries.

Distinct values are cut into tokens (also at changes of case, as blanks get lost). Each distinct
token is joined to the tokens of the reference forms by edit distance: a word is cut into one part more than the
edits allowed, of which a token within that distance holds one unchanged and hardly moved; an equi-join on the parts finds all
such pairs, and the distance confirms. A token has a bounded number of such keys, however long it is, and none if no word is of about its length.
Abbreviations join in the same way, by prefix or by consonants. The corrected tokens of a value are then
weighed against every form that shares one, by the cosine of inverse document frequencies times the
similarity of the tokens. Values whose blanks went missing altogether are compared as one string.

Scale: everything runs on distinct values and distinct tokens; the pairs are bounded by the forms that
share a token, never by values among themselves; rows are mapped by an equi-join on the value.

Defined cases: null and blank values are no cases; a value with no entry at ``least`` or above, or with two
entries that score alike, gets 0; entries without aliases count by their name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.text import is_blank, strip
from parallax.session import checkpoint

#: Words and marks that typists add behind a name and that name nothing.
NOISE_WORDS = ("value", "values", "nom", "nominal value", "site")


def name_tokens(c: Column, noise: Sequence[str] = NOISE_WORDS) -> Column:
    """Lower-case tokens; brackets, what follows an at sign, and noise words are left out."""
    s = F.regexp_replace(strip(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"@.*$", " ")
    s = F.regexp_replace(s, r"(?<=\p{L}[\p{Ll}0-9.])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}%]+"), lambda w: w != "")
    kept = words
    if noise:  # also as a scanner reads them, or stuck to the last word
        stuck = r"(?<=\p{L}{4})(?:" + "|".join(w for w in noise if len(w) > 4 and " " not in w) + ")$"
        kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, stuck, "")), lambda w: ~F.translate(w, "01", "ol").isin(list(noise)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def _deletions(t: Column) -> Column:
    """``t`` and what is left of it without one character; for words of the reference."""
    return F.array_union(F.array(t), F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))


def _distance(a: Column, b: Column) -> Column:
    """Edit distance in which swapped neighbours count as one edit."""
    d = F.levenshtein(a, b)
    letters = lambda s: F.array_sort(F.split(s, ""))
    return F.when((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), 1).otherwise(d)


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, edits: Callable[[Column], Column], most: int) -> DataFrame:
    """(a, b, longest): all pairs of strings of a column of ``left`` and one of ``right`` that may be within ``edits(longest)`` edits, 1 to ``most``.

    Complete: of the ``k`` + 1 even parts of ``b``, ``k`` edits leave one unchanged, the i-th at most i places from its own
    and, counted from the end, at most ``k`` - i. Only strings of at least ``most`` + 1 letters are cut.
    The places are broadcast: some 60 rows at most for each distinct length of ``b``, however many strings there are.
    """
    lengths = right.select(F.length(b).alias("lb")).distinct()
    longest = F.greatest("la", "lb")
    fits = lengths.withColumn("la", F.explode(F.sequence(F.greatest(F.lit(1), F.col("lb") - most), F.col("lb") + most))).withColumn("k", edits(longest)).where("abs(la - lb) <= k")
    # The i-th of k + 1 parts of a string of n letters: the first ones are a letter shorter where n is no multiple.
    short, spare = F.floor(F.col("lb") / (F.col("k") + 1)).cast("int"), F.col("lb") % (F.col("k") + 1)
    full = F.greatest(F.lit(0), F.col("i") - (F.col("k") + 1 - spare))
    parts = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("size", short + (F.col("i") >= F.col("k") + 1 - spare).cast("int")).withColumn("start", F.col("i") * short + full)
    moved = F.col("la") - F.col("lb")
    lo = F.greatest(F.lit(0), F.col("start") - F.col("i"), F.col("start") + moved - (F.col("k") - F.col("i")))
    hi = F.least(F.col("la") - F.col("size"), F.col("start") + F.col("i"), F.col("start") + moved + (F.col("k") - F.col("i")))
    places = parts.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi")))
    at_a = left.select(a, F.length(a).alias("la")).join(F.broadcast(places.select("la", "lb", "k", "i", "size", "at")), "la").select(a, "la", "lb", "k", "i", F.expr(f"substring({a}, at + 1, size)").alias("part"))
    at_b = right.select(b, F.length(b).alias("lb")).join(F.broadcast(parts.select("lb", "k", "i", "size", "start").distinct()), "lb").select(b, "lb", "k", "i", F.expr(f"substring({b}, start + 1, size)").alias("part"))
    return at_a.join(at_b, ["lb", "k", "i", "part"]).select(a, b, F.greatest("la", "lb").alias("longest")).distinct()


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim) for distinct ``tokens`` (column token) and reference words (column word)."""
    # Swapped neighbours are two edits to the search, but one to the distance.
    near = near_pairs(tokens.where("length(token) >= 4"), vocabulary.where("length(word) >= 4"), "token", "word", lambda n: F.when(n >= 7, 3).otherwise(2), 3)
    close = near.withColumn("d", _distance(F.col("token"), F.col("word"))).where("d <= case when longest >= 7 then 3 when longest = 6 then 2 else 1 end").select("token", "word", (1 - F.col("d") / F.col("longest")).alias("sim"))
    folds = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s")]
    read = F.array_distinct(F.array(F.col("token"), *[F.translate("token", a, b) for a, b in folds], *[F.translate("token", "01", f"o{x}") for x in "li"]))
    same = tokens.select("token", F.explode(read).alias("word")).join(vocabulary, "word").select("token", "word", F.when(F.col("token") == F.col("word"), 1.0).otherwise(0.98).alias("sim"))
    heads = vocabulary.where("length(word) >= 4").select("word", F.explode(F.transform(F.sequence(F.lit(3), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("token"))
    short = tokens.where("length(token) >= 3").withColumn("head", F.translate("token", "01", "ol")).join(heads.withColumnRenamed("token", "head"), "head").select("token", "word", F.lit(0.9).alias("sim"))
    # An abbreviation without vowels: the consonants of the word, one of them possibly lost.
    bones = vocabulary.where("length(word) >= 5").withColumn("b", F.concat(F.substring("word", 1, 1), F.regexp_replace(F.expr("substring(word, 2)"), "[aeiou]", ""))).where("length(b) >= 3")
    boned = tokens.where("length(token) >= 3 and not substring(token, 2) rlike '[aeiou]'").join(bones.select("word", F.explode(_deletions(F.col("b"))).alias("token")), "token").select("token", "word", F.lit(0.85).alias("sim"))
    return close.unionByName(same).unionByName(short).unionByName(boned).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, reference: DataFrame, *, least: float = 0.62, margin: float = 0.01) -> DataFrame:
    """(name, entry, score) for the distinct names in ``values`` (column name); entry 0 where none is meant.

    ``reference`` has (entry int, name string, aliases array<string>).
    """
    names = checkpoint(values.select("name").where(~is_blank("name")).distinct().withColumn("tokens", name_tokens(F.col("name"))))
    forms = (
        reference.select("entry", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where(~is_blank("form"))
        .distinct().withColumn("tokens", name_tokens(F.col("form"), ()))
    )
    form_tokens = forms.select("entry", "form", F.explode(F.array_distinct("tokens")).alias("word"))
    total = forms.count()
    idf = form_tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.log(1 + total / F.col("df")).alias("w"))
    weighed = form_tokens.join(idf, "word")
    norms = weighed.groupBy("entry", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("form_norm"))
    name_rows = names.select("name", F.explode("tokens").alias("token")).distinct()
    # Read three times below; checkpoints also keep the plan small.
    matches = checkpoint(repair_tokens(name_rows.select("token").distinct(), idf.select("word")).join(idf, "word"))
    best = matches.groupBy("token").agg(F.max_by("w", F.struct("sim", "w")).alias("tw"))
    # A token that resembles nothing weighs as much as the rarest one.
    own = checkpoint(name_rows.join(best, "token", "left").select("name", "token", F.coalesce("tw", F.log(F.lit(1.0 + total))).alias("tw")))
    name_norms = own.groupBy("name").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("name_norm"))
    shared = (
        own.join(matches.select("token", "word", "sim"), "token").join(weighed.select("entry", "form", "word", "w"), "word")
        .groupBy("name", "entry", "form", "word").agg(F.max(F.col("sim") * F.col("tw") * F.col("w")).alias("part")).groupBy("name", "entry", "form").agg(F.sum("part").alias("dot"))
    )
    scored = shared.join(norms, ["entry", "form"]).join(name_norms, "name").select("name", "entry", (F.col("dot") / F.col("form_norm") / F.col("name_norm")).alias("score"))
    # A value put together from several forms of one entry: how much of it the words of the entry explain.
    covered = (
        own.join(matches.select("token", "word", "sim"), "token").join(form_tokens.select("entry", "word").distinct(), "word")
        .groupBy("name", "entry", "token").agg(F.max(F.col("sim") * F.col("tw") * F.col("tw")).alias("part")).groupBy("name", "entry").agg(F.sum("part").alias("dot"), F.count(F.lit(1)).alias("words"))
    )
    mixed = covered.where("words > 1").join(name_norms, "name").select("name", "entry", (F.lit(0.85) * F.col("dot") / (F.col("name_norm") * F.col("name_norm"))).alias("score"))
    # Lost blanks: the whole value against the whole form.
    run_n = names.select("name", F.array_join("tokens", "").alias("run")).where("length(run) >= 6").withColumn("read", F.translate("run", "01", "ol"))
    run_f = forms.select("entry", F.array_join("tokens", "").alias("form_run")).where("length(form_run) >= 6").distinct()
    alike = near_pairs(run_n.select("read").distinct(), run_f.select("form_run").distinct(), "read", "form_run", lambda n: F.lit(2), 2).select("read", "form_run")
    whole = (
        alike.join(run_n, "read").join(run_f, "form_run").withColumn("d", _distance(F.col("run"), F.col("form_run"))).where("d <= 2")
        .select("name", "entry", (1 - F.col("d") / F.length("form_run")).alias("score"))
    )
    ranked = scored.unionByName(whole).unionByName(mixed).groupBy("name", "entry").agg(F.max("score").alias("score"))
    by = Window.partitionBy("name").orderBy(F.desc("score"), "entry")
    first = ranked.withColumn("k", F.row_number().over(by)).withColumn("second", F.lead("score").over(by)).where("k = 1")
    sure = (F.col("score") >= least) & (F.coalesce("second", F.lit(0.0)) < F.col("score") - margin)
    return names.select("name").join(first, "name", "left").select("name", F.when(sure, F.col("entry")).otherwise(0).cast("int").alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"))
