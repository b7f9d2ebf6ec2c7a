"""Measures of a review against expectations; all aggregates, with defined results for empty inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.text import col, strip


def rate(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def precision_recall(df: DataFrame, tp: Column, fp: Column, fn: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of 0/1 columns; zero where a denominator is zero."""
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    rows = df.groupBy(*by).agg(n(tp, "tp"), n(fp, "fp"), n(fn, "fn"))
    rows = rows.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matches_gold(flags: DataFrame, gold: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Flags and expectations of one pair whose parameter and both values contain, without case, what is expected ('' matches all)."""
    has = lambda flag, want: F.contains(F.lower(F.col(flag)), F.lower(F.coalesce(F.col(want), F.lit(""))))
    f = flags.select(*keys, "flag_id", "parameter", F.col("a_record.raw_value").alias("a_raw"), F.col("b_record.raw_value").alias("b_raw"), "confidence")
    return f.join(gold, list(keys)).where(has("parameter", "parameter_substr") & has("a_raw", "a_value_substr") & has("b_raw", "b_value_substr"))


def matches_span_gold(flags: DataFrame, gold: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """The variant by place: equal page, and one of four containments of texts without blanks and case."""
    flat = lambda c: F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", ""))
    f = flags.select(*keys, "flag_id", F.col("a_record.page").alias("page"), F.col("a_record.span_text").alias("a_span"), F.col("b_record.span_text").alias("b_span"), F.col("a_record.raw_value").alias("a_raw"), F.col("b_record.raw_value").alias("b_raw"), "confidence")
    inside = lambda want, have: (flat(want) != "") & F.contains(flat(have), flat(want))
    return f.join(gold, [*keys, "page"]).where(inside("gold_a", "a_span") | inside("gold_a", "a_raw") | inside("gold_b", "b_span") | inside("gold_b", "b_raw"))


def score_gold(flags: DataFrame, gold: DataFrame, keys: Sequence[str] = ("pair_id",), threshold: float = 0.6) -> DataFrame:
    """(keys, gold_id, expected, outcome): tp or fn of what should surface, fp or tn of traps, over flags at ``threshold``."""
    hits = matches_gold(flags.where(F.col("confidence") >= threshold), gold, keys).select(*keys, "gold_id").distinct().withColumn("hit", F.lit(True))
    out = gold.select(*keys, "gold_id", "expected").join(hits, [*keys, "gold_id"], "left")
    surfaced, hit = F.col("expected") == "surfaced", F.col("hit").isNotNull()
    return out.select(*keys, "gold_id", "expected", F.when(surfaced & hit, "tp").when(surfaced, "fn").when(hit, "fp").otherwise("tn").alias("outcome"))


def recall_and_traps(scored: DataFrame) -> DataFrame:
    """(recall, trap_rate): share of expected flags found, share of traps that surfaced."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return scored.agg(rate(n("tp"), n("tp") + n("fn")).alias("recall"), rate(n("fp"), n("fp") + n("tn")).alias("trap_rate"))


def accuracy(df: DataFrame, truth: str, guess: str, groups: Sequence[str]) -> DataFrame:
    """(groups, n, accuracy): overall and by each of ``groups``, in one pass of grouping sets; null marks all."""
    sets = [F.col(g) for g in groups]
    same = F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("int")
    return df.groupingSets([[], *[[c] for c in sets]], *sets).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("accuracy"))


def class_precision(df: DataFrame, truth: str, guess: str, label: str) -> DataFrame:
    """Precision of one class; 1 where it is never guessed."""
    guessed = F.count_if(F.col(guess) == label)
    return df.agg(rate(F.count_if((F.col(guess) == label) & (F.col(truth) == label)), guessed, 1.0).alias("precision"))


def calibration_bins(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n, mean_score, hit_rate): all bins, zeros where empty; scores are clamped to 0..1, and 1 falls in the last bin."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    filled = df.where(F.col(score).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(s * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"), F.avg(F.col(truth).cast("double")).alias("hit_rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return every.join(filled, "bin", "left").select("bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), zero("n", 0), zero("mean_score", 0.0), zero("hit_rate", 0.0))


def brier(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(n, brier): mean squared difference of clamped score and truth; zero for no rows."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) - F.col(truth).cast("double")
    return df.agg(F.count(d).alias("n"), F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier"))


def diagnostics(**tables: DataFrame) -> DataFrame:
    """(table, rows) of the given tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpaired_tally(records: DataFrame) -> DataFrame:
    """(name, records, values by page and value), the most frequent names first."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("page", strip("raw_value").alias("v")))), lambda s: s["v"])
    return records.groupBy("name").agg(F.count(F.lit(1)).alias("records"), values.alias("values")).orderBy(F.desc("records"), "name")
