"""Pairing records of two documents: exact one-to-one, by similarity, and by range; many document pairs in one job.

``keys`` separate document pairs. Ties are broken by ``ord``, the position in the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.scalars import canonical_phrase, designation_family, equivalent, middle, with_base_quantity
from parallax.functions.text import clean, strip


def _prepared(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = df.select(
        *keys, "page", F.lower(strip("name")).alias("nm"), "record_id", "ord", F.coalesce("entity_tag", F.lit("")).alias("tag"), middle(F.col("bbox.y0"), F.col("bbox.y1")).alias("y"),
        F.col("normalized_magnitude").isNotNull().alias("numeric"), designation_family("raw_value").alias("family"), "raw_value",
    )
    # Fresh attributes, so that both sides may come from one frame.
    fresh = [F.col(c).alias(c) for c in (*keys, "page", "record_id", "ord")]
    return with_base_quantity(rows, "raw_value", "q").select(*fresh, "nm", "tag", "y", "numeric", "family", clean("raw_value").alias("folded"), F.col("q.magnitude").alias("m"), F.col("q.dimension").alias("d"))


def _same_value(a: dict, b: dict, tolerance: float = 1e-3) -> bool:
    if a["folded"] == b["folded"]:
        return True
    if a["d"] is None or a["d"] != b["d"] or a["m"] is None or b["m"] is None:
        return False
    return a["m"] == 0 if b["m"] == 0 else abs(a["m"] - b["m"]) / abs(b["m"]) <= tolerance


def pair_bucket(left: Sequence[dict], right: Sequence[dict], reach: float = 1000.0) -> list[tuple]:
    """(a, b, pairing_confidence, value_equivalent) for the records of one page and name; each record is used once.

    A record looks for partners with its tag, else with any tag. Where counts differ or positions tell
    nothing, only an equal value pairs; else the nearest by height does, within ``reach``.
    """
    a_rows, b_rows = (sorted(rows, key=lambda r: (r["ord"], r["record_id"])) for rows in (left, right))
    n_a, n_b, used, out = len(a_rows), len(b_rows), set(), []
    for a in a_rows:
        fits = [b for b in b_rows if a["numeric"] or a["family"] is None or b["family"] is None or a["family"] == b["family"]]
        strict = [b for b in fits if b["tag"] == a["tag"]]
        pool = strict or fits
        free = [b for b in pool if b["record_id"] not in used]
        if not free:
            continue
        anchored = bool(a["tag"]) and len(strict) == 1
        uneven = n_a != n_b and max(n_a, n_b) > 1
        level = len(pool) > 1 and len({b["y"] for b in pool}) == 1
        if (uneven or level) and not anchored:
            best = next((b for b in free if _same_value(a, b)), None)
            if best is None:
                continue
            same_tag = a["tag"] == best["tag"]
            sure = (1.0 if a["tag"] else 0.5) if same_tag else 0.4
            equal = True
        else:
            best = min(free, key=lambda b: abs(a["y"] - b["y"]))
            if abs(a["y"] - best["y"]) > reach:
                continue
            sure = (1.0 if a["tag"] and a["tag"] == best["tag"] else 0.55 if a["tag"] != best["tag"] else 0.9 if n_a <= 1 and n_b <= 1 else 0.75)
            equal = _same_value(a, best)
        used.add(best["record_id"])
        out.append((a["record_id"], best["record_id"], sure, equal))
    return out


def align_exact(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("pair_id",), reach: float = 1000.0) -> DataFrame:
    """(keys, a, b, name_match_confidence, value_equivalent, pairing_confidence): one-to-one on page and name.

    What one record uses up matters only to records of the same page and name, so each such bucket is
    paired on its own; a bucket is one name on one page of one pair of documents. Buckets with one record on either side, the
    common case, need no order and are paired by expressions; the others go through Python many at a time.
    """
    keys, bucket = list(keys), [*keys, "page", "nm"]
    left, right = _prepared(a, keys), _prepared(b, keys)
    id_type = a.schema["record_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type.value_type.field("record_id").type
            got = [p for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in pair_bucket(x, y, reach)]
            columns = list(zip(*got, strict=True)) or [[], [], [], []]
            types = [kind, kind, pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["a_id", "b_id", "pairing_confidence", "value_equivalent"])

    row = F.struct(*[c for c in left.columns if c not in bucket])
    sides = [df.groupBy(*bucket).agg(F.count(F.lit(1)).alias(f"n_{s}"), F.collect_list(row).alias(s)) for df, s in ((left, "a"), (right, "b"))]
    both = sides[0].join(sides[1], bucket)
    crowded = both.where("n_a > 1 or n_b > 1").select("a", "b").mapInArrow(run, f"a_id {id_type}, b_id {id_type}, pairing_confidence double, value_equivalent boolean")
    lone = both.where("n_a = 1 and n_b = 1").select(*[F.get(s, F.lit(0))[c].alias(f"{t}_{c}") for s, t in (("a", "l"), ("b", "r")) for c in left.columns if c not in bucket])
    q = lambda s: F.struct(F.col(f"{s}_m").alias("magnitude"), F.col(f"{s}_d").alias("dimension"))
    lone = lone.where((F.col("l_numeric") | F.coalesce(F.col("l_family") == F.col("r_family"), F.lit(True))) & (F.abs(F.col("l_y") - F.col("r_y")) <= reach)).select(
        F.col("l_record_id").alias("a_id"), F.col("r_record_id").alias("b_id"),
        F.when((F.col("l_tag") != "") & (F.col("l_tag") == F.col("r_tag")), 1.0).when(F.col("l_tag") != F.col("r_tag"), 0.55).otherwise(0.9).alias("pairing_confidence"),
        equivalent(F.col("l_folded"), q("l"), F.col("r_folded"), q("r")).alias("value_equivalent"),
    )
    return attach(lone.unionByName(crowded), a, b, keys).withColumn("name_match_confidence", F.lit(1.0))


def attach(matches: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Record structs a and b for matches by a_id and b_id."""
    left = a.select(*keys, F.col("record_id").alias("a_id"), F.struct(*a.columns).alias("a"))
    right = b.select(F.col("record_id").alias("b_id"), F.struct(*b.columns).alias("b"))
    return matches.join(left, "a_id").join(right, "b_id").drop("a_id", "b_id")


Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(dims: int = 256, n: int = 3) -> Embed:
    """A fixed embedder: signed hashed character n-grams and words; needs no model."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            s = f" {t.lower()} "
            for g in [*(s[k : k + n] for k in range(len(s) - n + 1)), *s.split()]:
                h = zlib.crc32(g.encode())
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
        return out

    return embed


def embed_texts(texts: DataFrame, text: str, embed: Embed, cache: DataFrame | None = None) -> DataFrame:
    """(text, vector) of distinct texts; those in ``cache`` (text, vector) are not embedded again."""
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    misses = distinct if cache is None else distinct.join(cache.select("text"), "text", "left_anti")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "vector": list(np.asarray(embed(b["text"].tolist()), np.float32)) if len(b) else []})

    fresh = misses.mapInPandas(run, "text string, vector array<float>")
    return fresh if cache is None else fresh.unionByName(cache.select("text", "vector").join(distinct, "text", "left_semi"))


def similarity_top1(a: DataFrame, b: DataFrame, *, key: str, vector: str, group: Sequence[str] = (), least: float = -1.0, block: int = 4096) -> DataFrame:
    """(a_key, b_key, similarity): for each a the most similar b of its group and another key; ties go to the smaller key.

    b is the stated set, taken in blocks: vectors of one block are stacked and every block of a is
    multiplied with them; the best of each block is kept and the best of all taken by an aggregate.
    """
    group = list(group)
    a_type, b_type = a.schema[key].dataType.simpleString(), b.schema[key].dataType.simpleString()
    blocks = max(1, -(-b.count() // block))
    left = a.select(F.col(key).alias("a_key"), F.col(vector).alias("v"), F.concat_ws("\u0001", *group).alias("g") if group else F.lit("").alias("g")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = b.select(F.col(key).alias("b_key"), F.col(vector).alias("v"), F.concat_ws("\u0001", *group).alias("g") if group else F.lit("").alias("g"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("blk"))

    def unit(rows) -> np.ndarray:
        m = np.vstack(rows).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a_key": [], "b_key": [], "similarity": []})
        y = y.sort_values("b_key", kind="stable")
        keys, right_m, out = y["b_key"].to_numpy(), unit(y["v"]), []
        for s in range(0, len(x), 1024):
            part = x.iloc[s : s + 1024]
            sims = unit(part["v"]) @ right_m.T
            sims[part["a_key"].to_numpy()[:, None] == keys[None, :]] = -np.inf
            best = np.argmax(sims, axis=1)
            top = sims[np.arange(len(part)), best]
            ok = np.isfinite(top)
            out.append(pd.DataFrame({"a_key": part["a_key"].to_numpy()[ok], "b_key": keys[best][ok], "similarity": top[ok]}))
        return pd.concat(out, ignore_index=True)

    # Queries of one group and block are spread over salts, so no task takes them all.
    salts = 8
    left = left.withColumn("salt", F.pmod(F.xxhash64("a_key"), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["g", "blk", "salt"]
    best = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(run, f"a_key {a_type}, b_key {b_type}, similarity double")
    top = best.groupBy("a_key").agg(F.min_by(F.struct("b_key", "similarity"), F.struct(F.negative(F.round("similarity", 12)), "b_key")).alias("t"))
    return top.select("a_key", "t.b_key", "t.similarity").where(F.col("similarity") >= least)


def align_semantic(a: DataFrame, b: DataFrame, embed: Embed, keys: Sequence[str] = ("pair_id",), *, threshold: float = 0.85, same_page_only: bool = True) -> DataFrame:
    """Pairs of numeric records whose names are alike: for each a the most similar b, the first of equals; b may serve several.

    Cosines are computed once for distinct pairs of names that share a document pair, dimension and, if asked, page;
    the records join on names afterwards.
    """
    keys = list(keys)
    prep = lambda df, s: with_base_quantity(df.where("normalized_magnitude is not null"), "raw_value", "q").select(
        *keys, F.col("q.dimension").alias("d"), canonical_phrase("name").alias(f"{s}_phrase"), F.col("page").alias(f"{s}_page"), F.coalesce("entity_tag", F.lit("")).alias(f"{s}_tag"),
        F.col("record_id").alias(f"{s}_id"), F.col("ord").alias(f"{s}_ord"), F.col("raw_value").alias(f"{s}_raw"), F.struct("q.*").alias(f"{s}_q"),
    ).where("d is not null")
    left, right = prep(a, "a"), prep(b, "b")
    on = [*keys, "d"]
    if same_page_only:
        left, right, on = left.withColumn("p", F.col("a_page")), right.withColumn("p", F.col("b_page")), [*on, "p"]
    phrases = left.select(*on, "a_phrase").distinct().join(right.select(*on, "b_phrase").distinct(), on).select("a_phrase", "b_phrase").distinct()
    vectors = embed_texts(phrases.select(F.explode(F.array("a_phrase", "b_phrase")).alias("text")), "text", embed)
    pairs = phrases.join(vectors.select(F.col("text").alias("a_phrase"), F.col("vector").alias("u")), "a_phrase").join(vectors.select(F.col("text").alias("b_phrase"), F.col("vector").alias("v")), "b_phrase")
    from parallax.functions.scalars import cosine

    alike = pairs.withColumn("sim", cosine(F.col("u"), F.col("v"))).where(F.col("sim") >= threshold).select("a_phrase", "b_phrase", "sim")
    joined = left.join(alike, "a_phrase").join(right, [*on, "b_phrase"])
    fits = ~((F.col("a_tag") != "") & (F.col("b_tag") != "") & (F.col("a_tag") != F.col("b_tag"))) & ~((F.col("a_page") != F.col("b_page")) & ((F.col("a_tag") != "") != (F.col("b_tag") != "")))
    best = joined.where(fits).groupBy("a_id").agg(F.max_by(F.struct("b_id", "sim", "a_raw", "a_q", "b_raw", "b_q"), F.struct("sim", F.negative("b_ord"))).alias("t"))
    matches = best.select("a_id", "t.b_id", F.col("t.sim").alias("name_match_confidence"), equivalent(F.col("t.a_raw"), F.col("t.a_q"), F.col("t.b_raw"), F.col("t.b_q")).alias("value_equivalent"), F.lit(1.0).alias("pairing_confidence"))
    return attach(matches, a, b, keys)


def combine_alignments(exact: DataFrame, semantic: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Exact pairs, and semantic pairs whose a (document, page, corner, name) is in none; the first semantic pair of each a."""
    a_key = lambda df: df.withColumns({"k1": F.col("a.doc_id"), "k2": F.col("a.page"), "k3": F.col("a.bbox.x0"), "k4": F.col("a.bbox.y0"), "k5": F.col("a.name")})
    on = [*keys, "k1", "k2", "k3", "k4", "k5"]
    rest = a_key(semantic).join(a_key(exact).select(*on).distinct(), on, "left_anti")
    first = rest.withColumn("n", F.row_number().over(Window.partitionBy(*on).orderBy("a.ord"))).where("n = 1").drop("n", "k1", "k2", "k3", "k4", "k5")
    return exact.unionByName(first, allowMissingColumns=True)


def same_entity_pairs(pairs: DataFrame, a_entity: Column, b_entity: Column) -> DataFrame:
    """Pairs whose entities are both implicit or equal."""
    implicit = lambda e: F.startswith(e, F.lit("implicit_"))
    return pairs.where((implicit(a_entity) & implicit(b_entity)) | (~implicit(a_entity) & ~implicit(b_entity) & (a_entity == b_entity)))


def unpaired(records: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Records in no pair; ``side`` is a or b."""
    return records.join(pairs.select(F.col(f"{side}.record_id").alias("record_id")).distinct(), "record_id", "left_anti")


def bind_to_ranges(records: DataFrame, ranges: DataFrame, keys: Sequence[str], *, value: Column, record_id: str = "record_id", label: str = "label", lo: str = "y_top", hi: str = "y_bottom", order: str = "ord", width: float | None = None) -> DataFrame:
    """(record_id, label): the narrowest range that holds the value, the first of equals; records in none are left out.

    With ``width`` both sides carry buckets of that width, and a range is copied to those it covers, so wide keys
    still join on equality; else the keys alone must be selective.
    """
    left = records.select(*keys, F.col(record_id).alias("record_id"), value.alias("v"))
    right = ranges.select(*keys, F.col(label).alias("label"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(order).alias("o")).where("lo <= hi")
    on = list(keys)
    if width is not None:
        left, on = left.withColumn("bk", F.floor(F.col("v") / width)), [*on, "bk"]
        right = right.withColumn("bk", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    # The least width first, by a hash aggregate over all hits; then the ranges of just that width, an equi-join.
    hits = left.join(right, on).where("v between lo and hi")
    least = hits.groupBy("record_id").agg(F.min(F.col("hi") - F.col("lo")).alias("w"))
    tight = left.join(least, "record_id").join(right.withColumn("w", F.col("hi") - F.col("lo")), [*on, "w"]).where("v between lo and hi")
    return tight.groupBy("record_id").agg(F.min_by("label", "o").alias("label"))
