"""Scalar functions of the review as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax import fixed
from parallax.functions.text import col, strip
from parallax.functions.units import NUMBER, with_unit


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The value of ``key`` in a small fixed mapping, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_parameter(name: Column | str, aliases: Mapping[str, str] = fixed.NAME_ALIASES) -> Column:
    """Display form of a parameter name, looked up without case and outer blanks; unknown names pass unchanged."""
    return F.coalesce(lookup(aliases, F.lower(strip(name))), col(name))


def canonical_phrase(name: Column | str, phrases: Mapping[str, str] = fixed.PHRASES) -> Column:
    """The phrase to embed: as written, then without outer blanks, else unchanged."""
    return F.coalesce(lookup(phrases, col(name)), lookup(phrases, strip(name)), col(name))


def attribute_family(name: Column | str, families: Mapping[str, str] = fixed.FAMILIES) -> Column:
    """Tolerance family of a parameter name; null if it has none."""
    return lookup(families, canonical_phrase(name))


def designation_family(raw: Column | str) -> Column:
    """Letters that open a designation before its first digit; null for values that open with a digit, lower case or nothing."""
    s = strip(raw)
    tight, loose, bare = (F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"^([A-Z][A-Z\-]*?)-?\d", r"^([A-Z][A-Z\-]*)(?:[\s\-]+)?\d", r"^([A-Z][A-Z\-]*)"))
    return F.coalesce(tight, loose, bare)


def families_agree(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def first_number(raw: Column | str) -> Column:
    """The first number in a text, commas dropped; null if none."""
    return F.regexp_replace(F.regexp_extract(col(raw), r"(-?\d[\d,]*\.?\d*)", 1), ",", "").try_cast("double")


def value_form(raw: Column | str) -> Column:
    """Lower case without commas, only letters, digits, points and percent signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(raw)), ",", ""), r"[^a-z0-9.%]", "")


def with_base_quantity(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct<magnitude, dimension> of "number unit" with commas dropped; a bare number is dimensionless.

    Apparent and real power are one dimension. Null where the text is no quantity.
    """
    s = F.regexp_replace(strip(raw), ",", "")
    number = F.regexp_extract(s, rf"^({NUMBER})", 1)
    df = df.withColumn("__n", number.try_cast("double")).withColumn("__u", strip(F.regexp_replace(s, rf"^{NUMBER}", "")))
    df = with_unit(df, F.nullif("__u", F.lit("")), "__unit")
    dimension = F.when(F.col("__unit.common") == "volt_ampere", "watt").otherwise(F.col("__unit.common"))
    q = F.when(F.col("__n").isNull(), F.lit(None)).when(F.col("__u") == "", F.struct(F.col("__n").alias("magnitude"), F.lit("dimensionless").alias("dimension"))).when(
        F.col("__unit").isNotNull(), F.struct((F.col("__n") * F.col("__unit.factor") + F.col("__unit.offset")).alias("magnitude"), dimension.alias("dimension"))
    )
    return df.withColumn(out, q).drop("__n", "__u", "__unit")


def equivalent(raw_a: Column, q_a: Column, raw_b: Column, q_b: Column, tolerance: float = 1e-3) -> Column:
    """Equal as text, or of one dimension and within ``tolerance`` of b; only zero equals zero."""
    a, b = q_a["magnitude"], q_b["magnitude"]
    close = F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)
    return (F.lower(strip(raw_a)) == F.lower(strip(raw_b))) | F.coalesce((q_a["dimension"] == q_b["dimension"]) & close, F.lit(False))


def relative_deviation(a: Column, b: Column) -> Column:
    """Percent of the larger side; zero where both are zero."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top * 100)


def severity(deviation: Column, tolerance: Column, major: Column, critical: Column) -> Column:
    return F.when(deviation >= critical, "critical").when(deviation >= major, "major").when(deviation >= tolerance, "minor").otherwise("info")


def severity_rank(s: Column) -> Column:
    return F.when(s == "critical", 0).when(s == "major", 1).when(s == "minor", 2).otherwise(3)


def confidence(extraction: Column, match: Column, authority: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), extraction * match * authority))


def decimal_shift(a: Column, b: Column, factor: float = 3.0) -> Column:
    """Whether the larger magnitude is more than ``factor`` times the smaller; false where one is missing or the smaller is zero."""
    lo = F.least(a, b)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (lo != 0) & (F.greatest(a, b) / lo > factor), F.lit(False))


def middle(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


def claim_id(entity: Column, attribute: Column, raw: Column, doc: Column, page: Column) -> Column:
    return F.sha2(F.concat_ws("|", entity, attribute, raw, doc, page.cast("string")), 256)


def flag_id(parameter: Column, a: Column, b: Column) -> Column:
    """``a`` and ``b`` are record structs."""
    y = a["bbox"]["y0"].cast("int").cast("string")
    return F.concat_ws("|", parameter, a["doc_id"], F.concat(F.lit("p"), a["page"]), F.concat(F.lit("y"), y), a["raw_value"], F.lit("vs"), b["doc_id"], F.concat(F.lit("p"), b["page"]), b["raw_value"])


def cache_key(namespace: str, *columns: str) -> Column:
    """Namespace and a hash of the values in the order of the column names."""
    return F.concat_ws(":", F.lit(namespace), F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two arrays, the longer one cut; zero for empty or zero vectors. For single pairs, not for all pairs."""
    n = F.least(F.size(u), F.size(v))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cut = lambda a: F.slice(a, 1, F.greatest(n, F.lit(1)))
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when((F.size(u) < 1) | (F.size(v) < 1) | (norm == 0), 0.0).otherwise(dot(cut(u), cut(v)) / norm)


def verbatim(span: Column, page: Column) -> Column:
    """Whether the span, blanks collapsed, stands in the page."""
    flat = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce((flat(span) != "") & F.contains(flat(page), flat(span)), F.lit(False))


def grounded(entity: Column, page: Column) -> Column:
    """The entity, blanks collapsed and in lower case, or each of its tokens, stands in the page."""
    flat = lambda c: F.lower(strip(F.regexp_replace(c, r"\s+", " ")))
    tokens = F.regexp_extract_all(flat(entity), F.lit(r"(\w[\w./\\\-]*)"))
    return F.coalesce((flat(entity) != "") & (F.contains(flat(page), flat(entity)) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(flat(page), t)))), F.lit(False))


def mentions_value(rationale: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.contains(rationale, a), F.lit(False)) | F.coalesce(F.contains(rationale, b), F.lit(False))


def row_marker(text: Column | str) -> Column:
    """The device or row marker that opens a line: circled digits as numbers, trailing point or bracket dropped; '' if none."""
    raw = F.regexp_extract(col(text), fixed.ROW_MARKER, 1)
    t = F.upper(F.regexp_replace(strip(raw), r"[.)]+$", ""))
    circled = {chr(0x2460 + i): str(i + 1) for i in range(20)} | {chr(0x3251 + i): str(21 + i) for i in range(15)}
    return F.coalesce(lookup(circled, t), t)


def infer_entity(text: Column | str, doc_id: Column | str, patterns: Sequence[tuple[str, str, str, str]] = fixed.TAG_PATTERNS) -> Column:
    """struct<id, type, label> of the left-most equipment tag; the implicit entity of the document if there is none."""
    text, found = col(text), []
    for k, (pattern, kind, prefix, label) in enumerate(patterns):
        groups = label.count("{")
        parts = [F.regexp_extract(text, pattern, g + 1) for g in range(groups)]
        shown = F.lit(label.split("{")[0])
        for g, part in enumerate(parts):
            shown = F.concat(shown, part, F.lit(label.split(f"{{{g}}}")[1].split("{")[0]))
        name = F.lower(F.concat_ws("_", *([F.lit(prefix)] if prefix else []), *parts))
        found.append(F.when(F.regexp_instr(text, F.lit(pattern)) > 0, F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), F.lit(k).alias("k"), name.alias("id"), F.lit(kind).alias("type"), shown.alias("label"))))
    best = F.array_min(F.array_compact(F.array(*found)))
    doc = F.lower(F.regexp_replace(F.regexp_replace(col(doc_id), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    implicit = F.struct(F.concat(F.lit("implicit_"), F.when(doc == "", "doc").otherwise(doc)).alias("id"), F.lit("implicit").alias("type"), F.concat(F.lit("(unnamed equipment in "), col(doc_id), F.lit(")")).alias("label"))
    return F.coalesce(F.when(best.isNotNull(), F.struct(best["id"].alias("id"), best["type"].alias("type"), best["label"].alias("label"))), implicit)


def entity_type(value: Column | str, known: Sequence[str] = fixed.ENTITY_TYPES) -> Column:
    return F.when(col(value).isin(*known), col(value)).otherwise("implicit")


def context_handle(title: Column | str) -> Column:
    """Stable handle of a context title: alias, numbered series, else its slug; '' for none."""
    slug = F.coalesce(F.regexp_replace(F.lower(strip(title)), r"[^a-z0-9]+", ""), F.lit(""))
    number = F.regexp_extract(slug, fixed.CONTEXT_SERIES, 1)
    return F.coalesce(lookup(fixed.CONTEXT_ALIASES, slug), F.when(number != "", F.concat(F.lit("tcc"), number)), slug)


def context_kind(title: Column | str) -> Column:
    slug = F.coalesce(F.regexp_replace(F.lower(strip(title)), r"[^a-z0-9]+", ""), F.lit(""))
    has = lambda *words: slug.rlike("|".join(words))
    return F.when(has("diagram", "oneline", "singleline"), "diagram_label").when(has("schedule"), "schedule").when(has("tcc", "curve", "plot", "table"), "table_row").otherwise("prose")


VALUE_IN_NAME = r"(?i)\b\d[\d,]*\.?\d*\s*(kva|mva|kv|mv|ka|va|hz|°c|°f|ω|μf|%|v|a)\b"
PART_NUMBER = r"\b(?:LPS|LPN|LPJ|KRP|FNQ|FRS|FRN|JCN|JJN|JJS|EC|KTK)[\-\s]"


def identity_anchor(text: Column | str) -> Column:
    """The first identity label in a text, unless the text holds a value with a unit; null if none."""
    s = strip(text)
    found = F.coalesce(*[F.nullif(F.regexp_extract(s, p, 0), F.lit("")) for p in fixed.ANCHORS])
    return F.when(~F.coalesce(s, F.lit("")).rlike(VALUE_IN_NAME), strip(found))


def is_part_number(anchor: Column) -> Column:
    return F.coalesce(anchor.rlike(PART_NUMBER), F.lit(False))


def equipment_kind(*texts: Column) -> Column:
    """The first kind one of whose words stands in the texts, joined by blanks and in lower case."""
    joined = F.array_join(F.filter(F.array(*[F.lower(t) for t in texts]), lambda t: t.isNotNull() & (t != "")), " ")
    out = F.when(F.lit(False), "other")
    for kind, words in fixed.KIND_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(joined, F.lit(w))
        out = out.when(hit, kind)
    return out.otherwise("other")


def coincidence_key(raw: Column | str, magnitude: Column | str) -> Column:
    """The leading number of a value without commas, else its magnitude in six significant digits; '' if neither."""
    token = F.regexp_replace(F.regexp_extract(F.coalesce(col(raw), F.lit("")), r"(\d[\d,]*\.?\d*)", 1), ",", "")
    m = col(magnitude).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(m))))
    return F.coalesce(F.nullif(token, F.lit("")), F.when(m == 0, "0").otherwise((F.round(m * scale) / scale).cast("string")), F.lit(""))


def centroid_label(x0: Column, y0: Column, x1: Column, y1: Column, page: Column) -> Column:
    rounded = lambda a, b: F.bround((a + b) / 2, 0).cast("long").cast("string")
    p = F.concat(F.lit("p"), page.cast("string"))
    return F.when(x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull(), F.concat(p, F.lit("_loc_centroid"))).otherwise(F.concat_ws("_", p, F.lit("loc"), rounded(x0, x1), rounded(y0, y1)))


def authority_side(a_class: Column, b_class: Column, family: Column, hierarchy: Mapping[str, Sequence[str]] = fixed.HIERARCHY) -> Column:
    """doc_a or doc_b: the class that ranks higher in the hierarchy of the family; doc_a where it does not apply."""
    ranks = F.create_map(*[x for k, v in hierarchy.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.try_element_at(ranks, family)
    position = lambda c: F.coalesce(F.array_position(own, c), F.lit(0))
    applies = own.isNotNull() & (a_class != "unknown") & (b_class != "unknown")
    return F.when(F.coalesce(applies & (position(b_class) > position(a_class)), F.lit(False)), "doc_b").otherwise("doc_a")


def provenance_label(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unknown").when((a == "regex") & (b == "regex"), "regex").when((a == "llm") & (b == "llm"), "llm").otherwise("mixed")


def page_structure(n_chars: Column, average: Column, short_share: Column, image_share: Column) -> Column:
    return (
        F.when((short_share > 0.6) & (average < 25), "diagram").when(n_chars < 200, "mixed").when((short_share < 0.3) & (average > 40), "prose")
        .when(image_share > 0.3, "diagram").otherwise("mixed")
    )


def value_excerpt(span: Column, raw: Column, around: int = 120, longest: int = 300) -> tuple[Column, Column]:
    """Where ``raw`` stands in ``span`` (exact, without case, with blanks ignored, its number; 0 if nowhere), and an excerpt around it."""
    exact, folded = F.instr(span, raw), F.instr(F.lower(span), F.lower(raw))
    loose = F.regexp_instr(span, F.concat(F.lit("(?i)"), F.array_join(F.transform(F.split(strip(raw), r"\s+"), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")), r"\s*")))
    number = F.regexp_extract(raw, r"(\d[\d,]*\.?\d*)", 1)
    at = F.when(exact > 0, exact).when(folded > 0, folded).when(loose > 0, loose).when(number != "", F.instr(span, number)).otherwise(0)
    start = F.greatest(at - around, F.lit(1))
    cut = F.substring(span, start, at + F.length(raw) + around - start)
    marked = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + F.length(cut) <= F.length(span), "…").otherwise(""))
    return at, F.when((F.length(span) <= longest) | (at == 0), span).otherwise(marked)


def model_cost(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column, in_rate: Column, out_rate: Column, hour: Column) -> Column:
    """Cost by rates per million tokens (a price table is joined by the caller); zero without a rate."""
    n = lambda c: F.coalesce(c, F.lit(0))
    total = n(input_tokens) * in_rate + n(output_tokens) * out_rate + n(cache_read) * in_rate * 0.1 + n(cache_write) * in_rate * F.when(hour, 2.0).otherwise(1.25)
    return F.coalesce(total / 1e6, F.lit(0.0))
