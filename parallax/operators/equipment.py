"""Equipment identity: contexts, mentions, clusters, cross-document matching, mutations. All passes are windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.scalars import centroid_label, coincidence_key, context_handle, context_kind, equipment_kind, identity_anchor, is_part_number
from parallax.functions.text import strip

#: Names under which a record states identity rather than a parameter.
IDENTITY_NAMES = ("equipment id", "device id", "row", "fuse designation", "equipment identifier", "equipment label", "device reference")
STATUS_CONFIDENCE = {"confident_cluster": 0.95, "ambiguous_cluster": 0.6, "lane_conflict": 0.55, "forbidden_cluster": 0.0}
GROUNDINGS = ("text_layer_grounded", "ocr_grounded", "image_region_grounded", "heuristic")


def extract_contexts(records: DataFrame, keys: Sequence[str] = ("doc_id",), title: str = "context_id") -> DataFrame:
    """(keys, raw_title, canonical_id, kind, row_count, pages) for each titled context."""
    named = records.where(F.coalesce(F.col(title), F.lit("")) != "")
    rows = named.groupBy(*keys, F.col(title).alias("raw_title")).agg(F.count_distinct(F.nullif("row_id", F.lit(""))).alias("row_count"), F.sort_array(F.collect_set(F.nullif("page", F.lit(0)))).alias("pages"))
    handle = context_handle("raw_title")
    return rows.select(*keys, "raw_title", F.when(handle == "", F.lower("raw_title")).otherwise(handle).alias("canonical_id"), context_kind("raw_title").alias("kind"), "row_count", "pages")


def align_contexts(contexts: DataFrame, fingerprint: Sequence[str | Column], canonical: str = "canonical_id") -> DataFrame:
    """``contexts`` with aligned_id: contexts of one fingerprint share the least of their handles.

    The least handle is an aggregate, joined back, so contexts of a frequent fingerprint need not meet in one task. Give the pair of
    documents in ``fingerprint`` to keep unrelated documents apart.
    """
    named = {f"__f{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(fingerprint)}
    rows = contexts.withColumns({k: F.coalesce(c.cast("string"), F.lit("\0")) for k, c in named.items()})
    least = rows.groupBy(*named).agg(F.min(canonical).alias("aligned_id"))
    return rows.join(least, list(named)).select(*contexts.columns, "aligned_id")


def cluster_mentions(records: DataFrame, keys: Sequence[str] = ("doc_id",), *, reuse_rows: bool = False) -> DataFrame:
    """Records with cluster_id, cluster_status and the columns that the assembly needs.

    Passes, each over what the passes before left: rows of one context with several mentions (in conflict where
    their identity labels differ); equal identity labels; equal kind and leading number across kinds of
    contexts, unless part numbers disagree (ambiguous); single records. ``reuse_rows`` lets the third
    pass take lone rows that the second already took.
    """
    keys = list(keys)
    handle = context_handle("context_id")
    r = records.withColumns({
        "ctx": F.when(F.coalesce("context_id", F.lit("")) != "", F.when(handle == "", F.lower("context_id")).otherwise(handle)), "row": F.nullif(F.col("row_id").cast("string"), F.lit("")),
        "ctx_kind": context_kind("context_id"), "anchor_value": identity_anchor("raw_value"), "anchor_tag": identity_anchor("entity_tag"),
        "kind1": equipment_kind(F.col("name"), F.col("entity_tag"), F.coalesce(F.nullif("raw_value", F.lit("")), F.col("entity_tag"))), "ck": coincidence_key("raw_value", "normalized_magnitude"),
    })
    r = r.withColumn("anchor", F.coalesce("anchor_value", "anchor_tag"))
    in_row = Window.partitionBy(*keys, "ctx", "row")
    rowed = F.col("ctx").isNotNull() & F.col("row").isNotNull()
    labels = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("anchor_value", "anchor_tag"))).over(in_row)))
    r = r.withColumn("n_row", F.when(rowed, F.count(F.lit(1)).over(in_row)).otherwise(0)).withColumn("row_labels", F.when(F.col("n_row") >= 2, F.size(labels)).otherwise(0))
    r = r.withColumn("p1", F.col("n_row") >= 2)
    left = lambda taken: F.when(~taken, F.lit(1))
    r = r.withColumn("n_anchor", F.when(~F.col("p1") & F.col("anchor").isNotNull(), F.count(left(F.col("p1"))).over(Window.partitionBy(*keys, "anchor"))).otherwise(0)).withColumn("p2", F.col("n_anchor") >= 2)
    free = ~F.col("p1") & (~F.col("p2") | (F.lit(reuse_rows) & (F.col("n_row") == 1))) & (F.col("ck") != "")
    group = Window.partitionBy(*keys, "kind1", "ck", "free")
    parts = F.size(F.collect_set(F.when(is_part_number(F.col("anchor")), F.col("anchor"))).over(group))
    r = r.withColumn("free", free).withColumn("p3", F.col("free") & (F.count(F.lit(1)).over(group) >= 2) & (F.min("ctx_kind").over(group) != F.max("ctx_kind").over(group)) & (parts < 2))
    status = F.when(F.col("p1"), F.when(F.col("row_labels") > 1, "lane_conflict").otherwise("confident_cluster")).when(F.col("p2") & ~(F.lit(reuse_rows) & F.col("p3")), "confident_cluster").when(F.col("p3"), "ambiguous_cluster").otherwise("confident_cluster")
    cluster = F.when(F.col("p1"), F.concat_ws("|", F.lit("row"), "ctx", "row")).when(F.col("p2") & ~(F.lit(reuse_rows) & F.col("p3")), F.concat_ws("|", F.lit("label"), "anchor")).when(F.col("p3"), F.concat_ws("|", F.lit("value"), "kind1", "ck")).otherwise(F.concat_ws("|", F.lit("one"), F.col("record_id").cast("string")))
    return r.withColumn("cluster_id", cluster).withColumn("cluster_status", status)


def build_inventory(records: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row of equipment for each cluster: kind, anchors, descriptors, parameters, canonical id, confidence."""
    keys = list(keys)
    r = cluster_mentions(records, keys)
    group = [*keys, "cluster_id", "cluster_status"]
    primary = F.struct(F.when(F.col("source_lane") == "regex", 0).when(F.col("source_lane") == "llm_text", 1).otherwise(2), "page", "ord")
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.array_compact(c).alias("v")))), lambda s: s["v"])))
    weak = F.array(F.when(F.col("anchor_value").isNull(), F.nullif(strip("raw_value"), F.lit(""))), F.when(F.col("anchor_tag").isNull(), F.nullif(strip("entity_tag"), F.lit(""))))
    r = r.withColumn("first_value", F.row_number().over(Window.partitionBy(*group, "raw_value").orderBy("ord")) == 1)
    base = r.groupBy(*group).agg(
        ordered(F.array("anchor_value", "anchor_tag")).alias("labels"), ordered(weak).alias("weak_descriptors"), F.min("row").alias("row"), F.min_by(F.struct("ctx", "page", "bbox"), primary).alias("first"),
        F.count_distinct("ctx").alias("n_ctx"), F.count_if(F.col("ctx").isNull()).alias("no_ctx"), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.array_compact(F.array(F.coalesce(F.nullif("raw_value", F.lit("")), "entity_tag"), "name", "entity_tag")).alias("v")))), lambda s: s["v"])), " ").alias("texts"),
        F.count(F.lit(1)).alias("mentions"),
    )
    kind, ctx = equipment_kind(F.col("texts")), F.col("first.ctx")
    anchors = F.array_distinct(F.concat("labels", F.array_compact(F.array(ctx, F.when(F.col("row").isNotNull(), F.concat(F.lit("row_"), "row"))))))
    part = F.get("labels", F.lit(0))
    box = F.col("first.bbox")
    place = centroid_label(box["x0"], box["y0"], box["x1"], box["y1"], F.col("first.page"))
    canonical = (
        F.when(ctx.isNotNull() & F.col("row").isNotNull(), F.concat_ws(":", "kind", ctx, F.concat(F.lit("row_"), "row"), part)).when(part.isNotNull(), F.concat_ws(":", "kind", part))
        .when(ctx.isNotNull(), F.concat_ws(":", "kind", ctx, place)).otherwise(F.concat_ws(":p", "kind", F.col("first.page").cast("string")))
    )
    status = F.create_map(*[F.lit(x) for kv in STATUS_CONFIDENCE.items() for x in kv])
    head = base.withColumn("kind", kind).withColumn("identity_anchors", anchors).withColumn("canonical_id", canonical)
    stated = r.where("first_value").where(~F.lower(F.coalesce("name", F.lit(""))).isin("", *IDENTITY_NAMES) & (F.coalesce("raw_value", F.lit("")) != "")).join(head.select(*group, "identity_anchors"), group)
    stated = stated.where(~F.array_contains("identity_anchors", strip("raw_value")))
    values = stated.groupBy(*group, "name").agg(F.max_by("raw_value", "ord").alias("v")).groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("parameters"))
    return head.join(values, group, "left").select(
        *keys, "canonical_id", "kind", "identity_anchors", "weak_descriptors", F.coalesce("parameters", F.create_map().cast("map<string,string>")).alias("parameters"), "mentions",
        F.coalesce(F.try_element_at(status, F.col("cluster_status")), F.lit(0.7)).alias("confidence"), "cluster_status",
    )


def invalid_equipment(inventory: DataFrame) -> DataFrame:
    """Rows that break an invariant: a value with unit in the id, an anchor that is a parameter's value, confidence outside 0..1."""
    from parallax.functions.scalars import VALUE_IN_NAME

    reason = F.when(F.col("canonical_id").rlike(VALUE_IN_NAME), "value_in_id").when(F.arrays_overlap("identity_anchors", F.map_values("parameters")), "anchor_is_value").when(~F.col("confidence").between(0, 1), "confidence")
    return inventory.withColumn("reason", reason).where("reason is not null")


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns of greatest total; shortest augmenting paths with potentials."""
    rows, cols = score.shape
    if rows > cols:
        return [(r, c) for c, r in best_assignment(score.T)]
    cost = score.max() - score
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)
    for r in range(1, rows + 1):
        owner[0], at, low, seen, back = r, 0, np.full(cols + 1, np.inf), np.zeros(cols + 1, bool), np.zeros(cols + 1, int)
        while owner[at]:
            seen[at] = True
            slack = np.concatenate([[np.inf], cost[owner[at] - 1] - u[owner[at]] - v[1:]])
            closer = ~seen & (slack < low)
            low[closer], back[closer] = slack[closer], at
            step = int(np.argmin(np.where(seen, np.inf, low)))
            delta = low[step]
            u[owner[seen]] += delta
            v[seen] -= delta
            low[~seen] -= delta
            at = step
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return [(owner[c] - 1, c - 1) for c in range(1, cols + 1) if owner[c]]


def connected(edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a bipartite graph that has an edge."""
    label = np.arange(edges.shape[0])
    while True:  # the least row of a part spreads over columns to its rows
        column = np.where(edges, label[:, None], edges.shape[0]).min(axis=0)
        new = np.minimum(label, np.where(edges, column[None, :], edges.shape[0]).min(axis=1, initial=edges.shape[0]))
        if (new == label).all():
            break
        label = new
    return [(np.flatnonzero((label == k) & edges.any(axis=1)), np.flatnonzero(column == k)) for k in np.unique(label[edges.any(axis=1)])]


def sorted_inventory(inventory: DataFrame, by: Sequence[str] = ("canonical_id",)) -> DataFrame:
    """An inventory by canonical id, or contexts by (canonical_id, raw_title): for reports; operators need no order."""
    return inventory.orderBy(*by)


def match_equipment(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("pair_id",), *, accept: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(keys, a_id, b_id, status, score): one-to-one matching of two inventories.

    Candidates share kind and an anchor (a label, a context or a row). Score: identity in common 0.5, be it a label or the row of a
    common context, labels in contradiction -0.5, context 0.2, overlap of descriptors 0.1, nearness of pages 0.05 at most where both sides
    have a column page. The assignment is made for each set of connected candidates of one kind; what has no candidate is unmatched.
    """
    keys = list(keys)
    pick = lambda df, s: df.select(*keys, "kind", F.col("canonical_id").alias(f"{s}_id"), F.col("identity_anchors").alias(f"{s}_anchors"), F.col("weak_descriptors").alias(f"{s}_weak"), (F.col("page") if "page" in df.columns else F.lit(None).cast("int")).alias(f"{s}_page"))
    left, right = pick(a, "a"), pick(b, "b")
    meet = left.withColumn("k", F.explode("a_anchors")).join(right.withColumn("k", F.explode("b_anchors")), [*keys, "kind", "k"]).drop("k").distinct()
    label = lambda c: F.filter(c, lambda x: ~F.startswith(x, F.lit("row_")) & identity_anchor(x).isNotNull())
    place = lambda c: F.filter(c, lambda x: ~F.startswith(x, F.lit("row_")) & identity_anchor(x).isNull())
    la, lb = label(F.col("a_anchors")), label(F.col("b_anchors"))
    shared, clash = F.arrays_overlap(la, lb), (F.size(la) > 0) & (F.size(lb) > 0) & ~F.arrays_overlap(la, lb)
    rows = F.arrays_overlap(F.filter("a_anchors", lambda x: F.startswith(x, F.lit("row_"))), F.filter("b_anchors", lambda x: F.startswith(x, F.lit("row_"))))
    union = F.size(F.array_union("a_weak", "b_weak"))
    overlap = F.when(union > 0, F.size(F.array_intersect("a_weak", "b_weak")) / union).otherwise(0.0)
    context = F.coalesce(F.arrays_overlap(place(F.col("a_anchors")), place(F.col("b_anchors"))), F.lit(False))
    near = F.coalesce(0.05 / (1 + F.abs(F.col("a_page") - F.col("b_page"))), F.lit(0.0))
    score = F.when(F.coalesce(shared, F.lit(False)), 0.5).when(clash, -0.5).when(F.coalesce(rows, F.lit(False)) & context, 0.5).otherwise(0.0) + F.when(context, 0.2).otherwise(0.0) + 0.1 * overlap + near
    scored = meet.select(*keys, "kind", "a_id", "b_id", score.alias("score"), clash.alias("clash"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ai, bi = sorted(g["a_id"].unique()), sorted(g["b_id"].unique())
        m = np.full((len(ai), len(bi)), -1.0)
        at = {x: i for i, x in enumerate(ai)}, {x: i for i, x in enumerate(bi)}
        clash = set()
        for r in g.itertuples():
            m[at[0][r.a_id], at[1][r.b_id]] = max(m[at[0][r.a_id], at[1][r.b_id]], r.score)
            if r.clash:
                clash.add((r.a_id, r.b_id))
        out = []
        for i, j in [p for rows, cols in connected(m > -1) for p in [(rows[x], cols[y]) for x, y in best_assignment(m[np.ix_(rows, cols)])]]:
            if m[i, j] <= -1:
                continue
            others = np.concatenate([np.delete(m[i], j), np.delete(m[:, j], i)])
            second = others.max() if len(others) else -1.0
            status = "conflict" if (ai[i], bi[j]) in clash else "matched" if m[i, j] >= accept and m[i, j] - second >= margin else "ambiguous"
            out.append((*[g[k].iat[0] for k in keys], ai[i], bi[j], status, float(m[i, j])))
        return pd.DataFrame(out, columns=[*keys, "a_id", "b_id", "status", "score"])

    types = ", ".join(f"{k} {a.schema[k].dataType.simpleString()}" for k in keys)
    found = scored.groupBy(*keys, "kind").applyInPandas(run, f"{types}, a_id string, b_id string, status string, score double")
    alone = lambda df, s, o: df.select(*keys, f"{s}_id").join(found.select(*keys, f"{s}_id"), [*keys, f"{s}_id"], "left_anti").select(*keys, *sorted([F.col(f"{s}_id"), F.lit(None).cast("string").alias(f"{o}_id")], key=str), F.lit(f"unmatched_{s}").alias("status"), F.lit(0.0).alias("score"))
    return found.unionByName(alone(left, "a", "b")).unionByName(alone(right, "b", "a"))


def parameter_changes(a: DataFrame, b: DataFrame, keys: Sequence[str], parameters: str = "parameters") -> DataFrame:
    """(keys, parameter, a_value, b_value, change): a full outer join of two maps of parameters of the same thing."""
    open_ = lambda df, s: df.select(*keys, F.explode(parameters).alias("parameter", f"{s}_value"))
    both = open_(a, "a").join(open_(b, "b"), [*keys, "parameter"], "full_outer")
    change = F.when(F.col("a_value").isNull(), "parameter_added").when(F.col("b_value").isNull(), "parameter_removed").when(F.col("a_value") != F.col("b_value"), "value_change")
    return both.withColumn("change", change).where("change is not null")


def equipment_mutations(a: DataFrame, b: DataFrame, matches: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Every difference of two inventories: values and parameters of matched equipment, equipment added or removed, ambiguous and conflicting matches."""
    keys = list(keys)
    sure = matches.where("status = 'matched'").select(*keys, "a_id", "b_id")
    side = lambda df, s: df.withColumnRenamed("canonical_id", f"{s}_id").join(sure, [*keys, f"{s}_id"]).select(*keys, "a_id", "b_id", "parameters")
    inside = parameter_changes(side(a, "a"), side(b, "b"), [*keys, "a_id", "b_id"])
    names = {"unmatched_a": "equipment_removed", "unmatched_b": "equipment_added", "ambiguous": "ambiguous_match", "conflict": "equipment_conflict"}
    change = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("status"))
    none = F.lit(None).cast("string")
    return inside.unionByName(matches.where("status <> 'matched'").select(*keys, "a_id", "b_id", none.alias("parameter"), none.alias("a_value"), none.alias("b_value"), change.alias("change")))
