"""Sources: parsed binary documents, registries, gold files, prompt files, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.schemas import CLAUSE, SPAN


def binary_spans(spark: SparkSession, paths: str | list[str], parse: Callable[[bytes], Iterable[tuple[int, tuple[float, float, float, float], str]]], *, glob: str = "*") -> DataFrame:
    """Spans of binary documents: ``parse`` gives (page, box, text); blank texts are dropped, a file that fails gives none.

    Files are read by the cluster and parsed in Arrow batches; no parser ships, so one is passed in.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = list(parse(bytes(content)))
                except Exception:
                    found = []
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for n, (page, box, text) in enumerate(found):
                    if text and text.strip():
                        out.append((name, page, dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)), text.strip(), path, n))
            yield pd.DataFrame(out, columns=["doc_id", "page", "bbox", "text", "source_path", "ord"])

    return files.mapInPandas(run, SPAN)


def first_non_empty(candidates: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first candidate that has any (readers tried in order)."""
    out, seen = None, None
    for c in candidates:
        fresh = c if seen is None else c.join(seen, key, "left_anti")
        out = fresh if out is None else out.unionByName(fresh)
        seen = out.select(key).distinct()
    return out


def _yaml(path: str | Path):
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError):
        return None


def load_clauses(spark: SparkSession, path: str | Path) -> DataFrame:
    """The clause registry of a YAML file; entries that break the schema are left out, a missing or broken file is empty."""
    loaded = _yaml(path)
    entries = loaded.get("clauses", []) if isinstance(loaded, dict) else loaded or []
    rows = []
    for e in entries if isinstance(entries, list) else []:
        try:
            row = (str(e["clause_id"]), int(e["edition_year"]), str(e["source_name"]), list(map(str, e["applicable_families"])), list(map(str, e.get("applicable_doc_classes") or [])), None if e.get("tolerance_band") is None else float(e["tolerance_band"]), str(e["summary"]))
        except (KeyError, TypeError, ValueError):
            continue
        if row[0] and row[3] and 1900 <= row[1] <= 2100:
            rows.append(row)
    return spark.createDataFrame(rows, CLAUSE)


def load_gold(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """Expected flags of a gold file: (pair_id, gold_id, expected, parameter_substr, a_value_substr, b_value_substr); None if it can't be read."""
    loaded = _yaml(path)
    if not isinstance(loaded, dict) or not isinstance(loaded.get("pairs"), list):
        return None
    rows = []
    for p in loaded["pairs"]:
        for expected in ("surfaced", "suppressed"):
            for g in p.get(expected) or []:
                rows.append((str(p.get("id")), str(g.get("id")), expected, g.get("parameter_substr") or "", g.get("a_value_substr") or "", g.get("b_value_substr") or ""))
    return spark.createDataFrame(rows, "pair_id string, gold_id string, expected string, parameter_substr string, a_value_substr string, b_value_substr string")


def prompt_for(doc_class: str, folder: str | Path, fallback: str = "generic") -> str:
    """The prompt of a document class, else the generic one, else ''."""
    for name in (doc_class, fallback):
        file = Path(folder) / f"{name}.md"
        if file.exists():
            return file.read_text(encoding="utf-8")
    return ""


def page_images(pages: DataFrame, content: str = "content") -> DataFrame:
    """Page images as base64 text for scorers."""
    return pages.withColumn("image_b64", F.base64(content))
