"""Matching mentions of equipment to a register without a common key.

Mentions and register entries are read into kind, number and place. Candidates come from equi-joins on
narrow keys inside a scope (number; exact place; for mentions without a number place through its deletion variants, or kind and area), never from all
pairs of a scope. Each candidate pair gets a vector of similarities (number, where one wrong digit counts half; kind; place; whether
a stored claim supports it); a matched and an unmatched class, regularised Gaussians with a rate of support each,
are fitted to the vectors by expectation-maximisation without labels. No rule stands beside them: the posterior decides.
Transitivity holds in two ways. In every E-step the entries of a register are different things, so the match
probabilities of one mention share a total of one with the case that none matches. And mentions of one entry are one thing: where
an entry says no place, the place to which its mentions give most probability is its place, and what else was
said to be it is not. The result is a posterior for each pair.

Scale: similarities are built-in expressions; the pair table is checkpointed; an EM step is one map that reduces every partition to the sums of
two classes, so nothing of the size of the data reaches the driver; the number of steps is fixed.
Candidates of one mention travel as one array: entries of its scope with its number, or with its place but for a letter.

Defined cases: mentions without number and place, or without a scope, have no candidates; null scopes of entries are looked up
through the documents of their claims, else they match by kind, number and place together; repeated rows of
one mention count once; empty inputs give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.session import checkpoint

# How the kinds of equipment are written
KINDS = {
    "transformer": ["xfmr", "xfr", "transformer", "trafo", "tx"],
    "breaker": ["cb", "bkr", "brkr", "breaker", "circuit breaker"],
    "motor": ["m", "mot", "mtr", "motor"],
    "relay": ["r", "rel", "rly", "relay", "protective relay"],
    "pump": ["p", "pmp", "pump"],
    "line": ["line", "ln", "feeder line", "feeder"],
    "bus": ["bus", "bb", "busbar"],
    "motor_operated_valve": ["mov", "movalve", "m.o.v.", "motor operated valve", "motor-operated valve"],
}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words}
_WORDS = "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(_KIND_OF, key=len, reverse=True))
_DIGITS = r"(?=[0-9lo]*[0-9l])[0-9lo]{1,6}"
_NUMBERED = re.compile(rf"(?<![a-z0-9])({_WORDS})\s*(?:no\.?|nr\.?|number)?\s*[-–—_.#:]*\s*({_DIGITS})(?![a-z0-9])|#\s*({_DIGITS})\s+({_WORDS})(?![a-z])", re.I)
_PLAIN = re.compile(rf"(?<![a-z0-9])({'|'.join(re.escape(w).replace(chr(92) + ' ', chr(92) + 's+') for w in sorted((w for w in _KIND_OF if len(w) > 2), key=len, reverse=True))})(?![a-z0-9])", re.I)
_BARE = re.compile(rf"^\s*#?\s*({_DIGITS})\s*[.)]?\s*$", re.I)
#: Where the naming of the equipment ends and the statement begins.
_HEAD_END = re.compile(r"\s+(?:carries|shows|the sheet states|is listed with|shall be|states)\b|:\s|\s\|\s|\s=\s")
_NOISE = {"the", "a", "an", "for", "row", "serving", "section", "marked", "here", "of", "in", "on", "at", "unit", "this", "page", "equipment", "below", "general", "note", "implicit", "n/a", "na", "tbd", "none", "unknown", "see", "above"}


@dataclass(frozen=True)
class Mention:
    kind: str | None
    number: int | None
    place: str


def _number(s: str) -> int:
    return int(s.lower().replace("l", "1").replace("o", "0"))


def read_mention(text: str | None, *, bare: bool = False) -> Mention:
    """Kind, number and place of a tag, a label or the head of a sentence; ``bare`` takes a lone number as the number."""
    s = (text or "").strip()
    if bare and (m := _BARE.match(s)):
        return Mention(None, _number(m[1]), "")
    kind = number = None
    if m := _NUMBERED.search(s):
        word, digits = (m[1], m[2]) if m[1] else (m[4], m[3])
        kind, number = _KIND_OF[re.sub(r"\s+", " ", word.lower())], _number(digits)
        s = s[: m.start()] + " " + s[m.end() :]
    if n := _PLAIN.search(s):
        kind = kind or _KIND_OF[re.sub(r"\s+", " ", n[1].lower())]
        s = _PLAIN.sub(" ", s)
    words = [w for w in re.split(r"[^\w-]+", re.sub(r"[()|,;]", " ", s.lower())) if w.strip("-_") and w.strip("-_") not in _NOISE and not re.search(r"\d", w)]
    return Mention(kind, number, " ".join(w.strip("-_") for w in words if re.search(r"[^\W\d_]{2}", w)))


def mention_of(tag: str | None, span: str | None, parameter_words: frozenset[str] = frozenset()) -> Mention:
    """The tag first, the head of the span for what the tag leaves open."""
    head = _HEAD_END.split(span or "", maxsplit=1)
    a, b = read_mention(tag, bare=True), read_mention(head[0] if len(head) > 1 else "", bare=True)
    words = b.place.split()
    if words and all(w in parameter_words for w in words):  # a row that names only the parameter
        b = Mention(b.kind, b.number, "")
    kind = a.kind or b.kind
    number = a.number if a.number is not None and (a.kind or b.number is None) else b.number if b.number is not None else a.number
    return Mention(kind, number, a.place or b.place)


def block_keys(scope: str | None, m: Mention) -> list[str]:
    """Keys under which an entry meets its candidates; ``scope`` None for entries of no known scope."""
    words = m.place.split()
    name, area = (words[0], words[-1]) if words else ("", "")
    if scope is None:
        return [f"?|{m.kind}|{m.number}|{name}|{area}"] if words and m.kind else []
    keys = [] if m.number is None else [f"{scope}|n|{m.number}"]
    if words:
        variants = {name, *(name[:i] + name[i + 1 :] for i in range(len(name)))} if len(name) >= 4 else {name}
        keys += [f"{scope}|w|{name}|{area}", *(f"{scope}|v|{v}" for v in sorted(variants))]
        if len(words) > 1 and m.kind:
            keys.append(f"{scope}|a|{m.kind}|{area}|{name[:1]}")
    return keys


def mention_keys(scope: str | None, m: Mention) -> list[str]:
    """The keys of a mention: its number and its exact place, or, without a number, its place as entries have it; and that of entries of no known scope."""
    if scope is None or (m.number is None and not m.place):
        return []
    keys = block_keys(scope, m)
    return [k for k in keys if m.number is None or "|v|" not in k and "|a|" not in k] + block_keys(None, m)


def pair_vector() -> Column:
    """Similarity of number, kind and place, null where one side is silent, and support by a stored claim."""
    a, b = F.col("number").cast("string"), F.col("e_number").cast("string")
    number = F.when(a == b, 1.0).when((F.length(a) > 1) & (F.levenshtein(a, b) == 1), 0.5).when(a.isNotNull() & b.isNotNull(), 0.0)
    kind = (F.col("kind") == F.col("e_kind")).cast("double")
    longest = F.greatest(F.length("place"), F.length("e_place"))
    place = F.when((F.col("place") != "") & (F.col("e_place") != ""), 1 - F.levenshtein("place", "e_place") / longest)
    return F.array(number, kind, place, F.when(F.col("supported"), 1.0).otherwise(0.0))


class Mixture:
    """Matched and unmatched class: Gaussians over similarities, with covariances regularised by the gap of the means, and rates of support.

    A vector counts by the dimensions that it has (the marginal density); moments are taken over the pairs of
    dimensions that are both there. The last column of a vector is support, 0 or 1, too rare for a Gaussian.
    """

    def __init__(self, dims: int):
        self.mean = np.array([np.full(dims, 0.95), np.full(dims, 0.4)])
        self.cov = np.array([np.eye(dims) * 0.05, np.eye(dims) * 0.05])
        self.weight = np.array([0.5, 0.5])
        self.support = np.array([0.2, 0.05])

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log of (weighted matched density / weighted unmatched density)."""
        given, x = x[:, -1], x[:, :-1]
        there = ~np.isnan(x)
        rate = np.log(self.support), np.log1p(-self.support)
        out = math.log(self.weight[0] / self.weight[1]) + np.where(given > 0, rate[0][0] - rate[0][1], rate[1][0] - rate[1][1])
        patterns, which = np.unique(there, axis=0, return_inverse=True)
        for i, pattern in enumerate(patterns):
            own, at = np.flatnonzero(which.ravel() == i), np.flatnonzero(pattern)
            for k, sign in ((0, 1.0), (1, -1.0)):
                d = x[np.ix_(own, at)] - self.mean[k][at]
                part = self.cov[k][np.ix_(at, at)]
                out[own] += sign * (-0.5 * np.linalg.slogdet(part)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(part), d))
        return np.clip(out, -60, 60)

    def posteriors(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Match probabilities under the constraint that one of the candidates of an owner matches or none."""
        if not len(x):
            return np.empty(0)
        ratio = np.exp(self.log_ratio(x))
        return ratio / (1 + np.bincount(owner, ratio))[owner]

    @staticmethod
    def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weight, weight with support, and for each pair of dimensions that are both there: weight, sum of the first, sum of products."""
        given, x = x[:, -1], x[:, :-1]
        there = (~np.isnan(x)).astype(float)
        v = np.nan_to_num(x)
        weighed = there * w[:, None]
        return np.concatenate([[w.sum(), (w * given).sum()], (weighed.T @ there).ravel(), ((v * w[:, None]).T @ there).ravel(), ((v * w[:, None]).T @ v).ravel()])

    def updated(self, sums: np.ndarray, shrink: float = 0.05) -> Mixture:
        dims, new = self.mean.shape[1], Mixture(self.mean.shape[1])
        n = sums[:, 0]
        new.support = (sums[:, 1] + 1) / (n + 2)
        for k in range(2):
            count, first, second = (m.reshape(dims, dims) for m in np.split(sums[k, 2:], 3))
            count = np.maximum(count, 1e-6)
            new.mean[k] = np.diag(first) / np.diag(count)
            new.cov[k] = second / count - (first / count) * (first.T / count)
        gap = np.maximum((new.mean[0] - new.mean[1]) ** 2, 0.01)
        for k in range(2):
            values, vectors = np.linalg.eigh((new.cov[k] + new.cov[k].T) / 2)
            new.cov[k] = (vectors * np.maximum(values, 0)) @ vectors.T + np.diag(shrink * gap + 1e-4)
        new.weight = np.maximum(n / max(n.sum(), 1e-6), 1e-4)
        return new


def _flat(column: pa.Array, dims: int = 4) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Vectors, the row that each belongs to, and the structs of array<struct<entry, x, ...>>, without making Python objects."""
    owner = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    inner = column.flatten()
    return inner.field(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims), owner, inner


def fit_mixture(candidates: DataFrame, dims: int, steps: int) -> Mixture:
    """EM over ``candidates`` (column c: array<struct<entry, x array<double>>>)."""
    model = Mixture(dims)
    for _ in range(steps):
        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2 + 3 * dims * dims))
            for b in batches:
                x, owner, _ = _flat(b.column(0), dims + 1)
                if len(x):
                    p = model.posteriors(x, owner)
                    total += [Mixture.sums(x, p), Mixture.sums(x, 1 - p)]
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        parts = candidates.select("c").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not parts:
            break
        model = model.updated(np.array([r.v for r in sorted(parts, key=lambda r: r.i)]).reshape(2, -1))
    return model


def match_mentions(mentions: DataFrame, entries: DataFrame, facts: DataFrame, *, parameter_words: Sequence[str] = (), steps: int = 8, alike: float = 0.6) -> DataFrame:
    """(id, entry, posterior): every candidate pair with its match probability.

    ``mentions``: id, scope, tag, span, fact. ``entries``: entry, scope, kind, label. ``facts``: entry, fact. A pair is supported when
    the entry has the fact of the mention.
    """
    words = frozenset(parameter_words)

    def read_m(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [mention_of(t, s, words) for t, s in zip(b["tag"], b["span"], strict=True)]
            keys = [mention_keys(s, m) for m, s in zip(got, b["scope"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "fact": b["fact"], "kind": [m.kind for m in got], "number": pd.array([m.number for m in got], "Int64"), "place": [m.place for m in got], "keys": keys})

    def read_e(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_mention(t) for t in b["label"]]
            got = [Mention(k if k in KINDS else m.kind, m.number, m.place) for m, k in zip(got, b["kind"], strict=True)]
            yield pd.DataFrame({"entry": b["entry"], "e_kind": [m.kind for m in got], "e_number": pd.array([m.number for m in got], "Int64"), "e_place": [m.place for m in got], "keys": [block_keys(s, m) for m, s in zip(got, b["scope"], strict=True)]})

    id_type, entry_type = mentions.schema["id"].dataType.simpleString(), entries.schema["entry"].dataType.simpleString()
    ms = mentions.select("id", "scope", "tag", "span", "fact").mapInPandas(read_m, f"id {id_type}, fact bigint, kind string, number bigint, place string, keys array<string>")
    es = entries.select("entry", "scope", "kind", "label").mapInPandas(read_e, f"entry {entry_type}, e_kind string, e_number bigint, e_place string, keys array<string>")
    met = ms.withColumn("key", F.explode("keys")).drop("keys").join(es.withColumn("key", F.explode("keys")).drop("keys"), "key").drop("key")
    support = facts.select("entry", "fact").distinct().withColumn("supported", F.lit(True))
    # What a mention says of the place of an entry that says none.
    claim = F.when((F.col("e_place") == "") & (F.col("place") != ""), F.col("place"))
    pairs = met.join(support, ["entry", "fact"], "left").groupBy("id").agg(F.collect_set(F.struct("entry", pair_vector().alias("x"), claim.alias("claim"))).alias("c"))
    candidates = checkpoint(pairs)
    model = fit_mixture(candidates, 3, steps)
    entry_arrow = pa.string() if entry_type == "string" else pa.int64()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner, pair = _flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pair.field(0).cast(entry_arrow), pair.field(2), pa.array(model.posteriors(x, owner), pa.float64())], names=["id", "entry", "claim", "posterior"])

    scored = candidates.mapInArrow(score, f"id {id_type}, entry {entry_type}, claim string, posterior double")
    # One entry, one place: of what its mentions claim, the likeliest, and what is like it.
    claimed = scored.where("claim is not null")
    place = claimed.groupBy("entry", "claim").agg(F.sum("posterior").alias("mass")).groupBy("entry").agg(F.max_by("claim", F.struct("mass", "claim")).alias("own"))
    likeness = 1 - F.levenshtein("claim", "own") / F.greatest(F.length("claim"), F.length("own"))
    settled = claimed.join(place, "entry").withColumn("posterior", F.when(likeness >= alike, F.col("posterior")).otherwise(0.0))
    return scored.where("claim is null").select("id", "entry", "posterior").unionByName(settled.select("id", "entry", "posterior"))
