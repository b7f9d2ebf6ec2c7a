"""Encoding of a corpus by byte-level BPE through a tokenization automaton.

The automaton has one state per token (the token read last) and an arc t -> u where u may follow
t in a tokenization. It starts as the automaton of all byte strings; each merge (a, b) -> c, in order
of rank, applies one gadget: every arc into a whose state continues with b gains an arc labelled
c to where b led, and the arc a -> b is removed. An arc therefore exists at the time of a merge if

- neither token was merged: always, or it comes from the arc of the later-made token's near
  half at the time that token was made, and
- no merge of just this pair has come before.

The gadgets are applied on demand: an arc is derived through the gadgets that made its two tokens
the first time that it is asked for, and kept in the transition table. The full table has
billions of entries, almost none of which text ever visits.

A word is encoded by running all paths through the table at once: from every byte position the byte
trie of the vocabulary proposes labels, and the table admits exactly one last token for each
prefix. The labels of the one path to the end are emitted. Words repeat, so a bounded table of
finished words stands in front.

Scale: one map over the documents, no shuffle. The merges (fixed by the vocabulary, about 1 MB) go out
as a broadcast; each Python worker compiles them once. Whole texts are encoded, of any length.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.text import col

#: Fixed value: the split of the vocabulary's model before merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOREVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The tokenization automaton of an ordered list of merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        alphabet = byte_alphabet()
        plain = {t: bytes(alphabet[c] for c in t) for t in vocabulary if all(c in alphabet for c in t)}
        size = max(vocabulary.values()) + 1
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        usable = {vocabulary[t] for t, b in plain.items() if len(b) == 1}
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.made[k] < 0 and k not in usable:
                self.left[k], self.right[k], self.made[k] = i, j, rank
                usable.add(k)
            self.pair.setdefault(i << 20 | j, rank)
        self.bytes = {i: b for t, b in plain.items() if (i := vocabulary[t]) in usable}
        # The trie is a table: state << 8 | byte -> state; the root is 0. Label of a state, or -1.
        self.step: dict[int, int] = {}
        self.label = [-1]
        for i, b in self.bytes.items():
            at = 0
            for x in b:
                key = at << 8 | x
                at = self.step.get(key, 0)
                if not at:
                    at = self.step[key] = len(self.label)
                    self.label.append(-1)
            self.label[at] = i
        self.arcs: dict[int, bool] = {}

    def arc_at(self, t: int, u: int, time: int) -> bool:
        """Whether u may follow t just before the merge of rank ``time``."""
        while True:
            if self.pair.get(t << 20 | u, FOREVER) < time:
                return False
            made_t, made_u = self.made[t], self.made[u]
            if made_t < 0 and made_u < 0:
                return True
            if made_u > made_t:  # the gadget of u drew its arcs from those into its left half
                # of a run a a a the first two merge: for a merge of a with itself the arcs count after the removal
                u, time = self.left[u], made_u + (self.left[u] == self.right[u])
            elif made_t > made_u:  # the state after t continued as its right half did
                t, time = self.right[t], made_t
            else:  # t = u
                t, u, time = self.right[t], self.left[u], made_t

    def encode(self, word: bytes) -> list[int]:
        """The labels of the only path that spells ``word``."""
        n = len(word)
        last = [-1] * (n + 1)
        step, label, arcs = self.step, self.label, self.arcs
        for at in range(n):
            state, before = 0, last[at]
            for end in range(at, n):
                state = step.get(state << 8 | word[end], 0)
                if not state:
                    break
                token = label[state]
                if token >= 0 and last[end + 1] < 0:
                    if before < 0:
                        last[end + 1] = token
                        continue
                    key = before << 20 | token
                    allowed = arcs.get(key)
                    if allowed is None:
                        if len(arcs) > 1_000_000:
                            arcs.clear()
                        allowed = arcs[key] = self.arc_at(before, token, FOREVER)
                    if allowed:
                        last[end + 1] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= len(self.bytes[last[at]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[i] for i in ids)


class _Words(dict):
    """Finished words; a miss is encoded. Emptied at a bound, so memory is bounded."""

    def __init__(self, automaton: Automaton, bound: int = 300_000):
        super().__init__()
        self.automaton, self.bound = automaton, bound

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode("utf-8", "replace")), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Pre-split and encode; see Automaton."""

    def __init__(self, model: bytes):
        spec = json.loads(model)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.words = _Words(Automaton(spec["vocab"], merges))
        self.split = regex.compile(SPLIT).findall

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.words.__getitem__, self.split(text))) if text else b""


_COMPILED: dict[str, Encoder] = {}


def compiled(model: bytes) -> Encoder:
    """One encoder per model and worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Encoder(model)
    return _COMPILED[key]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: Column | str = "text", *, tokenizer: str) -> DataFrame:
    """(key, ids array<int>): every text as the ids of the byte-level BPE in the file ``tokenizer``, without special tokens."""
    with open(tokenizer, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(key), col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = compiled(model.value)
        for b in batches:
            done = [encoder.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(done) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in done], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(done))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")
