"""Passages of held-out test texts inside a corpus: a Wu-Manber search over the letters and digits of both.

Both sides are reduced to the stream of their letters and digits: Unicode compatibility forms composed, case folded,
everything else left out. Gaps between words, and hyphens at line ends, thereby make no difference to the search; the
patterns are all windows of ``least`` consecutive words of the test texts, run together. Patterns go into a few tables by length.
A block is the last characters of the part of a window that all patterns of a table share in length. The shift table says how far
the window may move for the block at its end; a block of no pattern moves it by nearly the whole window, so most
of a text is never looked at. A block with shift zero selects the bucket of patterns whose shared part ends in it, and a direct comparison
of the whole pattern confirms. Only then are word borders looked at, in texts that hold the letters of a passage: every word border on either
side must be one on the other, or fall on a hyphen at a line end, where a border may be or not. Each break of
a line is thus read both ways, whatever else the text or the other tests contain.

Scale: one map over the documents, no shuffle before the few findings; tables are compiled once per worker process. Test texts
are taken in blocks of about ``block_letters`` letters; one block is broadcast and one pass made for each, so what is broadcast is bounded
however many test texts there are; a finding depends on its own test text only.

Defined cases: null and empty texts hold nothing; a test text of fewer than ``least`` words can't leak; equal
test texts are all reported; repeated documents give one row for each id.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are not seen; a soft hyphen is one too, but may stand for a break at the end of a line.
_HIDDEN = re.compile("[" + "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x200E, 0x200F, *range(0x202A, 0x202F)))) + "]")
#: A hyphen at the end of a line, between two parts of a word.
_HYPHENS, _ENDS = "-" + "".join(map(chr, (0x2010, 0x2011, 0xAC, 0xAD))), "\n\r\x0b\x0c" + "".join(map(chr, (0x85, 0x2028, 0x2029)))
BROKEN = re.compile(rf"(?<=[^\W_])[{_HYPHENS}][^\S{_ENDS}]*(?:\r\n|[{_ENDS}])\s*(?=[^\W_])")
_JOINT = chr(0xE000)  # stands for a break while a text is normalised; no letter, no digit
_WORD = re.compile(rf"[^\W_]+(?:{_JOINT}[^\W_]+)*")
_GAPS = {i: None for i in range(128) if not chr(i).isalnum()}


def _composed(text: str) -> str:
    """Without hidden characters, in compatibility form, case folded."""
    text = _HIDDEN.sub("", text)
    text = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
    folded = text.casefold()
    return folded if unicodedata.is_normalized("NFKC", folded) else unicodedata.normalize("NFKC", folded)


def letters_of(text: str | None) -> str:
    """The letters and digits of a text, run together."""
    if not text:
        return ""
    if text.isascii():
        return text.lower().translate(_GAPS)
    text = _composed(text)
    for c in set(text):
        if not c.isalnum():
            text = text.replace(c, "")
    return text


def worded(text: str | None) -> tuple[list[str], set[int], set[int]]:
    """The words of a text with broken ones joined, the offsets in its letters where a word must begin or end, and those where one may."""
    words, must, may, at = [], {0}, set(), 0
    for piece in _WORD.findall(BROKEN.sub(_JOINT, _composed(text or "").replace(_JOINT, " ")).replace("\xad", "")):
        parts = piece.split(_JOINT)
        for p in parts:
            may.add(at)
            at += len(p)
        may.discard(at - sum(map(len, parts)))
        must.add(at)
        words.append("".join(parts))
    return words, must, may


class WuManber:
    """All windows of ``least`` words of the given texts, in tables by length; see the module's text."""

    #: Shared lengths of the tables: a pattern goes to the longest that it reaches.
    CLASSES = (48, 24, 8, 1)

    def __init__(self, texts: Iterable[tuple[object, str | None]], least: int):
        self.least = least
        self.items: list[tuple[object, str, list[int], set[int], set[int]]] = []
        patterns: dict[int, list[tuple[int, int]]] = {}
        for item, text in texts:
            words, must, may = worded(text)
            if len(words) < least:
                continue
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w))
            k = len(self.items)
            self.items.append((item, "".join(words), starts, must, may))
            for i in range(len(words) - least + 1):
                size = starts[i + least] - starts[i]
                patterns.setdefault(next(c for c in self.CLASSES if c <= size), []).append((k, i))
        self.tables = [self._table(m, own) for m, own in sorted(patterns.items(), reverse=True)]

    def _table(self, m: int, own: list[tuple[int, int]]):
        block = max(1, min(12, m // 3))
        reach = m - block + 1
        shift: dict[str, int] = {}
        bucket: dict[str, list[tuple[int, int]]] = {}
        for k, i in own:
            _, letters, starts, _, _ = self.items[k]
            at = starts[i]
            for end in range(block, m + 1):
                b = letters[at + end - block : at + end]
                shift[b] = min(m - end, shift.get(b, reach))
            bucket.setdefault(letters[at + m - block : at + m], []).append((k, i))
        return m, block, reach, shift, bucket

    def search(self, text: str | None) -> set[object]:
        """The items of which ``text`` holds ``least`` consecutive words."""
        letters = letters_of(text)
        found: set[object] = set()
        borders = None
        n = len(letters)
        for m, block, reach, shift, bucket in self.tables:
            end, move_of = m, shift.get
            while end <= n:
                move = move_of(letters[end - block : end], reach)
                if move:
                    end += move
                    continue
                at = end - m
                for k, i in bucket[letters[end - block : end]]:
                    item, theirs, starts, must, may = self.items[k]
                    a, b = starts[i], starts[i + self.least]
                    if item in found or not letters.startswith(theirs[a:b], at):
                        continue
                    borders = borders or worded(text)[1:]
                    if self._same_borders(borders, at, (must, may), a, b - a):
                        found.add(item)
                end += 1
        return found

    @staticmethod
    def _same_borders(one: tuple[set[int], set[int]], at: int, other: tuple[set[int], set[int]], a: int, size: int) -> bool:
        (must1, may1), (must2, may2) = one, other
        if not all(at + e in must1 or at + e in may1 for e in (0, size)):
            return False
        for d in range(1, size):
            x, y = at + d, a + d
            if (x in must1 and y not in must2 and y not in may2) or (y in must2 and x not in must1 and x not in may1):
                return False
        return True


_COMPILED: dict[str, WuManber] = {}


def _compiled(name: str, texts: list[tuple[object, str]], least: int) -> WuManber:
    """One machine per block of test texts and worker process; the last one only is kept."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = WuManber(texts, least)
    return _COMPILED[name]


def leaked_items(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 15, block_letters: int = 500_000) -> DataFrame:
    """(key, item): the document holds at least ``least`` consecutive words of the item."""
    spark = documents.sparkSession
    tests = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_letters))
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    schema = f"doc {rows.schema[0].dataType.simpleString()}, item {tests.schema[0].dataType.simpleString()}"
    item_type = pa.int64() if tests.schema[0].dataType.simpleString() == "bigint" else None
    found = []
    for b in range(blocks):
        own = spark.sparkContext.broadcast([(r.item, r.text) for r in tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()])

        def run(batches: Iterator[pa.RecordBatch], own=own, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            machine = _compiled(name, own.value, least)
            for batch in batches:
                at, hit = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    for i in machine.search(t):
                        at.append(k)
                        hit.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hit, item_type)], names=["doc", "item"])

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found).distinct().select(F.col("doc").alias(key), F.col("item").alias(item))
