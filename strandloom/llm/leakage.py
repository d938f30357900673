"""Evaluation passages inside training text: Wu-Manber search over words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a passage that must occur in a row, and words of a block in the shift table.
PASSAGE, BLOCK = 12, 2
#: Items whose tables one task holds at a time; more items are searched in several passes.
ITEMS_AT_ONCE = 20_000
_WORD, _BEYOND = re.compile(r"[^\W_]+"), re.compile(r"[^\x00-\x7f]+")


_known: dict[str, str] = {}


def _folded(run: re.Match) -> str:
    """A run of characters beyond ASCII, remembered, as the same few come again and again."""
    text = run.group()
    if (out := _known.get(text)) is None:
        if len(_known) > 100_000:
            _known.clear()
        out = _known[text] = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return out


def fold_text(text: str) -> str:
    """The text without case and accents."""
    return text.lower() if text.isascii() else _BEYOND.sub(_folded, text).lower()


def text_words(text: str | None) -> list[str]:
    """Runs of letters and digits without case and accents."""
    return _WORD.findall(fold_text(text)) if text else []


class WuManber:
    """Multi-pattern search for every run of ``length`` words of the items.

    ``shift``: for each block of two words, how far the search may move when it ends there: the least distance of the block to a
    pattern's end, and length - 1 for a block in no pattern. ``buckets``: the patterns by their last block and first word, to be
    compared word by word where the shift is 0.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], length: int = PASSAGE):
        self.length, self.far = length, length - BLOCK + 1
        self.number: dict[str, int] = {}
        self.shift: dict[tuple[int, int], int] = {}
        self.buckets: dict[tuple[int, int, int], list[tuple[tuple[int, ...], list[int]]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in text_words(text)]
            for k in range(len(ids) - length + 1):
                self._add(tuple(ids[k : k + length]), item)

    def _add(self, pattern: tuple[int, ...], item: int) -> None:
        for j in range(1, self.length):
            block = pattern[j - 1 : j + 1]
            self.shift[block] = min(self.shift.get(block, self.far), self.length - 1 - j)
        bucket = self.buckets.setdefault((pattern[-2], pattern[-1], pattern[0]), [])
        for known, items in bucket:
            if known == pattern:
                if items[-1] != item:
                    items.append(item)
                return
        bucket.append((pattern, [item]))

    def search(self, text: str | None) -> set[int]:
        """Items of which the text holds a passage."""
        number, shift, far, back = self.number.get, self.shift.get, self.far, self.length - 1
        ids = [number(w, 0) for w in text_words(text)]
        found: set[int] = set()
        i, n = back, len(ids)
        while i < n:
            step = shift((ids[i - 1], ids[i]), far)
            if step:
                i += step
                continue
            for pattern, items in self.buckets.get((ids[i - 1], ids[i], ids[i - back]), ()):
                if pattern == tuple(ids[i - back : i + 1]):
                    found.update(items)
            i += 1
        return found


#: Tables built in this Python worker, with the items they were built from (a worker keeps a broadcast value for all its tasks).
_tables: dict[tuple[int, int], tuple[list, WuManber]] = {}


def tables_of(items: list[tuple[int, str]], length: int) -> WuManber:
    """The tables of a broadcast list of items, built once a worker."""
    key = (id(items), length)
    if key not in _tables:
        if len(_tables) >= 4:
            _tables.clear()
        _tables[key] = (items, WuManber(items, length))
    return _tables[key][1]


def leaked_items(documents: DataFrame, items: DataFrame, length: int = PASSAGE, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id), distinct: the documents that hold ``length`` consecutive words of an item, consecutive there too.

    Null, empty and shorter texts hold nothing; items of fewer words can't leak. Repeated documents or items give one row. The
    items are evaluation sets, small beside the corpus: their tables go to every task, at most ``at_once`` items a pass, and
    with more items the corpus is read once for each pass. Documents are not shuffled; only hits are.
    """
    spark = documents.sparkSession
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    passes = max(1, math.ceil(texts.count() / at_once))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for p in range(passes):
        part = texts if passes == 1 else texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        held = spark.sparkContext.broadcast(sorted(tuple(r) for r in part.collect()))

        def scan(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = tables_of(held.value, length).search
            for batch in batches:
                hits = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        hits = docs.mapInArrow(scan, "doc_id long, item_id long")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
