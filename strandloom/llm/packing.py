"""Filling context windows of fixed capacity with texts: best-fit decreasing with a segment tree."""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Public tokenizer (byte-level BPE for many languages); the module beside it holds its word pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents packed by one task, together with their share of windows.
SHARD = 25_000
PACKED = "budget_name string, doc_id long, part int, start_token long, tokens long, window_id long"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer whose ranks lie at ``path``, once per Python worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(os.path.dirname(path), "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("text", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) over the whole texts; a null text has none."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id long, tokens long")


class OpenBins:
    """Open bins by remaining capacity: leaf r of a segment tree tells whether a bin with r left is open."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.base)
        self.bins: dict[int, list[int]] = {}

    def put(self, left: int, number: int) -> None:
        self.bins.setdefault(left, []).append(number)
        i = left + self.base
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (left, bin) of the bin with the least room of at least ``size``."""
        tree, i = self.tree, size + self.base
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a subtree to the right holds one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:  # down to its first leaf
                i = 2 * i if tree[2 * i] else 2 * i + 1
        left = i - self.base
        held = self.bins[left]
        number = held.pop()
        if not held:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return left, number


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """Bin of each size; sizes come largest first and are at most ``capacity``. Each goes to the open bin it fills best."""
    open_bins, out, n = OpenBins(capacity), [], 0
    for size in sizes:
        if (found := open_bins.take(size)) is None:
            found = (capacity, n)
            n += 1
        left, number = found
        open_bins.put(left - size, number)
        out.append(number)
    return out


def pack_documents(counts: DataFrame, budgets: dict[str, int], shard: int = SHARD, rows: int | None = None) -> DataFrame:
    """PACKED rows: each document of (doc_id, tokens) assigned to windows of each budget (name -> capacity).

    A document is split only if it alone exceeds the capacity: into full windows of its own and a rest that is packed like a
    document (part 0, 1, ... with start_token). Documents without tokens are assigned too and take no room; rows with a null id
    are left out; a doc_id given twice is packed once, by its largest count. A capacity below 1 or null has no windows.

    Documents fall into shards of about ``shard`` by a hash of their id, each packed by one task: bins, like texts, don't depend
    on other shards, and a shard adds less than one half-empty window. Ties go by doc_id, so a lost task repeats its result.
    rows: how many rows ``counts`` has, where that is known without reading the texts; else it is counted.
    """
    shards = max(1, math.ceil((counts.count() if rows is None else rows) / shard))
    counts = counts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    usable = {name: int(c) for name, c in sorted(budgets.items()) if c is not None and c >= 1}

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        at = int(part["shard"].iloc[0])
        docs = part.sort_values("doc_id")
        ids, sizes = docs["doc_id"].to_numpy(np.int64), docs["tokens"].fillna(0).to_numpy(np.int64)
        out = []
        for name, c in usable.items():
            parts = np.maximum(-(-sizes // c), 1)
            owner = np.repeat(np.arange(len(ids)), parts)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(sizes[owner] - part * c, c)
            order = np.argsort(-size, kind="stable")
            window = np.empty(len(owner), np.int64)
            window[order] = best_fit_decreasing(size[order].tolist(), c)
            out.append(pd.DataFrame({"budget_name": name, "doc_id": ids[owner], "part": part.astype(np.int32), "start_token": part * c, "tokens": size, "window_id": window + (at << 32)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["budget_name", "doc_id", "part", "start_token", "tokens", "window_id"])

    return counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(pack, PACKED)


def context_windows(documents: DataFrame, context_budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of each context budget (a table of a few rows) for the whole texts."""
    budgets = {r["budget_name"]: r["max_tokens"] for r in context_budgets.select("budget_name", "max_tokens").collect() if r["budget_name"] is not None}
    return pack_documents(token_counts(documents, tokenizer), budgets, rows=documents.count())
