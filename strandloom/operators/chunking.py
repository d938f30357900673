"""Cutting texts into chunks, hashed embeddings, and greedy selections under a budget.

Everything here depends on the order of what was taken before, which no column expression can say; it runs in Arrow batches on
Python workers, row by row for single texts and key by key (bounded by the caller's key) for selections.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

CHUNKS = "chunk_index int, start int, chunk string"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BOUNDARY = re.compile(r"^(?:async\s+def |def |class |func |fn |static |public |private |#{1,6} |//\s?-{3,})")
_TOKEN = re.compile(r"[a-z0-9_]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _packed(parts: Iterable[str], limit: int, glue: str) -> Iterator[str]:
    """Neighbouring parts joined while they fit; a part beyond the limit stands alone."""
    held = ""
    for part in parts:
        if held and len(held) + len(glue) + len(part) > limit:
            yield held
            held = part
        else:
            held = f"{held}{glue}{part}" if held else part
    if held:
        yield held


def chunk_text(text: str, limit: int = 500) -> list[str]:
    """Paragraphs packed up to the limit; a longer paragraph by sentences, a longer sentence by windows of characters."""
    out: list[str] = []
    for block in _packed([p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()], limit, "\n\n"):
        if len(block) <= limit:
            out.append(block)
            continue
        for piece in _packed(sentences(block), limit, " "):
            out += [piece[i : i + limit] for i in range(0, len(piece), limit)]
    return out


def chunk_json(text: str, limit: int = 2000) -> list[str]:
    """Objects by top-level key and arrays by item, packed up to the limit and written again; of other text (no
    readable JSON, or a text within JSON) the first ``limit`` characters are one chunk and the rest is dropped, as in the reference."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [text[:limit]] if text else []
    if isinstance(value, dict):
        items, wrap = [{k: v} for k, v in value.items()], lambda g: {k: v for x in g for k, v in x.items()}
    elif isinstance(value, list):
        items, wrap = value, list
    else:
        return [json.dumps(value)[:limit]]
    out, held, size = [], [], 2
    for item in items:
        n = len(json.dumps(item)) + 2
        if held and size + n > limit:
            out.append(json.dumps(wrap(held)))
            held, size = [], 2
        held.append(item)
        size += n
    return [*out, json.dumps(wrap(held))] if held or not out else out


def chunk_recursive(text: str, limit: int = 800, overlap: float = 0.25, least: int = 120, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Split by the first separator that helps, then by the next within longer pieces; each window starts with the end of the
    one before (``overlap`` of the limit, at least ``least`` characters); equal windows are kept once."""

    def pieces(part: str, level: int) -> list[str]:
        if len(part) <= limit:
            return [part]
        if level == len(separators):
            return [part[i : i + limit] for i in range(0, len(part), limit)]
        split = [s for s in part.split(separators[level]) if s]
        return [x for s in split for x in pieces(s, level + 1)] if len(split) > 1 else pieces(part, level + 1)

    back = max(int(limit * overlap), least)
    windows = list(_packed(pieces(text.strip(), 0), limit, " "))
    joined = [w if i == 0 else (windows[i - 1][-back:] + " " + w).strip() for i, w in enumerate(windows)]
    return list(dict.fromkeys(j for j in joined if j.strip()))


def chunk_code(text: str, limit: int = 2000) -> list[str]:
    """Lines packed up to the limit, cut before definitions and headings, else after a blank line."""
    blocks, held = [], []
    for line in text.split("\n"):
        if held and (_BOUNDARY.match(line) or not held[-1].strip() and line.strip()):
            blocks.append("\n".join(held))
            held = []
        held.append(line)
    blocks.append("\n".join(held))
    return [p[i : i + limit] for p in _packed(blocks, limit, "\n") if p.strip() for i in range(0, len(p), limit)]


def exploded(rows: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk_index, start, chunk) of each text; start is the chunk's place in the text, -1 where it was rewritten.

    Null and blank texts have no chunks.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, index, start, chunks = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                at = 0
                for n, c in enumerate(cut(t) if t and t.strip() else ()):
                    place = t.find(c, at)
                    at = place + 1 if place >= 0 else at
                    take.append(i)
                    index.append(n)
                    start.append(place)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_index", "start", "chunk"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, {CHUNKS}")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def span_chunks(files: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """(key, chunk_id, start, chunk): byte spans of each text, the whole text without spans, blank ones dropped; chunk_id is the
    signed 64-bit FNV-1a of 'key:start'. spans: array<struct<start, end>>."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, t, spans_ in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode()
                for s, e in [(x["start"], x["end"]) for x in spans_ or ()] or [(0, len(raw))]:
                    if (chunk := raw[s:e].decode("utf-8", "replace")).strip():
                        h = fnv1a(f"{k}:{s}".encode())
                        out.append((k, h - (1 << 64) if h >> 63 else h, s, chunk))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), batch.schema.field(0).type), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int32()), pa.array(list(cols[3]), pa.string())], names=[key, "chunk_id", "start", "chunk"])

    return files.select(key, text, spans).mapInArrow(run, f"{key} {kind}, chunk_id long, start int, chunk string")


def hash_embedding(rows: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """(key, embedding): counts of the tokens' FNV-1a buckets, of length 1; zero for texts without tokens."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            codes = array("q")
            for i, t in enumerate(batch.column(1).to_pylist()):
                for w in _TOKEN.findall((t or "").lower()):
                    if (b := known.get(w)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        b = known[w] = fnv1a(w.encode()) % size
                    codes.append(i * size + b)
            counts = np.bincount(np.frombuffer(codes, np.int64) if len(codes) else np.zeros(0, np.int64), minlength=batch.num_rows * size)
            out = counts.reshape(batch.num_rows, size).astype(np.float32)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), out.ravel())], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def _unit_counts(parts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sentence and word of each distinct token of a sentence, in order, with (counts, vocabulary, counts over the sentence's norm)."""
    at: dict[str, int] = {}
    rows, words, n = [], [], []
    for i, p in enumerate(parts):
        c = Counter(at.setdefault(w, len(at)) for w in _TOKEN.findall(p.lower()))
        rows += [i] * len(c)
        words += c
        n += c.values()
    rows, words, n = np.array(rows, np.int64), np.array(words, np.int64), np.array(n, np.float64)
    norm = np.sqrt(np.bincount(rows, n * n, minlength=len(parts)))
    return rows, words, (n, np.arange(max(1, len(at))), n / np.maximum(norm, 1e-12)[rows])


def mmr(parts: list[str], share: float = 0.3, weight: float = 0.5, pool: int | None = None, near: int | None = None) -> list[int]:
    """Places of the sentences kept, in order: each the best by weight * likeness to the whole - (1 - weight) * redundancy.

    All sentences are considered, or with ``pool`` an even spread of that many. Likenesses are worked out one sentence at a time,
    so memory follows the sentences, not their pairs. Redundancy is the highest likeness to those taken; with
    ``near`` it is known only to the neighbours that close, 0.5 to others, and the lowest of them counts.
    """
    if pool is not None and len(parts) > pool:
        places = np.unique(np.linspace(0, len(parts) - 1, pool).astype(int))
    else:
        places = np.arange(len(parts))
    chosen = [parts[i] for i in places]
    rows, words, counts = _unit_counts(chosen)
    total = np.bincount(words, counts[0], minlength=len(counts[1]))
    whole = np.bincount(rows, counts[2] * total[words], minlength=len(chosen)) / max(np.linalg.norm(total), 1e-12)
    ends = np.searchsorted(rows, np.arange(len(chosen) + 1))

    def likeness(i: int) -> np.ndarray:
        """Of sentence i to all."""
        own = np.zeros(len(total))
        span = slice(ends[i], ends[i + 1])
        own[words[span]] = counts[2][span]
        out = np.bincount(rows, counts[2] * own[words], minlength=len(chosen))
        return out if near is None else np.where(np.abs(np.arange(len(chosen)) - i) <= near, out, 0.5)

    k = max(1, int(share * len(chosen)))
    taken: list[int] = []
    redundancy = np.zeros(len(chosen))
    free = np.ones(len(chosen), bool)
    while len(taken) < min(k, len(chosen)):
        score = np.where(free, weight * whole - (1 - weight) * redundancy, -np.inf)
        best = int(np.argmax(score))
        own = likeness(best)
        redundancy = own if not taken else np.minimum(redundancy, own) if near is not None else np.maximum(redundancy, own)
        taken.append(best)
        free[best] = False
    return sorted(int(places[i]) for i in taken)


def extract(rows: DataFrame, key: str, text: str, near: int | None = None) -> DataFrame:
    """(key, n_sentences, summary): sentences kept by mmr, joined by blanks."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sentences(t) if t else [] for t in batch.column(1).to_pylist()]
            kept = [" ".join(p[i] for i in mmr(p, near=near)) if p else "" for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in parts], pa.int32()), pa.array(kept, pa.string())], names=[key, "n_sentences", "summary"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, n_sentences int, summary string")


def compact_fields(text: str | None, share: float = 0.5, heavy: tuple[str, ...] = ("id", "name", "type", "status", "error", "path")) -> str | None:
    """JSON object with the better ``share`` of its fields (at least one), in their order; other texts stay as they are.

    A field scores 2 for a heavy name, 1 for a boolean or number, 1 for a text of at most 100 characters, 0.5 for a longer text,
    0.25 for a list or object, 0 for null and empty; ties keep the earlier field.
    """
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return text
    if not isinstance(value, dict) or not value:
        return text

    def score(k: str, v: object) -> float:
        base = 2.0 if any(h in k.lower() for h in heavy) else 0.0
        if v is None or v == "" or v == [] or v == {}:
            return base
        if isinstance(v, (bool, int, float)):
            return base + 1.0
        if isinstance(v, str):
            return base + (1.0 if len(v) <= 100 else 0.5)
        return base + 0.25

    order = sorted(range(len(value)), key=lambda i: -score(*list(value.items())[i]))
    keep = set(order[: max(1, int(share * len(value)))])
    return json.dumps({k: v for i, (k, v) in enumerate(value.items()) if i in keep})


def compacted(rows: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compact_fields(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "compacted"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, compacted string")


def packed_budget(rows: DataFrame, group: str, ident: str, order: list[str], size: str, budget: int, stop: bool = False) -> DataFrame:
    """(group, ident, taken): items in order taken while the budget lasts; one that doesn't fit is skipped, or ends it (``stop``).

    With ``stop`` an item is taken where the running sum is within the budget (sizes aren't negative). Skipping depends on what was
    taken before: a group's (ident, size) rows are folded by one task.
    """
    kinds = dict(rows.dtypes)
    if stop:
        run = F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return rows.select(group, ident, (run <= budget).alias("taken"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        left, taken = budget, []
        for n in pdf[size].to_numpy():
            ok = bool(n <= left)
            left -= n if ok else 0
            taken.append(ok)
        return pd.DataFrame({group: pdf[group], ident: pdf[ident], "taken": taken})

    cols = list(dict.fromkeys([group, ident, *order, size]))
    return rows.select(*cols).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {ident} {kinds[ident]}, taken boolean")


def sliding_dedup(rows: DataFrame, group: str, order: str, vector: str, window: int = 20, likeness: float = 0.95) -> DataFrame:
    """(group, order, kept): a row is dropped if its cosine to one of the last ``window`` kept rows exceeds ``likeness``."""
    kinds = dict(rows.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        last: deque = deque(maxlen=window)
        kept = []
        for v in pdf[vector]:
            v = np.asarray(v, np.float64)
            n = np.linalg.norm(v)
            v = v / n if n else v
            ok = not (last and n and max(float(v @ u) if len(u) == len(v) else 0.0 for u in last) > likeness)
            if ok:
                last.append(v)
            kept.append(ok)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "kept": kept})

    return rows.select(group, order, vector).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, kept boolean")


def prefix_budget(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows up to the first that exceeds the budget: a running sum, all in the JVM."""
    run = F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("running", run).filter(F.col("running") <= budget)
