"""Exact lexical searches of many queries over whole tables: postings of a block of rows, scored in numpy where the rows are read.

Nothing but the best rows of each task is shuffled. Rows with the same key are scored as one.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = re.compile(r"[a-z0-9_]+")
#: Rows that are scored at once, rows of an output batch.
BLOCK, OUT = 32_768, 500_000

#: Floors of the searches that this worker was at last: what its tasks found before holds for the next ones, as it is in the same table.
_floors: dict[object, np.ndarray] = {}


def floors_of(search: object, n: int) -> np.ndarray:
    """Floors of the ``n`` queries of a search, as this worker knows them; the tasks of several searches may take turns."""
    if search not in _floors:
        while len(_floors) >= 8:
            _floors.pop(next(iter(_floors)))
        _floors[search] = np.full(n, -np.inf)
    return _floors[search]


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves up; for numbers from 0 on."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Best:
    """The best ``k`` (score, then least key) of each of ``n`` queries; ``floor`` is what a score must reach to be among them."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.kept, self.new, self.room = k, np.full(n, -np.inf), [], 0, 200_000

    def add(self, q: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        self.kept.append((q, keys, scores))
        self.new += len(q)
        if self.new > self.room:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, keys, scores = (np.concatenate(c) for c in zip(*self.kept))
        self.kept = []
        order = np.lexsort((keys, -scores, q))
        q, keys, scores = q[order], keys[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last])
        keep = place < self.k
        self.kept, self.new = [(q[keep], keys[keep], scores[keep])], 0
        self.room = max(200_000, int(keep.sum()) // 2)
        return self.kept[0]


class Terms:
    """The terms of a set of queries, and which of them a text holds: as whole tokens, or with ``within`` as parts of tokens."""

    def __init__(self, queries: list[list[str]], within: bool):
        self.number: dict[str, int] = {}
        rows = [sorted({self.number.setdefault(t, len(self.number)) for t in q}) for q in queries]
        self.ends = np.cumsum([0, *map(len, rows)])
        self.flat = np.fromiter((t for r in rows for t in r), np.int32, int(self.ends[-1]))
        self.lengths = sorted({len(t) for t in self.number}) if within else []
        self.within, self.known = within, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def held(self, token: str) -> tuple[int, ...]:
        if (out := self.known.get(token)) is None:
            get, n = self.number.get, len(token)
            out = tuple({i for size in self.lengths if size <= n for at in range(n - size + 1) if (i := get(token[at : at + size])) is not None})
            if n <= 200:
                if len(self.known) > 300_000:
                    self.known.clear()
                self.known[token] = out
        return out

    def of(self, words: list[str]) -> list[int]:
        if self.within:
            return [i for w in set(words) for i in self.held(w)]
        get = self.number.get
        return [i for w in words if (i := get(w)) is not None]


def by_key(chunks: DataFrame, key: str, text: str, bonus: Column | None = None) -> DataFrame:
    """(key, texts, bonus): the lower-cased texts of each key, usually one. Only rows of repeated keys are shuffled."""
    from strandloom.operators.retrieval import small

    rows = chunks.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"), (F.lit(0.0) if bonus is None else bonus.cast("double")).alias("bonus"))
    repeated = chunks.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key")
    if repeated.isEmpty():
        return rows.select(key, F.array("_t").alias("texts"), "bonus")
    repeated, same = small(repeated), F.col(key).eqNullSafe(F.col("_key"))
    once = rows.join(repeated, same, "left_anti").select(key, F.array("_t").alias("texts"), "bonus")
    return once.unionByName(rows.join(repeated, same, "left_semi").groupBy(key).agg(F.collect_list("_t").alias("texts"), F.max("bonus").alias("bonus")))


def _parts(texts: list[str], terms: Terms) -> Iterator[tuple[int, list[int]]]:
    """(length, terms) of a key's texts; those of equal length count as one."""
    if len(texts) == 1:
        words = _TOKEN.findall(texts[0])
        yield len(words), terms.of(words)
        return
    by: dict[int, list[int]] = {}
    for t in texts:
        words = _TOKEN.findall(t)
        by.setdefault(len(words), []).extend(terms.of(words))
    yield from by.items()


class Postings:
    """Postings of the terms in a block of rows: ``rows`` and ``weights`` from ``at[term]`` to ``at[term + 1]``."""

    def __init__(self, parts: list[tuple[int, int, list[int]]], n: int, n_terms: int, weight: Callable | None, counted: bool = False):
        """parts: (row, length, terms). weight(term, tf, length), 1 without. Made for ``counted``, frequent terms have a byte a row."""
        slot, length = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.float64)
        found, sizes = array("i"), []
        for _, _, t in parts:
            found.extend(t)
            sizes.append(len(t))
        span = max(1, len(parts))
        code = np.frombuffer(found, np.int32).astype(np.int64) * span + np.repeat(np.arange(len(parts)), sizes) if len(found) else np.zeros(0, np.int64)
        code, tf = np.unique(code, return_counts=True)
        term, part = code // span, code % span
        w = weight(term, tf, length[part]) if weight else np.ones(len(code))
        row = slot[part]
        if len(parts) != n:  # a key with texts of several lengths
            code, back = np.unique(term * n + row, return_inverse=True)
            w = np.bincount(back, w, len(code)) if weight else np.ones(len(code))
            term, row = code // n, code % n
        self.n, self.rows, self.weights = n, row, w
        at = np.searchsorted(term, np.arange(n_terms + 1))
        held, many = np.flatnonzero(np.diff(at)), np.diff(at)
        most = np.zeros(n_terms)
        if len(held):
            most[held] = np.maximum.reduceat(w, at[held])
        order = np.empty(n_terms, np.int64)
        order[np.lexsort((-many, most))] = np.arange(n_terms)
        self.at, self.most, self.order = at.tolist(), most.tolist(), order.tolist()
        self.dense = {}
        for t in np.flatnonzero(many * (64 if counted else 20) > n).tolist():
            s, e = self.at[t], self.at[t + 1]
            self.dense[t] = v = np.zeros(n, np.uint8 if counted else np.float64)
            v[row[s:e]] = 1 if counted else w[s:e]

    def counted(self, terms: list[int], least: int, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, numbers of terms held) of the rows that hold at least ``least`` of at most 255 terms."""
        at, dense = self.at, self.dense
        acc[:] = 0
        for t in terms:
            if (v := dense.get(t)) is not None:
                np.add(acc, v, out=acc)
            elif (s := at[t]) < (e := at[t + 1]):
                acc[self.rows[s:e]] += 1
        rows = np.flatnonzero(acc >= least)
        return rows, acc[rows]

    def add(self, terms: list[int], out: np.ndarray) -> None:
        at, dense = self.at, self.dense
        for t in terms:
            if (v := dense.get(t)) is not None:
                out += v
            elif (s := at[t]) < (e := at[t + 1]):
                out[self.rows[s:e]] += self.weights[s:e]

    def reaching(self, terms: list[int], floor: float, acc: np.ndarray, most_before: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of at least the rows that reach ``floor``; ``acc`` holds what rows have before, at most ``most_before``.

        Terms whose greatest weights together stay below the floor bring no row there by themselves (MaxScore): they are looked up
        only in rows that the other terms bring near enough.
        """
        if not floor > 2e-6:
            self.add(terms, acc)
            at = np.flatnonzero(acc > 0)
            return at, acc[at]
        terms, rest, few = sorted(terms, key=self.order.__getitem__), 0.0, 0
        for t in terms:
            if rest + self.most[t] + most_before >= floor - 1e-5:
                break
            rest += self.most[t]
            few += 1
        self.add(terms[few:], acc)
        at = np.flatnonzero(acc >= floor - rest - 2e-6)
        score = acc[at]
        if not len(at):
            return at, score
        for t in reversed(terms[:few]):
            if (v := self.dense.get(t)) is not None:
                score += v[at]
            elif (s := self.at[t]) < (e := self.at[t + 1]):
                rows = self.rows[s:e]
                place = np.minimum(np.searchsorted(rows, at), e - s - 1)
                score += np.where(rows[place] == at, self.weights[s:e][place], 0.0)
            rest -= self.most[t]
            near = score >= floor - rest - 2e-6
            if not near.all():
                at, score = at[near], score[near]
                if not len(at):
                    break
        return at, score


def at_once(rows: DataFrame) -> DataFrame:
    """``rows`` in no more tasks than the cluster runs at once, without a shuffle: a task gives the best rows of every query, so what
    is shuffled follows the tasks, however many files there are."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def _blocks(batches: Iterable[pa.RecordBatch], terms: Terms) -> Iterator[tuple[pa.Array, list, np.ndarray, int]]:
    """(keys, parts, bonus, rows) of blocks of about BLOCK rows, those that have a key."""
    for batch in batches:
        rows, size = batch.num_rows, -(-batch.num_rows // max(1, round(batch.num_rows / BLOCK)))
        for lo in range(0, rows, max(1, size)):
            b = batch.slice(lo, size)
            if lo + size >= rows:
                del batch
            b = b.filter(b.column(0).is_valid())
            parts = [(i, n, t) for i, texts in enumerate(b.column(1).to_pylist()) for n, t in _parts(texts, terms)]
            b = b.drop_columns([b.schema.names[1]])
            yield b.column(0), parts, np.asarray(b.column(1), np.float64), b.num_rows


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK rows: scoring a block of few rows costs as much as one of many. Only the batch given is kept."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        del b
        if n >= BLOCK:
            many = pa.Table.from_batches(held).combine_chunks().to_batches()[:1]
            held, n = [], 0
            yield many.pop()
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _asked(queries: DataFrame, of: Column, within: bool) -> tuple[pa.Array, Terms]:
    """Ids and terms of the queries; rows with the same id are one query."""
    rows = queries.filter("query_id IS NOT NULL").select("query_id", of.alias("terms")).toArrow()
    by: dict = {}
    for q, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        by.setdefault(q, []).extend(t)
    return pa.array(by, rows.schema.field(0).type), Terms(list(by.values()), within)


def _counted(docs: DataFrame, terms) -> tuple[dict[int, int], int, int]:
    """({term: rows}, texts, tokens) over the whole table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        rows, texts, tokens = np.zeros(len(t.number), np.int64), 0, 0
        for batch in batches:
            for many in batch.column(0).to_pylist():
                texts += len(many)
                tokens += sum(len(_TOKEN.findall(x)) for x in many) if len(many) > 1 else 0
                for n, found in _parts(many, t):
                    tokens += n if len(many) == 1 else 0
                    rows[list(set(found))] += 1
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[rows[at], texts, tokens])], names=["term", "n"])

    sums = dict(docs.select("texts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return sums, sums.get(-1, 0), sums.get(-2, 0)


def best_rows(chunks: DataFrame, queries: DataFrame, key: str, text: str, k: int, within: bool, factor: float = 1.0, bm25: tuple[float, float] | None = None, bonus: Column | None = None) -> DataFrame:
    """(query_id, key, score): for each query at least its best ``k`` rows, by score and then key, among those of a score above 0.

    Without ``bm25`` (k1, b) the score is the row's ``bonus`` plus ``factor`` for each distinct term that it holds.
    """
    from strandloom.operators.retrieval import tokens

    spark = chunks.sparkSession
    docs, kinds = by_key(chunks, key, text, bonus), dict(chunks.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}

    def search(ids: pa.Array, terms: Terms) -> DataFrame:
        held = spark.sparkContext.broadcast(terms)
        weight = lambda term, tf, length: np.full(len(term), factor)
        if bm25:
            sums, n, total = _counted(docs, held)
            df, (k1, b), mean = np.array([sums.get(t, 0) for t in range(len(terms.number))], np.float64), bm25, total / max(1, n)
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            weight = lambda term, tf, length: idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        shared = spark.sparkContext.broadcast(ids)
        own_bonus, search_id = bonus is not None, uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, ids = held.value, shared.value
            asked = [terms.flat[s:e].tolist() for s, e in zip(terms.ends[:-1], terms.ends[1:])]
            even = not bm25 and not own_bonus and factor > 0 and max(map(len, asked), default=0) < 256
            best, kind = Best(len(ids), k), None
            best.floor = floors_of(search_id, len(ids))
            for names, parts, extra, n in _blocks(_joined(batches), terms):
                kind, keys = names.type, names.to_numpy(zero_copy_only=False)
                posted, acc, floor = Postings(parts, n, len(terms.number), weight, even), np.zeros(n, np.uint8 if even else np.float64), best.floor
                parts.clear()
                out, most = [], extra.max(initial=0.0)
                for q, wanted in enumerate(asked):
                    if not wanted and not own_bonus:
                        continue
                    if even:
                        if (least := max(1, math.ceil((max(floor[q], 0.0) - 2e-6) / factor))) > len(wanted):
                            continue
                        at, score = posted.counted(wanted, least, acc)
                        score = score * factor
                    else:
                        acc[:] = extra
                        at, score = posted.reaching(wanted, floor[q], acc, most)
                    if not len(at):
                        continue
                    if len(at) > 4 * k:
                        near = score >= np.partition(score, -k)[-k] - 2e-6
                        at, score = at[near], score[near]
                    score = rounded(score)
                    if len(at) > k:
                        order = np.lexsort((keys[at], -score))[:k]
                        at, score = at[order], score[order]
                    if len(at) == k:
                        floor[q] = max(floor[q], score.min())
                    out.append((q, at, score))
                if out:
                    at = np.concatenate([a for _, a, _ in out])
                    best.add(np.repeat([q for q, _, _ in out], [len(a) for _, a, _ in out]), keys[at], np.concatenate([s for *_, s in out]))
                del posted, out  # before the next block is read
            if kind is not None:
                q, names, score = best.compact()
                for lo in range(0, len(q), OUT):
                    hi = lo + OUT
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[lo:hi])), pa.array(names[lo:hi], kind), pa.array(score[lo:hi])], names=["query_id", key, "score"])

        return at_once(docs).mapInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")

    return search(*_asked(queries, F.array_distinct(tokens(F.col("query"))), within))


class Asking:
    """Postings of the queries: which of them, in the order of their numbers of terms, hold a term."""

    def __init__(self, terms: Terms):
        sizes = np.diff(terms.ends)
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        kind = np.min_scalar_type(int(sizes.max(initial=0)))
        code = np.unique(terms.flat.astype(np.int64) * max(1, len(sizes)) + np.repeat(place, sizes))
        term, asking = code // max(1, len(sizes)), code % max(1, len(sizes))
        at = np.searchsorted(term, np.arange(len(terms.number) + 1)).tolist()
        self.held: list[np.ndarray] = [asking[s:e] for s, e in zip(at[:-1], at[1:])]
        self.dense = {}
        for t, q in enumerate(self.held):
            if len(q) * 32 > len(sizes):
                self.dense[t] = v = np.zeros(len(sizes), kind)
                v[q] = 1
        self.acc = np.zeros(len(sizes), kind)

    def sharing(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(queries, numbers of terms they share) with a row of these distinct terms, by that number, then the query's terms."""
        acc = self.acc
        acc[:] = 0
        for t in terms:
            if (v := self.dense.get(t)) is not None:
                np.add(acc, v, out=acc)
            else:
                acc[self.held[t]] += 1
        at = np.flatnonzero(acc)
        n = acc[at]
        order = np.argsort(n, kind="stable")
        return at[order], n[order]


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b of whole numbers from 0 on, to six digits, halves up."""
    return (2_000_000 * a + b) // (2 * b) / 1e6


def sharing_rows(chunks: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, jaccard, overlap) of the sets of tokens of a query and a row, where they share one; to six digits.

    Pairs are written where the row is read, those of a row by what they share, so that they are stored in few bytes: all but the
    query's id comes in runs. None is shuffled or kept.
    """
    from strandloom.operators.retrieval import tokens

    spark = chunks.sparkSession
    kinds = dict(chunks.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    docs = chunks.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def search(ids: pa.Array, terms: Terms) -> DataFrame:
        held, shared = spark.sparkContext.broadcast(terms), spark.sparkContext.broadcast(ids)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, asking = held.value, Asking(held.value)
            ids = shared.value.take(pa.array(asking.order))

            def pairs(names: pa.Array, rows: list[int], sizes: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                many = [len(q) for q, _ in found]
                q, n = (np.concatenate(x) for x in zip(*found))
                row, wanted = np.repeat(np.arange(len(rows)), many), asking.sizes[q]
                first = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (wanted[1:] != wanted[:-1]) | (row[1:] != row[:-1])])
                times = np.diff(np.r_[first, len(q)])
                n, wanted, size = n[first].astype(np.int64), wanted[first], np.array(sizes, np.int64)[row[first]]
                cols = [ids.take(pa.array(q)), names.take(pa.array(np.array(rows, np.int64)[row])), pa.array(np.repeat(ratio(n, wanted + size - n), times)), pa.array(np.repeat(ratio(n, wanted), times))]
                return pa.RecordBatch.from_arrays(cols, names=["query_id", key, "jaccard", "overlap"])

            for b in batches:
                b = b.filter(b.column(0).is_valid())
                rows, sizes, found, n = [], [], [], 0
                for i, t in enumerate(b.column(1).to_pylist()):
                    words = set(_TOKEN.findall(t))
                    q, shares = asking.sharing(terms.of(words))
                    if len(q):
                        rows.append(i)
                        sizes.append(len(words))
                        found.append((q, shares))
                        n += len(q)
                    if n > OUT:
                        yield pairs(b.column(0), rows, sizes, found)
                        rows, sizes, found, n = [], [], [], 0
                if n:
                    yield pairs(b.column(0), rows, sizes, found)

        return docs.mapInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, jaccard double, overlap double")

    return search(*_asked(queries, F.array_distinct(tokens(F.col("query"))), False))
