"""Lexical and vector retrieval, rank fusion and reranking over whole tables.

Queries are small tables; each operator ranks within a query by a total order. Query sets are broadcast only under
``QUERY_LIMIT`` rows, else they are joined by shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.operators.searching import Best, at_once, best_rows, floors_of, sharing_rows
from strandloom.session import cut_lineage

QUERY_LIMIT = 10_000
RRF_K, K1, B = 60, 1.2, 0.75


def small(df: DataFrame, limit: int = QUERY_LIMIT) -> DataFrame:
    """A broadcast hint where at most ``limit`` rows are there, checked by reading no more than limit + 1."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def keywords(text: Column, stopwords: list[str], least: int = 3, most: int = 16) -> Column:
    """First distinct tokens of at least ``least`` characters that aren't stop words, in order."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(stopwords))), 1, most)


def top_per(df: DataFrame, group: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group by ``order`` (which must be total), with their 1-based bigint rank."""
    keys = [group] if isinstance(group, str) else group
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(name) <= k)


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): the term frequencies, counted once for all queries."""
    terms = chunks.select(F.col(key), F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    lengths = chunks.select(F.col(key), F.size(tokens(F.col(text))).cast("bigint").alias("length"))
    return terms.join(lengths, key)


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score, rank) by BM25 over the OR of a query's distinct terms. queries: (query_id, query).

    The table is read twice, for document frequencies and for scores; only the best rows of each task are shuffled.
    """
    return in_blocks(queries, lambda part: top_per(best_rows(chunks, part, key, text, k, within=False, bm25=(k1, b)), "query_id", [F.desc("score"), F.asc(key)], k))


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame], block: int = 50_000, *, cut: bool = True) -> DataFrame:
    """search(queries) in blocks of about ``block`` queries, so that what is shuffled (if anything: ``cut``) and what a task holds at
    once doesn't grow with the queries."""
    n = max(1, -(-queries.count() // block))
    if n == 1:
        return search(queries)
    parts = (search(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n))
    return reduce(DataFrame.unionByName, [cut_lineage(p) if cut else p for p in parts])


def term_score(chunks: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10, weight: float = 2.0, bonus: Column | None = None) -> DataFrame:
    """(query_id, key, score, rank): ``weight`` for each distinct query term the text holds as a substring, plus ``bonus``; 0 is dropped.

    Terms are whole runs of token characters, so each lies within a token of the text: parts of tokens are looked up among the terms.
    """
    return in_blocks(queries, lambda part: top_per(best_rows(chunks, part, key, text, k, within=True, factor=weight, bonus=bonus), "query_id", [F.desc("score"), F.asc(key)], k))


def token_overlap(chunks: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, jaccard, overlap) of the token sets of queries and texts that share a token: counted over postings of the
    queries' tokens where the texts are read; nothing is shuffled. overlap is the share of the query's tokens."""
    return in_blocks(queries, lambda part: sharing_rows(chunks, part, key, text), cut=False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """0 on unequal lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 32_000, metric: str = "cosine") -> DataFrame:
    """(query_id, key, score, rank): exact nearest vectors by cosine, or (``metric`` 'l2') by distance, without the query itself.
    With 'l2' there is also ``distance``, which isn't rounded.

    queries: (query_id, query_vector), cut into blocks of at most ``block`` rows that are broadcast as one matrix. The table is
    multiplied with a block where it is read, by cosine in single precision first: what may be among the best is worked out again in
    double. Each task keeps the best k per query, so that only those are shuffled. Null keys, zero vectors (by cosine only)
    and vectors of another length than the query are skipped.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]
    near = metric == "l2"
    values = ["score", "distance"] if near else ["score"]
    asked = queries.filter("query_id IS NOT NULL AND query_vector IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), "query_vector")
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    n = max(1, -(-asked.count() // block))
    found = None
    for i in range(n):
        part = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else asked).toArrow()
        sizes = _by_size(part.column(0).combine_chunks(), part.column(1).combine_chunks(), near)
        held = spark.sparkContext.broadcast([(size, ids, matrix if near else _unit(matrix)) for size, ids, matrix in sizes])
        search = _nearest_by_distance(held, key, k) if near else _nearest_by_cosine(held, key, k)
        sims = (rows if near else at_once(rows)).mapInArrow(search, f"query_id long, {key} {kind}, {', '.join(f'{v} double' for v in values)}")
        best = top_per(sims, "query_id", [F.desc("score"), F.asc(key)], k)
        best = best.withColumn("score", -F.col("score")) if near else best
        found = best if found is None else found.unionByName(best)
    return found


def _by_size(keys: pa.Array, vectors: pa.Array, zero: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, keys, matrix) of the vectors of each length, without zero vectors or with."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = pa.array(np.flatnonzero(sizes == size))
        flat = np.asarray(vectors.take(at).flatten().cast(pa.float64()).fill_null(0)).reshape(len(at), size)
        some = slice(None) if zero else flat.any(1)
        yield size, keys.take(at) if zero else keys.take(at).filter(pa.array(some)), flat[some]


def _nearest_by_distance(held, key: str, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {size: (np.asarray(ids), matrix) for size, ids, matrix in held.value}
        for batch in batches:
            for size, names, flat in _by_size(batch.column(0), batch.column(1), True):
                if size not in asked:
                    continue
                ids, matrix = asked[size]
                far = _distances(flat, matrix)
                score = -np.round(far, 6)
                score[names.to_numpy(zero_copy_only=False)[:, None] == ids[None, :]] = -np.inf
                place = max(0, len(flat) - k)
                r, q = np.nonzero((score >= np.partition(score, place, axis=0)[place]) & (score > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), names.take(pa.array(r)), pa.array(score[r, q]), pa.array(far[r, q])], names=["query_id", key, "score", "distance"])

    return search


def _nearest_by_cosine(held, key: str, k: int, tall: int = 4_096, wide: int = 2_048) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    search_id = uuid.uuid4().hex

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {size: (np.asarray(ids), matrix, matrix.astype(np.float32), Best(len(matrix), k)) for size, ids, matrix in held.value}
        for size, (*_, best) in asked.items():
            best.floor = floors_of((search_id, size), len(best.floor))
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for size, names, flat in _by_size(batch.column(0), batch.column(1), False):
                if size not in asked:
                    continue
                ids, matrix, single, best = asked[size]
                keys, flat = names.to_numpy(zero_copy_only=False), _unit(flat)
                for lo in range(0, len(flat), tall):
                    part, mine = flat[lo : lo + tall], keys[lo : lo + tall]
                    half = part.astype(np.float32)
                    for left in range(0, len(ids), wide):
                        right = left + wide
                        score = half @ single[left:right].T
                        floor = best.floor[left:right]
                        if np.isinf(floor).any():  # the first rows give a floor
                            score[mine[:, None] == ids[None, left:right]] = -np.inf
                            place = max(0, len(part) - k)
                            floor = np.maximum(floor, np.partition(score, place, axis=0)[place] - 1e-4)
                        at = np.flatnonzero(score >= (floor - 1e-4).astype(np.float32))  # single precision is off by less
                        r, q = np.divmod(at, score.shape[1])
                        q += left
                        other = mine[r] != ids[q]
                        r, q = r[other], q[other]
                        exact = np.concatenate([np.zeros(0)] + [np.round(np.einsum("ij,ij->i", part[r[s : s + 8_000]], matrix[q[s : s + 8_000]]), 6) for s in range(0, len(r), 8_000)])
                        keep = exact >= best.floor[q]
                        best.add(q[keep], mine[r[keep]], exact[keep])
        for ids, _, _, best in asked.values():
            q, names, score = best.compact()
            for lo in range(0, len(q), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[lo : lo + 500_000]]), pa.array(names[lo : lo + 500_000], kind), pa.array(score[lo : lo + 500_000])], names=["query_id", key, "score"])

    return search


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows, one query at a time: exact also for near ones."""
    return np.stack([np.sqrt(((a - q) ** 2).sum(1)) for q in b], 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def oversampled(ranked: DataFrame, keep: Column, k: int, key: str) -> DataFrame:
    """From a pool ranked per query (``rank``): filter after the pool was cut, then the first k. May give fewer than k."""
    return top_per(ranked.filter(keep).drop("rank"), "query_id", [F.desc("score"), F.asc(key)], k)


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, k: int, c: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank): sum over the lists of 1 / (c + rank), ranks from 0."""
    parts = [r.select("query_id", key, (F.lit(1.0) / (F.lit(c) + F.col("rank") - 1)).alias("s")) for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    total = union.groupBy("query_id", key).agg(F.round(F.sum("s"), 6).alias("score"))
    return top_per(total, "query_id", [F.desc("score"), F.asc(key)], k)


def weighted_merge(lexical: DataFrame, vector: DataFrame, key: str, k: int = 10, lexical_weight: float = 0.65, vector_weight: float = 8.0) -> DataFrame:
    """Full outer merge of two scored lists: lexical_weight * lexical + vector_weight * vector."""
    a = lexical.select("query_id", key, F.col("score").alias("lexical_score"))
    b = vector.select("query_id", key, F.col("score").alias("vector_score"))
    both = a.join(b, ["query_id", key], "full_outer").fillna(0.0, ["lexical_score", "vector_score"])
    both = both.withColumn("score", F.round(lexical_weight * F.col("lexical_score") + vector_weight * F.col("vector_score"), 6))
    return top_per(both, "query_id", [F.desc("score"), F.asc(key)], k)


def kept_candidates(vector: DataFrame, lexical: DataFrame, allowed: DataFrame, key: str, least: float = 0.45, head: int = 10) -> DataFrame:
    """Vector hits among the allowed keys that are also in the lexical head or score above ``least``."""
    lead = lexical.filter(F.col("rank") <= head).select("query_id", key, F.lit(True).alias("lexical"))
    return vector.join(allowed.select(key), key, "left_semi").join(lead, ["query_id", key], "left").filter(F.col("lexical") | (F.col("score") > least)).select("query_id", key, "score")


def first_per_key(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each combination of ``keys``; rows with a blank first key are dropped."""
    named = rows
    for i, c in enumerate(keys):
        named = named.withColumn(f"_k{i}", c)
    names = [f"_k{i}" for i in range(len(keys))]
    return top_per(named.filter(F.col("_k0").isNotNull() & (F.col("_k0").cast("string") != "")), names, order, 1, "_n").drop("_n", *names)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_of_first(a: Column, b: Column) -> Column:
    """Share of the first set that is in the second; 0 where the first is empty."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def confidence_label(hits: DataFrame, high: float = 11.0, medium: float = 6.0) -> DataFrame:
    """(query_id, top_score, confidence): high if the best reaches ``high`` and two of the best three ``medium``."""
    top3 = hits.filter("rank <= 3").groupBy("query_id").agg(F.max("score").alias("top_score"), F.count_if(F.col("score") >= medium).alias("good"))
    label = F.when((F.col("top_score") >= high) & (F.col("good") >= 2), "high").when(F.col("top_score") >= medium, "medium").otherwise("low")
    return top3.select("query_id", "top_score", label.alias("confidence"))


def compacted(text: Column, limit: int, marker: str) -> Column:
    """Whitespace collapsed; a longer text keeps its head and tail around the marker."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = max((limit - len(marker)) // 2, 1)
    tail = max(limit - len(marker) - head, 1)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(marker), F.substring(t, -tail, tail)))


def truncated(text: Column, limit: int) -> Column:
    """Head and tail around an ellipsis of three dots, ``limit`` characters in all."""
    room = limit - 3
    head = room // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.substring(text, -(room - head), room - head)))


def token_estimate(text: Column) -> Column:
    """Bytes over four, rounded down, plus one."""
    return F.floor(F.octet_length(text) / 4).cast("bigint") + 1


def classify(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the rule with most keywords in the text; on a tie the first rule, without any ``default``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for _, words in rules]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.when(best == 0, F.lit(default))
    for (label, _), n in zip(rules, hits):
        out = out.when(n == best, F.lit(label))
    return out


def expanded(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """Terms with the synonyms of those present, each once."""
    out = terms
    for word, more in sorted(synonyms.items()):
        out = F.when(F.array_contains(terms, word), F.array_union(out, F.array(*map(F.lit, more)))).otherwise(out)
    return out
