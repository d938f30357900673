"""Findings of round 2, each with a case that failed before."""

import math
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import chunking, graphs as G, retrieval as R, schema_drift, searching as S, traversal as T
from strandloom.plans import findings, graphs, retrieval


def test_l2_similarity_is_rounded_once(spark, sf_dir, tmp_path):
    vectors = {20: [0.0, 0.0], 1: [0.123457, 0.0], 2: [0.3, 0.1], 3: [0.9123451, 0.7]}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.score, r.similarity) for r in retrieval.l2_score(spark, str(tmp_path)).collect()}
    far = {i: math.dist(v, vectors[20]) for i, v in vectors.items() if i != 20}
    assert got == {i: (-round(d, 6), round(max(0.0, 1 - d / 2), 6)) for i, d in far.items()}


def test_l2_similarity_of_near_halves(spark):
    docs = spark.createDataFrame([(i, [i * 1.0000004e-6]) for i in range(1, 40)], "vec_id long, v array<double>")
    q = spark.createDataFrame([(0, [0.0])], "query_id long, query_vector array<double>")
    rows = R.knn(docs, q, "vec_id", "v", 39, metric="l2").collect()
    assert [(r.vec_id, r.distance) for r in sorted(rows, key=lambda r: r["rank"])] == [(i, i * 1.0000004e-6) for i in range(1, 40)]


def searched(docs, queries, within):
    """Scores of all pairs in plain Python: BM25, or two for each term that a text holds."""
    words = {i: re.findall("[a-z0-9_]+", (t or "").lower()) for i, t in docs}
    tf, mean = {i: Counter(w) for i, w in words.items()}, sum(map(len, words.values())) / len(words)
    df = Counter(w for c in tf.values() for w in c)
    part = lambda c, w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    low = {i: (t or "").lower() for i, t in docs}
    return {q: {i: sum(2.0 * (w in low[i]) if within else part(tf[i], w) for w in set(a.split()) if within or w in tf[i]) for i in tf} for q, a in queries}


def first(scores, k):
    return {q: sorted((-s, i) for i, s in x.items() if s > 0)[:k] for q, x in scores.items()}


def some_texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    return [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(n)], [(i, " ".join({word() for _ in range(rng.randint(1, 9))})) for i in range(60)]


def held(spark, search, within, monkeypatch):
    """The search in small blocks of rows and queries against all pairs; nothing but the best rows of a task comes out of it."""
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(R.in_blocks, "__defaults__", (25,))
    docs, queries = some_texts(900)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(queries, "query_id long, query string")
    got = {}
    for r in search(d, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {i: x for i, x in first(searched(docs, queries, within), 10).items() if x}
    assert got.keys() == want.keys()
    assert all(len(got[i]) == len(x) and all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(got[i], x)) for i, x in want.items())
    if within:
        assert got == want
    rows = S.best_rows(d, q, "doc_id", "text", 10, within, bm25=None if within else (R.K1, R.B))
    assert rows.count() <= 10 * len(want)  # one task; every hit of every query was shuffled before


def test_bm25_shuffles_only_the_best_rows(spark, monkeypatch):
    held(spark, R.bm25, False, monkeypatch)


def test_bm25_of_repeated_and_missing_keys(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "alpha"), (None, "alpha"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha"), (7, "beta"), (None, "alpha"), (8, "")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, q).collect()}
    n, mean = 5, 6 / 5
    part = lambda df, tf, size: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    want = {(7, 1): part(3, 2, 2) + part(1, 2, 2), (7, 2): part(3, 1, 1)}
    assert got.keys() == want.keys() and all(abs(got[x] - s) < 1e-6 for x, s in want.items())


def test_term_score_shuffles_only_the_best_rows(spark, monkeypatch):
    held(spark, R.term_score, True, monkeypatch)


@pytest.mark.parametrize("query", [retrieval.confidence, retrieval.rerank, retrieval.rrf_hybrid, retrieval.merge_fused, retrieval.semi_candidates, findings.schema_score])
def test_postings_are_not_shuffled(spark, sf_dir, query):
    """A row a term and text was shuffled for each block of queries, and rows a query and text."""
    assert "explode" not in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_pairs_are_not_shuffled(spark, sf_dir):
    docs, queries = some_texts(120)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    found = R.token_overlap(d, q, "doc_id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    sets, asked = {i: set(t.split()) for i, t in docs}, {i: set(t.split()) for i, t in queries}
    want = {(a, b): (len(x & y) / len(x | y), len(x & y) / len(x)) for a, x in asked.items() for b, y in sets.items() if x & y}
    got = {(r.query_id, r.doc_id): (r.jaccard, r.overlap) for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(g - w) < 1e-6 for x in got for g, w in zip(got[x], want[x]))


def test_knn_in_blocks(spark):
    """All queries in one matrix, ties by key, repeated vectors, against plain Python."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(500)] + [(500, None), (None, [1.0] * 4), (501, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>")
    q = v.filter("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "v AS query_vector")
    got = {}
    for r in R.knn(v, q, "vec_id", "v", 7, block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    some = {i: x for i, x in rows[:500] if any(x)}
    cos = lambda a, b: round(sum(map(float.__mul__, a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = {i: sorted((-cos(x, y), j) for j, y in some.items() if j != i)[:7] for i, x in some.items() if i % 3 == 0}
    assert {i: x for i, x in got.items() if i < 500} == want


def some_edges(spark, n=40, m=70, seed=5):
    rng = random.Random(seed)
    pairs = {(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)} | {(3, 3)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] * 2 + [(None, "n1"), ("n1", None)], "src string, dst string")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(n + 10)] + [(None,), ("none",), ("n1",)], "root string")
    return edges.coalesce(1), roots.coalesce(1), spark.createDataFrame([("n7",), ("n20",), (None,)], "node string").coalesce(1)


def rows_of(df):
    got = sorted(map(tuple, df.collect()))
    assert len(got) == len(set(got)) > 0
    return got


def test_reachable_in_workers_as_by_joins(spark, monkeypatch):
    """Cycles, loops, repeated and null edges, roots outside of the graph; a graph beyond the limit goes by joins."""
    edges, roots, blocked = some_edges(spark)
    got = rows_of(T.reachable(edges, roots, blocked))
    assert len(rows_of(T.reachable(edges, roots))) > len(got)
    monkeypatch.setattr(T, "HELD", 10)
    assert got == rows_of(T.reachable(edges, roots, blocked))


def test_steps_of_deep_graphs():
    """More levels than a byte holds."""
    rng = random.Random(2)
    pairs = {(i, i + 1) for i in range(600)} | {(600, 5)} | {(rng.randint(0, 600), rng.randint(590, 600)) for _ in range(30)}
    graph = T.Held(*(pa.chunked_array([[f"n{p[i]}" for p in sorted(pairs)]]) for i in (0, 1)))
    name, out = graph.names.to_pylist(), {f"n{a}": [f"n{y}" for x, y in pairs if x == a] for a, _ in pairs}
    roots = np.arange(0, 601, 11)
    for r, steps in zip(roots, graph.steps(roots)):
        assert {name[v]: n for v, n in enumerate(steps.tolist()) if n} == least_steps(out, name[r])


def least_steps(out, root):
    seen, frontier, n = {}, [root], 0
    while frontier:
        n += 1
        frontier = [b for b in {b for a in frontier for b in out.get(a, ())} if b not in seen]
        seen |= dict.fromkeys(frontier, n)
    return seen


def test_shortest_paths_in_workers_as_by_joins(spark, monkeypatch):
    edges, roots, _ = some_edges(spark, m=80)
    got = rows_of(T.shortest_paths(edges, roots))
    assert got == rows_of(G.shortest_paths(edges, roots))
    monkeypatch.setattr(T, "OUT", 70)
    assert got == rows_of(T.shortest_paths(edges, roots))
    numbers = spark.createDataFrame([(1, 10), (1, 9), (10, 3), (9, 3), (3, 1)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "root long")
    assert rows_of(T.shortest_paths(numbers, start)) == [(1, 3, "1 > 10 > 3"), (1, 9, "1 > 9"), (1, 10, "1 > 10")]


def test_searches_of_an_empty_graph(spark):
    edges, roots, blocked = some_edges(spark)
    none = edges.limit(0)
    assert T.reachable(none, roots).count() == T.shortest_paths(none, roots).count() == T.reachable(edges, roots.limit(0), blocked).count() == 0


@pytest.mark.parametrize("query", [graphs.call_paths, graphs.hops, graphs.taint])
def test_found_nodes_are_not_kept(spark, sf_dir, query):
    """What a search found went through a shuffle and into checkpoints, round by round."""
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|ExistingRDD", plan), plan


def test_confidence_searches_for_three(spark, sf_dir, monkeypatch):
    """The best ten of every task were searched for and shuffled."""
    want, k, bm25 = sorted(map(tuple, R.confidence_label(retrieval.bm25(spark, sf_dir)).collect())), [], R.bm25
    monkeypatch.setattr(R, "bm25", lambda *a, **x: k.append(x["k"]) or bm25(*a, **x))
    assert sorted(map(tuple, retrieval.confidence(spark, sf_dir).collect())) == want and k == [4]


def test_nearest_vectors_of_a_later_task_start_from_the_floors(spark):
    """Each task gave the best k of its own rows, however far they were."""
    rng = np.random.default_rng(4)
    near, far = rng.normal(1, 0.1, (50, 8)), rng.normal(-1, 0.1, (50, 8))
    batch = lambda x, at: pa.record_batch([pa.array(np.arange(at, at + len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])
    held = type("Held", (), {"value": [(8, pa.array(np.arange(1000, 1020)), R._unit(rng.normal(1, 0.1, (20, 8))))]})
    search = R._nearest_by_cosine(held, "vec_id", 5)
    assert sum(b.num_rows for b in search(iter([batch(near, 0)]))) == 100 and sum(b.num_rows for b in search(iter([batch(far, 50)]))) == 0
    other = R._nearest_by_cosine(held, "vec_id", 5)
    assert sum(b.num_rows for b in other(iter([batch(far, 50)]))) == 100


def test_terms_are_counted_in_bytes(spark):
    """More terms than a byte counts, and rows that hold as many as the floor."""
    docs, queries = some_texts(300, seed=8)
    queries = [*queries, (99, " ".join(f"w{i}" for i in range(300)))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(queries, "query_id long, query string")
    for ask in (queries, queries[:-1]):
        got = {}
        for r in R.term_score(d, q.filter(f"query_id <= {max(i for i, _ in ask)}"), k=6, weight=0.1).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
        want = {i: {j: round(s / 20, 6) for j, s in x.items()} for i, x in searched(docs, ask, True).items()}
        assert got == {i: x for i, x in first(want, 6).items() if x}


def test_equal_texts_are_weighed_once(monkeypatch):
    """Every text of a payload was matched anew."""
    seen, signature = [], schema_drift.value_signature
    monkeypatch.setattr(schema_drift, "value_signature", lambda x: seen.append(x) or signature(x))
    schema_drift._weigh_text.cache_clear()
    texts = ["12 u", "done", "x" * 300, "-3.5", "1e999", ""]
    assert [schema_drift._weigh(x) for x in texts] == [schema_drift._weigh(x) for x in texts]
    assert sorted(seen) == sorted([*texts, "x" * 300])


def test_searches_run_in_no_more_tasks_than_slots(spark):
    """Each file's task gave the best rows of every query, so that what was shuffled grew with the files."""
    docs, queries = some_texts(400)
    slots = spark.sparkContext.defaultParallelism
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5 * slots), spark.createDataFrame(queries, "query_id long, query string")
    rows = S.best_rows(d, q, "doc_id", "text", 3, False, bm25=(R.K1, R.B))
    assert rows.rdd.getNumPartitions() == slots and rows.count() <= slots * 3 * len(queries)
    got = {}
    for r in R.bm25(d, q, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {i: x for i, x in first(searched(docs, queries, False), 3).items() if x}
    assert got.keys() == want.keys() and all(abs(a[0] - b[0]) < 2e-6 for i, x in want.items() for a, b in zip(got[i], x, strict=True))
    v = chunking.hash_embedding(d, "doc_id", "text", 16)
    near = R.knn(v, v.filter("doc_id < 60").withColumnsRenamed({"doc_id": "query_id", "embedding": "query_vector"}), "doc_id", "embedding", 3)
    assert f"Coalesce {slots}" in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == 3 * sum(bool(t) for _, t in docs[:60])


def test_jaccard_pairs_of_a_row_come_in_runs(spark):
    """Pairs came by query: two values a pair were stored in many bits, and rounded one by one."""
    docs, queries = some_texts(500, seed=3)
    long = (70, " ".join(f"w{i}" for i in range(300)))
    d, q = spark.createDataFrame([*docs, (None, "w1"), (500, None)], "doc_id long, text string").coalesce(1), spark.createDataFrame([*queries, long, (71, "")], "query_id long, query string")
    found = R.token_overlap(d, q, "doc_id", "text").collect()
    sets, asked = {i: set(t.split()) for i, t in docs}, {i: set(t.split()) for i, t in [*queries, long]}
    keys = [(r.doc_id, len(asked[r.query_id] & sets[r.doc_id]), len(asked[r.query_id])) for r in found]
    assert keys == sorted(keys)
    up = lambda a, b: int(Decimal(a / b).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1_000_000)
    want = {(a, b, up(len(x & y), len(x | y)), up(len(x & y), len(x))) for a, x in asked.items() for b, y in sets.items() if x & y}
    assert {(r.query_id, r.doc_id, round(r.jaccard * 1e6), round(r.overlap * 1e6)) for r in found} == want and len(found) == len(want)


def test_ratios_round_halves_up():
    n, d = np.array([1, 1, 3, 2, 16, 1]), np.array([128, 640, 640, 3, 16, 3])
    assert S.ratio(n, d).tolist() == [0.007813, 0.001563, 0.004688, 0.666667, 1.0, 0.333333]
