"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import chunking, retrieval as R
from strandloom.session import table

#: Fixed texts for query_expansion; searches ask the documents.
ASKED = [(1, "flash sector map erase cycle"), (2, "frames dropped at bus load"), (3, "recall of the context window"), (4, "signing certificate audit trail"), (5, "meeting agenda and hiring plan")]
STOP = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not"]
SYNONYMS = {"bus": ["can", "lin"], "flash": ["nvm", "erase"], "recall": ["retrieval", "ranking"]}
INTENTS = [("build", ["compile", "linker", "build"]), ("search", ["recall", "index", "search"]), ("review", ["review", "thread", "comment"])]


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, query string")


def searches(spark, d):
    """Keywords of the documents whose id is divisible by 20, against all rows."""
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(R.keywords(F.col("text"), STOP), " ").alias("query"))


def _others(search, docs, q, k=10):
    """First k of a lexical search without the query's own document, as the vector searches leave it out."""
    rows = search(docs, q, k=k + 1).filter("doc_id <> query_id").drop("rank")
    return R.top_per(rows, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def _nearest(docs, k):
    """Nearest documents by their hashed embeddings, for the documents whose id is divisible by 20."""
    v = chunking.hash_embedding(docs, "doc_id", "text")
    q = chunking.hash_embedding(docs.filter("doc_id % 20 = 0"), "doc_id", "text").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.knn(v, q, "doc_id", "embedding", k)


def vector_queries(spark, d):
    """Vectors whose id is divisible by 20, against all rows."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _pool(spark, d, k=40):
    return R.knn(table(spark, d, "embeddings"), vector_queries(spark, d), "vec_id", "embedding", k)


def term_score(spark, d):
    return _others(R.term_score, table(spark, d, "documents"), searches(spark, d))


def bm25(spark, d):
    return _others(R.bm25, table(spark, d, "documents"), searches(spark, d))


def rrf_hybrid(spark, d):
    docs = table(spark, d, "documents")
    return R.reciprocal_rank_fusion([_others(R.bm25, docs, searches(spark, d), 40), _nearest(docs, 40)], "doc_id", 10)


def knn_topk(spark, d):
    return _pool(spark, d, 10)


def knn_oversample_filter(spark, d):
    pool = _pool(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return R.oversampled(pool, (F.col("label") % 2 == 0) & (F.col("score") >= 0.1), 10, "vec_id").select("query_id", "vec_id", "score", "rank")


def knn_prefilter(spark, d):
    """The metadata filter comes before the search."""
    return R.knn(table(spark, d, "embeddings").filter("label % 2 = 0"), vector_queries(spark, d), "vec_id", "embedding", 10)


def l2_score(spark, d):
    """Nearest by L2 distance; the score is its negative, the similarity max(0, 1 - d / 2)."""
    v, q = table(spark, d, "embeddings"), vector_queries(spark, d)
    near = R.knn(v, q, "vec_id", "embedding", 10, metric="l2").withColumnRenamed("score", "far")
    return near.select("query_id", "vec_id", (-F.col("far")).alias("score"), F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") / 2), 6).alias("similarity"), "rank")


def merge_fused(spark, d):
    docs = table(spark, d, "documents")
    lex, vec = _others(R.term_score, docs, searches(spark, d)), _nearest(docs, 10)
    return R.weighted_merge(lex, vec, "doc_id").select("query_id", "doc_id", "lexical_score", "vector_score", "score", "rank")


def semi_candidates(spark, d):
    docs = table(spark, d, "documents")
    return R.kept_candidates(_nearest(docs, 30), _others(R.term_score, docs, searches(spark, d)), docs.filter("lang = 'en'"), "doc_id")


def confidence(spark, d):
    """By the best three, so that no more are searched for."""
    return R.confidence_label(_others(R.bm25, table(spark, d, "documents"), searches(spark, d), 3))


def path_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "path", "source", "n_chars")
    return R.first_per_key(docs, [F.lower(F.trim("path")), F.lower(F.trim(F.coalesce("source", F.lit(""))))], [F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("doc_id", "path", "source")


def exact_dedup(spark, d):
    """First document of each content, by SHA-256."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def dup_groups(spark, d):
    """Files of equal size and digest."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.groupBy("size", "digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(R.keywords(F.col("text"), STOP), " ").alias("keywords"))


def query_expansion(spark, d):
    q = asked(spark)
    return q.select("query_id", F.array_join(R.expanded(F.array_distinct(R.tokens(F.col("query"))), SYNONYMS), " ").alias("terms"))


def intent(spark, d):
    return table(spark, d, "documents").select("doc_id", R.classify(F.col("text"), INTENTS, "explain").alias("intent"))


def jaccard(spark, d):
    """Token sets of each query against each document that shares a token with it (all others have 0)."""
    return R.token_overlap(table(spark, d, "documents"), searches(spark, d), "doc_id", "text").filter("doc_id <> query_id")


def char_overlap(spark, d):
    a, b = (F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), "")) for c in ("source", "path"))
    return table(spark, d, "documents").select("doc_id", F.round(R.overlap_of_first(F.filter(a, lambda x: x != ""), F.filter(b, lambda x: x != "")), 6).alias("overlap"))


def compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", R.compacted(F.col("text"), 200, " [...] ").alias("text"))


def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", R.truncated(F.col("text"), 2000).alias("text"))


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", R.token_estimate(F.col("text")).alias("tokens"))


def embedding_text(spark, d):
    """Path, source and the first 2,400 characters, blanks dropped, one per line."""
    parts = [F.when(F.trim(c) != "", F.trim(c)) for c in (F.col("path"), F.col("source"), F.substring("text", 1, 2400))]
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


def haystack(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.concat_ws(" ", "path", "source", F.substring("text", 1, 2500))).alias("hay"))


def proximity_order(spark, d):
    """Same path first, by distance of ids, then same source, then others; ranked around the first document of each source."""
    docs = table(spark, d, "documents").select("doc_id", "path", "source")
    at = docs.groupBy("source").agg(F.min("doc_id").alias("at"))
    near = docs.join(at, "source").withColumn("class", F.when(F.col("doc_id") == F.col("at"), 0).when(F.abs(F.col("doc_id") - F.col("at")) < 100, 1).otherwise(2))
    return near.select("source", "doc_id", F.row_number().over(R.W.partitionBy("source").orderBy("class", F.abs(F.col("doc_id") - F.col("at")), "doc_id")).cast("bigint").alias("place"))


def rerank(spark, d):
    """BM25 pool of 10 reranked by Jaccard with the query, ties by the first score, then id."""
    docs = table(spark, d, "documents")
    # the queries come first: the texts' tokens are shuffled once
    pool = bm25(spark, d).drop("rank").join(R.small(searches(spark, d)), "query_id").join(docs.select("doc_id", F.array_distinct(R.tokens(F.col("text"))).alias("w")), "doc_id")
    scored = pool.select("query_id", "doc_id", "score", F.round(R.jaccard(F.array_distinct(R.tokens(F.col("query"))), F.col("w")), 6).alias("rerank_score"))
    return R.top_per(scored, "query_id", [F.desc("rerank_score"), F.desc("score"), F.asc("doc_id")], 10)


QUERIES = {f.__name__: f for f in (term_score, bm25, rrf_hybrid, knn_topk, knn_oversample_filter, knn_prefilter, l2_score, merge_fused, semi_candidates, confidence, path_dedup, exact_dedup, dup_groups, keywords, query_expansion, intent, jaccard, char_overlap, compact_text, truncated_text, token_estimate, embedding_text, haystack, proximity_order, rerank)}

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+')"
_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_KEYWORDS = f"""kept AS (SELECT doc_id, list_filter({_TOK.format("text")}, lambda x: length(x) >= 3 AND x NOT IN ({", ".join(f"'{w}'" for w in STOP)})) AS t FROM documents),
keyed AS (SELECT doc_id, array_to_string({_IN_ORDER.format("t")}[:16], ' ') AS keywords FROM kept)"""
_ASKED = f"{_KEYWORDS}, asked AS (SELECT doc_id AS query_id, keywords AS query FROM keyed WHERE doc_id % 20 = 0)"
_TERM = f"""terms AS (SELECT query_id, unnest(list_distinct({_TOK.format("query")})) AS t FROM asked),
holds AS (SELECT doc_id, t FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), (SELECT DISTINCT t FROM terms) WHERE contains(low, t)),
term AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, 2.0::DOUBLE * count(*) AS score FROM holds JOIN terms USING (t) WHERE doc_id <> query_id GROUP BY query_id, doc_id))"""
#: Hashed embeddings (64-bit FNV-1a of the tokens, fixed values) and the nearest by cosine.
_HASHED = f"""vocabulary AS (SELECT t, (list_reduce([14695981039346656037::UHUGEINT] || list_transform(string_split(t, ''), lambda c: ord(c)::UHUGEINT), lambda h, c: xor(h, c) * 1099511628211 % 18446744073709551616) % 256)::INT AS bucket
  FROM (SELECT DISTINCT unnest({_TOK.format("text")}) AS t FROM documents)),
counts AS (SELECT doc_id, bucket, count(*)::FLOAT AS n FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS t FROM documents) JOIN vocabulary USING (t) GROUP BY 1, 2),
part AS (SELECT doc_id, bucket, n / sqrt(sum(n::DOUBLE * n) OVER (PARTITION BY doc_id))::FLOAT AS x FROM counts),
unit AS (SELECT doc_id, bucket, x, x::DOUBLE / sqrt(sum(x::DOUBLE * x) OVER (PARTITION BY doc_id)) AS u FROM part),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT d.doc_id AS query_id, v.doc_id, round(coalesce(sum(a.u * b.u), 0), 6) AS score FROM (SELECT DISTINCT doc_id FROM unit WHERE doc_id % 20 = 0) d JOIN (SELECT DISTINCT doc_id FROM unit) v ON v.doc_id <> d.doc_id
  LEFT JOIN unit a ON a.doc_id = d.doc_id LEFT JOIN unit b ON b.doc_id = v.doc_id AND b.bucket = a.bucket GROUP BY 1, 2))"""
_BM = f"""w AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents), size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
hits AS (SELECT doc_id, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN (SELECT unnest({_TOK.format("query")}) FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM hits JOIN dfs USING (term) JOIN (SELECT DISTINCT query_id, unnest({_TOK.format("query")}) AS term FROM asked) USING (term), size WHERE doc_id <> query_id GROUP BY query_id, doc_id))"""
_COS = """round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"""
_KNN = f"""knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id {{}}))"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {}) AS rank"
SQL = {
    "term_score": f"WITH {_ASKED}, {_TERM} SELECT * FROM term WHERE rank <= 10",
    "bm25": f"WITH {_ASKED}, {_BM} SELECT * FROM bm WHERE rank <= 10",
    "rrf_hybrid": f"""WITH {_ASKED}, {_BM}, {_HASHED}, u AS (SELECT query_id, doc_id, rank FROM near WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank FROM bm WHERE rank <= 40),
s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank - 1)), 6) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, {_RANK.format("doc_id")} FROM s) SELECT * FROM r WHERE rank <= 10""",
    "keywords": f"WITH {_KEYWORDS} SELECT doc_id, keywords FROM keyed",
    "knn_topk": f"WITH {_KNN.format('')} SELECT query_id, vec_id, score, rank FROM knn WHERE rank <= 10",
    "knn_oversample_filter": f"WITH {_KNN.format('')}, f AS (SELECT query_id, vec_id, score, {_RANK.format('vec_id')} FROM knn WHERE knn.rank <= 40 AND label % 2 = 0 AND score >= 0.1) SELECT * FROM f WHERE rank <= 10",
    "knn_prefilter": f"WITH {_KNN.format('AND v.label % 2 = 0')} SELECT query_id, vec_id, score, rank FROM knn WHERE rank <= 10",
    "l2_score": f"""WITH f AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS far FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
g AS (SELECT query_id, vec_id, round(-far, 6) AS score, round(greatest(0.0, 1 - far / 2), 6) AS similarity FROM f), r AS (SELECT *, {_RANK.format("vec_id")} FROM g) SELECT * FROM r WHERE rank <= 10""",
    "merge_fused": f"""WITH {_ASKED}, {_TERM}, {_HASHED}, m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS lexical_score, coalesce(b.score, 0) AS vector_score
FROM (SELECT * FROM term WHERE rank <= 10) a FULL JOIN (SELECT * FROM near WHERE rank <= 10) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
s AS (SELECT *, round(0.65::DOUBLE * lexical_score + 8::DOUBLE * vector_score, 6) AS score FROM m), r AS (SELECT *, {_RANK.format("doc_id")} FROM s) SELECT * FROM r WHERE rank <= 10""",
    "semi_candidates": f"""WITH {_ASKED}, {_TERM}, {_HASHED} SELECT query_id, doc_id, score FROM near WHERE rank <= 30 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
AND (score > 0.45 OR EXISTS (SELECT 1 FROM term t WHERE t.rank <= 10 AND t.query_id = near.query_id AND t.doc_id = near.doc_id))""",
    "confidence": f"""WITH {_ASKED}, {_BM} SELECT query_id, max(score) AS top_score, CASE WHEN max(score) >= 11 AND count(*) FILTER (score >= 6) >= 2 THEN 'high' WHEN max(score) >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM bm WHERE rank <= 3 GROUP BY query_id""",
    "path_dedup": "SELECT doc_id, path, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(path)), lower(trim(coalesce(source, ''))) ORDER BY n_chars DESC NULLS LAST, doc_id) AS n FROM documents WHERE trim(path) <> '') WHERE n = 1",
    "exact_dedup": "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "dup_groups": "SELECT strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "jaccard": f"""WITH {_ASKED}, w AS (SELECT doc_id, list_distinct({_TOK.format("text")}) AS w FROM documents), q AS (SELECT query_id, list_distinct({_TOK.format("query")}) AS q FROM asked)
SELECT query_id, doc_id, round(len(list_intersect(q, w)) / (len(q) + len(w) - len(list_intersect(q, w))), 6) AS jaccard, round(len(list_intersect(q, w)) / len(q), 6) AS overlap FROM w, q WHERE doc_id <> query_id AND len(list_intersect(q, w)) > 0""",
    "query_expansion": "WITH asked(query_id, query) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in ASKED) + f"), t AS (SELECT query_id, {_IN_ORDER.format(_TOK.format('query'))} AS t FROM asked) SELECT query_id, array_to_string(t"
    + "".join(f" || CASE WHEN list_contains(t, '{w}') THEN list_filter([{', '.join(repr(x) for x in more)}], lambda x: NOT list_contains(t, x)) ELSE [] END" for w, more in sorted(SYNONYMS.items()))
    + ", ' ') AS terms FROM t",
    "char_overlap": "WITH c AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(coalesce(source, '')), ''), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(coalesce(path, '')), ''), lambda x: x <> '')) AS b FROM documents) SELECT doc_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS overlap FROM c",
    "compact_text": "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE left(t, 96) || ' [...] ' || right(t, 97) END AS text FROM t",
    "embedding_text": "SELECT doc_id, concat_ws(chr(10), nullif(trim(path), ''), nullif(trim(source), ''), nullif(trim(substr(text, 1, 2400)), '')) AS text FROM documents",
    "token_estimate": "SELECT doc_id, (strlen(text) // 4 + 1)::BIGINT AS tokens FROM documents",
    "truncated_text": "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 998) || '...' || right(text, 999) END AS text FROM documents",
    "haystack": "SELECT doc_id, lower(concat_ws(' ', path, source, substr(text, 1, 2500))) AS hay FROM documents",
    "intent": "SELECT doc_id, CASE " + "WHEN b + s + r = 0 THEN 'explain' WHEN b >= s AND b >= r THEN 'build' WHEN s >= r THEN 'search' ELSE 'review' END AS intent FROM (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN 1 ELSE 0 END" for w in ws) + f") AS {label[0]}" for label, ws in [("build", INTENTS[0][1]), ("search", INTENTS[1][1]), ("review", INTENTS[2][1])]) + " FROM documents)",
    "proximity_order": "WITH a AS (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id = first_id THEN 0 WHEN abs(doc_id - first_id) < 100 THEN 1 ELSE 2 END, abs(doc_id - first_id), doc_id) AS place FROM documents JOIN a USING (source)",
    "rerank": f"""WITH {_ASKED}, {_BM}, p AS (SELECT query_id, doc_id, score, list_distinct(w.w) AS w, list_distinct({_TOK.format("query")}) AS q FROM bm JOIN w USING (doc_id) JOIN asked USING (query_id) WHERE rank <= 10),
s AS (SELECT query_id, doc_id, score, round(len(list_intersect(q, w)) / (len(q) + len(w) - len(list_intersect(q, w))), 6) AS rerank_score FROM p) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, doc_id) AS rank FROM s""",
}
