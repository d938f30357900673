"""Queries of chunking and budget operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import chunking as C, retrieval as R
from strandloom.plans.retrieval import _HASHED
from strandloom.session import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _digest(df):
    return df.withColumn("chunk", F.sha2("chunk", 256))


def chunk_paragraphs(spark, d):
    return _digest(C.exploded(_docs(spark, d), "doc_id", "text", C.chunk_text))


def chunk_windows(spark, d):
    return _digest(C.exploded(_docs(spark, d), "doc_id", "text", C.chunk_recursive))


def chunk_code(spark, d):
    return _digest(C.exploded(_docs(spark, d).filter("doc_type = 'code_comment'"), "doc_id", "text", C.chunk_code))


def chunk_json(spark, d):
    return _digest(C.exploded(table(spark, d, "workflow_events"), "ingest_id", "payload_json", C.chunk_json))


def chunk_spans(spark, d):
    """Two spans of each document, its halves in bytes."""
    half = F.floor(F.octet_length("text") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("start"), half.alias("end")), F.struct(half.alias("start"), F.octet_length("text").cast("int").alias("end")))
    return _digest(C.span_chunks(_docs(spark, d).withColumn("spans", spans), "doc_id", "text", "spans"))


def sentence_counts(spark, d):
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return _docs(spark, d).select("doc_id", F.size(parts).cast("bigint").alias("n_sentences"))


def hash_embeddings(spark, d):
    """Each document's embedding, its parts in millionths and empty ones left out, as bucket:part."""
    e = C.hash_embedding(_docs(spark, d), "doc_id", "text")
    parts = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), F.round(x.cast("double") * 1_000_000).cast("bigint").alias("x"))), lambda p: p["x"] > 0)
    return e.select("doc_id", F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["i"], p["x"])), " ").alias("embedding"))


def mmr_extract(spark, d):
    return C.extract(_docs(spark, d), "doc_id", "text").withColumn("summary", F.sha2("summary", 256))


def mmr_near(spark, d):
    return C.extract(_docs(spark, d), "doc_id", "text", near=10).withColumn("summary", F.sha2("summary", 256))


def kv_compact(spark, d):
    return C.compacted(table(spark, d, "workflow_events"), "ingest_id", "payload_json")


def budget_skip(spark, d):
    """Nearest documents of a path's source first; those that don't fit are skipped."""
    rows = _docs(spark, d).filter("source IS NOT NULL").withColumn("tokens", R.token_estimate(F.coalesce("text", F.lit(""))))
    return C.packed_budget(rows, "source", "doc_id", ["tokens", "doc_id"], "tokens", 4000)


def budget_stop(spark, d):
    rows = _docs(spark, d).filter("source IS NOT NULL").withColumn("tokens", R.token_estimate(F.coalesce("text", F.lit(""))))
    return C.packed_budget(rows, "source", "doc_id", ["doc_id"], "tokens", 4000, stop=True)


def budget_prefix(spark, d):
    rows = _docs(spark, d).filter("source IS NOT NULL").withColumn("chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    return C.prefix_budget(rows, "source", ["doc_id"], "chars", 20_000).select("source", "doc_id", "running")


def sliding_dedup(spark, d):
    return C.sliding_dedup(table(spark, d, "embeddings"), "label", "vec_id", "embedding", likeness=0.2)


def conv_tokens(spark, d):
    """Four tokens a message and its estimate, per thread of chat documents by source."""
    rows = _docs(spark, d).filter("doc_type = 'chat'").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 4) + 1).alias("t"))
    return rows.select("source", (4 * F.col("n") + F.col("t")).cast("bigint").alias("tokens"))


QUERIES = {f.__name__: f for f in (chunk_paragraphs, chunk_windows, chunk_code, chunk_json, chunk_spans, sentence_counts, hash_embeddings, mmr_extract, mmr_near, kv_compact, budget_skip, budget_stop, budget_prefix, sliding_dedup, conv_tokens)}

_TOK = "(SELECT source, doc_id, strlen(coalesce(text, '')) // 4 + 1 AS tokens FROM documents WHERE source IS NOT NULL)"
SQL = {
    "hash_embeddings": f"WITH {_HASHED.split('unit AS')[0].rstrip().rstrip(',')}, e AS (SELECT doc_id, string_agg(bucket || ':' || round(x::DOUBLE * 1000000)::BIGINT, ' ' ORDER BY bucket) AS embedding FROM part WHERE round(x::DOUBLE * 1000000) > 0 GROUP BY doc_id) SELECT doc_id, coalesce(embedding, '') AS embedding FROM documents LEFT JOIN e USING (doc_id)",
    "sentence_counts": r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> ''))::BIGINT AS n_sentences FROM documents",
    "budget_stop": f"SELECT source, doc_id, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 4000 AS taken FROM {_TOK}",
    "budget_prefix": "SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents WHERE source IS NOT NULL) WHERE running <= 20000",
    "conv_tokens": "SELECT source, (4 * count(*) + sum(strlen(coalesce(text, '')) // 4 + 1))::BIGINT AS tokens FROM documents WHERE doc_type = 'chat' GROUP BY source",
}
