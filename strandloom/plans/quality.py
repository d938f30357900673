"""Queries of governance, compression, evaluation and metrics operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandloom.operators import evaluation as E, governance as G, retrieval as R
from strandloom.session import table

NOW = "2026-09-01 00:00:00"
TTL = [("click", 3600.0, True), ("view", 2592000.0, True), ("error", 604800.0, False), ("signup", 7776000.0, True)]
BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0]


def _docs(spark, d):
    return table(spark, d, "documents")


def _events(spark, d):
    return table(spark, d, "events")


def _age(column="created_at"):
    return F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col(column).cast("timestamp"))


def pii_counts(spark, d):
    return _docs(spark, d).select("doc_id", *(c.alias(n) for n, c in G.pii_counts(F.col("text")).items()))


def pii_redact(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(G.redact(F.coalesce("text", F.lit(""))), 256).alias("digest"))


def retention_check(spark, d):
    policy = spark.createDataFrame(TTL, "kind string, ttl double, auto_cleanup boolean")
    age = F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return G.retention(_events(spark, d), "event_type", age, policy).select("event_id", "ttl", "expired", "remaining", "deletable")


def retention_stats(spark, d):
    return retention_check(spark, d).join(_events(spark, d).select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("expired").alias("expired"), F.count_if("deletable").alias("deletable"))


def decay_curves(spark, d):
    days = F.floor(_age() / 86400).cast("double")
    start = (F.col("doc_id") % 100) / 100.0
    return _docs(spark, d).filter("created_at IS NOT NULL").select("doc_id", *(F.round(G.decayed(start, days, how, rate), 6).alias(how) for how, rate in (("linear", 0.005), ("exponential", 0.01), ("step", 0.05), ("none", 0.0))))


def decay_below(spark, d):
    return decay_curves(spark, d).filter("exponential < 0.2").agg(F.count("*").alias("n"), F.round(F.avg("exponential"), 6).alias("mean"))


def provenance_filter(spark, d):
    level = F.element_at(F.array(*map(F.lit, G.LEVELS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _docs(spark, d).select("doc_id", level.alias("level"))
    return rows.filter(G.level_rank(F.col("level")) >= 2)


def filter_for_use(spark, d):
    """Provenance, decayed confidence and expiry, one after the other."""
    return provenance_filter(spark, d).join(decay_curves(spark, d).filter("linear >= 0.05"), "doc_id", "left_semi").join(_docs(spark, d).filter(_age() < 200 * 86400).select("doc_id"), "doc_id", "left_semi")


def _memory(spark, d):
    return _docs(spark, d).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), (F.col("doc_id") % 3 == 0).alias("compressed"), (F.col("doc_id") % 11 == 0).alias("no_compress"), (F.col("doc_id") % 13 == 0).alias("deleted"), (F.col("doc_id") % 6).alias("access_count"), F.when(F.col("doc_id") % 17 > 0, _age()).alias("idle"))


def compression_status(spark, d):
    m = _memory(spark, d)
    cols = lambda name: [F.lit(name).alias("source"), F.count("*").alias("total"), F.sum(F.when(F.col("compressed"), 1).otherwise(0)).alias("compressed"), F.round(F.avg(F.when(F.col("compressed"), F.col("size"))), 6).alias("avg_size"), F.round(F.sum(F.when(F.col("compressed"), F.col("size"))) / F.nullif(F.sum("size"), F.lit(0)), 6).alias("ratio")]
    return m.agg(*cols("memory")).unionByName(m.filter("doc_id % 2 = 0").agg(*cols("tool_cache")))


def compression_candidates(spark, d):
    m = _memory(spark, d).filter("NOT compressed AND NOT no_compress AND NOT deleted AND idle > 604800")
    return m.select("doc_id", F.round(G.compression_priority(F.col("size"), F.col("idle"), F.col("size") * 0.6), 6).alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(100)


def soft_delete_candidates(spark, d):
    return _memory(spark, d).filter("compressed AND idle > 2592000 AND access_count < 3").select("doc_id")


def prune_candidates(spark, d):
    return _memory(spark, d).filter("NOT no_compress AND NOT deleted AND idle >= 2592000 AND access_count < 2").select("doc_id")


def compression_accept(spark, d):
    squeezed = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r" +", " "))
    return _docs(spark, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("before"), squeezed.cast("bigint").alias("after")).withColumn("accepted", G.accept_compression(F.col("before"), F.col("after")))


def old_blobs(spark, d):
    return G.latest_per_item(_events(spark, d).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id")


def blob_refcount(spark, d):
    return G.reference_counts(_events(spark, d), "user_id", F.sha2(F.col("event_type"), 256))


def integrity_sample(spark, d):
    """A deterministic sample of one per cent, at least 10 and at most 100 rows, by a hash of the id."""
    docs = _docs(spark, d).select("doc_id", F.sha2(F.concat(F.lit("s:"), F.col("doc_id").cast("string")), 256).alias("place"))
    n = docs.agg(G.sample_size(F.count("*")).alias("n"))
    return R.top_per(docs.orderBy("place").limit(100).withColumn("all", F.lit(1)), ["all"], [F.asc("place")], 100).crossJoin(F.broadcast(n)).filter("rank <= n").select("doc_id")


def _ranked(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.knn(e, q, "vec_id", "embedding", 10)


def _judged(spark, d):
    """Vectors of the query's label are relevant to it."""
    return E.label_judged(_ranked(spark, d), table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


def eval_ranking(spark, d):
    return E.judged_quality(*_judged(spark, d))


def eval_summary(spark, d):
    e = eval_ranking(spark, d)
    return e.groupBy((F.col("query_id") % 3).alias("category")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("hit_10", "precision_5", "recall_10", "mrr")))


def eval_golden(spark, d):
    return E.judged_golden(*_judged(spark, d))


def eval_drift(spark, d):
    runs = _events(spark, d).groupBy("event_type", F.date_trunc("day", "ts").alias("run")).agg(F.round(F.avg("value"), 6).alias("value"))
    return E.drift(runs, "event_type", "run", "value").select("event_type", "run", "value", "previous")


def ab_assign(spark, d):
    share = E.bucket_share(F.col("user_id"), "exp1")
    return _events(spark, d).select("user_id").distinct().select("user_id", share.alias("share"), F.when(share < 0.5, "control").otherwise("treatment").alias("variant"))


def _observed(spark, d):
    return _events(spark, d).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment"))


def ab_summary(spark, d):
    return E.variant_summary(_observed(spark, d), ["event_type", "variant"], "value")


def ab_welch(spark, d):
    return E.welch(_observed(spark, d), "event_type", "variant", "value", "control", "treatment")


def metric_summary(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum("value"), 4).alias("total"))


def hist_plain(spark, d):
    return E.histogram(_events(spark, d), ["event_type"], "value", BOUNDS)


def hist_cumulative(spark, d):
    return E.histogram(_events(spark, d), ["event_type"], "value", BOUNDS, cumulative=True)


def card_guard(spark, d):
    return E.label_overflow(_events(spark, d), "event_type", "user_id", "event_id", 50)


def gauge(spark, d):
    op = F.when(F.col("event_id") % 10 == 0, "set").when(F.col("event_id") % 3 == 0, "dec").otherwise("inc")
    return E.gauge_value(_events(spark, d).withColumn("op", op), "user_id", "event_id", "op", "value")


def intent_drift(spark, d):
    share = lambda df: df.groupBy("event_type").agg((F.count("*") / F.first("n")).alias("w"))
    e = _events(spark, d).withColumn("half", F.col("ts") < F.lit(dt.datetime(2024, 1, 16)))
    n = e.groupBy("half").agg(F.count("*").alias("n"))
    e = e.join(F.broadcast(n), "half")
    return E.divergence(share(e.filter("NOT half")), share(e.filter("half")), "event_type", "w")


def hash_ring(spark, d):
    return E.ring_owner(table(spark, d, "customer").select("c_custkey"), "c_custkey", ["alpha", "beta", "gamma", "delta"])


def exposition(spark, d):
    n = _events(spark, d).groupBy("event_type", (F.col("user_id") % 5).alias("shard")).agg(F.count("*").alias("n"))
    return E.exposition(n, "events_total", ["shard", "event_type"], F.col("n"))


QUERIES = {f.__name__: f for f in (pii_counts, pii_redact, retention_check, retention_stats, decay_curves, decay_below, provenance_filter, filter_for_use, compression_status, compression_candidates, soft_delete_candidates, prune_candidates, compression_accept, old_blobs, blob_refcount, integrity_sample, eval_ranking, eval_summary, eval_golden, eval_drift, ab_assign, ab_summary, ab_welch, metric_summary, hist_plain, hist_cumulative, card_guard, gauge, intent_drift, hash_ring, exposition)}

_P = {k: v.replace("'", "''") for k, v in G.PII.items()}
_RED = "coalesce(text, '')"
for _n, _p in _P.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[{_n.upper()}]', 'g')"
_AGE = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch(created_at)))::BIGINT"
_TTL = "ttl AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {t}::DOUBLE, {str(a).lower()})" for k, t, a in TTL) + ") t(event_type, ttl, auto_cleanup))"
_RET = f"""{_TTL}, ret AS (SELECT event_id, event_type, coalesce(ttl, 86400.0) AS ttl, age >= coalesce(ttl, 86400.0) AS expired, greatest(0.0::DOUBLE, coalesce(ttl, 86400.0) - age) AS remaining, age >= coalesce(ttl, 86400.0) AND coalesce(auto_cleanup, false) AS deletable
FROM (SELECT *, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)))::BIGINT AS age FROM events) LEFT JOIN ttl USING (event_type))"""
_DEC = f"""dec AS (SELECT doc_id, round(least(greatest(s - 0.005::DOUBLE * days, 0), 1), 6) AS linear, round(least(greatest(s * power(0.99::DOUBLE, days), 0), 1), 6) AS exponential, round(least(greatest(s - 0.05::DOUBLE * floor(days / 7), 0), 1), 6) AS step, round(least(greatest(s, 0), 1), 6) AS "none"
FROM (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS s, floor({_AGE} / 86400)::DOUBLE AS days FROM documents WHERE created_at IS NOT NULL))"""
_LEV = "['none', 'low', 'medium', 'high', 'verified'][(doc_id % 5 + 1)::INT]"
_MEM = f"mem AS (SELECT doc_id, strlen(coalesce(text, '')) AS size, doc_id % 3 = 0 AS compressed, doc_id % 11 = 0 AS no_compress, doc_id % 13 = 0 AS deleted, doc_id % 6 AS access_count, CASE WHEN doc_id % 17 > 0 THEN {_AGE} END AS idle FROM documents)"
_STAT = "SELECT '{}' AS source, count(*) AS total, sum(CASE WHEN compressed THEN 1 ELSE 0 END)::BIGINT AS compressed, round(avg(CASE WHEN compressed THEN size END), 6) AS avg_size, round(sum(CASE WHEN compressed THEN size END)::DOUBLE / nullif(sum(size), 0)::DOUBLE, 6) AS ratio FROM mem {}"
_KNN = """knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS rel,
round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id))"""
_CUTS = (1, 3, 5, 10)
_EVAL = f"""{_KNN}, h AS (SELECT query_id, count(*) FILTER (rel) AS n_relevant, {", ".join(f"count(*) FILTER (rel AND rank <= {c}) AS h{c}" for c in _CUTS)}, min(rank) FILTER (rel AND rank <= 10) AS f, sum(CASE WHEN rel AND rank <= 10 THEN 1 / sqrt(rank) ELSE 0 END) AS dcg FROM knn GROUP BY query_id),
ev AS (SELECT query_id, n_relevant, {", ".join(f"round(h{c} / {c}, 6) AS precision_{c}, round(h{c} / n_relevant, 6) AS recall_{c}, (h{c} > 0)::INT AS hit_{c}, round(CASE WHEN h{c} > 0 THEN 2 * (h{c} / {c}) * (h{c} / n_relevant) / (h{c} / {c} + h{c} / n_relevant) ELSE 0 END, 6) AS f1_{c}" for c in _CUTS)},
round(coalesce(1 / f, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / sqrt(i))), 6) AS ndcg FROM h WHERE n_relevant > 0)"""
_HIST = lambda cum: "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}" + ("" if cum or i == 0 else f" AND value > {BOUNDS[i - 1]}") + f") AS le_{i}" for i, b in enumerate(BOUNDS)) + (", count(value) AS le_inf" if cum else f", count(*) FILTER (value > {BOUNDS[-1]}) AS le_inf") + ", round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY event_type"
SQL = {
    "pii_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {n}" for n, p in _P.items()) + " FROM documents",
    "pii_redact": f"SELECT doc_id, sha256({_RED}) AS digest FROM documents",
    "retention_check": f"WITH {_RET} SELECT event_id, ttl, expired, remaining, deletable FROM ret",
    "retention_stats": f"WITH {_RET} SELECT event_type, count(*) AS n, count(*) FILTER (expired) AS expired, count(*) FILTER (deletable) AS deletable FROM ret GROUP BY event_type",
    "decay_curves": f"WITH {_DEC} SELECT * FROM dec",
    "decay_below": f"WITH {_DEC} SELECT count(*) AS n, round(avg(exponential), 6) AS mean FROM dec WHERE exponential < 0.2",
    "provenance_filter": f"SELECT doc_id, {_LEV} AS level FROM documents WHERE doc_id % 5 >= 2",
    "filter_for_use": f"WITH {_DEC} SELECT doc_id, {_LEV} AS level FROM documents WHERE doc_id % 5 >= 2 AND doc_id IN (SELECT doc_id FROM dec WHERE linear >= 0.05) AND {_AGE} < 200 * 86400",
    "compression_status": f"WITH {_MEM} {_STAT.format('memory', '')} UNION ALL {_STAT.format('tool_cache', 'WHERE doc_id % 2 = 0')}",
    "compression_candidates": f"WITH {_MEM} SELECT doc_id, round(0.4 * least(size * 0.6 / 30720.0, 1.0::DOUBLE) + 0.3 * least(idle / 7776000.0, 1.0::DOUBLE) + 0.3 * least(size / 1048576.0, 1.0::DOUBLE), 6)::DOUBLE AS priority FROM mem WHERE NOT compressed AND NOT no_compress AND NOT deleted AND idle > 604800 ORDER BY 2 DESC, 1 LIMIT 100",
    "soft_delete_candidates": f"WITH {_MEM} SELECT doc_id FROM mem WHERE compressed AND idle > 2592000 AND access_count < 3",
    "prune_candidates": f"WITH {_MEM} SELECT doc_id FROM mem WHERE NOT no_compress AND NOT deleted AND idle >= 2592000 AND access_count < 2",
    "compression_accept": "SELECT doc_id, before, after, before - after >= 100 OR (before > 0 AND after / before < 0.95) AS accepted FROM (SELECT doc_id, length(coalesce(text, '')) AS before, length(regexp_replace(coalesce(text, ''), ' +', ' ', 'g')) AS after FROM documents)",
    "old_blobs": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 1",
    "blob_refcount": "SELECT user_id, sha256(event_type) AS digest, count(*) AS refs FROM events GROUP BY 1, 2",
    "integrity_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('s:' || doc_id)) AS r, count(*) OVER () AS n FROM documents) WHERE r <= least(greatest(10, floor(n * 0.01)), 100)",
    "hash_ring": """WITH nodes AS (SELECT unnest(['alpha', 'beta', 'gamma', 'delta']) AS node), ring AS (SELECT ('0x' || left(sha256(node || ':' || i), 15))::BIGINT AS h, node FROM nodes, range(100) t(i)),
k AS (SELECT c_custkey, ('0x' || left(sha256(c_custkey::VARCHAR), 15))::BIGINT AS h FROM customer)
SELECT c_custkey, coalesce(ring.node, (SELECT arg_min(node, h) FROM ring)) AS node FROM k ASOF LEFT JOIN ring ON ring.h >= k.h""",
    "eval_ranking": f"WITH {_EVAL} SELECT * FROM ev",
    "eval_summary": f"WITH {_EVAL} SELECT query_id % 3 AS category, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("hit_10", "precision_5", "recall_10", "mrr")) + " FROM ev GROUP BY 1",
    "eval_golden": f"WITH {_EVAL} SELECT query_id, " + ", ".join(f"(h10 >= least({k}, n_relevant))::INT AS golden_hit_{k}" for k in (1, 5, 10)) + " FROM h WHERE n_relevant > 0",
    "eval_drift": "SELECT event_type, run, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY run) AS previous FROM (SELECT event_type, date_trunc('day', ts) AS run, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)) WHERE previous > 0 AND previous - value > 0.1 * previous",
    "ab_assign": "SELECT user_id, share, CASE WHEN share < 0.5 THEN 'control' ELSE 'treatment' END AS variant FROM (SELECT DISTINCT user_id, (((('0x' || left(md5('exp1:' || user_id), 16))::UBIGINT % 10000)::BIGINT * 1616 + (('0x' || right(md5('exp1:' || user_id), 16))::UBIGINT % 10000)::BIGINT) % 10000) / 10000 AS share FROM events)",
    "ab_summary": "SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS lower, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS upper FROM events GROUP BY 1, 2",
    "ab_welch": "SELECT event_type, round(t, 6) AS t, abs(t) > 1.96 AS significant FROM (SELECT event_type, (avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0)) / sqrt(var_samp(value) FILTER (user_id % 2 = 0) / count(value) FILTER (user_id % 2 = 0) + var_samp(value) FILTER (user_id % 2 = 1) / count(value) FILTER (user_id % 2 = 1)) AS t FROM events GROUP BY 1)",
    "metric_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "hist_plain": _HIST(False),
    "hist_cumulative": _HIST(True),
    "card_guard": "SELECT event_type, user_id, first_seen, row_number() OVER (PARTITION BY event_type ORDER BY first_seen, user_id) <= 50 AS kept FROM (SELECT event_type, user_id, min(event_id) AS first_seen FROM events GROUP BY 1, 2)",
    "gauge": "WITH s AS (SELECT user_id, max(event_id) AS o, arg_max(value, event_id) AS v FROM events WHERE event_id % 10 = 0 GROUP BY 1) SELECT user_id, round(coalesce(any_value(v), 0) + sum(CASE WHEN event_id % 10 = 0 OR event_id <= coalesce(o, -1) THEN 0 WHEN event_id % 3 = 0 THEN -value ELSE value END), 4) AS value FROM events LEFT JOIN s USING (user_id) GROUP BY user_id",
    "intent_drift": """WITH h AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') / sum(count(*) FILTER (ts < TIMESTAMP '2024-01-16')) OVER () AS q, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') / sum(count(*) FILTER (ts >= TIMESTAMP '2024-01-16')) OVER () AS p FROM events GROUP BY 1)
SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sum(p * p / q), 6) AS ratio_sum FROM h""",
    "exposition": "SELECT 'events_total{event_type=\"' || event_type || '\",shard=\"' || (user_id % 5) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 5",
}
