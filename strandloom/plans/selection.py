"""Queries of the smaller selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import selection as S
from strandloom.session import table

NAMED = {"pages": (r"page (\d+)", 6), "sections": (r"section (\d+)", 8), "codes": (r"(0x[0-9A-F]{5})", 12)}


def _docs(spark, d):
    return table(spark, d, "documents")


def _events(spark, d):
    return table(spark, d, "events")


def entities(spark, d):
    return _docs(spark, d).select("doc_id", *(F.array_join(c, ",").alias(n) for n, c in S.entities(F.col("text"), NAMED).items()))


def token_prefix(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(S.within_tokens(F.coalesce("text", F.lit("")), 50), 256).alias("digest"))


def table_quality(spark, d):
    c = (F.col("event_id") % 100) / 100.0
    return _events(spark, d).select("event_id", F.round(S.table_quality(c, F.col("event_id") % 2 == 0, (F.col("event_id") % 7) / 7.0, F.col("event_id") % 5 == 0, F.col("event_id") % 3 > 0, F.col("event_id") % 11 == 0), 6).alias("quality"))


def trivial_filter(spark, d):
    return _docs(spark, d).filter(S.trivial(F.col("text"), "ok|thanks|todo|n/a|tbd|lorem ipsum")).select("doc_id")


def tag_overlap(spark, d):
    tags = F.array("lang", "doc_type")
    return _docs(spark, d).filter(F.arrays_overlap(tags, F.array(F.lit("de"), F.lit("runbook")))).select("doc_id", "lang", "doc_type")


def read_until(spark, d):
    return S.read_until(_events(spark, d), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


def schema_range(spark, d):
    """Events a handler of versions 3 to 6 takes."""
    return table(spark, d, "workflow_events").filter(F.col("schema_version").between(3, 6)).groupBy("feed", "event_type").agg(F.count("*").alias("n"))


def file_resolution(spark, d):
    p = table(spark, d, "part")
    defs = p.select(F.col("p_partkey").cast("bigint").alias("def_id"), F.col("p_brand").alias("name"), F.floor(F.col("p_partkey") / 100).alias("def_file"))
    uses = p.select(F.col("p_partkey").cast("bigint").alias("use_id"), F.col("p_brand").alias("name"), F.floor(F.col("p_partkey") / 100).alias("use_file"))
    return S.preferred_definition(uses, defs, "name")


def fan_in(spark, d):
    return S.fan_in(_events(spark, d), "user_id", F.col("event_type") != "view", F.col("event_type").isin("click", "purchase"), 20)


def audit_trail(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min_by("ts", "event_id").alias("first_ts"), F.max_by("ts", "event_id").alias("last_ts"))


def version_dedup(spark, d):
    w = table(spark, d, "workflow_events").select("workflow_id", "event_type", "version", "ingest_id", F.lit(1).cast("bigint").alias("copies"))
    return S.latest_versions(w, ["workflow_id", "event_type"], "version", "ingest_id", "copies")


def tamper_positions(spark, d):
    a = _events(spark, d).select("event_id", F.sha2("event_type", 256).alias("digest"))
    b = _events(spark, d).filter("event_id % 97 <> 0").select("event_id", F.sha2(F.when(F.col("event_id") % 89 == 0, "x").otherwise(F.col("event_type")), 256).alias("digest"))
    return S.positional_differences(a, b, "event_id", "digest")


def prune_episodes(spark, d):
    e = _events(spark, d).withColumn("importance", (F.col("event_id") % 10) / 10.0)
    return S.kept_episodes(e, "user_id", "event_id", "importance", 10, 0.7, 25).select("user_id", "event_id")


def explanation_limit(spark, d):
    rows = S.within_bytes(_docs(spark, d).filter("source IS NOT NULL AND text IS NOT NULL"), "source", [F.asc("doc_id")], F.col("text"), 100, 10_240)
    return rows.select("source", "doc_id", "bytes")


def bloom_semi(spark, d):
    """Line items of large orders: a Bloom filter first, then the exact semi join."""
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return S.bloom_filtered(li, big, "l_orderkey").join(big, "l_orderkey", "left_semi")


def fuzzy_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.round(S.fuzzy_score("prt1", F.col("p_name")), 1).alias("score"))
    return p.filter("score > 0")


def snippet_pack(spark, d):
    rows = S.packed_snippets(_docs(spark, d).filter("source IS NOT NULL"), "source", "doc_id", ["doc_id"], "text", 2000)
    return rows.select("source", "doc_id", F.sha2("snippet", 256).alias("digest"))


def trust_scores(spark, d):
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date"))
    return S.trust_scores(_events(spark, d), "user_id", F.col("event_type") != "error", F.col("event_id") % 5003 == 0, F.col("event_id") % 9001 == 0, age)


def snapshot_gc(spark, d):
    f = table(spark, d, "file_index_state").groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("indexed_at").alias("accessed"))
    f = f.withColumn("accessed", F.coalesce("accessed", "mtime"))
    return S.collectable(f, "path", F.col("path").startswith("lib/"), F.lit(1.79e9) - F.col("mtime"), "accessed", 1.5e7, 300)


def stale_keys(spark, d):
    e = _events(spark, d)
    cache = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("generation"))
    return S.stale_keys(cache, e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("generation")), "user_id", "generation")


def restore_range(spark, d):
    """Archived events of a range of versions."""
    return table(spark, d, "workflow_events").filter("version BETWEEN 5 AND 9").groupBy("workflow_id").agg(F.countDistinct("version").alias("n"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


def replay_hash(spark, d):
    """Chained digest of each user's events by place, type and source: a digest of the ordered row digests."""
    from strandloom.operators.logs import row_checksum, with_offsets

    e = with_offsets(_events(spark, d), ["user_id"], ["event_id"])
    each = e.select("user_id", "offset", row_checksum(F.col("offset"), F.col("event_type"), F.col("event_id")).alias("c"), F.floor(F.col("offset") / 1000).alias("block"))
    digest = lambda by, o: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, "c"))), lambda x: x["c"]), ""), 256)
    blocks = each.groupBy("user_id", "block").agg(digest("block", "offset").alias("c"))  # at most 1,000 rows each
    return blocks.groupBy("user_id").agg(digest("user_id", "block").alias("replay"))


def cache_hit_rate(spark, d):
    hit = F.col("event_type").isin("view", "click")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"))


def idempotency_keys(spark, d):
    w = table(spark, d, "workflow_events")
    key = F.concat_ws(":", "workflow_id", "version", "event_type")
    return w.groupBy(key.alias("key")).agg(F.count("*").alias("deliveries"), F.min("ingest_id").alias("first_ingest")).filter("deliveries > 1")


QUERIES = {f.__name__: f for f in (entities, token_prefix, table_quality, trivial_filter, tag_overlap, read_until, schema_range, file_resolution, fan_in, audit_trail, version_dedup, tamper_positions, prune_episodes, explanation_limit, bloom_semi, fuzzy_match, snippet_pack, trust_scores, snapshot_gc, stale_keys, restore_range, replay_hash, cache_hit_rate, idempotency_keys)}
SQL = {
    "entities": "SELECT doc_id, " + ", ".join(f"array_to_string(list_filter(x{k}, lambda v, i: list_position(x{k}, v) = i)[:{most}], ',') AS {n}" for k, (n, (_, most)) in enumerate(NAMED.items())) + " FROM (SELECT doc_id, " + ", ".join(f"regexp_extract_all(coalesce(text, ''), '{p}', 1) AS x{k}" for k, (p, _) in enumerate(NAMED.values())) + " FROM documents)",
    "replay_hash": """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events),
c AS (SELECT user_id, o, o // 1000 AS block, sha256(o || '|' || event_type || '|' || event_id) AS c FROM e), b AS (SELECT user_id, block, sha256(string_agg(c, '' ORDER BY o)) AS c FROM c GROUP BY 1, 2)
SELECT user_id, sha256(string_agg(c, '' ORDER BY block)) AS replay FROM b GROUP BY 1""",
    "token_prefix": "SELECT doc_id, sha256(left(coalesce(text, ''), 199)) AS digest FROM documents",
    "table_quality": "SELECT event_id, round(least((event_id % 100) / 100.0::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7 END * CASE WHEN (event_id % 7) / 7.0::DOUBLE < 0.5 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN event_id % 5 = 0 THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN event_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.85 END * CASE WHEN event_id % 11 = 0 THEN 0.7::DOUBLE ELSE 1 END, 0.98), 6) AS quality FROM events",
    "trivial_filter": "SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) < 10 OR regexp_full_match(lower(trim(text)), 'ok|thanks|todo|n/a|tbd|lorem ipsum')",
    "tag_overlap": "SELECT doc_id, lang, doc_type FROM documents WHERE lang = 'de' OR doc_type = 'runbook'",
    "read_until": "SELECT user_id, event_id FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) WHERE seen = 0",
    "schema_range": "SELECT feed, event_type, count(*) AS n FROM workflow_events WHERE schema_version BETWEEN 3 AND 6 GROUP BY 1, 2",
    "file_resolution": "SELECT use_id, def_id, def_file <> use_file AS cross_file FROM (SELECT u.p_partkey AS use_id, u.p_partkey // 100 AS use_file, d.p_partkey AS def_id, d.p_partkey // 100 AS def_file, row_number() OVER (PARTITION BY u.p_partkey ORDER BY CASE WHEN d.p_partkey // 100 <> u.p_partkey // 100 THEN 0 ELSE 1 END, d.p_partkey) AS n FROM part u JOIN part d ON u.p_brand = d.p_brand) WHERE n = 1",
    "fan_in": "SELECT user_id, ok = n AS all_ok, ok > 0 AS any_ok, ok >= 20 AS quorum_ok, done = n AS all_done FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'view') AS done, count(*) FILTER (event_type IN ('click', 'purchase')) AS ok FROM events GROUP BY 1)",
    "audit_trail": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, arg_min(ts, event_id) AS first_ts, arg_max(ts, event_id) AS last_ts FROM events GROUP BY 1",
    "version_dedup": "SELECT workflow_id, event_type, version, ingest_id, copies FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, event_type ORDER BY version DESC, ingest_id DESC) AS n, count(*) OVER (PARTITION BY workflow_id, event_type) AS copies FROM workflow_events) WHERE n = 1",
    "tamper_positions": "SELECT event_id FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0",
    "prune_episodes": "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS m FROM a WHERE n <= 10 OR event_id % 10 > 7) SELECT user_id, event_id FROM b WHERE m <= 25",
    "explanation_limit": "SELECT source, doc_id, bytes FROM (SELECT source, doc_id, row_number() OVER w AS n, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM documents WHERE source IS NOT NULL AND text IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE n <= 100 AND bytes <= 10240",
    "bloom_semi": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)",
    "fuzzy_match": "SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN lower(p_name) = 'prt1' THEN 1.0::DOUBLE WHEN contains(lower(p_name), 'prt1') THEN 0.8::DOUBLE WHEN regexp_matches(lower(p_name), 'p.*r.*t.*1') THEN 0.6::DOUBLE ELSE 0 END AS score FROM part) WHERE score > 0",
    "trust_scores": "SELECT user_id, round(CASE WHEN bool_or(event_id % 9001 = 0) THEN 0 ELSE greatest(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) * greatest(0.5, 1 - min(date_diff('day', ts::DATE, DATE '2024-02-01')) * 0.02::DOUBLE) - 0.3::DOUBLE * count(*) FILTER (event_id % 5003 = 0), 0.0) END, 6) AS score FROM events GROUP BY user_id",
    "snapshot_gc": "WITH f AS (SELECT path, max(mtime) AS mtime, coalesce(max(indexed_at), max(mtime)) AS accessed FROM file_index_state GROUP BY path), g AS (SELECT *, row_number() OVER (ORDER BY accessed DESC, path) AS n FROM f) SELECT path FROM g WHERE NOT starts_with(path, 'lib/') AND (1.79e9 - mtime > 1.5e7 OR n > 300)",
    "stale_keys": "SELECT user_id, generation FROM (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS generation, max(event_id) FILTER (event_type = 'purchase') AS g FROM events GROUP BY 1) WHERE g > generation",
    "restore_range": "SELECT workflow_id, count(DISTINCT version) AS n, min(version) AS first_version, max(version) AS last_version FROM workflow_events WHERE version BETWEEN 5 AND 9 GROUP BY 1",
    "cache_hit_rate": "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM events GROUP BY 1",
    "idempotency_keys": "SELECT concat_ws(':', workflow_id, version, event_type) AS key, count(*) AS deliveries, min(ingest_id) AS first_ingest FROM workflow_events GROUP BY 1 HAVING count(*) > 1",
}
