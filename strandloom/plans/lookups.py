"""Queries of lookups and housekeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.keys import normal_path
from strandloom.operators import logs, lookups as K
from strandloom.plans.graphs import _NORM
from strandloom.session import table


def alias_resolve(spark, d):
    """Every line uses the brand of its part in its supplier's file: files' aliases, definitions and project entries come from parts."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    uses = li.join(p, li["l_partkey"] == p["p_partkey"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), (F.col("l_suppkey") % 40).alias("file"), F.col("p_brand").alias("name"))
    aliases = p.filter("p_size % 5 = 0").select((F.col("p_partkey") % 40).alias("file"), F.col("p_brand").alias("name"), F.col("p_name").alias("target"), F.col("p_partkey").alias("place"))
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    definitions = p.select(F.when(brand % 3 == 0, F.col("p_brand")).when(brand % 3 == 1, F.concat("p_type", F.lit("."), "p_brand")).alias("qualified"), F.col("p_partkey").alias("place")).filter("qualified IS NOT NULL")
    project = p.filter(brand % 2 == 0).select(F.col("p_brand").alias("name"), F.col("p_type").alias("target"), F.col("p_partkey").alias("place"))
    return K.alias_resolved(uses, aliases, definitions, project)


def imported_files(spark, d):
    """Imports and the indexed file they name."""
    i = table(spark, d, "file_dependencies").filter("dep_type = 'import' AND trim(target_path) <> ''").select("dep_id", "source_path", normal_path(F.col("target_path")).alias("path"))
    f = table(spark, d, "file_index_state").groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    return i.join(f, "path").select("dep_id", "source_path", "path", "indexed_at").distinct()


def file_symbols(spark, d):
    """Symbols (parts) of each file (a hundred numbers) in order of position."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("file"), "p_partkey", "p_name")
    return p.withColumn("position", F.row_number().over(logs.W.partitionBy("file").orderBy("p_partkey")).cast("bigint"))


def matched_entries(spark, d):
    """Parts hit by type or brand of an order's lines, with what they were matched on; numbers beyond the table are skipped."""
    li = table(spark, d, "lineitem")
    hits = li.select((F.col("l_partkey") + F.when(F.col("l_quantity") > 45, 1_000_000).otherwise(0)).alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("on"))
    rows = K.entries_of(hits, table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "on")
    return rows.select("p_partkey", "p_name", F.array_join("matched_on", ",").alias("matched_on"))


def journal_compaction(spark, d):
    e = table(spark, d, "events")
    return K.partition_actions(e, logs.partition_name(F.col("ts"), "day"), "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


def merkle_proofs(spark, d):
    """Leaves of each user's tree and how many of their proofs hold."""
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.col("event_type"), 256).alias("digest"))
    e = logs.with_offsets(e, ["user_id"], ["event_id"], "place")
    proofs = K.merkle_proofs(K.merkle_levels(e, ["user_id"], "place", "digest"), ["user_id"])
    return proofs.groupBy("user_id").agg(F.count("*").alias("n_leaves"), F.count_if("valid").alias("n_valid"), F.max(F.size(F.coalesce("proof", F.array()))).cast("bigint").alias("longest"))


def check_and_add(spark, d):
    """Vectors added per label; a third of the id stands for the content, so that copies occur."""
    e = table(spark, d, "embeddings").withColumn("content", F.floor(F.col("vec_id") / 3))
    return K.checked_and_added(e, "label", "vec_id", F.col("content"), "embedding", likeness=0.2)


def hot_callers(spark, d):
    e = table(spark, d, "file_dependencies").filter("dep_type <> 'system' AND trim(target_path) <> ''")
    return K.first_callers(e.select(F.col("source_path").alias("src"), normal_path(F.col("target_path")).alias("dst"), "dep_id"), "dep_id")


def card_sample(spark, d):
    """Labels beyond the first 50 of a metric are counted under four overflow labels."""
    e = K.sampled_labels(table(spark, d, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id", 50)
    return e.groupBy("event_type", "kept").agg(F.count("*").alias("n"))


def decay_boost(spark, d):
    c = table(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 100) / 100.0).alias("confidence"))
    return c.select("doc_id", F.round(K.boosted(F.col("confidence"), 0.1, 0.95), 6).alias("confidence"))


def plan_quality(spark, d):
    """Plans (parts) of good quality, seldom failed and verified, best first: the first hundred."""
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 10) / 10.0).alias("quality"), ((F.col("p_partkey") % 7) / 10.0).alias("failure"), (F.col("p_partkey") % 3 > 0).alias("verified"))
    return p.filter("quality >= 0.8 AND failure <= 0.2 AND verified").orderBy(F.desc("quality"), "failure", "p_partkey").limit(100).select("p_partkey", "quality", "failure")


def serial_match(spark, d):
    """Address and page named by a document's first match of a pattern with groups."""
    form = r"(0x[0-9A-F]{5})\D{0,40}?(\d+)"
    t = table(spark, d, "documents").filter(F.col("text").rlike(form))
    return t.select("doc_id", F.regexp_extract("text", form, 1).alias("address"), F.regexp_extract("text", form, 2).alias("number"))


QUERIES = {f.__name__: f for f in (alias_resolve, imported_files, file_symbols, matched_entries, journal_compaction, merkle_proofs, check_and_add, hot_callers, card_sample, decay_boost, plan_quality, serial_match)}

_BRAND = "split_part(p_brand, '#', 2)::INT"
SQL = {
    "alias_resolve": f"""WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, l_suppkey % 40 AS file, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT p_partkey % 40 AS file, p_brand AS name, arg_min(p_name, p_partkey) AS t FROM part WHERE p_size % 5 = 0 GROUP BY ALL), x AS (SELECT DISTINCT p_brand AS name FROM part WHERE {_BRAND} % 3 = 0),
s AS (SELECT p_brand AS name, arg_min(p_type || '.' || p_brand, p_partkey) AS t FROM part WHERE {_BRAND} % 3 = 1 GROUP BY 1), g AS (SELECT p_brand AS name, arg_min(p_type, p_partkey) AS t FROM part WHERE {_BRAND} % 2 = 0 GROUP BY 1)
SELECT use_id, coalesce(a.t, x.name, s.t, g.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'alias' WHEN x.name IS NOT NULL THEN 'exact' WHEN s.t IS NOT NULL THEN 'suffix' WHEN g.t IS NOT NULL THEN 'project' END AS how
FROM u LEFT JOIN a USING (file, name) LEFT JOIN x ON x.name = u.name LEFT JOIN s ON s.name = u.name LEFT JOIN g ON g.name = u.name""",
    "imported_files": f"SELECT DISTINCT dep_id, source_path, i.path, f.indexed_at FROM (SELECT dep_id, source_path, {_NORM} AS path FROM file_dependencies WHERE dep_type = 'import' AND trim(target_path) <> '') i JOIN (SELECT path, max(indexed_at) AS indexed_at FROM file_index_state GROUP BY path) f ON i.path = f.path",
    "file_symbols": "SELECT p_partkey // 100 AS file, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS position FROM part",
    "matched_entries": "SELECT p_partkey, p_name, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS matched_on FROM lineitem JOIN part ON p_partkey = l_partkey + CASE WHEN l_quantity > 45 THEN 1000000 ELSE 0 END GROUP BY 1, 2",
    "journal_compaction": "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS n, max(ts) AS last_ts, CASE WHEN max(ts) < TIMESTAMP '2024-01-15 12:00:00' THEN 'delete' WHEN min(ts) < TIMESTAMP '2024-01-15 12:00:00' THEN 'compact' ELSE 'keep' END AS action FROM events GROUP BY 1",
    "merkle_proofs": "SELECT user_id, count(*) AS n_leaves, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n_valid, ceil(log2(count(*)))::BIGINT AS longest FROM events GROUP BY 1",
    "hot_callers": f"WITH e AS (SELECT {_NORM} AS node, source_path AS src, min(dep_id) AS p FROM file_dependencies WHERE dep_type <> 'system' AND trim(target_path) <> '' GROUP BY 1, 2) SELECT node, count(*) AS n_in, arg_min(src, p) AS first_caller FROM e GROUP BY 1 HAVING count(*) >= 3",
    "card_sample": """WITH f AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id), user_id) AS r FROM events GROUP BY 1, 2)
SELECT event_type, CASE WHEN r <= 50 THEN user_id::VARCHAR ELSE '_overflow_' || user_id % 4 END AS kept, count(*) AS n FROM events JOIN f USING (event_type, user_id) GROUP BY 1, 2""",
    "decay_boost": "SELECT doc_id, round(least(c + (1 - c) * 0.1::DOUBLE, 0.95::DOUBLE), 6) AS confidence FROM (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS c FROM documents)",
    "plan_quality": "SELECT p_partkey, (p_size % 10) / 10.0::DOUBLE AS quality, (p_partkey % 7) / 10.0::DOUBLE AS failure FROM part WHERE p_size % 10 >= 8 AND p_partkey % 7 <= 2 AND p_partkey % 3 > 0 ORDER BY p_size % 10 DESC, p_partkey % 7, p_partkey LIMIT 100",
    "serial_match": r"SELECT doc_id, regexp_extract(text, '(0x[0-9A-F]{5})\D{0,40}?(\d+)', 1) AS address, regexp_extract(text, '(0x[0-9A-F]{5})\D{0,40}?(\d+)', 2) AS number FROM documents WHERE regexp_matches(text, '(0x[0-9A-F]{5})\D{0,40}?(\d+)')",
}
