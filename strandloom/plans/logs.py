"""Queries of the event-log operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandloom.operators import logs as L
from strandloom.session import table

NOW = dt.datetime(2024, 2, 1)


def _events(spark, d):
    return table(spark, d, "events")


def journal_scan(spark, d):
    e = L.scan(_events(spark, d), ["click", "error"], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20), F.col("value") > 10)
    return e.select("event_id", "ts", "user_id", "event_type", "value")


def journal_partitions(spark, d):
    ts = F.col("ts")
    return _events(spark, d).select("event_id", *(L.partition_name(ts, by).alias(f"by_{by}") for by in ("day", "hour", "week", "main")))


def _day_log(spark, d):
    return L.with_offsets(_events(spark, d).withColumn("day", L.partition_name(F.col("ts"), "day")), ["day"], ["event_id"])


def journal_page(spark, d):
    return L.page(_day_log(spark, d), 10, 25).select("day", "offset", "event_id")


def journal_bounds(spark, d):
    return L.partition_bounds(_day_log(spark, d), "day", "ts", "offset")


def journal_offsets(spark, d):
    return L.with_offsets(_events(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "offset")


def gap_detect(spark, d):
    return L.sequence_gaps(table(spark, d, "workflow_events").select("workflow_id", "version"), "workflow_id", "version")


def last_n(spark, d):
    return L.last_n(_events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


def archive_split(spark, d):
    """Rows beyond the last 50 of a user."""
    e = _events(spark, d)
    kept = L.last_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id")
    return e.join(kept, "event_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("archived"), F.max("ts").alias("last_ts"))


def snapshot_diff(spark, d):
    """Orders before and after a cut: one in seven is gone, one in eleven changed, later ones came."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.sha2(F.col("o_orderstatus"), 256).alias("digest"))
    new = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.sha2(F.when(F.col("o_orderkey") % 11 == 0, "changed").otherwise(F.col("o_orderstatus")), 256).alias("digest"))
    return L.snapshot_diff(old, new, "o_orderkey", "digest")


def replay_diff(spark, d):
    e = _events(spark, d)
    a = e.filter("event_id % 13 <> 0").select("event_id", L.row_checksum(F.col("event_type"), F.col("user_id")).alias("c"))
    b = e.filter("event_id % 17 <> 0").select("event_id", L.row_checksum(F.when(F.col("event_id") % 19 == 0, "x").otherwise(F.col("event_type")), F.col("user_id")).alias("c"))
    return L.replay_diff(a, b, "event_id", "c")


def order_mismatch(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "ts", "value")
    return L.order_mismatches(e, e.withColumnRenamed("value", "v2"), "event_id", "ts", "v2", "user_id")


def state_fold(spark, d):
    return L.fold_state(_events(spark, d), "user_id", "event_id", "event_type", "value")


def checksum_verify(spark, d):
    """Stored checksums of one row in 23 are wrong."""
    e = _events(spark, d).withColumn("stored", L.row_checksum(F.col("event_id"), F.when(F.col("event_id") % 23 == 0, "bad").otherwise(F.col("event_type"))))
    ok = F.col("stored") == L.row_checksum(F.col("event_id"), F.col("event_type"))
    return e.groupBy("event_type").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def chain_verify(spark, d):
    """Hash chain per user, broken at one event in 29."""
    e = _events(spark, d).withColumn("digest", L.row_checksum(F.col("event_id"), F.col("event_type")))
    prev = F.coalesce(F.lag("digest").over(L.W.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    e = e.withColumn("previous", F.when(F.col("event_id") % 29 == 0, "forged").otherwise(prev))
    return L.chain_breaks(e, "user_id", "event_id", "digest", "previous")


def trailing_failures(spark, d):
    return L.trailing_count(_events(spark, d), ["user_id"], "ts", 86400, F.col("event_type") == "error").select("event_id", "trailing")


def message_rate(spark, d):
    return L.trailing_rate(_events(spark, d), "event_type", "ts", 86400)


def rate_limit(spark, d):
    return L.rate_limited(_events(spark, d), "user_id", "ts", "event_id", 5, 3600 * 6)


def flush_groups(spark, d):
    e = L.flush_groups(_events(spark, d), "user_id", "event_id", F.col("event_type") == "purchase")
    return e.groupBy("user_id", "flush").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def count_flush(spark, d):
    """Batches of ten tokens."""
    e = L.with_offsets(_events(spark, d), ["user_id"], ["event_id"])
    return e.groupBy("user_id", F.floor(F.col("offset") / 10).alias("batch")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ").alias("text"))


def upsert_latest(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "event_id", "value", "ts")
    return L.latest(e, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


def trace_corr(spark, d):
    return L.correlated(_events(spark, d), "event_type", "ts", "event_id", 60)


def causal(spark, d):
    return L.causal_lookback(_events(spark, d), "user_id", "ts", "event_id", F.col("event_type") == "error", 43200)


def audit_stats(spark, d):
    """Counts by type, by user and in all, in one pass of grouping sets."""
    e = _events(spark, d)
    e.createOrReplaceTempView("_audit_events")
    return spark.sql("SELECT event_type, user_id, count(*) AS n, count_if(event_type = 'error') AS errors FROM _audit_events GROUP BY GROUPING SETS ((event_type), (user_id), ())")


def audit_query(spark, d):
    """A conjunction of optional filters, case-insensitive substring on props only where there are any."""
    e = _events(spark, d).filter("event_type IN ('error', 'signup') AND user_id > 3 AND (props IS NULL OR contains(lower(props), '\"k\": 5'))")
    return e.orderBy(F.desc("ts"), "event_id").offset(5).limit(50).select("event_id", "ts", "user_id")


def dlq_retryable(spark, d):
    """Attempts below five whose back-off of min(2^attempts, 300) s has passed, by priority, then age."""
    e = _events(spark, d).filter("event_type = 'error'").select("event_id", "ts", (F.col("event_id") % 7).alias("attempts"), (F.col("user_id") % 3).alias("priority"))
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(300.0))
    return e.filter((F.col("attempts") < 5) & (L.micros(F.col("ts")) / 1e6 + wait <= F.lit((NOW - dt.datetime(1970, 1, 1)).total_seconds()))).select("event_id", "attempts", "priority", F.row_number().over(L.W.partitionBy("priority").orderBy("ts", "event_id")).cast("bigint").alias("place"))


def dlq_stats(spark, d):
    e = _events(spark, d).withColumn("attempts", F.col("event_id") % 7)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("attempts"), 6).alias("avg_attempts"))


def session_windows(spark, d):
    """Extension: activity sessions with a gap of six hours."""
    e = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start_ts"), "n")


def tumbling_windows(spark, d):
    """Extension: counts and sums per hour and type."""
    e = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (journal_scan, journal_partitions, journal_page, journal_bounds, journal_offsets, gap_detect, last_n, archive_split, snapshot_diff, replay_diff, order_mismatch, state_fold, checksum_verify, chain_verify, trailing_failures, message_rate, rate_limit, flush_groups, count_flush, upsert_latest, trace_corr, causal, audit_stats, audit_query, dlq_retryable, dlq_stats, session_windows, tumbling_windows)}

_DAY = "day_log AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS offset_ FROM events)"
_CHECK = "sha256(concat_ws('|', event_id::VARCHAR, {}))"
SQL = {
    "journal_scan": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND value > 10",
    "journal_partitions": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS by_day, strftime(ts, '%Y-%m-%d-%H') AS by_hour, strftime(ts, '%G-W%V') AS by_week, 'main' AS by_main FROM events",
    "journal_page": f"WITH {_DAY} SELECT day, offset_ AS \"offset\", event_id FROM day_log WHERE offset_ >= 10 AND offset_ < 35",
    "journal_bounds": f"WITH {_DAY} SELECT day, count(*) AS n, arg_min(ts, offset_) AS first_ts, arg_max(ts, offset_) AS last_ts FROM day_log GROUP BY day",
    "journal_offsets": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS \"offset\" FROM events",
    "gap_detect": "SELECT workflow_id, expected, version AS actual FROM (SELECT workflow_id, version, lag(version) OVER (PARTITION BY workflow_id ORDER BY version) + 1 AS expected FROM workflow_events) WHERE expected <> version",
    "last_n": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20",
    "archive_split": "SELECT user_id, count(*) AS archived, max(ts) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 50 GROUP BY user_id",
    "snapshot_diff": """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0)
SELECT k AS o_orderkey, 'added' AS change FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'removed' FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT a.k, 'modified' FROM a JOIN b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s""",
    "replay_diff": """WITH a AS (SELECT event_id AS k, event_type AS s FROM events WHERE event_id % 13 <> 0), b AS (SELECT event_id AS k, CASE WHEN event_id % 19 = 0 THEN 'x' ELSE event_type END AS s FROM events WHERE event_id % 17 <> 0)
SELECT k AS event_id, 'added' AS change FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'removed' FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT a.k, 'modified' FROM a JOIN b ON a.k = b.k WHERE a.s <> b.s""",
    "order_mismatch": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place_a, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id) AS place_b FROM events) WHERE place_a <> place_b",
    "state_fold": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "checksum_verify": "SELECT event_type, count(*) FILTER (event_id % 23 <> 0) AS valid, count(*) FILTER (event_id % 23 = 0) AS invalid FROM events GROUP BY event_type",
    "chain_verify": f"""WITH c AS (SELECT user_id, event_id, lag({_CHECK.format("event_type")}) OVER (PARTITION BY user_id ORDER BY event_id) AS want FROM events), p AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN 'forged' ELSE coalesce(want, '') END AS previous FROM c)
SELECT user_id, min(event_id) AS first_break, count(*) AS n_breaks FROM p WHERE previous <> coalesce(want, '') GROUP BY user_id""",
    "trailing_failures": "SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS trailing FROM events",
    "message_rate": """WITH t AS (SELECT event_type, max(ts) AS top FROM events GROUP BY 1), r AS (SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events JOIN t USING (event_type) WHERE ts >= top - INTERVAL 86400 SECOND GROUP BY 1)
SELECT event_type, n, round(CASE WHEN n >= 2 AND hi > lo THEN (n - 1) / ((hi - lo) / 1e6) ELSE 0 END, 6) AS rate FROM r""",
    "flush_groups": "SELECT user_id, flush, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS flush FROM events) GROUP BY 1, 2",
    "count_flush": "SELECT user_id, (o // 10)::BIGINT AS batch, count(*) AS n, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events) GROUP BY 1, 2",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "trace_corr": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND INTERVAL 59999999 MICROSECOND FOLLOWING) - 1 AS n_near FROM events",
    "causal": """WITH n AS (SELECT event_id, user_id, ts, min(CASE WHEN event_type = 'error' THEN (epoch_us(ts), event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM events),
x AS (SELECT event_id, s[2] AS symptom_id, (s[1] - epoch_us(ts)) / 1e6 AS far FROM n WHERE s IS NOT NULL)
SELECT event_id, symptom_id, round(CASE WHEN far < 1 THEN 0.4::DOUBLE * (1 - far) ELSE 0.2::DOUBLE END, 6) AS score FROM x WHERE far > 0 AND far <= 43200""",
    "audit_stats": "SELECT event_type, user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "audit_query": "SELECT event_id, ts, user_id FROM events WHERE event_type IN ('error', 'signup') AND user_id > 3 AND (props IS NULL OR contains(lower(props), '\"k\": 5')) ORDER BY ts DESC, event_id LIMIT 50 OFFSET 5",
    "dlq_retryable": "SELECT event_id, event_id % 7 AS attempts, user_id % 3 AS priority, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'error' AND event_id % 7 < 5 AND epoch_us(ts) / 1e6 + least(power(2.0, event_id % 7), 300.0) <= epoch(TIMESTAMP '2024-02-01')",
    "dlq_stats": "SELECT event_type, count(*) AS n, round(avg(event_id % 7), 6) AS avg_attempts FROM events GROUP BY event_type",
    "session_windows": """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM g GROUP BY user_id, s""",
    "tumbling_windows": "SELECT date_trunc('hour', ts) AS start_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
