"""Queries that run a stream over a whole table until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans.logs import SQL as _LOGS
from strandloom.streaming import ops as S


def stream_exactly_once(spark, d):
    e = S.exactly_once(S.read_table(spark, d, "events"), ["user_id", "event_type"], "ts", "60 days")
    return S.drained(e.select("user_id", "event_type"), "once")


def _events(spark, d, order="event_id"):
    """Events in five files, and a last one of no user long after, that closes windows and open batches."""
    closing = {"event_id": F.lit(-1), "ts": F.lit("2100-01-01 00:00:00"), "user_id": F.lit(-1), "event_type": F.lit("end")}
    return S.in_turns(spark, d, "events", order, 5, closing)


def stream_count_flush(spark, d):
    out = S.drained(S.count_flush(_events(spark, d), "user_id", "event_id", "event_type", 10, "ts", "60 days"), "flush")
    return out.filter("user_id >= 0")


def stream_rate_limit(spark, d):
    return S.drained(S.rate_limit(S.read_table(spark, d, "events"), "user_id", "ts", "event_id", 5, 3600 * 6), "limit")


def stream_windows(spark, d):
    """Counts and sums per hour and type, each once it is final."""
    w = S.drained(S.tumbling_counts(_events(spark, d, "ts"), "ts", "event_type", "value", "1 hour", "1 day"), "windows")
    return w.filter("event_type <> 'end'").select(F.col("start").alias("start_ts"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_exactly_once, stream_count_flush, stream_rate_limit, stream_windows)}
SQL = {
    "stream_exactly_once": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_count_flush": "SELECT user_id, (o // 10)::BIGINT AS batch, count(*) AS n, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events) GROUP BY 1, 2",
    "stream_windows": _LOGS["tumbling_windows"],
}
