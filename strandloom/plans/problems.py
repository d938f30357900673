"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators.activities import current_activities
from strandloom.operators.intervals import target_periods
from strandloom.operators.references import orphans
from strandloom.operators.schema_drift import schema_changes, unified_payloads
from strandloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "workflow_events"))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads as one table, one row per delivered readable event."""
    return unified_payloads(table(spark, sf_dir, "workflow_events"), ["ingest_id", "feed", "file_no", "workflow_id", "version", "schema_version", "event_type"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*(table(spark, sf_dir, t) for t in ("sessions", "threads", "file_index_state", "file_dependencies")))


def p2_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, reason and month."""
    return p2_found(spark, sf_dir).groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_references"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_periods(table(spark, sf_dir, "flash_transactions"))


def p3_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy and idle time of each target."""
    length = F.col("end_ms") - F.col("start_ms")
    return p3_found(spark, sf_dir).groupBy("target_name").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("busy_ms"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("idle_ms"),
        F.max(F.when(F.col("kind") == "gap", length)).alias("longest_gap_ms"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_activities(table(spark, sf_dir, "workflow_events"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p2_found, p2_by_period, p3_found, p3_by_target, p5_found)}


def _ms(column: str) -> str:
    """Epoch milliseconds of a time in any of the notations."""
    shape = "^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})[T ](\\d{1,2}:\\d{2}:\\d{2}(?:\\.\\d{1,9})?)\\s*(?:Z|([+-])(\\d{2}):?(\\d{2}))?$"
    part = [f"regexp_extract(trim({column}), '{shape}', {k})" for k in range(8)]
    base = f"epoch_ms(try_cast({part[1]} || '-' || {part[2]} || '-' || {part[3]} || ' ' || {part[4]} AS TIMESTAMP))"
    shift = f"CASE WHEN {part[5]} = '' THEN 0 ELSE (CASE {part[5]} WHEN '-' THEN -1 ELSE 1 END) * ({part[6]}::INT * 60 + {part[7]}::INT) * 60000 END"
    digits = f"try_cast(trim({column}) AS BIGINT)"
    return f"CASE WHEN regexp_full_match(trim({column}), '\\d{{1,17}}') THEN CASE WHEN {digits} <= 100000000000 THEN {digits} * 1000 ELSE {digits} END WHEN {part[0]} <> '' THEN {base} - {shift} END"


_SPANS = f"""spans AS (SELECT * FROM (SELECT regexp_replace(lower(trim(target_name)), '[\\s_]', '-', 'g') AS target_name, {_ms("started_at")} AS s, {_ms("completed_at")} AS e FROM flash_transactions)
  WHERE target_name <> '' AND e > s AND s < 4133980800000 AND e < 4133980800000),
marked AS (SELECT *, max(e) OVER (PARTITION BY target_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY target_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
periods AS (SELECT target_name, min(s) AS s, max(e) AS e FROM numbered GROUP BY target_name, k),
found3 AS (SELECT target_name, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods UNION ALL
  SELECT * FROM (SELECT target_name, 'gap', lag(e) OVER (PARTITION BY target_name ORDER BY s) AS p, s FROM periods) WHERE p IS NOT NULL)"""
#: '..' steps back over the folder before it; once is enough for these tables.
_PATH = "regexp_replace(regexp_replace(regexp_replace(replace({}, '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g')"
_ORPHANS = f"""ses AS (SELECT lower(trim(id)) AS k, {_ms("created_at")} AS made, {_ms("updated_at")} AS moment, coalesce(lower(trim(status)) = 'deleted', false) AS gone FROM sessions WHERE id IS NOT NULL),
born AS (SELECT k, min(made) AS made FROM ses GROUP BY k), steps AS (SELECT k, moment, bool_and(gone) AS gone FROM ses WHERE moment IS NOT NULL GROUP BY k, moment),
thr AS (SELECT DISTINCT id, lower(trim(session_id)) AS k, {_ms("created_at")} AS t FROM threads WHERE trim(session_id) <> ''),
was AS (SELECT thr.id, thr.k, thr.t, born.k IS NULL AS missing, any_value(born.made) AS made, arg_max(steps.gone, steps.moment) AS gone FROM thr LEFT JOIN born ON thr.k = born.k LEFT JOIN steps ON thr.k = steps.k AND steps.moment <= thr.t GROUP BY ALL),
paths AS (SELECT {_PATH.format("path")} AS k, indexed_at AS a, deleted_at AS b FROM file_index_state WHERE path IS NOT NULL),
dep AS (SELECT DISTINCT dep_id, {_PATH.format("target_path")} AS k, CASE WHEN recorded_at > 1e11 THEN recorded_at / 1000 ELSE recorded_at END AS t FROM file_dependencies WHERE coalesce(lower(trim(dep_type)), '') <> 'system' AND trim(target_path) <> ''),
there AS (SELECT dep_id, dep.k, t, count(paths.k) = 0 AS missing, count(*) FILTER (coalesce(a, -1e18) <= t AND coalesce(b, 1e18) > t) > 0 AS alive, min(coalesce(a, -1e18)) AS first_at FROM dep LEFT JOIN paths ON dep.k = paths.k GROUP BY 1, 2, 3),
found2 AS (SELECT DISTINCT ref_table, record_key, reason, coalesce(strftime(make_timestamp((t * 1000000)::BIGINT), '%Y-%m'), 'unknown') AS period FROM (
  SELECT 'threads' AS ref_table, id AS record_key, t / 1000 AS t, CASE WHEN missing THEN 'missing' WHEN t IS NULL THEN NULL WHEN t < made THEN 'late' WHEN gone THEN 'deleted' END AS reason FROM was
  UNION ALL SELECT 'file_dependencies', dep_id::VARCHAR, t, CASE WHEN missing THEN 'missing' WHEN t IS NULL OR alive THEN NULL WHEN t < first_at THEN 'late' ELSE 'deleted' END FROM there) WHERE reason IS NOT NULL)"""
SQL = {
    "p2_found": f"WITH {_ORPHANS} SELECT * FROM found2",
    "p2_by_period": f"WITH {_ORPHANS} SELECT ref_table, period, reason, count(*) AS n_references FROM found2 GROUP BY 1, 2, 3",
    "p3_found": f"WITH {_SPANS} SELECT * FROM found3",
    "p3_by_target": f"""WITH {_SPANS} SELECT target_name, count(*) FILTER (kind = 'period') AS n_periods, (sum(end_ms - start_ms) FILTER (kind = 'period'))::BIGINT AS busy_ms, coalesce(sum(end_ms - start_ms) FILTER (kind = 'gap'), 0)::BIGINT AS idle_ms, max(end_ms - start_ms) FILTER (kind = 'gap') AS longest_gap_ms FROM found3 GROUP BY target_name""",
}
